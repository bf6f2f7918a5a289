"""The corpus operators against brute force on small tables with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import itertools
import json
import math
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import _tiles, ann, bpe, embedding_dedup, html_text, lm, mixing, ngram_join, quality, queries, url_filter, warc
from verdigris.llm import _textvec as tv
from verdigris.llm._shared import connected_components
from verdigris.llm._tiles import runs

WORD = re.compile("[^\x20\x09-\x0d]+")
RNG = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(400)]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def texts():
    """Copies, near copies, short, empty, null, long and odd ones."""
    rng = random.Random(11)
    base = [prose(n, rng) for n in (3, 5, 6, 20, 60, 61, 150, 400)]
    out = [None, "", "  \t\n", "one", "Two words", "a b c d e", "A B C D E", *base, *base[3:]]
    for text in base[3:]:
        words = text.split()
        for changes in (1, 2, 4, 8, 16):
            copy = list(words)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = rng.choice(VOCABULARY)
            out.append(" ".join(copy))
    shared = prose(70, rng)
    out += [f"{prose(40, rng)} {shared} {prose(40, rng)}" for _ in range(6)]
    out += ["é" * 50 + " naïve\u0301 ÀÉ <|endoftext|> x's I'LL 1234 !!!", "x" * 30_000, "tab\tand\x0bvt\x0cff\rcr", "日本語 のテキスト です ね よ", prose(5000, rng)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 4}" if i % 7 else None, 1, "clash") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, size int, key string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def components(n, links):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 202), (202, 200), (7, 7)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = dict(connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    want = components(500, edges)
    assert got == {x: want[x] for x in {x for e in edges if e[0] != e[1] for x in e}}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_words_and_hashes():
    import pyarrow as pa

    for _, _, data, offsets in tv.text_slices(pa.array(texts(), pa.string())):
        low, starts, ends, first = tv.words(data, offsets)
        got = [[bytes(low[s:e]).decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [WORD.findall(lowered(t)) for t in texts()]
    hashes = tv.word_hashes(low, starts, ends)
    by_word = {}
    for w, h in zip(itertools.chain(*got), hashes.tolist(), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_runs_keep_tiles_whole():
    import pyarrow as pa

    keys = sorted(RNG.choices(range(9), k=100))
    batches = [pa.RecordBatch.from_pydict({"k": pa.array(keys[i : i + 7], pa.int64())}) for i in range(0, 100, 7)]
    out = [b.column(0).to_pylist() for b in runs(iter(batches), 1)]
    assert list(itertools.chain(*out)) == keys and all(a[-1] != b[0] for a, b in itertools.pairwise(out))


def vectors():
    rng = np.random.default_rng(3)
    out = []
    for center in range(12):
        c = rng.normal(size=16)
        for spread in (0, 0, 0.01, 0.03, 0.05, 0.06, 0.3):
            out.append((c + spread * rng.normal(size=16)).tolist())
    big = rng.normal(size=16)
    out += [(big + 0.035 * rng.normal(size=16)).tolist() for _ in range(60)]
    rows = [(i, v, 1 if i % 11 == 0 else 2) for i, v in enumerate(out)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [float("nan")] + [1.0] * 15, 1), (n + 4, [None] + [1.0] * 15, 1), (n + 5, out[0], None), (n + 6, [2 * x for x in out[0]], 1), (n + 7, [1.0, 2.0], 1), (n + 8, [float("inf")] * 16, 2)]
    return rows


@pytest.mark.parametrize("tile", [512, 16])
def test_near_duplicates(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rows = vectors()
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) and lab is not None for _, v, lab in rows]
    links = []
    for a, b in itertools.combinations(range(len(rows)), 2):
        if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
            x, y = np.array(rows[a][1]), np.array(rows[b][1])
            if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                links.append((a, b))
    assert len(links) > 500
    counts, comp = np.bincount(np.array(links).ravel(), minlength=len(rows)), components(len(rows), links)
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("key", F.lit("clash"))
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame).collect()}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (counts[i], comp[i], comp[i] == i) for i in range(len(rows))}
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_a_tile_of_several_widths_keeps_all_links(spark):
    """As a collision of bucket keys would make it."""
    rows = []
    for i, (width, turn) in enumerate([(4, 0), (6, 0), (4, 1), (6, 1), (4, 50), (5, 0)]):
        vec = np.ones(width)
        vec[0] += turn / 100
        rows.append((1, 0, 0, i, vec.tobytes(), [1, 2, 3, 4], 1, 0))
    frame = spark.createDataFrame(rows, "key bigint, t1 int, t2 int, cls bigint, vec binary, keys array<bigint>, m bigint, chunk int")
    found = embedding_dedup.links_in_tiles(frame, 0.98, 4).collect()
    assert {(r.a, r.b) for r in found if r.b is not None} == {(0, 2), (1, 3)} or {r.a: r.n for r in found if r.b is None} == {0: 2, 2: 2, 4: 2, 1: 1, 3: 1}


def test_hash_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(20_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * side
    label = np.ones(len(a), np.int64)
    x, y = embedding_dedup.buckets(a, label), embedding_dedup.buckets(b, label)
    shared = np.zeros(len(a), bool)
    for c in range(x.shape[1]):
        shared |= (y == x[:, c : c + 1]).any(1)
    assert (~shared).sum() <= 1


def test_hadamard():
    x = np.random.default_rng(0).normal(size=(3, 8))
    h = embedding_dedup.hadamard(np.eye(8))
    assert np.allclose(h @ h.T, np.eye(8)) and np.allclose(embedding_dedup.hadamard(x), x @ h)


def test_bpe(spark, docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.encode_documents(docs, path).collect()}
    assert len(got) == len(texts())
    for i, t in enumerate(texts()):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(empty, path).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_of_odd_texts(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path(name))
    library, codec = Tokenizer.from_file(path), bpe.ChunkCodec(path, fine_entries=50, coarse_entries=4)
    rng = random.Random(8)
    alphabet = "ab cé\u0301\n\t's1!  \u00a0\u2003Σσ<|endoftext|>日"
    for _ in range(150):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) + prose(rng.randrange(600), rng)
        ids = library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ids, t
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_buffers_of_many_texts(name, monkeypatch):
    """Chunks that texts of a buffer share, white space alone, marks of our own, caches that turn over, joins that must be repaired."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path(name))
    monkeypatch.setattr(bpe, "COARSE_MASK", 1)
    library, codec = Tokenizer.from_file(path), bpe.ChunkCodec(path, fine_entries=40, coarse_entries=6)
    rng = random.Random(4)
    shared = prose(40, rng)
    many = ["", " ", " \n\t ", "a\x01b \x01 c", "</w> x</w>y", "İ ﬁ e\u0301 \u0301", *(f"{prose(rng.randrange(9), rng)}  {shared}\n{'é!? ' * rng.randrange(4)}" for _ in range(60))]
    for _ in range(2):
        raw = [t.encode() for t in many]
        got = codec.encode_slice(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
        for t, code in zip(many, got, strict=True):
            want = library.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(code, np.int32).tolist() == want, t
            assert codec.numbers(want).decode() == " ".join(map(str, want))
            assert codec.decoded(want).decode() == library.decode(want, skip_special_tokens=False)
        rng.shuffle(many)


def test_a_worker_keeps_the_codec_until_another_operator_comes():
    path = queries.tokenizer_path()
    first = bpe._codec(path)
    assert bpe._codec(path) is first
    tv.kept("quality")["model"] = 1
    assert "bpe" not in tv._kept and tv.kept("quality") == {"model": 1}
    assert bpe._codec(path) is not first and tv._kept.keys() == {"bpe"}


def shingles(text):
    w = WORD.findall(lowered(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_join(all_texts):
    sets = [shingles(t) for t in all_texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, components(len(sets), links)


@pytest.mark.parametrize(("small", "tile", "blocks", "hot"), [(12, 1024, 42, 10**6), (2, 4, 10**9, 10**6), (12, 1024, 42, 3), (12, 1024, 0, 10**6), (2, 16, 1, 3)])
def test_jaccard_join(docs, empty, monkeypatch, small, tile, blocks, hot):
    monkeypatch.setattr(_tiles, "HOT", hot)
    monkeypatch.setattr(_tiles, "SHARE", 1)
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "TILE", tile)
    sets, comp = brute_join(texts())
    assert len(set(comp)) < len(comp) - 15
    got = {r.doc_id: r for r in ngram_join.jaccard_join(docs, first_blocks=blocks).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), comp[i]) for i in range(len(sets))}
    assert ngram_join.jaccard_join(empty).count() == 0


def test_large_groups_with_a_hub(spark, monkeypatch):
    """Copies that link with their original only, in buckets that are cut into tiles."""
    monkeypatch.setattr(ngram_join, "TILE", 8)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    rows = [" ".join(base)]
    for k in range(40):
        copy = list(base)
        for j in rng.sample(range(300), 6):
            copy[j] = f"x{k}-{j}"
        rows.append(" ".join(copy))
    order = rng.sample(range(len(rows)), len(rows))
    _, comp = brute_join([rows[i] for i in order])
    frame = spark.createDataFrame([(n, rows[i]) for n, i in enumerate(order)], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_join(frame).collect()} == dict(enumerate(comp))


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(6)
    edges = ngram_join.band_edges(0.8)
    for n in (5, 40, 300, 2000):
        a = np.unique(rng.integers(1, 1 << 62, n, dtype=np.uint64))
        cut = int(ngram_join.most_apart(n, 0.8)) // 2
        b = np.unique(np.concatenate([a[cut:], rng.integers(1, 1 << 62, cut, dtype=np.uint64)]))
        (ka, _, sa), (kb, _, sb) = (ngram_join.sketch_one(x, edges, 0.8, 10**9) for x in (a, b))
        assert np.bitwise_count(np.frombuffer(sa, np.uint8) ^ np.frombuffer(sb, np.uint8)).sum() <= len(np.setxor1d(a, b))
        assert set(ka.tolist()) & set(kb.tolist())


@pytest.mark.parametrize("blocks", [42, 0, 10**9])
def test_all_links_of_small_sets_share_a_key(blocks):
    rng = np.random.default_rng(9)
    edges = ngram_join.band_edges(0.8)
    for a in range(4, 41):
        for b in range(a, a * 5 // 4 + 1):
            common = -(-80 * (a + b) // 180)  # the fewest in common that link them
            for _ in range(60):
                every = rng.integers(1, 1 << 62, a + b - common, dtype=np.uint64)
                ka, kb = (set(np.concatenate(ngram_join.sketch_one(np.unique(x), edges, 0.8, blocks)[:2]).tolist()) for x in (every[:a], every[a - common :]))
                assert ka & kb, (a, b)


def test_one_of_each(spark, docs):
    _, comp = brute_join(texts())
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(comp))
    twice = docs.union(docs.where("doc_id in (8, 12)"))
    assert sorted(r.doc_id for r in ngram_join.one_of_each(twice).collect()) == sorted(set(comp))


def test_mixing(spark, docs, empty):
    rows = {r.doc_id: r for r in mixing.mix(docs, block_tokens=4, shard_tokens=300).collect()}
    sizes = {i: len(WORD.findall(t or "")) for i, t in enumerate(texts())}
    assert {i: r["size"] for i, r in rows.items()} == sizes
    sources = {}
    for r in rows.values():
        s = sources.setdefault(r.source, [0, 0, r.target])
        s[0] += r["size"]
        s[1] += r.taken
        assert r.taken <= 2 * r["size"] and r.target == s[2]
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(s[0] for s in sources.values()), set(order), {}
    while True:  # the rule as it is told: what is above a cap is dealt again
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sources[s][0]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sources[s][0]
            left -= target[s]
            open_.discard(s)
    for s in order:
        assert sources[s][2] == pytest.approx(target[s]) and abs(sources[s][1] - target[s]) <= 60
    assert {i: r.taken for i, r in rows.items()} == {r.doc_id: r.taken for r in mixing.mix(docs.repartition(5), block_tokens=4, shard_tokens=300).collect()}
    assert mixing.mix(empty).count() == 0


def test_mix_takes_what_it_says(docs):
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
    assert words == {i: t for i, t in taken.items() if t}


def test_sainte_lague_by_highest_quotients(spark):
    """Caps that bind for all, some or no parts, ties, zeros, seats for none and for more than all."""
    rng = random.Random(3)
    rows, want = [], {}
    for case in range(200):
        values = [rng.choice([0, 1, 5, 5, 10, 100, rng.randrange(1000)]) for _ in range(rng.randrange(1, 9))]
        most = rng.choice([[1000] * len(values), [rng.randrange(30) for _ in values], [max(1, 2 * v // 3) for v in values]])
        seats = rng.randrange(80)
        quotients = sorted((-(v / (2 * k + 1)), i, k) for i, v in enumerate(values) if v for k in range(min(most[i], 80)))
        given = [i for _, i, _ in quotients[:seats]]
        for i, (v, m) in enumerate(zip(values, most, strict=True)):
            rows.append((case, i, v, m, seats))
            want[case, i] = given.count(i)
    frame = spark.createDataFrame(rows, "g int, part int, v bigint, m bigint, seats bigint")
    got = {(r.g, r.part): r.quota for r in mixing.sainte_lague(frame, ["g"], F.col("seats"), "v", "m").collect()}
    assert got == want
    tied = spark.createDataFrame([(1, 1, 5, 9), (1, 0, 5, 9)], "g int, part int, v bigint, m bigint")
    assert {r.part: r.quota for r in mixing.sainte_lague(tied, ["g"], F.lit(1).cast("bigint"), "v", "m").collect()} == {0: 1, 1: 0}


@pytest.mark.parametrize("copies", [1, 9])
def test_mixing_against_sql_that_ranks_every_quotient(docs, copies):
    """Odd rows: null texts, sources and ids, repeated rows."""
    import duckdb

    table = docs.withColumn("doc_id", F.when(F.col("doc_id") % 11 != 3, F.col("doc_id"))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("copy")
    got = mixing.mix(table).select("doc_id", "size", "source_size", "target", "taken").collect()
    documents = table.toArrow()  # noqa: F841  read by name
    con = duckdb.connect()
    con.register("documents", documents)
    found = con.execute(queries.ORACLE_SQL["op4_source_mixing"]).fetchall()
    order = lambda rows: sorted(map(str, (tuple(r) for r in rows)))
    assert order(got) == order(found) and len(got) == copies * len(texts())


def judge_url(url):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url[at + 3 :]).groups()
    host = lowered(host)
    best = None
    for verdict, rule in url_filter.RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_urls(spark):
    urls = [None, "", "nothing", "http://", "HTTP://Example.ORG/es/1?x", "https://a.example.org/en/12", "http://org/", "http://borg/", "http://x.com/de/1#a", "http://x.com/fr/", "http://com", "a://b://c/d", "http://EXAMPLE.org?q=/es/", "http://x.org/\n/y", "http://h.net/a/b/c/d/e/f"]
    urls += [f"http://spam.net/buy/{i}" for i in range(60)] + [f"http://spam.net/news/{i}" for i in range(60)]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id bigint, url string, p string")
    labels = spark.createDataFrame([(i, int("/buy/" in (u or ""))) for i, u in enumerate(urls) if u and "spam" in u and i % 2], "page_id bigint, bad int")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, labels).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, best = judge_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best[1] if best else None)
        if best:
            assert got[i].verdict == best[0]
        elif u and "spam" in u:
            assert got[i].verdict == ("block" if "/buy/" in u else "allow")
    assert url_filter.filter_urls(pages.limit(0), labels).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, labels.limit(0)).where("rule is null").collect()} == {"allow"}


def test_quality(spark, docs, empty):
    rng = random.Random(1)
    good = [(i, prose(rng.randrange(5, 80), rng)) for i in range(200)]
    bad = [(200 + i, " ".join(f"{w}{rng.choice('#*%')*3}" for w in prose(rng.randrange(5, 80), rng).split())) for i in range(60)]
    rows = spark.createDataFrame(good + bad, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(260)] + [(999, 1), (3, None)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.classify(rows, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].predicted == int(i < 200) for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert quality.classify(docs, labels).count() == len(texts()) and quality.classify(empty, labels).count() == 0
    assert {r.score for r in quality.classify(rows, labels.where("quality = 1")).collect()} != set()


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(2)
    rows = quality.Features.of([np.unique(np.concatenate([rng.integers(10, 60, 8), [g]])).astype(np.int32) for g in (0, 1) * 100])
    good = np.array([False, True] * 100)
    ratio = quality.log_ratio(rows, good)
    weight, bias = quality.descend(rows, ratio, np.where(good, 1, -1))
    assert (np.array([weight[r].sum() / np.sqrt(len(r)) + bias > 0 for r in rows]) == good).mean() == 1.0


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b<br>c", "a\n\nb\nc"),
        ("<div>a</div><div>b</div>", "a\nb"),
        ("<title>t</title><script>if (a<b) x('</p>')</script><style>p{}</style><p>seen", "seen"),
        ("<p hidden>x</p><p style='display: none'>y</p><p aria-hidden=true>z</p><p>seen <!-- no --> here</p>", "seen here"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"),
        ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"),
        ("<table><tr><th>name<th>n<tr><td>longer name<td>7</table>", "name         n\nlonger name  7"),
        ("<table><tr><td colspan=2>wide<td>x<tr><td>a<td>b<td>c</table>", "wide  x\na  b  c"),
        ("<pre>a\n  b</pre>", "a\n  b"),
        ("a < b <i>c</i></nothing>", "a < b c"),
        ("<p>one</div> two", "one two"),
        ("<h1>t</h1>x<blockquote>q</blockquote>", "t\n\nx\n\n  q"),
        ("<p>unclosed <a href='x", "unclosed <a href='x"),
        ("<head><title>no</title><body>yes", "yes"),
        ("<img alt='pic'> <input type=hidden value=no>", "pic"),
    ],
)
def test_html(html, text):
    assert html_text.render(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("a <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math> b", "a x=1 b"),
        ("<svg><title>no</title><rect/><text>seen</text><g><text>too</text></g></svg> b", "seen too b"),
        ("<select><option>a<option selected>b<option>c</select>", "b"),
        ("<select><option disabled>a<option>b</select>", "b"),
        ("<select multiple><option>a<option>b</select>", "a\nb"),
        ("<dialog open>seen</dialog><dialog>not</dialog>", "seen"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td><b><i><u><s><em><q><b>x<td>y<tr><td>z<td>w</table>", "x  y\nz  w"),
        ("<table><tr><td><ul><li>x<td>y</table>", "- x  y"),
        ("<p><b><i><u><s><em><q><b><i><u>x<div>y</div>", "x\n\ny"),
    ],
)
def test_html_of_all_visible_text(html, text):
    assert html_text.render(html) == text


def naive_text(source):
    """The words that a plain recursive walk over the tree finds visible, in the order of the page; tables and selects aside."""
    out = []

    def walk(node, veiled):
        for child in node.children:
            if isinstance(child, str):
                out.extend([] if veiled else child.split())
            elif not child.hidden:
                style = child.attributes.get("style", "")
                walk(child, False if "visible" in style else True if "visibility" in style else veiled)

    walk(html_text.parse(source), False)
    return out


def test_html_words_of_random_pages():
    rng = random.Random(3)
    pieces = ["<div>", "</div>", "<p>", "</p>", "<b>", "</b>", "<span style='visibility:hidden'>", "<span style='visibility:visible'>", "</span>", "<i hidden>", "</i>", "<blockquote>", "</blockquote>", "<table>", "<tr>", "<td>", "<td rowspan=2>", "<td colspan=3>", "</table>", "<script>x</script>", "<!-- c -->", "<br>", "<", "<a title='>'>", "</a>"]
    for _ in range(400):
        source = " ".join(rng.choice(pieces) if rng.random() < 0.5 else f"w{i}" for i in range(rng.randrange(60)))
        got = html_text.render(source).split()
        assert sorted(got) == sorted(naive_text(source)), source
        if "<table>" not in source:
            assert got == naive_text(source), source


@pytest.mark.parametrize("piece", ["<b ", "<b x", "<a '", "<a \"'", "</script ", "<li>", "<table><tr><td>", "<ul><li>x", "<tr><td rowspan=9 colspan=1000>x", "<p>", "<!--", "<div></x>"])
def test_html_takes_time_as_pages_grow(piece):
    began = time.process_time()
    text = html_text.render("<table>" * ("rowspan" in piece) + piece * (400_000 // len(piece)) + "\">")
    assert time.process_time() - began < 20 and len(text) < 100 * 400_000


def test_html_of_deep_and_odd_pages(spark):
    assert html_text.render("<div>" * 5000 + "x") == "x"
    assert "x" in html_text.render("<table><tr><td>" * 60 + "x")
    rng = random.Random(7)
    parts = ["<p>", "</p>", "<li>", "<table>", "<tr>", "<td>", "</table>", "x", " ", "&lt;", "<", ">", "<b", "='", "<!--", "-->", "<ul>", "</ul>", "<script>", "</script>", "\n", "<pre>"]
    for _ in range(300):
        html_text.render("".join(rng.choice(parts) for _ in range(60)))
    pages = spark.createDataFrame([(1, None, "c"), (1, "<p>a", "c"), (2, "<p>a", "c")], "page_id bigint, html string, text string")
    assert sorted(r.text for r in html_text.extract_text(pages).collect()) == ["", "a", "a"]
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    import zstandard

    long = "<p>" + "long page " * 40
    rows = [(5, "u5", long), (2, "u2", long), (2, "u2b", long), (9, None, long), (1, "u1", "short"), (3, "u\r\n3", "short"), (4, "u4", None), (6, "u6", ""), (None, "un", long), (7, "u7", "é" * 60)]
    rows += [(100 + i, f"u{i}", f"<html><body>{prose(60)}</body></html>") for i in range(80)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, digest string").repartition(3)
    archives = warc.write_warc(pages, folder=f"file://{tmp_path}/w")
    files = archives.collect()
    assert sum(r.records for r in files) == len(rows)
    got = warc.read_warc(archives).collect()
    want = []
    seen = set()
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        again = len(data) >= 100 and digest in seen
        seen.add(digest)
        want.append((page, len(data), digest, "revisit" if again else "response", 2 if again else None))
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=key) == sorted(want, key=key)
    payload = {r.page_id: r.payload for r in got if r.record_type == "response"}
    assert bytes(payload[2]).decode() == long and bytes(payload[4]) == b""
    raw = open(files[0].archive.removeprefix("file://"), "rb").read()
    assert raw[:4] == (0x184D2A5D).to_bytes(4, "little") and zstandard.MAGIC_NUMBER.to_bytes(4, "little") in raw
    assert warc.write_warc(pages.limit(0), folder=f"file://{tmp_path}/e").count() == 0


def test_every_archive_has_a_dictionary(spark):
    for n in (1, 2, 30):
        writer = warc.ArchiveWriter()
        for i in range(n):
            writer.add(warc.Record("response", {"WARC-Record-ID": f"<urn:{i}>"}, b"<p>the same page again</p>" * 3))
        raw = writer.to_bytes()
        assert int.from_bytes(raw[4:8], "little") > 100
        assert [r.payload for r in warc.read_archive(raw)] == [b"<p>the same page again</p>" * 3] * n


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("page_id"), F.lit("http://x/").alias("url"), F.repeat(F.col("id").cast("string"), 200).alias("html"))
    written = warc.write_warc(rows.repartition(4), folder=str(tmp_path / "w"), archive_bytes=1000)
    back = warc.read_warc(written)
    assert written.count() > 4 and back.rdd.getNumPartitions() == written.count()
    assert back.count() == 40 and {r.payload_bytes for r in back.collect()} == {200, 400}


def test_warc_dictionary_helps_and_damage_is_found():
    writer = warc.ArchiveWriter()
    for i in range(300):
        writer.add(warc.Record("response", {"WARC-Page-ID": str(i), "WARC-Target-URI": f"http://h/{i}", "WARC-Payload-Digest": "sha256:x", "WARC-Payload-Length": "1"}, f"<html><head><title>Page {i}</title></head><body>{prose(20)}</body></html>".encode()))
    raw = writer.to_bytes()
    assert int.from_bytes(raw[4:8], "little") > 0
    records = list(warc.read_archive(raw))
    assert len(records) == 300 and records[7].headers["WARC-Page-ID"] == "7"
    with pytest.raises(Exception):
        list(warc.read_archive(raw[:-3]))


def test_nearest(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 24))
    x[300:600] = x[299]  # a third is alike
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    rows += [(901, None, "c"), (920, [float("nan")] * 24, "c"), (940, [0.0] * 24, "c"), (960, [None] * 24, "c"), (None, x[0].tolist(), "c"), (3, x[3].tolist(), "c")]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, list string")
    got = {}
    for r in ann.search(frame, list_rows=40).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 20))
    found = 0
    for q, hits in got.items():
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, 21))
        score = x @ x[q]
        assert all(h[2] == pytest.approx(score[h[1]], abs=1e-12) for h in hits) and [(-h[2], h[1]) for h in hits] == sorted((-h[2], h[1]) for h in hits)
        score[q] = -np.inf
        best = np.lexsort((np.arange(900), -np.round(score, 12)))[:20]
        found += len(set(best.tolist()) & {h[1] for h in hits})
    assert found >= 0.9 * 20 * len(got)
    few = ann.search(frame.where("vec_id in (0, 1, 2)")).collect()
    assert len(few) == 2 and ann.search(frame.limit(0)).count() == 0


def test_graph_search_finds_the_nearest():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 16))
    fitted = ann.Centroids.fit(x, 100, float(np.linalg.norm(x, axis=1).max()))
    rows = ann.lift(x[:300], fitted.top)
    order, _ = fitted.search(rows, 4)
    exact = np.argsort(ann.squared(rows, fitted.points), axis=1)[:, :4]
    assert np.mean([len(set(a) & set(b)) / 4 for a, b in zip(order, exact, strict=True)]) > 0.95


def test_fitting_and_searching_hold_blocks_only():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(8192, 8))
    fitted = ann.Centroids.fit(x, 1024, float(np.linalg.norm(x, axis=1).max()))
    tracemalloc.start()
    try:
        fitted.calibrate(x, 20)
        place = fitted.assign(x)
        assert tracemalloc.get_traced_memory()[1] < 80e6  # a matrix of all rows by all centroids alone is 67 MB, and there were several
    finally:
        tracemalloc.stop()
    exact = ann.nearest(ann.lift(x, fitted.top), fitted.points)
    assert np.mean(place[:, 0] == exact) > 0.95 and fitted.visited < 1024
    wide, near = fitted.search(fitted.aim(x[:40]), 4 * ann.WIDTH)  # several centroids are expanded in a step
    best = np.sort(ann.squared(fitted.aim(x[:40]), fitted.points), axis=1)[:, 4 * ann.WIDTH - 1 :][:, :1]
    assert (near <= best + 1e-9).mean() > 0.9 and all(len(set(w)) == len(w) for w in wide.tolist())


def test_nearest_sends_no_sample_to_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 12))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    whole = {tuple(r) for r in ann.search(frame, list_rows=100).collect()}

    def refuse(*_args, **_more):
        raise AssertionError("fitted on the driver")

    monkeypatch.setattr(ann.Centroids, "fit", refuse)
    monkeypatch.setattr(type(frame), "toArrow", refuse)
    assert {tuple(r) for r in ann.search(frame, list_rows=100).collect()} == whole and len(whole) == 75 * 20
    monkeypatch.setattr(ann, "PART_ROWS", 64)  # nearly every list is cut, as in a large table
    monkeypatch.setattr(ann, "QUERY_ROWS", 8)
    monkeypatch.setattr(F, "create_map", refuse)  # the pieces of lists are no part of the plan
    assert {tuple(r) for r in ann.search(frame, list_rows=100).collect()} == whole


def brute_ppm(train, text, order, escape):
    """PPM with exclusion, symbol by symbol."""
    counts = {}
    stream = lambda t: " ".join(WORD.findall(lowered(t))).encode() + b"\n"
    for t in train:
        s = b"\n" * order + stream(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                c = counts.setdefault(s[i - k : i], {})
                c[s[i]] = c.get(s[i], 0) + 1
    total = 0.0
    s = b"\n" * order + stream(text)
    for i in range(order, len(s)):
        out = set()
        for k in range(order, -1, -1):
            c = counts.get(s[i - k : i])
            if c is None:
                continue
            left = {b: n for b, n in c.items() if b not in out}
            out |= set(c)
            if not left:
                continue
            weight = sum(left.values()) + escape * len(left)
            if s[i] in left:
                total += math.log10(left[s[i]] / weight)
                break
            total += math.log10(escape * len(left) / weight)
        else:
            total -= math.log10(256 - len(out))
    return total


def judged_urls(spark, urls):
    """(url, verdict) of urls whose labels say that /spam/ is bad; every second page has one."""
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    labels = spark.createDataFrame([(i, int("/spam" in u)) for i, u in enumerate(urls) if i % 2], "page_id bigint, bad int")
    return [(urls[r.page_id], r.verdict) for r in url_filter.filter_urls(pages, labels).collect()]


def brute_tree(rows, max_children=50, z=1.96, smoothing=10.0):
    """{(host, template): share} by plain recursion over rows (host, template, bad)."""
    out = {}
    labelled = [b for _, _, b in rows if b is not None]
    if not labelled:
        return {(h, t): None for h, t, _ in rows}
    everywhere = (sum(labelled) + 1) / (len(labelled) + 2)

    def counts(some):
        known = [b for _, b in some if b is not None]
        return len(known), sum(known)

    def walk(host, some, depth, p):
        """some: (template, bad) below one node"""
        n, k = counts(some)
        for t, _ in some:
            out[host, t] = p
        open_ones = [(t, b) for t, b in some if len(t.split("/")) >= depth] if 0 < k < n else []
        children = {}
        for t, b in open_ones:
            segments = t.split("/")
            children.setdefault(segments[depth] if depth < len(segments) else "", []).append((t, b))
        total = [x for c in children.values() for x in c]
        share = (counts(total)[1] + 1) / (counts(total)[0] + 2)

        def own(c):
            n, k = counts(c)
            return n > 0 and abs(k - n * share) - 0.5 > z * math.sqrt(n * share * (1 - share))

        grouped = {}
        for name, c in children.items():
            grouped.setdefault(name if len(children) <= max_children or name == "" or own(c) else "*", []).extend(c)
        sides = {-1: [], 1: []}
        for name, c in grouped.items():
            n, k = counts(c)
            if n and abs(k / n - p) > z * math.sqrt(p * (1 - p) / n):
                sides[1 if k / n > p else -1].append((k / n, name, n, k))
        estimate = {}
        for side in sides.values():
            branches = []
            for own_share, name, n, k in sorted(side):
                if branches:
                    _, n0, k0 = branches[-1][-1]
                    pooled = (k + k0) / (n + n0)
                if branches and abs(k / n - k0 / n0) <= z * math.sqrt(pooled * (1 - pooled) * (1 / n + 1 / n0)):
                    branches[-1].append((name, n, k))
                else:
                    branches.append([(name, n, k)])
            for branch in branches:
                n, k = sum(x[1] for x in branch), sum(x[2] for x in branch)
                estimate |= {x[0]: (k + smoothing * p) / (n + smoothing) for x in branch}
        for name, c in grouped.items():
            walk(host, c, depth + 1, estimate.get(name, p))

    for host in {h for h, _, _ in rows}:
        mine = [(t, b) for h, t, b in rows if h == host]
        n, k = counts(mine)
        walk(host, mine, 0, (k + smoothing * everywhere) / (n + smoothing))
    return out


@pytest.mark.parametrize("max_children", [50, 3])
def test_template_tree_by_brute_force(spark, max_children):
    rng = random.Random(max_children)
    rates = {}
    rows = []
    for _ in range(3000):
        host = rng.choice(["a.net", "b.net", ""])
        parts = [rng.choice("pqrstuv") for _ in range(rng.randrange(4))]
        rate = rates.setdefault((host, *parts[:2]), rng.choice([0.02, 0.1, 0.5, 0.9, 0.97]))
        rows.append((host, "/".join(parts), int(rng.random() < rate) if rng.random() < 0.8 else None))
    frame = spark.createDataFrame(rows, "host string, template string, bad int")
    got = {(r.host, r.template): r.bad_share for r in url_filter.template_tree(frame, max_children=max_children).collect()}
    want = brute_tree(rows, max_children)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    none = url_filter.template_tree(frame.withColumn("bad", F.lit(None).cast("int"))).collect()
    assert len(none) == len(want) and {r.bad_share for r in none} == {None}


def test_alike_siblings_share_an_estimate_and_a_bar_is_a_bar(spark):
    rows = [("h", f"{s}/x", int(i < bad)) for s, bad in (("a", 38), ("b", 39), ("c", 1), ("d", 20)) for i in range(40)]
    tree = {r.template: r.bad_share for r in url_filter.template_tree(spark.createDataFrame(rows, "host string, template string, bad int")).collect()}
    assert tree["a/x"] == tree["b/x"] > 0.8 and tree["c/x"] < 0.2 and 0.4 < tree["d/x"] < 0.7
    pages = spark.createDataFrame([(0, "http://h/a"), (1, "http://h/a")], "page_id bigint, url string")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "page_id bigint, bad int")
    assert {(r.verdict, r.bad_share) for r in url_filter.filter_urls(pages, labels).collect()} == {("block", 0.5)}


def test_urls_of_many_sections(spark):
    urls = [f"http://h.net/sec-{a}{b}/{i}" for a in "abcdefgh" for b in "abcdefgh" for i in range(10)] + [f"http://h.net/spam/{i}" for i in range(100)]
    for url, verdict in judged_urls(spark, urls):
        assert verdict == ("block" if "/spam" in url else "allow"), url


def test_urls_of_deep_paths(spark):
    urls = [f"http://h.net/a/b/c/d/e/{s}/{i}" for s in ("spam", "news") for i in range(60)]
    for url, verdict in judged_urls(spark, urls):
        assert verdict == ("block" if "/spam" in url else "allow"), url


@pytest.mark.parametrize("max_words", [1 << 18, 50])
def test_lm(spark, docs, empty, max_words):
    all_texts = texts()
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(all_texts))]
    train = [t for t, h in zip(all_texts, held, strict=True) if not h]
    counts, n = {}, 0
    for t in train:
        for w in [*WORD.findall(lowered(t)), None]:
            counts[w] = counts.get(w, 0) + 1
            n += 1
    got = {r.doc_id: r for r in lm.score(docs, order=3, max_words=max_words).collect()}
    assert len(got) == len(all_texts)
    for i, t in enumerate(all_texts):
        tokens = [*WORD.findall(lowered(t)), None]
        base = sum(math.log10((counts.get(w, 0) + 1) / (n + len(counts) + 1)) for w in tokens)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens), sum(w in counts for w in tokens), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        if len(t or "") < 3000:
            assert r.score == pytest.approx(brute_ppm(train, t, 3, lm.ESCAPE), rel=1e-9)
    assert lm.score(empty).count() == 0


@pytest.mark.parametrize(("max_nodes", "order"), [(40, 5), (1 << 20, 5), (0, 2)])
def test_lm_keeps_every_gram(docs, max_nodes, order):
    all_texts = texts()
    train = [t for i, t in enumerate(all_texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    got = {r.doc_id: r.score for r in lm.score(docs, order=order, max_nodes=max_nodes).collect()}
    for i, t in enumerate(all_texts):
        if len(t or "") < 600:
            assert got[i] == pytest.approx(brute_ppm(train, t, order, lm.ESCAPE), rel=1e-9)


def test_ppm_is_a_distribution_even_if_pruned():
    import pyarrow as pa

    for _, _, data, offsets in tv.text_slices(pa.array([t for t in texts() if t])):
        low, starts, ends, first = tv.words(data, offsets)
        stream, begin = lm.byte_stream(low, starts, ends, first)
    key, count = np.unique(lm.grams(stream, begin, 4), return_counts=True)
    full = lm.Ppm.from_grams(key, count, 4)
    pruned = lm.Ppm([(k[c >= (3 if i > 2 else 1)], c[c >= (3 if i > 2 else 1)]) for i, (k, c) in enumerate(full.levels)])
    for model in (full, pruned):
        for gram in key[:: len(key) // 40]:
            every = ((gram >> np.uint64(8)) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
            assert (10 ** model.log10(every)).sum() == pytest.approx(1.0)


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    json.dumps(queries.ORACLE_SQL)
