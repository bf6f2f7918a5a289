"""The stages one by one on the smallest tables, each against what it must do to its own input."""

import hashlib
import re

import pytest

import corpus_pipeline
from verdigris.llm import ngram_join, queries
from verdigris.llm._shared import materialize, table

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = table(spark, sf, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out.append(materialize(stage(spark, out[-1], sf), name))
    return out


def test_stages(spark, sf, stages):
    first, good, single, mixed = stages
    assert all(s.columns == first.columns for s in stages)
    known = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    kept = {r.doc_id for r in good.select("doc_id").collect()}
    everything = {r.doc_id for r in first.select("doc_id").collect()}
    agree = [(i in kept) == bool(q) for i, q in known.items() if i in everything]
    assert sum(agree) >= 0.9 * len(agree)  # some 80 labels are few to learn from
    groups = ngram_join.jaccard_join(good).collect()
    assert {r.doc_id for r in single.select("doc_id").collect()} == {r.component_id for r in groups}
    before = {r.doc_id: len(WORD.findall(r.text or "")) for r in single.collect()}
    after = {}
    for r in mixed.collect():
        after[r.doc_id] = after.get(r.doc_id, 0) + len(WORD.findall(r.text))
    assert set(after) <= set(before) and all(n <= 2 * before[i] for i, n in after.items())
    assert abs(sum(after.values()) - 1.5 * sum(before.values())) < 20 * 16


def test_last_stage(spark, sf, stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    mixed = stages[-1]
    got = sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.encoded(spark, mixed, sf).collect())
    want = sorted((r.doc_id, hashlib.sha256(" ".join(map(str, library.encode(r.text, add_special_tokens=False).ids)).encode()).hexdigest()) for r in mixed.collect())
    assert got == want
