"""Queries of the corpus operators over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, embedding_dedup, html_text, lm, mixing, ngram_join, quality, url_filter, warc
from ._shared import table
from .bpe import tokenizer_path


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of a page are those of the document with its number: bad if toxic or of low quality."""
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), labels)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op8_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.read_warc(warc.write_warc(table(spark, sf_dir, "pages")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_bpe_codec,
        op3_ngram_jaccard_join,
        op4_source_mixing,
        op5_url_filter,
        op6_quality_classifier,
        op7_html_extraction,
        op8_warc_dictionary,
        op9_nearest_neighbours,
        op10_lm_scoring,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.98
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), c AS (SELECT a, count(*) AS n FROM links GROUP BY a), m AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, m.low) AS component_id, e.vec_id = least(e.vec_id, m.low) AS kept
FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN m ON m.a = e.vec_id
""",
    "op3_ngram_jaccard_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: CAST(hash(array_to_string(ws[i:i + 4], ' ')) AS VARCHAR)) END) AS g FROM w
), t AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s WHERE len(g) > 0),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p WHERE 100 * i >= 80 * (na + nb - i)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
m AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, least(s.doc_id, m.low) AS component_id FROM s LEFT JOIN m ON m.a = s.doc_id
""",
    # Every quotient of every source and shard is ranked here, and every block looked at by itself.
    "op4_source_mixing": """
WITH d AS (
  SELECT *, md5(concat_ws(':', 7, CAST(doc_id AS VARCHAR), CASE WHEN doc_id IS NULL THEN size END)) AS h FROM (
  SELECT row_number() OVER () AS rid, doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents)
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM d GROUP BY source
), w AS (SELECT *, CAST([3, 1, 2][CAST(pos % 3 AS INT) + 1] AS BIGINT) AS weight FROM src
), tot AS (SELECT 1.5::DOUBLE * sum(source_size) AS goal FROM w
), lv AS (  -- the first so many sources by cap and weight are at their caps; the least number after which no other is above its own
  SELECT *, ((SELECT goal FROM tot) - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY 2 * source_size / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (ORDER BY 2 * source_size / weight, pos) AS rnk FROM w
), fst AS (SELECT level AS water, rnk AS first_free FROM lv WHERE 2 * source_size > level * weight ORDER BY rnk LIMIT 1
), t AS (
  SELECT lv.*, CASE WHEN rnk >= first_free THEN water * weight ELSE CAST(2 * source_size AS DOUBLE) END AS target, source_size // 1048576 + 1 AS shards FROM lv LEFT JOIN fst ON true
), seats AS (SELECT CAST(round(sum(target) / 16) AS BIGINT) AS n FROM t
), sq AS (SELECT pos, target / (2 * k + 1) AS q, k FROM (SELECT pos, target, unnest(range(source_size * 2 // 16 + 1)) AS k FROM t WHERE target > 0)
), given AS (SELECT pos, count(*) AS quota FROM (SELECT pos, row_number() OVER (ORDER BY q DESC, pos, k) AS r FROM sq) WHERE r <= (SELECT n FROM seats) GROUP BY pos
), p AS (
  SELECT d.*, t.pos, t.source_size, t.target, CAST('0x' || substr(h, 17, 8) AS BIGINT) % t.shards AS part, CAST('0x' || substr(h, 1, 12) AS BIGINT) AS o
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), sh AS (SELECT pos, any_value(source) AS source, part, CAST(sum(size) AS BIGINT) AS v, CAST(ceil(sum(size) / 16) AS BIGINT) AS blocks FROM p GROUP BY pos, part
), hq AS (SELECT pos, part, v / (2 * k + 1) AS q, k FROM (SELECT pos, part, v, unnest(range(2 * blocks)) AS k FROM sh WHERE v > 0)
), hr AS (SELECT pos, part, row_number() OVER (PARTITION BY pos ORDER BY q DESC, part, k) AS r FROM hq
), hg AS (SELECT hr.pos, part, count(*) AS quota FROM hr JOIN given USING (pos) WHERE r <= given.quota GROUP BY hr.pos, part
), s AS (
  SELECT sh.*, coalesce(hg.quota, 0) AS quota, greatest(blocks, 1) AS m, CAST('0x' || substr(md5(concat_ws(':', 7, source, part)), 1, 8) AS BIGINT) % greatest(blocks, 1) AS shift
  FROM sh LEFT JOIN hg USING (pos, part)
), r AS (
  SELECT p.*, s.m, s.shift, s.quota // s.m AS passes, s.quota % s.m AS rest, CAST(sum(size) OVER (PARTITION BY p.pos, p.part ORDER BY o, doc_id NULLS FIRST, size, rid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ending
  FROM p JOIN s USING (pos, part)
), b AS (SELECT *, ending - size AS beginning FROM r
), partial AS (
  SELECT rid, sum(least(ending, (block + 1) * 16) - greatest(beginning, block * 16)) AS words
  FROM (SELECT *, unnest(range(beginning // 16, (ending - 1) // 16 + 1)) AS block FROM b WHERE size > 0 AND rest > 0)
  WHERE (block * (2147483647 % m) + shift) % m < rest GROUP BY rid
)
SELECT doc_id, size, source_size, target, CAST(size * passes + coalesce(words, 0) AS BIGINT) AS taken FROM b LEFT JOIN partial USING (rid)
""",
    "op8_warc_dictionary": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY h)
SELECT p.page_id, p.n AS payload_bytes, sha256(p.h) AS payload_digest,
  CASE WHEN f.first_id IS NULL OR f.first_id = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON f.h = p.h AND p.n >= 100
""",
}
