"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bitplane, bitslice, filter_audit, hard_negatives, jaccard, katz, licenses, mixing, packing, slack, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The tokenizer file of the token queries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_adaptive_scan(spark, sf_dir):
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), k=10, query_step=100)


def op2_warc_revisits(spark, sf_dir):
    return warc.warc_round_trip(spark, table(spark, sf_dir, "pages"), min_bytes=0)


def op3_licence_scan(spark, sf_dir):
    return licenses.scan_licences(table(spark, sf_dir, "documents"), licenses.train_licence_model(spark, negatives=table(spark, sf_dir, "benchmark")))


def op4_jaccard_join(spark, sf_dir):
    return jaccard.link_documents(table(spark, sf_dir, "documents"), shingle=5, percent=75)


def op5_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096)


def op6_toxicity_chain(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ChainModel:
    """The chain low_quality, toxic, fitted on the labelled documents."""
    return toxicity.fit_chain(docs, toxicity.category_labels(labels), toxicity.CATEGORIES)


def op7_katz_scores(spark, sf_dir):
    return katz.score_documents(table(spark, sf_dir, "documents"), folds=5, held=1)


def op8_bit_sliced_top_k(spark, sf_dir):
    return bitslice.exact_top_k(table(spark, sf_dir, "embeddings"), k=20, query_step=20)


def op9_temperature_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs).select("doc_id", "source", F.round("mix_weight", 6).alias("weight"), F.col("mix_block").alias("block"), F.col("mix_key").alias("order_key"))


def op10_bitplane_ids(spark, sf_dir):
    return bitplane.bitplane_round_trip(spark, table(spark, sf_dir, "documents"), tokenizer_path(), planes="byte")


def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit_filters(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


def op12_minimum_slack(spark, sf_dir):
    import public_tokenizers

    return slack.pack_windows(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024)


def op13_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved))


QUERIES = {f.__name__: f for f in (op1_adaptive_scan, op2_warc_revisits, op3_licence_scan, op4_jaccard_join, op5_best_fit_packing, op6_toxicity_chain, op7_katz_scores, op8_bit_sliced_top_k, op9_temperature_mixing, op10_bitplane_ids, op11_filter_audit, op12_minimum_slack, op13_hard_negatives)}

ORACLE_SQL = {
    "op2_warc_revisits": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first_id FROM p
)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d""",
    "op4_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS shingles FROM d
), e AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), r AS (
  SELECT x, y FROM p UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x
)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.y), s.doc_id)) AS component_id
FROM s LEFT JOIN r ON r.x = s.doc_id GROUP BY s.doc_id, len(shingles)""",
    "op8_bit_sliced_top_k": """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op9_temperature_mixing": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents
), n AS (
  SELECT source, CAST(sum(tokens) AS BIGINT) AS n FROM t GROUP BY source
), sh AS (
  SELECT source, n, n / sum(n) OVER () AS p, 0.95 * ln(count(*) OVER ()) AS wanted FROM n WHERE n > 0
), h0 AS (
  SELECT -sum(p * ln(p)) >= any_value(wanted) AS met FROM sh
), b AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN f THEN lo ELSE m END, CASE WHEN f THEN m ELSE hi END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS m, ln(sum(pow(p, 1 - (lo + hi) / 2))) - (1 - (lo + hi) / 2) * sum(pow(p, 1 - (lo + hi) / 2) * ln(p)) / sum(pow(p, 1 - (lo + hi) / 2)) >= any_value(wanted) AS f
    FROM b, sh WHERE i < 60 GROUP BY i, lo, hi)
), x AS (
  SELECT greatest(CASE WHEN (SELECT met FROM h0) THEN 1 ELSE 1 - (SELECT hi FROM b WHERE i = 60) END,
    CASE WHEN max(p) / min(p) <= 2 THEN 0 ELSE 1 - ln(2) / ln(max(p) / min(p)) END) AS e FROM sh
), w AS (
  SELECT source, n, pow(p, e) / sum(pow(p, e)) OVER () AS weight, round(greatest(1, pow(max(p) OVER () / p, 1 - e)), 9) AS epochs FROM sh, x
), plan AS (
  SELECT n.source, coalesce(weight, 0) AS weight, CAST(floor(coalesce(epochs, 1)) AS BIGINT) AS whole, CAST(floor((coalesce(epochs, 1) - floor(coalesce(epochs, 1))) * n.n) AS BIGINT) AS rest FROM n LEFT JOIN w ON w.source IS NOT DISTINCT FROM n.source
), k AS (
  SELECT t.*, weight, whole, rest, substr(md5(concat_ws('|', '17', CAST(whole AS VARCHAR), CAST(doc_id AS VARCHAR))), 1, 16) AS key FROM t JOIN plan ON plan.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES), 0) - tokens AS before FROM k
), draws AS (
  SELECT doc_id, source, weight, unnest(range(0, whole + CASE WHEN rest > 0 AND before < rest THEN 1 ELSE 0 END)) AS block FROM c
)
SELECT doc_id, source, round(weight, 6) AS weight, CAST(block AS INTEGER) AS block, substr(md5(concat_ws('|', '17', CAST(block AS VARCHAR), CAST(doc_id AS VARCHAR))), 1, 16) AS order_key FROM draws""",
    "op11_filter_audit": r"""
WITH l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1
), d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id
), c AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL
), f AS (
  SELECT i, substr('ABCDE', i + 1, 1) AS letter FROM range(5) t(i)
), o AS (
  SELECT a.letter || b.letter || x.letter || y.letter || z.letter AS filter_order FROM f a, f b, f x, f y, f z
  WHERE a.i NOT IN (b.i, x.i, y.i, z.i) AND b.i NOT IN (x.i, y.i, z.i) AND x.i NOT IN (y.i, z.i) AND y.i <> z.i
), s AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, (SELECT 1 << f.i FROM f WHERE letter = substr(filter_order, step, 1)) AS own,
    coalesce((SELECT sum(1 << f.i) FROM f WHERE strpos(substr(filter_order, 1, step - 1), letter) > 0), 0)::INTEGER AS before
  FROM o, range(1, 6) t(step)
), r AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER ((mask & (before | own)) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER ((mask & own) <> 0 AND (mask & before) = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER ((mask & own) <> 0 AND (mask & before) <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER ((mask & own) <> 0 AND (mask & before) = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER ((mask & own) <> 0 AND (mask & before) = 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r""",
    "op13_hard_negatives": """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score FROM p JOIN s ON s.anchor_id = p.anchor_id WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n QUALIFY rank <= 5""",
}
