"""The pipeline, stage by stage, on the smallest tables."""

import os
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from langdrift.llm import common

DIR = "/root/testdata/sf0.001"


def test_stages_with_nulls_repeats_and_clashing_columns(spark, tmp_path):
    from test_operators import components_by_hand, ids_of

    words = [f"w{i}" for i in range(400)]
    base = " ".join(words[:60])
    texts = [base, base, " ".join([*words[:60], "more"]), " ".join(words[100:160]), "", None, " ", "zonk " + " ".join(words[200:230]), "zonk " + " ".join(words[300:330]), "lone words", "word " * 9000]
    texts += [f"{'zonk' if i % 5 == 0 else 'fine'} text{i} of{i} its{i} own{i}" for i in range(30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _p double, _dropped int, mix_block string, key string, row int"
    rows = [(i, t, None, None if i % 3 else "s", 1, 0.5, 3, "m", "k", i) for i, t in enumerate(texts)] + [(None, base, "x", "s", None, None, None, None, None, None), (0, texts[0], None, "s", 1, 0.5, 3, "m", "k", 0)]
    docs = spark.createDataFrame(rows, schema)
    labels = [(i, 1, int("zonk" in (t or ""))) for i, t in enumerate(texts)] + [(None, 1, 1), (77, 0, 1), (3, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(9).write.parquet(str(tmp_path / "labels.parquet"))
    toxic, near, mix, pack = (f for _, f in corpus_pipeline.STAGES)
    clean = common.written(toxic(spark, docs, str(tmp_path)), "t")
    assert clean.columns == docs.columns
    assert sorted(str(tuple(r)) for r in clean.collect()) == sorted(str(r) for r in rows if "zonk" not in (r[1] or ""))
    single = common.written(near(spark, clean, str(tmp_path)), "n")
    kept = {c for _, _, c in components_by_hand([(r["doc_id"], r["text"]) for r in clean.collect()])} | {None}
    assert single.columns == docs.columns and {r["doc_id"] for r in single.collect()} == kept
    mixed = common.written(mix(spark, single, str(tmp_path)), "m")
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} == kept
    packed = pack(spark, mixed, str(tmp_path))
    crc = {r["doc_id"]: zlib.crc32(ids_of(r["text"])[:4096].tobytes()) for r in mixed.collect()}
    first = packed.filter("piece = 0").collect()
    assert len(first) == mixed.count() and all(r["ids_crc32"] == crc[r["doc_id"]] for r in first)
    none = docs.limit(0)
    for stage in (toxic, near, mix):
        assert stage(spark, none, str(tmp_path)).columns == docs.columns and stage(spark, none, str(tmp_path)).isEmpty()
    assert pack(spark, none, str(tmp_path)).isEmpty()


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_stages_hand_on(spark):
    from test_operators import components_by_hand, ids_of, mixture_by_hand

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    toxic, near, mix, pack = (f for _, f in corpus_pipeline.STAGES)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    clean = common.written(toxic(spark, docs, DIR), "t")
    kept = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == docs.columns and all(d in kept for d, t in labels.items() if t == 0)
    assert sum(d in kept for d, t in labels.items() if t == 1) <= 0.1 * sum(labels.values())
    single = common.written(near(spark, clean, DIR), "n")
    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    assert single.columns == docs.columns
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({c for _, _, c in components_by_hand(rows)})
    mixed = common.written(mix(spark, single, DIR), "m")
    assert mixed.columns == docs.columns
    want = mixture_by_hand([(r["doc_id"], r["text"], r["source"]) for r in single.collect()], 17, 0.95, 2.0)
    copies = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert sum(want.values()) == sum(copies.values()) and all(copies[d] == sum(v for (x, _), v in want.items() if x == d) for d in copies)
    packed = pack(spark, mixed, DIR)
    crc = {(r["doc_id"]): zlib.crc32(ids_of(r["text"])[:4096].tobytes()) for r in mixed.collect()}
    assert all(crc[r["doc_id"]] == r["ids_crc32"] for r in packed.filter("piece = 0").collect())
    assert packed.filter("piece = 0").count() == sum(copies.values())
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").isEmpty()
