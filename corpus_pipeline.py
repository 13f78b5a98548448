"""A training-data pipeline of four of the operators in ``langdrift.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langdrift.llm import common, jaccard, mixing, packing, queries, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject; no shuffle of texts.

    Null and empty texts have no toxic features and stay. Labels of documents that aren't
    there take no part. Repeated rows are judged each; an empty table stays empty. All
    columns of ``docs`` are returned, whatever their names.
    """
    model = queries.toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    p = toxicity.chain_probabilities(model, spark, F.col("text"))
    return docs.filter(p[len(model.categories) - 1] < toxicity.THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that five-word shingles link at a Jaccard similarity of 0.75.

    Documents without words are linked with nothing and stay, as do rows with a null id.
    Rows that repeat an id stay or go together.
    """
    groups = jaccard.link_documents(docs)
    return jaccard.keep_representatives(docs, groups)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mixture of their sources reads them, at least once.

    A null source is one of its own; texts without words count no tokens and are read as
    their key falls.
    """
    return mixing.mix_sources(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents packed into sequences of 4096 tokens; null and empty texts are their end id alone."""
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", drop_near_copies), ("mixing", mix), ("packing", pack)]
#: SQL cannot express the classifier, the tokenizer and the packing; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.written(docs, f"stage-{name}")
    return docs
