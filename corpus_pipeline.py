"""A corpus from raw documents: quality, exact copies, near copies, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm import bpe, common, exact_dedup, mixing, ngram_join, quality
from hourloom.llm.queries import tokenizer

#: Rows to keep are found again by this key: a row's id with the hash of id and text, so that documents of different ids never share one.
KEY = "_pipeline_key"


def _key(found: Column) -> Column:
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")), F.hex(found)).alias(KEY)


def _with_key(docs: DataFrame) -> DataFrame:
    return docs.select("*", _key(common.row_key("doc_id", "text")))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from `labels`, accepts."""
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return quality.score(docs, model, score_col="_score").where(F.col("_score") >= quality.ACCEPT).select(*docs.columns)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; of a row that repeats, one."""
    kept = exact_dedup.exact_dedup(docs).where("kept").select(_key(F.col("row_key"))).distinct()
    return _with_key(docs).join(kept, KEY, "left_semi").dropDuplicates([KEY]).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies; documents without words stay."""
    found = ngram_join.jaccard_components(docs)
    first = (F.col("n_shingles") == 0) | F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))
    kept = found.where(first).select(_key(F.col("k"))).distinct()
    return _with_key(docs).join(kept, KEY, "left_semi").dropDuplicates([KEY]).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mixture takes it."""
    taken = mixing.mix(docs, carry=True).where("copies > 0")
    return taken.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_doc.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and checksums of each document's token ids and of what they decode to."""
    return bpe.encode_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good), ("exact_dedup", unique), ("near_dedup", distinct), ("mixture", mixed), ("tokens", encoded),
]

#: Trees, sampling by hashes and a tokenizer's merges are beyond SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = common.stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
