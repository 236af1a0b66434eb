"""The text operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm import common as C
from hourloom.llm import bpe, exact_dedup, fingerprints, hmm, mixing, ngram_join, prefix_trie, quality, secrets, sharding, token_files, whitening, wrappers


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "documents")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir)).drop("n_chars", "row_key")


def tokenizer(name: str) -> str:
    """A public tokenizer file's JSON, read by the driver."""
    import public_tokenizers

    return bpe.load(public_tokenizers.path(name))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(_documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_documents(spark, sf_dir)).drop("k")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_documents(spark, sf_dir))


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(_documents(spark, sf_dir), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(_documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality.train(docs, C.table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_pages(C.table(spark, sf_dir, "pages"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(_documents(spark, sf_dir))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(C.table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(C.table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_exact_dedup, op2_token_files, op3_ngram_join, op4_fingerprints, op5_kd_shards, op6_hmm, op7_quality, op8_html, op9_mix, op10_bpe,
        op11_secrets, op12_whitening, op13_prefix_trie,
    )
}
