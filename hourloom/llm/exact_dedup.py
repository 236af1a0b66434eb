"""Exact dedup by deterministic block naming.

A text loses its white space and is cut into blocks of a fixed number of bytes. All distinct blocks are sorted and
numbered; a block's number is its name. Adjacent names are paired, the distinct pairs are sorted and numbered in
the same way, and so on, until each document has one name. Two documents have equal texts if and only if they have
as many blocks and the same name: names come from the blocks' whole bytes, not from a hash.

A 64-bit hash serves only to look a block's name up without moving its bytes again. Where two different blocks share a
hash, the bytes are compared as well. Of n blocks about n*n / 2**65 share one, so the list of such hashes stays short:
one entry at 25 TB of distinct text in blocks of 4 KB, a hundred thousand at 8 PB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.llm import common as C

BLOCK_BYTES = 8192


def normalised(text: Column) -> Column:
    """UTF-8 bytes of a text without white space."""
    return F.translate(text, C.SPACE_CHARS, "").cast("binary")


def _blocks(body: Column, size: int, make: Callable[[Column], Column]) -> Column:
    """make(block) for each block; an empty text has one empty block. The outer array binds the bytes once."""
    def cut(b: Column) -> Column:
        last = F.greatest(F.ceil(F.octet_length(b) / F.lit(size)).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: make(F.substring(b, i * size + 1, F.lit(size))))

    return F.element_at(F.transform(F.array(body), cut), 1)


def _number(values: DataFrame, by: list[str]) -> DataFrame:
    """Distinct rows, sorted inside their partitions, with an integer name each."""
    return values.distinct().sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def name_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, block_bytes: int = BLOCK_BYTES,
    hash_block: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per row of docs: _row, doc_id, row_key, n_chars, text_sha256, n_blocks, name. Equal (n_blocks, name) = equal texts."""
    source = C.id_rows(docs, id_col, text_col).withColumn("row_key", C.row_key("doc_id", "text"))

    def clash(h: Column, block: Column, clashing: list[int]) -> Column:
        """The block's bytes where its hash isn't enough, else nothing."""
        empty = F.lit(b"").cast("binary")
        return F.when(h.isin(clashing), block).otherwise(empty) if clashing else empty

    def names_of(clashing: list[int]) -> DataFrame:
        blocks = source.select(F.explode(_blocks(normalised(F.col("text")), block_bytes, lambda b: b)).alias("block"))
        named = _number(blocks.select(hash_block(F.col("block")).alias("h"), "block"), ["block"])
        return C.stage(named.select("h", clash(F.col("h"), F.col("block"), clashing).alias("bytes"), "name"), "block-names")

    names = names_of([])
    clashing = [r.h for r in names.groupBy("h").count().where("count > 1").select("h").collect()]
    if clashing:
        names = names_of(clashing)

    def entry(block: Column) -> Column:
        h = hash_block(block)
        return F.struct(h.alias("h"), clash(h, block, clashing).alias("bytes")) if clashing else h

    body = source.select("doc_id", "row_key", F.char_length("text").cast("long").alias("n_chars"), normalised(F.col("text")).alias("body"))
    rows = C.stage(
        body.select(
            F.monotonically_increasing_id().alias("_row"), "doc_id", "row_key", "n_chars", F.sha2("body", 256).alias("text_sha256"),
            _blocks(F.col("body"), block_bytes, entry).alias("entries"),
        ), "block-rows",
    )
    at = rows.select("_row", F.size("entries").alias("n_blocks"), F.posexplode("entries").alias("pos", "e"))
    key = [F.col("e.h").alias("h"), F.col("e.bytes").alias("bytes")] if clashing else [F.col("e").alias("h"), F.lit(b"").cast("binary").alias("bytes")]
    on = ["h", "bytes"] if clashing else ["h"]
    found = at.select("_row", "n_blocks", "pos", *key).join(names.select(*on, "name"), on)

    def gathered(named: DataFrame) -> DataFrame:
        """A row's names in order; as many as one document has blocks."""
        return named.groupBy("_row", "n_blocks").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("s")).select(
            "_row", "n_blocks", F.col("s.name").alias("names"))

    single = found.where("n_blocks = 1").select("_row", "n_blocks", "name")
    level = C.stage(gathered(found.where("n_blocks > 1")), "names-0")
    left = level.agg(F.max(F.size("names"))).first()[0] or 1
    while left > 1:
        pairs = level.select("_row", "n_blocks", F.posexplode(F.transform(
            F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int")),
            lambda i: F.struct(F.col("names")[i * 2].alias("l"), F.coalesce(F.get(F.col("names"), i * 2 + 1), F.lit(-1)).alias("r")),
        )).alias("pos", "p")).select("_row", "n_blocks", "pos", "p.l", "p.r")
        pair_names = C.stage(_number(pairs.select("l", "r"), ["l", "r"]), "pair-names")
        level = C.stage(gathered(pairs.join(pair_names, ["l", "r"])), "names")
        left = (left + 1) // 2
    named = single.unionByName(level.select("_row", "n_blocks", F.col("names")[0].alias("name")))
    return rows.drop("entries").join(named, "_row")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chars, row_key (common.row_key): one row per row of docs.

    Null texts count as empty, and all empty (or white) texts are equal. The longest original text stays, then the
    smallest doc_id (nulls last); of repeated rows exactly one. No rows in, no rows out. Other columns are not read.
    """
    named = C.stage(name_documents(docs, id_col, text_col, **options), "named")
    order = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("z"), "doc_id", "_row")
    groups = C.stage(named.groupBy("n_blocks", "name").agg(F.count("*").alias("group_size"), F.min(order).alias("keep")), "groups")
    return named.join(groups, ["n_blocks", "name"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("keep._row")).alias("kept"),
        "text_sha256", "n_chars", "row_key",
    )
