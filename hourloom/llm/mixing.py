"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document of weight w gets the key -ln(u) / w, u being a uniform number made of its id and text. In the order of these
keys the documents of a source are a weighted sample without replacement. A source that needs more words than it has
first gives complete epochs; the rest comes from the documents with the smallest keys, up to the word budget.

The prefix sum over a source is made in two steps, so that no task orders a whole source: keys are binned, the bins' sums are
added up, and only the one bin of a source in which the budget ends is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourloom.llm import common as C

#: Weights of the sources in order, repeating; words of the mix over words there are; most times a document is taken.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
BINS = 4096


def uniform(id_col: Column, text: Column) -> Column:
    """A number between 0 and 1 (neither) from the id and the text: 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("null")), F.md5(text)).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def quality_weight(text: Column) -> Column:
    """Share of letters and white space among the characters, squared, 0.01 at least: prose weighs more than symbols."""
    n = F.greatest(F.char_length(text), F.lit(1))
    return F.greatest(F.pow(1 - F.regexp_count(text, F.lit(r"[^\p{L}\s]")) / n, F.lit(2.0)), F.lit(0.01))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> also target: one row per source.

    Budgets in proportion to the weights, stopped at `most` times the source, with the excess shared again, are
    min(cap, level * weight) for one level. The sources in order of cap / weight fill up first.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("_rank", F.row_number().over(W.orderBy(F.col("source").isNull(), "source"))).withColumn("_w", weight)
    up = W.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("_w").over(
        up.rowsBetween(0, W.unboundedFollowing))
    filled = (
        ranked.withColumn("_cap", F.col("source_size") * F.lit(most))
        .withColumn("_total", F.sum("source_size").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * F.lit(share))
        .withColumn("_level", level)
    )
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    open_level = F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))).over(whole)
    return filled.withColumn("target", F.least(F.col("_cap"), F.coalesce(open_level * F.col("_w"), F.col("_cap")))).select("source", "source_size", "target")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
    weight: Column | None = None, weights=WEIGHTS, share: float = SHARE, most: float = MOST, bins: int = BINS, carry: bool = False,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken and the row key _key: one row per row of docs.

    With carry also _doc, a struct of all columns of docs.

    A null text has no words; a null source is a source of its own, ordered last. Documents without words are taken in
    complete epochs and up to the budget's end like others. The document in which the budget ends is taken if at least
    half of it fits, so a source's taken words miss the target by at most half a document. Repeated rows count
    one by one. No rows in, no rows out.
    """
    text, more = F.col("text"), ["_doc"] if carry else []
    rows = C.stage(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), C.text_or_empty(text_col).alias("text"), F.col(source_col).cast("string").alias("source"),
                    C.row_key(id_col, text_col).alias("_key"), *[F.struct(*docs.columns).alias(c) for c in more])
        .select("doc_id", "source", "_key", F.monotonically_increasing_id().alias("_row"), C.word_count(text).alias("size"),
                (-F.log(uniform(F.col("doc_id"), text)) / (quality_weight(text) if weight is None else weight)).alias("_es"), *more)
        .withColumn("_bin", F.floor(F.col("_es") / (1 + F.col("_es")) * bins).cast("int")), "mix-rows",
    )
    binned = C.stage(rows.groupBy("source", "_bin").agg(F.sum("size").alias("s")), "mix-bins")
    targets = source_targets(binned.groupBy("source").agg(F.sum("s").alias("source_size")), weights, share, most)
    plan = targets.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")).withColumn(
        "_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    by = W.partitionBy("source").orderBy("_bin")
    ends = (
        binned.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        .withColumn("_to", F.sum("s").over(by)).withColumn("_from", F.col("_to") - F.col("s"))
        .where("_from <= _rest")
        .groupBy("source", "source_size", "target", "_epochs", "_rest").agg(F.max(F.struct("_bin", "_from")).alias("m"))
        .select(F.col("source").alias("_s"), "source_size", "target", "_epochs", "_rest", F.col("m._bin").alias("_last"), F.col("m._from").alias("_from"))
    )
    ends = C.stage(ends, "mix-ends")
    met = rows.join(ends, F.col("source").eqNullSafe(F.col("_s")))
    before = F.col("_from") + F.sum("size").over(W.partitionBy("source").orderBy("_es", "doc_id", "_row")) - F.col("size")
    end = met.where("_bin = _last")
    fits = end.drop(*more).select("_row", (before + F.col("size") / 2 <= F.col("_rest")).cast("int").alias("_more"))
    last = end.join(fits, "_row").select(*met.columns, "_more")
    rest = met.where("_bin <> _last").withColumn("_more", (F.col("_bin") < F.col("_last")).cast("int"))
    return last.unionByName(rest).withColumn("copies", F.col("_epochs") + F.col("_more")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "_key", "_row", *more)
