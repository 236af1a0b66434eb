"""Exact quantiles of groups of any size by rank selection.

A quantile of n sorted values lies between two ranks. The values of a group are counted in buckets between its least and
its greatest value; the bucket that holds a wanted rank becomes the next range, until it has no more than `limit` rows or
one value. Only those rows are sorted. What moves are counts per bucket, so no task holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.session import materialize

BUCKETS = 1024
LIMIT = 10_000
#: Rows meet their group's ranges over so many parts of the values' hashes, so that a large group is in many tasks.
SALTS = 32


def exact_quantiles(
    rows: DataFrame, group: list[str], value: str, probabilities: list[float], *, limit: int = LIMIT, buckets: int = BUCKETS,
) -> DataFrame:
    """(group, q0, q1, ...): the given quantiles, interpolated between neighbours; null values don't count.

    A group without values has no row. Group columns may be null.
    """
    group = list(group)
    facts = rows.select(*group, F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    v = F.col("v")
    spans = facts.groupBy(*group).agg(F.count("*").alias("size"), F.min("v").alias("low"), F.max("v").alias("high"))
    steps = F.array(*[F.struct(F.lit(i).alias("at"), ((F.col("size") - 1) * F.lit(float(p))).alias("place")) for i, p in enumerate(probabilities)])
    placed = spans.select(*group, "size", "low", "high", F.inline(steps))
    ends = F.array_distinct(F.array(F.floor("place"), F.ceil("place")))
    ranges = materialize(
        placed.select(*group, "size", "low", "high", F.explode(F.transform(ends, lambda r: r.cast("long"))).alias("rank")).distinct()
        .withColumns({"goal": F.col("rank"), "held": F.col("size")}), "quantile-ranges")

    def inside(wanted: DataFrame) -> DataFrame:
        """Each wanted range with the rows of its group that lie in it."""
        salted = wanted.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = facts.withColumn("__salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
        same = _same(dealt, salted, group)
        return dealt.join(salted, same & (dealt["__salt"] == salted["__salt"]) & (dealt["v"] >= salted["low"]) & (dealt["v"] <= salted["high"])).select(
            *[salted[g] for g in group], "goal", "rank", "low", "high", "held", "v")

    def chosen(counted: DataFrame, order: str) -> DataFrame:
        """Of counts per bucket or value, the one that holds the wanted rank, and how many lie before."""
        upto = F.sum("n").over(Window.partitionBy(*group, "goal").orderBy(order))
        return counted.withColumn("__upto", upto).where((F.col("rank") < F.col("__upto")) & (F.col("rank") >= F.col("__upto") - F.col("n")))

    wide = (F.col("high") > F.col("low")) & (F.col("held") > limit)
    done = ranges.where(~wide)
    open_ = ranges.where(wide)
    while not open_.isEmpty():
        share = (v - F.col("low")) / (F.col("high") - F.col("low"))
        bucket = F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int")
        counted = inside(open_).groupBy(*group, "goal", "rank", bucket.alias("bucket")).agg(
            F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        narrowed = materialize(chosen(counted, "bucket").select(
            *group, F.lit(0).cast("long").alias("size"), "low", "high", (F.col("rank") - F.col("__upto") + F.col("n")).alias("rank"), "goal",
            F.col("n").alias("held")), "quantile-ranges")
        done = done.unionByName(narrowed.where(~wide))
        open_ = narrowed.where(wide)

    one = done.where("low = high").select(*group, "goal", F.col("low").alias("v"))
    counted = inside(done.where("low < high")).groupBy(*group, "goal", "rank", "v").agg(F.count("*").alias("n"))
    found = materialize(one.unionByName(chosen(counted, "v").select(*group, "goal", "v")), "quantile-values")
    both = placed.withColumn("goal", F.explode(F.transform(ends, lambda r: r.cast("long"))))
    matched = both.join(found, _same(both, found, group) & (both["goal"] == found["goal"])).select(
        *[both[g] for g in group], "at", "place", both["goal"], "v")
    pairs = matched.groupBy(*group, "at", "place").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    made = pairs.withColumn("q", F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place")))
    return made.groupBy(*group).agg(*[F.max(F.when(F.col("at") == i, F.col("q"))).alias(f"q{i}") for i in range(len(probabilities))])


def _same(a: DataFrame, b: DataFrame, group: list[str]) -> Column:
    out = F.lit(True)
    for g in group:
        out = out & a[g].eqNullSafe(b[g])
    return out
