"""Nearest-known lookup and linear filling over a gapless grid, in bounded groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourloom.functions import timeline as tl

_BLOCK = "__block"


def nearest_known(df: DataFrame, keys, cols, block, ts: str = "ts") -> DataFrame:
    """Add, per value column, the previous and next known (ts, value) of each row.

    Each column `c` gains the structs `__prev_c`, `__next_c`, right where `c` is null; every row gains `__lo`, `__hi`,
    the first and last instant of its series. Rows are scanned within (keys, block); what lies outside
    a block is carried by one summary row per block, so no task scans a whole series.
    """
    keys = list(keys)
    # Both uses of `base` below must plan alike for its shuffle to be made once and reused. A block
    # that cannot be null keeps the join from filtering one of them; hours have no null block.
    block = F.coalesce(block, F.lit("1970-01-01").cast("date"))
    base = df.withColumn(_BLOCK, block).repartition(*keys, _BLOCK)

    # min_by/max_by keep primitive buffers, so this stays a hash aggregate (a struct would sort).
    edges = base.groupBy(*keys, _BLOCK).agg(
        F.min(ts).alias("__lo"), F.max(ts).alias("__hi"), *[e for c in cols for e in _edge(c, ts)]
    )
    edges = edges.select(
        *keys,
        _BLOCK,
        "__lo",
        "__hi",
        *[
            F.when(F.col(f"__{side}_ts_{c}").isNotNull(), F.struct(
                F.col(f"__{side}_ts_{c}").alias("ts"), F.col(f"__{side}_v_{c}").alias("v")
            )).alias(f"__{side}_{c}")
            for c in cols
            for side in ("first", "last")
        ],
    )
    earlier = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    later = (
        Window.partitionBy(*keys).orderBy(F.desc(_BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy(*keys)
    carried = edges.select(
        *keys,
        _BLOCK,
        F.min("__lo").over(whole).alias("__lo"),
        F.max("__hi").over(whole).alias("__hi"),
        *[F.last(f"__last_{c}", True).over(earlier).alias(f"__in_{c}") for c in cols],
        *[F.last(f"__first_{c}", True).over(later).alias(f"__out_{c}") for c in cols],
    )
    joined = base.join(carried, [*keys, _BLOCK])

    # lag and lead over non-nulls share one sort, and cost one step per row; they answer for
    # null rows, the only ones that need neighbours.
    here = Window.partitionBy(*keys, _BLOCK).orderBy(ts)
    marked = joined.withColumns({f"__at_{c}": F.when(F.col(c).isNotNull(), F.col(ts)) for c in cols})
    seen = {}
    for c in cols:
        for side, fn in (("prev", "lag"), ("next", "lead")):
            seen[f"__{side}_at_{c}"] = F.expr(f"{fn}(__at_{c}, 1) IGNORE NULLS").over(here)
            seen[f"__{side}_v_{c}"] = F.expr(f"{fn}({c}, 1) IGNORE NULLS").over(here)
    looked = marked.withColumns(seen)
    found = {}
    for c in cols:
        for side, carry in (("prev", "in"), ("next", "out")):
            at, v = F.col(f"__{side}_at_{c}"), F.col(f"__{side}_v_{c}")
            inside = F.when(at.isNotNull(), F.struct(at.alias("ts"), v.alias("v")))
            found[f"__{side}_{c}"] = F.coalesce(inside, F.col(f"__{carry}_{c}"))
    spent = [n for n in (*seen, *(f"__{p}_{c}" for p in ("at", "in", "out") for c in cols))]
    return looked.withColumns(found).drop(*spent)


def _edge(c: str, ts: str):
    """First and last known (ts, value) of a group as plain columns."""
    at = F.when(F.col(c).isNotNull(), F.col(ts))
    return [
        F.min(at).alias(f"__first_ts_{c}"),
        F.min_by(c, at).alias(f"__first_v_{c}"),
        F.max(at).alias(f"__last_ts_{c}"),
        F.max_by(c, at).alias(f"__last_v_{c}"),
    ]


def filled(c: str, ts: str = "ts"):
    """Linear-in-time value of a row; leading and trailing nulls take the nearest known value."""
    prev, nxt = F.col(f"__prev_{c}"), F.col(f"__next_{c}")
    share = tl.hours_between(prev["ts"], F.col(ts)) / tl.hours_between(prev["ts"], nxt["ts"])
    between = prev["v"] + (nxt["v"] - prev["v"]) * share
    return (
        F.when(F.col(c).isNotNull(), F.col(c))
        .when(prev.isNotNull() & nxt.isNotNull(), between)
        .otherwise(F.coalesce(prev["v"], nxt["v"]))
    )


def run_bounds(c: str):
    """(start, length) of the maximal null run a row belongs to; meaningful where c is null."""
    start = F.coalesce(F.col(f"__prev_{c}")["ts"] + tl.hours(1), F.col("__lo"))
    stop = F.coalesce(F.col(f"__next_{c}")["ts"] - tl.hours(1), F.col("__hi"))
    return start, tl.hours_between(start, stop).cast("int") + 1


def drop_lookups(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__")])
