"""K-d tree sharding: split at distributed weighted medians along the widest metadata dimension.

The tree is a few numbers per shard and is kept in the driver; rows are only ever counted, never gathered. A median is
found by counting weights in bins of the dimension's range and looking again into the bin in which it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourloom.llm import common as C

BINS = 256


def document_dimensions(text: Column, size: Column, crc: Column) -> list[Column]:
    """The text's bytes, words and bytes beyond its characters (which tell scripts apart), with its checksum below each, so that only equal texts share a coordinate."""
    beyond = F.octet_length(text) - F.char_length(text)
    return [F.least(x, F.lit(2**31 - 1)).cast("long") * F.lit(2**32) + crc for x in (size, C.word_count(text), beyond)]


def _cuts(rows: DataFrame, nodes: dict[int, dict], bins: int, tolerance: float) -> None:
    """Gives each node its cut: the coordinate up to which about `part` of its weight lies."""
    open_nodes = dict(nodes)
    while open_nodes:
        plan = rows.sparkSession.createDataFrame(
            [(k, n["axis"], n["lo"], max(1, -(-(n["hi"] - n["lo"] + 1) // bins))) for k, n in open_nodes.items()], "node long, axis int, lo long, step long")
        # As many rows as there are nodes, so at most as there are shards.
        x = F.element_at("coords", F.col("axis") + 1)
        counted = rows.join(F.broadcast(plan), "node").where(x >= F.col("lo")).select("node", "step", x.alias("x"), "lo", "weight")
        counted = counted.withColumn("bin", F.expr("(x - lo) div step")).where(F.col("bin") < bins)
        sums: dict[int, list] = {}
        for r in counted.groupBy("node", "step", "bin").agg(F.sum("weight").alias("w"), F.max("x").alias("top")).collect():  # nodes x bins at most
            sums.setdefault(r.node, []).append((r.bin, r.w, r.step, r.top))
        for k, n in list(open_nodes.items()):
            goal, below = n["part"] * n["weight"], n["below"]
            for b, w, step, top in sorted(sums[k]):
                if below + w >= goal or (b, w, step, top) == max(sums[k]):
                    break
                n["cut"], below = top, below + w
            first, over = n["lo"] + b * step, below + w - goal
            if step == 1 or w <= tolerance * n["weight"]:
                # Before or after this bin, whichever is nearer.
                if over <= goal - below or "cut" not in n:
                    n["cut"] = top
                del open_nodes[k]
            else:
                n["lo"], n["hi"], n["below"] = first, first + step - 1, below


def kd_tree(rows: DataFrame, shards: int, *, bins: int = BINS, tolerance: float = 1e-4) -> DataFrame:
    """rows (coords array<long>, weight) with the column shard, 0 to shards - 1.

    A node that is to become k shards is cut where the lower side holds k // 2 parts in k of its weight (to
    `tolerance`, or as near as equal coordinates allow, which are never separated).
    """
    nodes, shard_of, n_axes = {0: shards}, {}, None
    # Not a constant, for a join on a constant would be planned as a nested loop.
    rows = rows.withColumn("node", F.element_at("coords", 1) * 0)
    ranges, level = None, 0
    while any(k > 1 for k in nodes.values()):
        n_axes = n_axes or rows.select(F.max(F.size("coords"))).first()[0]
        if n_axes is None:  # no rows
            break
        stats = rows.groupBy("node").agg(F.sum("weight").alias("w"), *[f(F.element_at("coords", a + 1)).alias(f"{n}{a}") for a in range(n_axes) for f, n in ((F.min, "lo"), (F.max, "hi"))]).collect()
        ranges = ranges or [max(1, stats[0][f"hi{a}"] - stats[0][f"lo{a}"]) for a in range(n_axes)]
        plan = {}
        for r in stats:
            if nodes[r.node] > 1:
                axis = max(range(n_axes), key=lambda a: ((r[f"hi{a}"] - r[f"lo{a}"]) / ranges[a], -a))
                plan[r.node] = {"axis": axis, "lo": r[f"lo{axis}"], "hi": r[f"hi{axis}"], "weight": r.w, "part": (nodes[r.node] // 2) / nodes[r.node], "below": 0}
        _cuts(rows, plan, bins, tolerance)
        # A node without rows, or that is one shard already, goes down on its lower side.
        cuts = rows.sparkSession.createDataFrame(
            [(k, p["axis"], p["cut"]) for k, p in plan.items()], "node long, axis int, cut long")
        upper = F.coalesce((F.element_at("coords", F.col("axis") + 1) > F.col("cut")).cast("long"), F.lit(0).cast("long"))
        rows = rows.join(F.broadcast(cuts), "node", "left").withColumn("node", F.col("node") * 2 + upper).drop("axis", "cut")
        level += 1
        if level % 3 == 0:
            rows = C.stage(rows, "kd-nodes")
        nodes = {c: k for n, m in nodes.items() for c, k in ((2 * n, m // 2 if m > 1 else m), (2 * n + 1, m - m // 2 if m > 1 else 0)) if k}
    shard_of = {n: i for i, n in enumerate(sorted(nodes))}
    number = F.create_map(*[F.lit(x) for n, i in shard_of.items() for x in (n, i)])
    return rows.withColumn("shard", F.element_at(number, F.col("node").cast("int"))).drop("node")


def kd_shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shards: int | None = None, target_bytes: int | None = None,
    rows_a_bucket: int = 200_000, bins: int = BINS, tolerance: float = 1e-4,
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: one row per row of docs, in shards of nearly equal bytes.

    Give the number of shards, or the bytes of one. Size is the text's UTF-8 bytes and 1 (null: 1). Equal texts stay in one
    shard, so a text whose copies outweigh a shard makes that shard larger. Slots count a shard's rows from 0
    without gaps; they are dealt in two steps, buckets and rows in a bucket. No rows in, no rows out.
    """
    text = F.col("text")
    sized = C.id_rows(docs, id_col, text_col).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("_row"), "text")
    coords = F.array(*document_dimensions(text, F.col("size"), F.col("text_crc32")))
    rows = C.stage(sized.withColumn("coords", coords).withColumn("weight", F.col("size")).drop("text"), "kd-rows")
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    if shards is None:
        shards = max(1, -(-(total or 0) // target_bytes))
    buckets = max(1, n // (shards * rows_a_bucket) + 1)
    dealt = C.stage(kd_tree(rows, shards, bins=bins, tolerance=tolerance).withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets))).drop("coords", "weight"), "kd-leaves")
    counts = dealt.groupBy("shard", "_bucket").agg(F.count("*").alias("c"))  # about n / rows_a_bucket rows
    starts = counts.withColumn("_start", F.sum("c").over(W.partitionBy("shard").orderBy("_bucket")) - F.col("c")).drop("c")
    place = F.row_number().over(W.partitionBy("shard", "_bucket").orderBy("doc_id", "_row")) - 1
    return dealt.withColumn("_place", place).join(starts, ["shard", "_bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_start") + F.col("_place")).cast("long").alias("slot"))
