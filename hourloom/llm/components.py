"""Connected components of an edge table, without gathering anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm import common as C


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> v, label: every node with the smallest node it is connected with.

    Each round a node takes the smallest label among its neighbours and then that node's own label, so labels travel twice as far each time.
    """
    both = C.stage(edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u"))).distinct(), "edges")
    label = C.stage(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("label")), "labels")
    while True:
        near = both.join(label.select(F.col("v").alias("u"), "label"), "u").groupBy("v").agg(F.min("label").alias("near"))
        taken = label.join(near, "v").select("v", "label", F.least("label", "near").alias("next"))
        far = label.select(F.col("v").alias("next"), F.col("label").alias("far"))
        moved = C.stage(taken.join(far, "next", "left").select("v", "label", F.least("next", "far").alias("next")), "labels")
        label = moved.select("v", F.col("next").alias("label"))
        if moved.where("next < label").isEmpty():
            return label
