"""Connected components. Lineage is cut by reliable checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from stagelight.session import cut_lineage


def _settled(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges behind a checkpoint, and their number and hash, observed while it is written."""
    seen = Observation()
    watched = edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    kept = cut_lineage(watched)
    got = seen.get
    return kept, (got["n"], got["h"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): component is the smallest id reachable. Nodes come from the edges; self edges keep lone nodes.

    Alternating star contraction: each round points neighbours at the smallest id seen, first upwards, then downwards,
    so the number of rounds grows with the logarithm of the size, not with the diameter. Every round that changes the edges lowers
    some label, so it ends at any size.
    """
    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    nodes = start.select(F.col("u").alias("id")).union(start.select("v")).distinct()
    e, last = _settled(start.where("u <> v"))
    while True:
        near = e.union(e.select("v", "u").toDF("u", "v"))
        low = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        e = near.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e, now = _settled(moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        if now == last:
            break
        last = now
    label = e.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(label.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
