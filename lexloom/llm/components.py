"""Connected components by alternating large-star and small-star rounds, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger neighbours (large) or smaller ones (small) to its least neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
    near = both.join(least, "a")
    if large:
        out = near.where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(least.select("a", F.col("_m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of type long -> (a, b) for every node a that isn't the least of its component, b the least."""
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    down, last = materialize(down, "edges"), None
    while True:
        mark = down.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if mark[0] == 0 or mark == last:
            return down
        last = mark
        large = materialize(_star(down, True), "edges")
        old, down = down, materialize(_star(large, False), "edges")
        discard(down.sparkSession, old, large)
