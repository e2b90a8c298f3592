"""Merkle trees over ordered chunks: leaf SHA-256(00 || chunk), node SHA-256(01 || left || right), an odd node promoted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.scratch import materialize


def leaves(chunks: DataFrame) -> DataFrame:
    """(idx from 0, chunk) -> (idx, h)."""
    return chunks.select("idx", F.unhex(F.sha2(F.concat(F.lit(b"\x00"), F.col("chunk").cast("binary")), 256)).alias("h"))


def _halved(nodes: Column) -> Column:
    def parent(i: Column) -> Column:
        both = F.unhex(F.sha2(F.concat(F.lit(b"\x01"), F.get(nodes, 2 * i), F.get(nodes, 2 * i + 1)), 256))
        return F.when(2 * i + 1 < F.size(nodes), both).otherwise(F.get(nodes, 2 * i))

    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(nodes) / 2).cast("int") - 1), parent)


def merkle_root(chunks: DataFrame, levels_at_once: int = 12) -> DataFrame:
    """One row, root (hex). Each round folds subtrees of 2 ** levels_at_once leaves, an aggregation by subtree."""
    level = leaves(chunks)
    span = 1 << levels_at_once
    while True:
        folded = level.groupBy(F.expr(f"idx div {span}").alias("idx")).agg(F.array_sort(F.collect_list(F.struct("idx", "h"))).alias("_c"))
        folded = folded.select("idx", F.transform("_c", lambda x: x["h"]).alias("_c"))
        for _ in range(levels_at_once):
            folded = folded.select("idx", _halved(F.col("_c")).alias("_c"))
        # written, so that counting and the next round don't fold it anew
        level = materialize(folded.select("idx", F.get("_c", F.lit(0)).alias("h")), "merkle")
        if level.count() <= 1:
            return level.select(F.lower(F.hex("h")).alias("root"))


def merkle_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """idx of chunks that differ or that one side lacks."""
    x, y = leaves(a), leaves(b).withColumnRenamed("h", "g")
    return x.join(y, "idx", "full_outer").where(~F.col("h").eqNullSafe(F.col("g"))).select("idx")
