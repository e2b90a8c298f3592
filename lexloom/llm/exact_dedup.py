"""Exact dedup by a heavy-hitter split; DataFrame functions only.

Each text's digest is the SHA-256 of its normalised form (A-Z lower-cased, null as empty). A Misra-Gries summary
(Spark's approx_top_k: mergeable counters of fixed number) names the digests that may be frequent. Their exact counts
and winners are aggregated with map-side combining, and these few rows, at most HEAVY, are broadcast, so that rows of
heavy digests never meet in one task. The summary's error bound leaves every other digest fewer than about
3.5 * rows / SLOTS copies, and those shuffle by digest.

Edge cases: null texts equal empty ones; a null doc_id loses to any other; of rows that tie in digest and doc_id one
row stays; empty tables give empty results; other columns pass through `deduplicate` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import lower_ascii, materialize, read

#: Counters of the summary, and how many of its heaviest digests get the broadcast path.
SLOTS, HEAVY = 16_384, 2_048


def digest(text: str):
    return F.sha2(lower_ascii(F.coalesce(F.col(text), F.lit(""))), 256)


def heavy_digests(rows: DataFrame, slots: int = SLOTS, heavy: int = HEAVY) -> DataFrame:
    """Up to `heavy` short digests (`_short`) that the Misra-Gries summary holds to be frequent."""
    top = rows.agg(F.expr(f"approx_top_k(_short, {heavy}, {slots})").alias("_top"))
    return top.select(F.explode("_top").alias("_e")).where("_e.count > 1").select(F.col("_e.item").alias("_short"))


def annotate(docs: DataFrame, slots: int = SLOTS, heavy: int = HEAVY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col("doc_id"), F.unhex(digest("text")).alias("_sha"))
    rows = rows.select("doc_id", "_sha", F.xxhash64("_sha").alias("_short"), F.monotonically_increasing_id().alias("_row"))
    rows = materialize(rows, "digests")
    winner = F.max(F.struct("doc_id", "_row"))
    often = rows.join(F.broadcast(heavy_digests(rows, slots, heavy)), "_short", "left_semi")
    winners = materialize(often.groupBy("_sha").agg(winner.alias("_win"), F.count("*").alias("group_size")), "winners")
    split = rows.drop("_short").join(F.broadcast(winners), "_sha", "left")
    heavy_part = split.where("group_size is not null")
    group = Window.partitionBy("_sha")
    rest = rows.drop("_short").join(F.broadcast(winners.select("_sha")), "_sha", "left_anti")
    light_part = rest.withColumn("_win", winner.over(group)).withColumn("group_size", F.count("*").over(group))
    return heavy_part.unionByName(light_part).select(
        "doc_id",
        F.col("_win.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_win._row")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, slots: int = SLOTS, heavy: int = HEAVY) -> DataFrame:
    """docs without all but the row of the largest doc_id of equal texts.

    The same split: winners of heavy digests, HEAVY at most, are broadcast and their other rows go map-side; what is left
    meets the winners of its digest by shuffle, at every size.
    """
    columns = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_doc"), F.unhex(digest("text")).alias("_sha"))
    rows = packed.select(F.col("_doc.doc_id").alias("_id"), "_sha", F.xxhash64("_sha").alias("_short"))
    rows = materialize(rows, "digests")
    short = materialize(heavy_digests(rows, slots, heavy), "heavy")

    def groups(part: DataFrame, label: str) -> DataFrame:
        tied = part.groupBy("_sha", "_id").agg(F.count("*").alias("_n"))
        found = tied.groupBy("_sha").agg(F.max(F.struct("_id", "_n")).alias("_win"), F.sum("_n").alias("_size")).where("_size > 1")
        return materialize(found.select("_sha", F.col("_win._id").alias("_keep"), F.col("_win._n").alias("_ties")), label)

    often = groups(rows.join(F.broadcast(short), "_short", "left_semi"), "often")
    seldom = groups(rows.join(F.broadcast(short), "_short", "left_anti"), "seldom")
    stays = F.col("_ties").isNull() | F.col("_doc.doc_id").eqNullSafe(F.col("_keep"))
    left = packed.join(F.broadcast(often), "_sha", "left").where(stays).withColumnsRenamed({"_keep": "_often", "_ties": "_often_ties"})
    left = left.hint("merge").join(seldom, "_sha", "left").where(stays)
    kept = left.where(F.coalesce("_ties", "_often_ties", F.lit(1)) == 1).select("_doc.*")
    if often.where("_ties > 1").isEmpty() and seldom.where("_ties > 1").isEmpty():
        return kept
    tied = left.where(F.coalesce("_ties", "_often_ties", F.lit(1)) > 1).groupBy("_sha").agg(F.first("_doc").alias("_doc"))
    return kept.unionByName(tied.select("_doc.*"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(read(spark, sf_dir, "documents"))


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
