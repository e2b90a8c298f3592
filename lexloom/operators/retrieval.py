"""Corpus scoring, rank fusion and ranking metrics as relational plans.

Corpora are (doc_id, text), ranked lists (list_id, pos, id, score), relevance (id, gain).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.native import tokens


#: Tokens counted together.
TOKENS = 1 << 20


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, words), rows of one doc_id beside each other -> (term, docs, tfs): a row for each term of a stretch of documents."""
    held = None

    def packed(counts: pa.Table) -> Iterator[pa.RecordBatch]:
        lists = counts.group_by("term", use_threads=False).aggregate([("doc_id", "list"), ("tf_sum", "list")])
        yield from lists.select(["term", "doc_id_list", "tf_sum_list"]).rename_columns(["term", "docs", "tfs"]).to_batches(10_000)

    for batch in batches:
        words = batch.column("words")
        ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy())
        first = 0
        while first < len(batch):
            before = ends[first - 1] if first else 0
            after = max(first + 1, int(np.searchsorted(ends, before + TOKENS, "right")))
            ids, some = (batch.column(k).slice(first, after - first) for k in ("doc_id", "words"))
            first = after
            flat = pa.table({"doc_id": ids.take(pc.list_parent_indices(some)), "term": pc.list_flatten(some)})
            flat = flat.append_column("tf_sum", pa.array(np.ones(len(flat), np.int64)))
            flat = flat if held is None else pa.concat_tables([held, flat])
            counts = flat.group_by(["doc_id", "term"], use_threads=False).aggregate([("tf_sum", "sum")])
            counts = counts.select(["doc_id", "term", "tf_sum_sum"]).rename_columns(["doc_id", "term", "tf_sum"])
            # the last document may go on
            last = pc.is_null(counts["doc_id"]) if not ids[-1].is_valid else pc.fill_null(pc.equal(counts["doc_id"], ids[-1]), False)
            held = counts.filter(last)
            yield from packed(counts.filter(pc.invert(last)))
    if held is not None:
        yield from packed(held)


def tf_idf(docs: DataFrame) -> DataFrame:
    """tf * (ln((1 + N) / (1 + df)) + 1) of each document's terms.

    Texts meet by doc_id, as they are shorter than their counts; counts meet their df packed by term, a row for each stretch of
    documents, so that frequent terms have many rows, which AQE splits as any skewed join side."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").repartition("doc_id").sortWithinPartitions("doc_id").select("doc_id", tokens(F.col("text")).alias("words"))
    counts = rows.mapInArrow(_postings, f"term string, docs array<{kind}>, tfs array<long>")
    df = counts.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    score = F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    each = counts.join(df, "term").select("term", "df", F.inline(F.arrays_zip(F.col("docs").alias("doc_id"), F.col("tfs").alias("tf"))))
    return each.crossJoin(F.broadcast(n)).select("doc_id", "term", "tf", "df", score.alias("score"))


def _times(term: str) -> Column:
    return F.size(F.filter("_t", lambda x: x == F.lit(term)))


def bm25_rank(docs: DataFrame, query: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """doc_id, score: every document, 0.0 without a query term. Only the query's terms leave the scan."""
    asked = docs.sparkSession.range(1).select(F.array_distinct(tokens(F.lit(query))).alias("terms")).first()[0]
    rows = docs.select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("_t"))
    rows = rows.select("doc_id", F.size("_t").alias("_len"), *(_times(t).alias(f"_tf{i}") for i, t in enumerate(asked)))
    total = rows.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *(F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(asked))))
    score = F.lit(0.0)
    for i in range(len(asked)):
        tf, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))
    return rows.crossJoin(F.broadcast(total)).select("doc_id", F.coalesce(score, F.lit(0.0)).alias("score"))


def first_positions(lists: DataFrame, *keep: str) -> DataFrame:
    """Each id's first place in each list, ranks from 1 without the repeats."""
    first = lists.groupBy("list_id", "id").agg(F.min("pos").alias("pos"), *(F.min_by(c, "pos").alias(c) for c in keep))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("list_id").orderBy("pos")))


def _weighted(first: DataFrame, weights: dict | None) -> DataFrame:
    """first with _w, the weight of its list: 1 unless given. Weights are above zero and finite."""
    if weights is None:
        return first.withColumn("_w", F.lit(1.0))
    if not all(0 < w < float("inf") for w in weights.values()):
        raise ValueError("weights must be above zero and finite")
    given = first.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()], "_list string, _given double")
    # as many rows as weights were written down
    joined = first.join(F.broadcast(given), F.col("list_id").cast("string") == F.col("_list"), "left")
    return joined.withColumn("_w", F.coalesce("_given", F.lit(1.0))).drop("_list", "_given")


def rank_fuse(lists: DataFrame, k: int = 60, weights: dict | None = None) -> DataFrame:
    """Reciprocal rank fusion: id, score = sum of weight / (k + rank); weights by list_id."""
    return _weighted(first_positions(lists), weights).groupBy("id").agg(F.sum(F.col("_w") / (k + F.col("rank"))).alias("score"))


def score_fuse(lists: DataFrame, method: str = "combmnz", weights: dict | None = None, k: int | None = None) -> DataFrame:
    """id, score by combmnz, linear (both on min-max scores, 0.5 where a list has no range) or borda; weights by list_id.

    borda: a list's n ids get (n - rank) / n. k keeps the best ids only, ties by id."""
    first = _weighted(first_positions(lists, "score"), weights)
    if method == "borda":
        sizes = first.groupBy("list_id").agg(F.count("*").alias("_n"))
        out = first.join(sizes, "list_id").groupBy("id").agg(F.sum(F.col("_w") * (F.col("_n") - F.col("rank")) / F.col("_n")).alias("score"))
    else:
        ranges = first.groupBy("list_id").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
        scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5)
        total = F.sum(F.col("_w") * scaled) * (F.count("*") if method == "combmnz" else F.lit(1))
        out = first.join(ranges, "list_id").groupBy("id").agg(total.alias("score"))
    return out if k is None else out.orderBy(F.desc("score"), "id").limit(k)


def metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """One row per list_id: mrr, recall, precision and ndcg at k. ranked (list_id, rank, id), relevant (id, gain)."""
    # the k best of each task, then of those: only k rows meet in one task
    best = relevant.orderBy(F.desc("gain"), "id").limit(k).withColumn("_r", F.row_number().over(Window.orderBy(F.desc("gain"), "id")))
    ideal = best.agg(F.sum(F.col("gain") / F.log2(F.col("_r") + 1)).alias("_ideal"))
    size = relevant.agg(F.count("*").alias("_all"))
    hit = ranked.join(relevant, "id", "left").withColumn("_in", F.col("gain").isNotNull() & (F.col("rank") <= k))
    out = hit.groupBy("list_id").agg(
        F.coalesce(1.0 / F.min(F.when(F.col("gain").isNotNull(), F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.count_if("_in").alias("_hits"),
        F.sum(F.when(F.col("_in"), F.col("gain") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("_dcg"),
    )
    out = out.crossJoin(F.broadcast(ideal)).crossJoin(F.broadcast(size))
    return out.select("list_id", "mrr", (F.col("_hits") / F.col("_all")).alias("recall"), (F.col("_hits") / F.lit(k)).alias("precision"), (F.col("_dcg") / F.col("_ideal")).alias("ndcg"))
