"""Mixing sources to target weights in fixed-length blocks.

1. Each source's documents, in a pseudorandom order by a hash of doc_id and text, make one stream of words; a document's start in it comes from
   prefix sums over buckets of the order and within them, so that no task holds a whole source.
2. The stream is cut into blocks of BLOCK words (the last may be short); a piece is a document's part of a block.
3. Targets are shared out by weight; what a source can't give within `limit` passes is shared among the others.
4. Each output shard draws its number of slots per source from a multinomial whose weights are what the sources still
   owe, so that totals meet the targets exactly.
5. A source's slot j maps to block p(j mod n) of pass j div n, p a keyed Feistel permutation of the block numbers for that pass.
6. Slots join pieces by source and block number.

What is kept on the driver is a number per source, and per source and shard; sources are what weights are given for, and
more than SOURCES are refused.

Edge cases: a null text has no words and takes part in nothing; a null source is a source like others, last in order;
repeated rows are documents of their own; an empty table or one without words gives no slots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import WORD, materialize, read, release

WEIGHTS, SHARE, LIMIT = (5.0, 2.0, 1.0), 1.5, 2.0
BLOCK, SHARDS, SEED, ROWS_PER_BUCKET = 128, 64, 20, 4_096
ROUNDS = 4
#: Sources that the driver takes at most, and slots to a task.
SOURCES, TASK_SLOTS = 20_000, 1 << 18


def n_words(text: str) -> Column:
    """Words of a text: starts of runs of characters other than the six separators."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def share_out(sizes: list[int], weights: list[float], total: float, limit: float) -> list[float]:
    """Targets in proportion to weights, none above limit * size; the excess is reshared until none is."""
    target, full = [0.0] * len(sizes), [s == 0 for s in sizes]
    while not all(full):
        left = total - sum(t for t, f in zip(target, full) if f)
        open_weight = sum(w for w, f in zip(weights, full) if not f)
        for i, w in enumerate(weights):
            if not full[i]:
                target[i] = left * w / open_weight
        over = [i for i, f in enumerate(full) if not f and target[i] > limit * sizes[i]]
        if not over:
            break
        for i in over:
            target[i], full[i] = limit * sizes[i], True
    return target


def draw_slots(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """slots[s] places of source s dealt to shards of near equal size: a multinomial draw per shard among what is still owed."""
    rng, owed = np.random.default_rng(seed), np.array(slots, np.int64)
    total, out = int(owed.sum()), np.zeros((shards, len(slots)), np.int64)
    for k in range(shards):
        want = total * (k + 1) // shards - total * k // shards
        while want:
            drawn = np.minimum(rng.multinomial(want, owed / owed.sum()), owed)
            out[k] += drawn
            owed -= drawn
            want -= int(drawn.sum())
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The places of indexes under keyed pseudorandom permutations of 0..size-1.

    A Feistel network over the least even number of bits that holds size - 1; what falls outside goes through again
    until it falls inside (cycle walking).
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    size, key = size.astype(np.uint64), _mix(key.astype(np.uint64))
    while len(todo):
        a, b = out[todo] >> half[todo], out[todo] & mask[todo]
        for r in range(ROUNDS):
            a, b = b, a ^ (_mix(b + key[todo] + np.uint64(r)) & mask[todo])
        out[todo] = (a << half[todo]) | b
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def _permuted(index: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permute(index.to_numpy(), size.to_numpy(), key.to_numpy()))


def place(rows: DataFrame, seed: int = SEED) -> tuple[DataFrame, list[dict]]:
    """rows (_row, doc_id, _text, source, size) -> (written rows with _src and _start, sources by rank: size and target).

    _text is a hash of the text: with doc_id it gives a row's place, whatever files and tasks the rows come in; _row only
    tells rows apart that are equal in both."""
    spark = rows.sparkSession
    found = [(r[0], r[1]) for r in rows.groupBy("source").agg(F.sum("size")).limit(SOURCES + 1).collect()]
    if len(found) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources: weights are for sources in this number")
    found.sort(key=lambda x: (x[0] is None, x[0] or ""))
    total = sum(n for _, n in found)
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(found))]
    targets = share_out([n for _, n in found], weights, SHARE * total, LIMIT)
    sources = [{"source": s, "size": n, "target": t} for (s, n), t in zip(found, targets)]
    ranks = spark.createDataFrame([(s, i) for i, (s, _) in enumerate(found)], "_name string, _src int")
    keyed = rows.join(F.broadcast(ranks), F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    buckets = 1 + rows.count() // ROWS_PER_BUCKET
    keyed = keyed.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "_text")).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    sums = keyed.groupBy("_src", "_b").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("_src").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_src", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_src", "_b").orderBy("_h", "_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, ["_src", "_b"])
    return materialize(placed.withColumn("_start", F.col("_base") + F.col("_in")).drop("_h", "_b", "_in", "_base", "_text"), "placed"), sources


def mix(placed: DataFrame, sources: list[dict], block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix: one row for each piece of each slot: shard, slot, _src, pass, block, _row, at (first word in the document), length."""
    spark = placed.sparkSession
    blocks = [-(-s["size"] // block) for s in sources]
    # a block holds size / blocks words on average
    slots = [min(int(LIMIT) * n, round(s["target"] * n / s["size"])) if n else 0 for s, n in zip(sources, blocks)]
    drawn = draw_slots(slots, shards, seed)
    before = np.cumsum(drawn, axis=0) - drawn
    table = [
        (k, i, int(drawn[k, i]), int(before[k, i]), int(drawn[k, :i].sum()), blocks[i])
        for k in range(shards)
        for i in range(len(sources))
        if drawn[k, i]
    ]
    counts = spark.createDataFrame(table, "shard int, _src int, _n long, _from long, _slot long, _blocks long")
    # slots of one row are one shard's of one source; its numbers are spread over tasks as ranges
    step = 4_096
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(slots) // TASK_SLOTS)
    spread = counts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(step).cast("long"))).alias("_lo")).repartition(tasks, "shard", "_src", "_lo")
    each = spread.select("*", F.explode(F.sequence("_lo", F.least(F.col("_lo") + step, F.col("_n")) - 1)).alias("_i"))
    each = each.select("shard", (F.col("_slot") + F.col("_i")).alias("slot"), "_src", (F.col("_from") + F.col("_i")).alias("_j"), "_blocks")
    each = each.withColumn("pass", F.floor(F.col("_j") / F.col("_blocks")).cast("long"))
    key = F.xxhash64(F.lit(seed), "_src", "pass")
    chosen = each.select("shard", "slot", "_src", "pass", F.pandas_udf(_permuted, "long")(F.pmod("_j", "_blocks"), "_blocks", key).alias("block"))
    first, last = F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("size") - 1) / block)
    pieces = placed.where("size > 0").select("_row", "_src", "_start", "size", F.explode(F.sequence(first, last)).alias("block"))
    at = F.greatest(F.lit(0).cast("long"), F.col("block") * block - F.col("_start"))
    end = F.least(F.col("size"), (F.col("block") + 1) * block - F.col("_start"))
    pieces = pieces.select("_row", "_src", "block", at.alias("at"), (end - at).alias("length"))
    # a size estimate that knows nothing of the exploded ranges would broadcast the slots
    return pieces.hint("merge").join(chosen, ["_src", "block"])


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.xxhash64("text").alias("_text"), "source", n_words("text").alias("size"))
    placed, sources = place(materialize(rows, "sizes"))
    taken = mix(placed, sources).groupBy("_row").agg(F.sum("length").alias("taken"))
    totals = spark.createDataFrame([(i, s["size"], s["target"]) for i, s in enumerate(sources)], "_src int, source_size long, target double")
    return placed.join(F.broadcast(totals), "_src").join(taken, "_row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: a row for each document and pass that takes some of it, with the taken words as text.

    Neighbouring pieces keep the white space between their words; others are joined by a newline. n_chars follows.
    """
    columns = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_doc"), F.monotonically_increasing_id().alias("_row"))
    rows = materialize(rows, "numbered")
    sizes = rows.select("_row", F.col("_doc.doc_id").alias("doc_id"), F.xxhash64("_doc.text").alias("_text"), F.col("_doc.source").alias("source"), n_words("_doc.text").alias("size"))
    placed, sources = place(materialize(sizes, "sizes"))
    spans = mix(placed, sources).groupBy("_row", "pass").agg(F.array_sort(F.collect_list(F.shiftleft("at", 32) + F.col("length"))).alias("_spans"))
    spans = materialize(spans, "spans")
    # a hint keeps one plan at every size: a document's rows meet its spans by shuffle
    together = rows.hint("merge").join(spans.select("_row", "_spans"), "_row")
    kind = together.schema["_doc"].dataType.simpleString()
    taken = together.select("_doc", "_spans").mapInArrow(_taken_text, f"_doc {kind}, _text string")
    out = [F.col("_text").alias(c) if c == "text" else F.char_length("_text").cast("long").alias(c) if c == "n_chars" else F.col("_doc")[c].alias(c) for c in columns]
    return taken.select(*out)


def _taken_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_doc, _spans: at * 2**32 + length) -> (_doc, _text), some rows at a time."""

    def one(t: str, parts: list[int]) -> str:
        ends = [m.span() for m in WORD.finditer(t)]
        runs: list[list[int]] = []
        for p in parts:
            at, n = p >> 32, p & 0xFFFFFFFF
            if runs and runs[-1][1] == at:
                runs[-1][1] += n
            else:
                runs.append([at, at + n])
        return "\n".join(t[ends[a][0] : ends[b - 1][1]] for a, b in runs)

    for batch in batches:
        for i in range(0, len(batch), 1_000):
            some = batch.slice(i, 1_000)
            docs = some.column("_doc")
            texts = [one(t.as_py(), p.as_py()) for t, p in zip(docs.field("text"), some.column("_spans"))]
            yield pa.RecordBatch.from_arrays([docs, pa.array(texts, pa.string())], ["_doc", "_text"])
    release()
