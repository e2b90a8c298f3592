"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints: bit i is set if more than half of a text's 3-word shingle hashes (XXH64, seed 42) have it. Copies of a
fingerprint are folded first. Two fingerprints at BITS = 2 or fewer differing bits agree on one of three disjoint blocks,
so each goes to three groups, one per block, keyed by as many low bits of the block as leave about GROUP fingerprints to
a group (MOST bits at most). Within a group the index does the search: fingerprints sorted by Gray rank, every FAN
neighbours under a node that holds the bits on which all agree (mask and pattern), nodes under upper nodes that take
over the bits their children share. A search adds up a query's differences node by node, from the top, and drops whole
subtrees beyond BITS, and subtrees whose members it's already connected to, so that a dense group costs no square. A
group emits a star per connected part, not its pairs. A group above LARGE is split again, exactly: of three disjoint
parts of the other blocks, one must agree. Components of all stars give the classes.

Edge cases: null and empty texts, and texts without words, have fingerprint zero and are linked like any other; a null
doc_id is never the smallest unless it's alone; repeated rows link to one another; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import materialize, read, release
from lexloom.llm.components import components

BITS, SHINGLE, SEED, FAN = 2, 3, 42, 16
#: Fingerprints to a group, roughly; bits of a group's key at most; fingerprints beyond which a group is split.
GROUP, MOST, LARGE = 2_048, 21, 32_768
#: Groups to a task, and tasks at most.
TASK_GROUPS, TASKS = 16, 100_000


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and the six separators
    if not words:
        return 0
    if len(words) <= SHINGLE:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], "<u8")
    else:
        line, digest = b" ".join(words), xxhash.xxh64_intdigest
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-SHINGLE].tolist()]
        h = np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())], "<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the extra columns and _f, the fingerprint's bits as a long; written."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *extra, F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.fromiter((fingerprint(t.as_py()) for t in batch.column("_text")), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *extra)), pa.array(f.view(np.int64))], ["doc_id", *extra, "_f"])
        release()

    types = dict(rows.dtypes)
    return materialize(rows.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in ("doc_id", *extra)) + ", _f long"), "fingerprints")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def connect(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each the least index known to be connected) after links i-j."""
    while len(i):
        a, b = label[i], label[j]
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
    return label


class GrayIndex:
    """The hierarchical index of distinct codes; `links` finds who is within `bits` of whom."""

    def __init__(self, codes: np.ndarray, fan: int = FAN):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes, self.fan = codes[self.order], fan
        self.visited = self.pruned = self.compared = 0  # nodes seen, nodes dropped by differences, codes compared
        low, high = self.codes, self.codes  # AND and OR of the members
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (mask of shared bits, pattern), leaves' nodes first
        while len(low) > 1:
            starts = np.arange(0, len(low), fan)
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            self.levels.append((~(low ^ high), low))
        # what an upper node holds, those below it don't hold again
        for k in range(len(self.levels) - 1):
            above = np.repeat(self.levels[k + 1][0], fan)[: len(self.levels[k][0])]
            self.levels[k] = (self.levels[k][0] & ~above, self.levels[k][1])

    def connected(self, bits: int) -> np.ndarray:
        """For each code, in the order given, the place of a representative of its connected part."""
        n = len(self.codes)
        label = np.arange(n)
        step = max(16, (1 << 21) // max(1, len(self.levels[0][0]) if self.levels else 1))
        for lo in range(0, n, step):
            label = self._search(np.arange(lo, min(n, lo + step)), bits, label)
        out = np.empty(n, np.int64)
        out[self.order] = self.order[label]
        return out

    def _search(self, queries: np.ndarray, bits: int, label: np.ndarray) -> np.ndarray:
        n, depth = len(self.codes), len(self.levels)
        if not depth:
            return label
        # a node whose members all have one label needs no visit by a query of that label
        uniform, size = [], 1
        lo_label, hi_label = label, label
        for _ in range(depth):
            starts = np.arange(0, len(lo_label), self.fan)
            lo_label, hi_label = np.minimum.reduceat(lo_label, starts), np.maximum.reduceat(hi_label, starts)
            uniform.append(np.where(lo_label == hi_label, lo_label, -1))
        q, node, acc = queries, np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        for k in range(depth - 1, -1, -1):
            mask, pattern = self.levels[k]
            acc = acc + np.bitwise_count((self.codes[q] ^ pattern[node]) & mask[node])
            size = self.fan ** (k + 1)
            wanted = ((node + 1) * size > q + 1) & (uniform[k][node] != label[q])
            keep = (acc <= bits) & wanted
            self.visited += int(wanted.sum())
            self.pruned += int(wanted.sum() - keep.sum())
            q, node, acc = q[keep], node[keep], acc[keep]
            below = n if k == 0 else len(self.levels[k - 1][0])
            child = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
            q, acc = np.repeat(q, self.fan), np.repeat(acc, self.fan)
            real = child < below
            q, node, acc = q[real], child[real], acc[real]
        later = node > q
        q, node = q[later], node[later]
        self.compared += len(q)
        near = np.bitwise_count(self.codes[q] ^ self.codes[node]) <= bits
        return connect(label, q[near], node[near])


def group_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_g, _k, _f) sorted by group -> (a, b): each code that isn't its part's representative, and that."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def stars(g, k, f) -> pa.RecordBatch:
        edge = np.flatnonzero((g[1:] != g[:-1]) | (k[1:] != k[:-1])) + 1
        starts, ends = np.r_[0, edge], np.r_[edge, len(g)]
        many = ends - starts > 1
        a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for s, e in zip(starts[many].tolist(), ends[many].tolist()):
            codes = f[s:e]
            root = GrayIndex(codes).connected(BITS)
            other = root != np.arange(len(codes))
            a.append(codes[other])
            b.append(codes[root[other]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy().view(np.uint64) for c in ("_g", "_k", "_f")))
        g, k, f = (np.concatenate(x) for x in zip(*held))
        # the last group may go on in the next batch
        cut = np.flatnonzero((g != g[-1]) | (k != k[-1]))
        cut = int(cut[-1]) + 1 if len(cut) else 0
        if cut:
            yield stars(g[:cut], k[:cut], f[:cut])
        held = [(g[cut:], k[cut:], f[cut:])]
    if held and len(held[0][0]):
        yield stars(*held[0])


def key_bits(n: int, group: int = GROUP) -> int:
    """Bits of a group's key for n fingerprints."""
    return min(MOST, max(0, (n - 1) // group).bit_length())


def links(codes: DataFrame, group: int = GROUP, large: int = LARGE) -> DataFrame:
    """Distinct codes (_f, a written table) -> stars (a, b) of longs that connect all at BITS or fewer differences."""
    n = codes.count()
    width = key_bits(n, group)
    block = [F.shiftrightunsigned("_f", MOST * i).bitwiseAND((1 << MOST) - 1) for i in range(3)]
    others = [block[(i + 1) % 3] + F.shiftleft(block[(i + 2) % 3], MOST) for i in range(3)]
    keys = [F.struct(F.lit(i).cast("long").alias("_g"), block[i].bitwiseAND((1 << width) - 1).alias("_k"), others[i].alias("_x")) for i in range(3)]
    keyed = codes.select("_f", F.inline(F.array(*keys)))
    sizes = materialize(keyed.groupBy("_g", "_k").agg(F.count("*").alias("_n")).where(F.col("_n") > large), "large-groups")
    if sizes.isEmpty():
        keyed = keyed.select("_g", "_k", "_f")
    else:
        part = 2 * MOST // 3
        again = F.array(*(F.shiftright("_x", part * j).bitwiseAND((1 << part) - 1) + (j << part) + 1 for j in range(3)))
        parts = F.when(F.col("_n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(again)
        keyed = keyed.hint("merge").join(sizes, ["_g", "_k"], "left").select("_g", "_k", "_f", F.explode(parts).alias("_p"))
        keyed = keyed.select((F.col("_g") + F.col("_p") * 4).alias("_g"), "_k", "_f")
    # a group's work is more than its bytes tell: the number of tasks goes by groups
    tasks = min(TASKS, max(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * n // (TASK_GROUPS * group)))
    return keyed.repartition(tasks, "_g", "_k").sortWithinPartitions("_g", "_k").mapInArrow(group_stars, "a long, b long")


def classes(prints: DataFrame) -> DataFrame:
    """Fingerprints (doc_id, _f) -> (_f, _root, component_id) for each distinct fingerprint."""
    codes = materialize(prints.groupBy("_f").agg(F.min("doc_id").alias("_least")), "codes")
    roots = components(links(codes.select("_f"))).select(F.col("a").alias("_f"), F.col("b").alias("_root"))
    rooted = codes.hint("merge").join(roots, "_f", "left").select("_f", "_least", F.coalesce("_root", "_f").alias("_root"))
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    return materialize(rooted.select("_f", "_root").join(least, "_root"), "classes")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = fingerprints(read(spark, sf_dir, "documents"))
    # here and below, hints keep one plan at every size
    joined = prints.hint("merge").join(classes(prints), "_f")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("_f")), 16, "0").alias("fingerprint"), "component_id")


def near_deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one document of each class: that of the smallest doc_id (of rows that tie in it, one).

    Whole rows meet the dropped ones by shuffle, on doc_id and the text's hash."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"))
    ids = packed.select(F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.text").alias("text"), F.xxhash64("_doc.text").alias("_t"))
    prints = fingerprints(ids, ("_t",))
    found = prints.hint("merge").join(classes(prints), "_f")
    # rows are known by doc_id and text; of each class one such pair stays
    best = found.groupBy("_root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_t")).alias("_b"), F.count("*").alias("_n"))
    many = best.where("_n > 1").select("_root", F.col("_b.doc_id").alias("_id"), F.col("_b._t").alias("_bt"))
    tied = found.join(many, "_root").groupBy("doc_id", "_t", "_id", "_bt").agg(F.count("*").alias("_copies"))
    odd = tied.select("doc_id", "_t", (F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_bt"))).alias("_best"), "_copies")
    odd = materialize(odd.where("not _best or _copies > 1"), "dropped")
    match = F.col("_doc.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("_doc.text") == F.col("_t"))
    kept = packed.hint("merge").join(odd, match, "left_anti").select("_doc.*")
    again = odd.where("_best")
    if again.isEmpty():
        return kept
    one = packed.hint("merge").join(again, match).groupBy("doc_id", "_t").agg(F.first("_doc").alias("_doc"))
    return kept.unionByName(one.select("_doc.*"))
