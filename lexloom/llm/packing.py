"""Sum-of-squares packing of documents into sequences of fixed length.

A document longer than a sequence is cut from its end into full pieces, each a sequence by itself; the rest, its first
piece, is an item to pack. Items go to groups of about GROUP by a hash; each group is packed by itself, in descending
order of length: an item goes where the sum, over gaps, of the squared number of open sequences with that gap becomes
smallest. The sequences still open at the end are dissolved and their items placed by best fit. Sequences are never split over groups, so groups run anywhere and again. What a group's last open sequences
leave empty is its only loss, and GROUP is large against it.

Edge cases: a null text is empty and has its end id alone; ties and repeated rows are packed like others; a null doc_id
is a document like others; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import read, release
from lexloom.llm.tokens import MEMO, PART, encoder, slices

CAPACITY, GROUP = 1024, 131_072
PIECES = "doc_id long, piece int, start long, length long, ids binary"


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, memo: int = MEMO, part: int = PART) -> DataFrame:
    """doc_id, piece, start, length and ids (32-bit little-endian) of every piece; only the first may be short.

    memo and part bound a worker's memory, not the result: pieces of text kept, and bytes of text encoded together.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, end_id, 4, memo)
        for batch in batches:
            for some in slices(batch, part):
                ids, bounds = encode(some.column("text"))
                n = np.diff(bounds)
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = (n - (pieces - 1) * capacity)[doc]  # the first piece is what the full ones leave
                start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
                length = np.where(piece == 0, head, capacity)
                # pieces tile the ids
                offsets = np.r_[0, np.cumsum(length)].astype(np.int32) * 4
                raw = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), raw],
                    ["doc_id", "piece", "start", "length", "ids"],
                )
            release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each item, lengths at most the capacity, placed in the order given.

    Placing an item of length a into a sequence of gap g changes the sum of squares by 2 * (count[g-a] - count[g]) + 2,
    by 1 - 2 * count[a] if it fills the gap, and by 2 * count[capacity-a] + 1 for a new sequence.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, a in enumerate(lengths.tolist()):
        best, gap = (2 * int(count[capacity - a]) + 1 if a < capacity else 0), capacity
        here = count[a:]
        cost = np.where(here > 0, 2 * (count[: capacity + 1 - a] - here) + 2, np.iinfo(np.int64).max)
        if count[a]:
            cost[0] = 1 - 2 * count[a]
        k = int(cost.argmin())
        if cost[k] <= best:
            gap = a + k
        if gap == capacity and not open_[gap]:
            s, n = n, n + 1
        else:
            s = open_[gap].pop()
            count[gap] -= 1
        sequence[i], offset[i] = s, capacity - gap
        if gap > a:
            open_[gap - a].append(s)
            count[gap - a] += 1
    return sequence, offset


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each item, placed in the order given where the least gap remains."""
    gaps: list[tuple[int, int]] = []
    sequence, offset, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, a in enumerate(lengths.tolist()):
        k = bisect_left(gaps, (a, -1))
        gap, s = gaps.pop(k) if k < len(gaps) else (capacity, n)
        n += s == n
        sequence[i], offset[i] = s, capacity - gap
        if gap > a:
            insort(gaps, (gap - a, s))
    return sequence, offset


def place_all(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of squares first; the sequences that it leaves open, about one for each gap, are dissolved and their items
    placed by best fit, so that a small group too needs hardly more sequences than its tokens fill."""
    sequence, offset = sum_of_squares(lengths, capacity)
    fill = np.bincount(sequence, lengths).astype(np.int64)
    rest = fill[sequence] < capacity
    if rest.any():
        again, at = best_fit(lengths[rest], capacity)
        if again.max() < (fill < capacity).sum():
            number = np.cumsum(fill == capacity) - 1
            sequence = number[sequence]
            sequence[rest], offset[rest] = again + (fill == capacity).sum(), at
    return sequence, offset


def pack(pieces: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """pieces (at least doc_id, piece, length) with sequence_id and offset."""
    columns = [c for c in pieces.columns if c != "_group"]

    def place(table: pa.Table) -> pa.Table:
        group = table.column("_group")[0].as_py()
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sequence, offset = place_all(table.column("length").to_numpy(), capacity)
        out = table.drop_columns("_group")
        return out.append_column("sequence_id", pa.array(sequence + (group << 40))).append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes if c != "_group") + ", sequence_id long, offset long"
    keyed = pieces.select(*columns, F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(groups)).alias("_group"))
    return keyed.groupBy("_group").applyInArrow(place, schema)


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    return packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2)


def packed_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, group: int = GROUP, memo: int = MEMO, part: int = PART) -> DataFrame:
    """Every piece of docs with its place and the crc32 of its ids."""
    pieces = token_pieces(docs, vocabulary, end_id, capacity, memo, part)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(digests, 1 + docs.count() // group, capacity)
