"""Removal of repeated 20-word passages by recompression.

Texts become symbols, one 64-bit name per word. Rounds of recompression then name runs of a symbol (a, length) and pairs
(a, b) of a symbol of the left class followed by one of the right class; a symbol's class in a round is a bit of its
hash. Names are hashes of what they stand for, so every task of the Spark round names equal things alike without
exchanging dictionaries. Each symbol carries the words its existence depends on; a symbol is *interior* to a window if
these lie in the window, and then every equal window has it, at the same place. Each window picks its highest interior
symbol (the longest, then by hash). Neighbouring windows mostly pick the same one, which makes an anchor row: symbol,
document, first window, and 48 bits of each window's own hash for verification. Windows of equal anchors (64 bits) and
equal hashes are equal; all but the earliest are repeats.

Rows travel packed: a chunk of about CHUNK words first resolves repeats within itself and emits each distinct window
once, so that a passage in a third of all documents gives a row per chunk and not per document. A task remembers up to
SEEN windows that it sent, those that came again longest: a window with an earlier place among them is a repeat at once
and needs no row, so that a passage in most chunks gives a few rows per task. Anchors go to buckets by symbol, a blob
for each bucket and chunk. Buckets are sized by the input. Removed windows return as ranges per document, and documents
are cut in a last pass.

Order is by doc_id, then start. Edge cases: null texts have no words; documents of equal doc_id are one in that order:
a window counts as earlier only if (doc_id, start) is smaller, so repeated rows of one doc_id keep what they share at
the same place (rows of one doc_id are told apart by the crc32 of their texts); a null doc_id comes before all others; texts under 20 words lose nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import input_bytes, materialize, read, release

WINDOW, ROUNDS, CHUNK = 20, 6, 400_000
#: Bytes of input files to a bucket of anchors; its rows take about twice as much.
BUCKET_BYTES, LEAST_BUCKETS = 4 << 20, 8
#: Windows that a task remembers, of about 30 bytes each.
SEEN = 1 << 20
#: Bytes of a window's own hash that travel with its anchor.
CHECKED = 6
NULL_ID = np.iinfo(np.int64).min
U = np.uint64
_rng = np.random.default_rng(40)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_ODD = int(_rng.integers(0, 1 << 63)) * 2 + 1
_INVERSE = pow(_ODD, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


def _range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each values[start:end], wherever it stands."""
    n = len(values)
    prefix = np.concatenate([np.zeros(1, U), np.cumsum(values * _powers(_ODD, n))])
    return mixed((prefix[ends] - prefix[starts]) * _powers(_INVERSE, n + 1)[starts] + (ends - starts).astype(U))


def word_names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit name for each word of all texts, the number of words before each text)."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    space = _SPACE[raw]
    inside = ~space
    starts = np.flatnonzero(inside & np.r_[True, space[:-1]]) if len(raw) else np.empty(0, np.int64)
    ends = np.flatnonzero(inside & np.r_[space[1:], True]) + 1 if len(raw) else np.empty(0, np.int64)
    limits = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return _range_hash(_BYTE[raw], starts, ends), np.searchsorted(starts, limits)


def _compress(name, start, end, lo, hi, doc, seed):
    """One round: runs, then pairs. Returns the new sequence and which of its symbols are new."""
    # runs
    same = (name[1:] == name[:-1]) & (doc[1:] == doc[:-1])
    first = np.flatnonzero(np.r_[True, ~same])
    last = np.r_[first[1:], len(name)] - 1
    k = last - first + 1
    # a run, or being in none, depends on the symbols at both sides; one at a text's edge depends on what isn't there
    left, right = np.maximum(first - 1, 0), np.minimum(last + 1, len(name) - 1)
    lone = (doc[left] != doc[first]) | (first == 0) | (doc[right] != doc[first]) | (last == len(name) - 1)
    run = k > 1
    name = np.where(run, mixed(name[first] + U(0x9E3779B97F4A7C15) * k.astype(U)), name[first])
    low, high = np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)
    low, high = np.minimum(low, np.minimum(lo[left], lo[right])), np.maximum(high, np.maximum(hi[left], hi[right]))
    lo, hi = np.where(lone, -1, low), np.where(lone, 1 << 62, high)
    start, end, doc, new = start[first], end[last], doc[first], run
    # pairs
    right_class = (mixed(name ^ U(seed)) >> U(40)) & U(1) == 1
    next_same = doc[1:] == doc[:-1]
    pair = np.r_[~right_class[:-1] & right_class[1:] & next_same, False]
    second = np.r_[False, pair[:-1]]
    # who stays alone depends on the neighbour that it could have met
    lo2, hi2 = lo.copy(), hi.copy()
    alone = ~pair & ~second
    meets_next, meets_last = alone & ~right_class, alone & right_class
    ahead = np.flatnonzero(meets_next)
    ok = (ahead + 1 < len(name)) & (doc[np.minimum(ahead + 1, len(name) - 1)] == doc[ahead])
    nxt = np.minimum(ahead + 1, len(name) - 1)
    lo2[ahead] = np.where(ok, np.minimum(lo[ahead], lo[nxt]), -1)
    hi2[ahead] = np.where(ok, np.maximum(hi[ahead], hi[nxt]), 1 << 62)
    back = np.flatnonzero(meets_last)
    prv = np.maximum(back - 1, 0)
    ok = (back > 0) & (doc[prv] == doc[back])
    lo2[back] = np.where(ok, np.minimum(lo[back], lo[prv]), -1)
    hi2[back] = np.where(ok, np.maximum(hi[back], hi[prv]), 1 << 62)
    at = np.flatnonzero(pair)
    name = name.copy()
    end, new = end.copy(), new.copy()
    name[at] = mixed(name[at] * U(0xD6E8FEB86659FD93) + mixed(name[at + 1]) + U(1))
    lo2[at], hi2[at] = np.minimum(lo[at], lo[at + 1]), np.maximum(hi[at], hi[at + 1])
    end[at] = end[at + 1]
    new[at] = True
    keep = ~second
    return name[keep], start[keep], end[keep], lo2[keep], hi2[keep], doc[keep], new[keep]


def anchors(names: np.ndarray, bounds: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """For each window, by its first word: (is it one of a text, the name of its highest interior symbol, 0 for none)."""
    n = len(names)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    ends = bounds[1:][doc]
    valid = np.arange(n) + window <= ends
    levels = window.bit_length()
    best = [np.zeros(n + window, U) for _ in range(levels)]
    word = np.arange(n)
    state = (names, word, word + 1, word, word + 1, doc, np.zeros(n, bool))
    for r in range(rounds):
        if len(state[0]) < 2:
            break
        state = _compress(*state[:6], 0xA24BAED4963EE407 * (r + 1) & (1 << 64) - 1)
        name, start, end, lo, hi, _, new = state
        use = np.flatnonzero(new & (lo >= 0) & (hi - lo <= window))
        # windows hi-window .. lo have the symbol inside; two overlapping powers of two cover the range
        first = np.maximum(hi[use] - window, 0)
        size = lo[use] - first + 1
        key = ((end[use] - start[use]).astype(U) << U(58)) | (mixed(name[use]) >> U(6))
        power = np.frexp(size.astype(np.float64))[1] - 1
        for p in np.unique(power):
            some = power == p
            np.maximum.at(best[p], first[some], key[some])
            np.maximum.at(best[p], lo[use][some] + 1 - (1 << int(p)), key[some])
    for p in range(levels - 1, 0, -1):
        half = 1 << (p - 1)
        np.maximum(best[p - 1], best[p], out=best[p - 1])
        np.maximum(best[p - 1][half:], best[p][:-half], out=best[p - 1][half:])
    return valid, best[0][:n]


def _first_of_equal(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by the keys, the last varying fastest; where a new value of the first key begins)."""
    order = np.lexsort(keys[::-1])
    k = keys[0][order]
    return order, np.r_[True, k[1:] != k[:-1]][: len(k)]


class Seen:
    """Windows that a task has sent, by hash, with the earliest place of each. Forgetting some only costs rows."""

    def __init__(self, most: int = SEEN):
        self.most, self.turn = most, 0
        self.hash, self.id, self.start = np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int32)
        self.worth = np.empty(0, np.int32)

    def earlier(self, hash: np.ndarray, id: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which windows were sent from an earlier place; equal hashes must come from one place."""
        found = np.zeros(len(hash), bool)
        if not len(hash):
            return found
        self.turn += 1
        new, back = np.unique(hash, return_index=True)
        nid, nstart = id[back], start[back].astype(np.int32)
        at = np.searchsorted(self.hash, new)
        known = np.zeros(len(new), bool)
        inside = at < len(self.hash)
        known[inside] = self.hash[at[inside]] == new[inside]
        old = at[known]
        before = (self.id[old] < nid[known]) | ((self.id[old] == nid[known]) & (self.start[old] < nstart[known]))
        late = new[known][before]
        if len(late):
            place = np.minimum(np.searchsorted(late, hash), len(late) - 1)
            found = late[place] == hash
        self.id[old], self.start[old] = np.where(before, self.id[old], nid[known]), np.where(before, self.start[old], nstart[known])
        # a window that comes again lives one turn longer each time, counted from now
        self.worth[old] = np.maximum(self.worth[old], self.turn) + 1
        fresh = ~known
        parts = (new, nid, nstart, np.full(len(new), self.turn, np.int32))
        merged = [np.concatenate([a, b[fresh]]) for a, b in zip((self.hash, self.id, self.start, self.worth), parts)]
        if len(merged[0]) > self.most:
            stay = np.argpartition(merged[3], len(merged[3]) - self.most)[-self.most :]
            merged = [a[stay] for a in merged]
        order = np.argsort(merged[0], kind="stable")
        self.hash, self.id, self.start, self.worth = (a[order] for a in merged)
        return found


def chunk_rows(ids: np.ndarray, texts: list[bytes], seen: Seen, window: int = WINDOW):
    """A chunk's (repeats of its own or of what was sent before: document places and starts; windows to send with their anchors)."""
    order = np.argsort(ids, kind="stable")
    ids, texts = ids[order], [texts[i] for i in order]
    names, bounds = word_names(texts)
    if not len(names):
        return None
    valid, symbol = anchors(names, bounds, window)
    at = np.flatnonzero(valid)
    if not len(at):
        return None
    doc = np.searchsorted(bounds, at, side="right") - 1
    start = at - bounds[doc]
    whole = _range_hash(names, at, at + window)
    # windows without an interior symbol are their own
    name = np.where(symbol[at] == 0, whole, symbol[at])
    # rank of (doc_id, start) decides; windows that tie in both are all first
    crc = np.array([zlib.crc32(t) for t in texts], np.int64)
    by, new = _first_of_equal(whole, ids[doc], start, crc[doc])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    first = np.zeros(len(at), bool)
    first[by] = (ids[doc[by]] == ids[doc[by[head]]]) & (start[by] == start[by[head]])
    lead = np.zeros(len(at), bool)  # of those that tie, one of each text goes on
    lead[by] = first[by] & (new | np.r_[True, crc[doc[by]][1:] != crc[doc[by]][:-1]])
    go = np.flatnonzero(lead)
    sent = seen.earlier(whole[go], ids[doc[go]], start[go])
    # ranges are by doc_id and text, so that one of several equal rows speaks for all
    repeat, go = ~first, go[~sent]
    repeat[np.flatnonzero(lead)[sent]] = True
    return ids, crc, (doc[repeat], start[repeat]), (doc[go], start[go], name[go], whole[go])


def _ranges(ids, crc, doc, start, window):
    """Removed words as ranges of consecutive windows: (doc_id, crc, from, to)."""
    if not len(doc):
        return (np.empty(0, np.int64),) * 4
    edge = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)]
    f = np.flatnonzero(edge)
    l = np.r_[f[1:], len(doc)] - 1
    return ids[doc[f]], crc[doc[f]], start[f], start[l] + window


ROW = np.dtype([("name", "<u8"), ("id", "<i8"), ("crc", "<u4"), ("start", "<i4"), ("n", "<u4")])


def emit(buckets: int, window: int = WINDOW):
    """mapInArrow: (doc_id, text) -> (bucket, rows, hashes, id, from, to); repeats within a chunk have ranges and a null bucket's place."""

    def flush(ids: list[int], texts: list[bytes], seen: Seen) -> Iterator[pa.RecordBatch]:
        found = chunk_rows(np.array(ids, np.int64), texts, seen, window)
        if found is None:
            return
        ids_, crc, (rdoc, rstart), (doc, start, name, whole) = found
        gone = _ranges(ids_, crc, rdoc, rstart, window)
        blobs = []
        if len(doc):
            # consecutive windows of one anchor make one row
            edge = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (name[1:] != name[:-1])]
            f = np.flatnonzero(edge)
            n = np.diff(np.r_[f, len(doc)])
            rows = np.empty(len(f), ROW)
            rows["name"], rows["id"], rows["crc"], rows["start"], rows["n"] = name[f], ids_[doc[f]], crc[doc[f]], start[f], n
            bucket = (mixed(rows["name"]) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            short = np.ascontiguousarray(whole.view(np.uint8).reshape(-1, 8)[:, :CHECKED])
            take = np.repeat(f[order] - np.r_[0, np.cumsum(n[order])[:-1]], n[order]) + np.arange(n.sum())
            short, rows, bucket = short[take], rows[order], bucket[order]
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            stop = np.r_[cut[1:], len(bucket)]
            edges = np.r_[0, np.cumsum(rows["n"].astype(np.int64))]
            blobs = [(int(bucket[a]), rows[a:b].tobytes(), short[edges[a] : edges[b]].tobytes()) for a, b in zip(cut, stop)]
        # ranges found here go through the same exchange, spread by place
        size = 4_096
        for k in range(0, len(gone[0]), size):
            part = np.stack([g[k : k + size] for g in gone]).astype("<i8").tobytes()
            blobs.append(((int(ids_[0]) + k // size) % buckets, None, part))
        if blobs:
            yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in blobs], pa.int64()), pa.array([b[1] for b in blobs], pa.binary()), pa.array([b[2] for b in blobs], pa.binary())], ["bucket", "rows", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[bytes] = []
        size, seen = 0, Seen()
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                ids.append(NULL_ID if i is None else i)
                texts.append(t or b"")
                size += len(t or b"")
                if size >= 6 * CHUNK:
                    yield from flush(ids, texts, seen)
                    ids, texts, size = [], [], 0
        if ids:
            yield from flush(ids, texts, seen)
        release()

    return run


def settle(table: pa.Table) -> pa.Table:
    """A bucket's anchors -> ranges (doc_id, text's crc, from, to) of all windows but the earliest of equal ones."""
    window = WINDOW
    gone, raws, shorts = [], [], []
    for rows, hashes in zip(table.column("rows"), table.column("hashes")):
        if rows.as_py() is None:
            gone.append(np.frombuffer(hashes.as_py(), "<i8").reshape(4, -1))
        else:
            raws.append(np.frombuffer(rows.as_py(), ROW))
            shorts.append(np.frombuffer(hashes.as_py(), np.uint8).reshape(-1, CHECKED))
    if raws:
        rows, short = np.concatenate(raws), np.concatenate(shorts)
        del raws, shorts
        n = rows["n"].astype(np.int64)
        # only names that stand twice or more can have repeats
        order = np.argsort(rows["name"], kind="stable")
        same = rows["name"][order][1:] == rows["name"][order][:-1]
        many = np.zeros(len(rows), bool)
        many[order[1:][same]] = many[order[:-1][same]] = True
        keep = np.repeat(many, n)
        short, rows = short[keep], rows[many]
        n = n[many]
        wide = np.zeros((len(short), 8), np.uint8)
        wide[:, :CHECKED] = short
        row = np.repeat(np.arange(len(rows)), n)
        start = rows["start"][row].astype(np.int64) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        ids, crc = rows["id"][row], rows["crc"][row].astype(np.int64)
        key = mixed(rows["name"][row]) ^ mixed(wide.view("<u8").ravel())
        by, new = _first_of_equal(key, ids, start)
        head = by[np.flatnonzero(new)[np.cumsum(new) - 1]]
        out = by[(ids[by] != ids[head]) | (start[by] != start[head])]
        out = out[np.lexsort((start[out], crc[out], ids[out]))]
        if len(out):
            d, c, s = ids[out], crc[out], start[out]
            f = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (c[1:] != c[:-1]) | (s[1:] != s[:-1] + 1)])
            gone.append(np.stack([d[f], c[f], s[f], s[np.r_[f[1:], len(d)] - 1] + window]))
    all_ = np.concatenate(gone, axis=1) if gone else np.empty((4, 0), np.int64)
    return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("_id", "_crc", "_from", "_to"), all_)})


def repeated_ranges(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id and its removed word ranges, an array of from * 2**32 + to; written. A null doc_id is NULL_ID here."""
    buckets = max(LEAST_BUCKETS, -(-input_bytes(docs) // bucket_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = rows.mapInArrow(emit(buckets), "bucket long, rows binary, hashes binary")
    ranges = packed.groupBy("bucket").applyInArrow(settle, "_id long, _crc long, _from long, _to long")
    found = ranges.groupBy("_id", "_crc").agg(F.collect_list(F.shiftleft("_from", 32) + F.col("_to")).alias("_ranges"))
    return materialize(found, "ranges")


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, _ranges) -> (doc_id, n_words, n_removed, kept), kept words joined by one space."""
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for t, ranges in zip(batch.column("text").cast(pa.binary()), batch.column("_ranges")):
            words = (t.as_py() or b"").split()
            left, at = [], 0
            for r in sorted(ranges.as_py() or ()):
                if r >> 32 > at:
                    left += words[at : r >> 32]
                at = max(at, r & 0xFFFFFFFF)
            left += words[at:]
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept, the text that is left."""
    found = repeated_ranges(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    same = (F.coalesce("doc_id", F.lit(int(NULL_ID))) == F.col("_id")) & (F.coalesce(F.crc32("text"), F.lit(0)) == F.col("_crc"))
    # a hint keeps one plan at every size: texts meet their ranges by shuffle
    joined = rows.hint("merge").join(found, same, "left").select("doc_id", "text", "_ranges")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
