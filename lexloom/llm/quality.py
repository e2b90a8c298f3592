"""Quality rules with an n-gram perplexity band per language.

The model is an interpolated modified Kneser-Ney bigram model of words (as written, nothing folded; a text's start is a
context of its own), trained on all texts of a language. Its size has no ceiling, so no task holds a model:

1. Tasks gather slices of texts of one language, name their words by hashes, store a slice's state (words, word
   numbers, base counts) in the shared folder and send its distinct bigrams with their counts to buckets by hash.
2. A bucket adds the counts up and answers each slice: the total of each bigram that it sent, and whether this slice is
   the bigram's owner, the one slice that counts it as a kind. Buckets are asked in TURNS, each for its share of them; a
   turn's shuffle files are deleted before the next, so that never all bigrams lie on disk at once.
3. A slice gathers for each of its words, from owned bigrams, how many kinds follow it (by total of 1, 2, more) and
   precede it, and how often it is a context; buckets by word add these up and answer in the same way.
4. With both answers and the language's discounts a slice scores its own texts, each under the counts of all texts but
   itself, so that words and bigrams that no other text has are unseen and get backoff's mass only (discounts are those
   of all texts). Log perplexity is by word.

Words are known by 48 bits of a hash, bigrams by KEY_BITS, so that of 10^8 bigrams hardly one pair is taken for one. Buckets
grow in number with the input; slices are bounded.

A document is judged by its log perplexity under the whole model and under the model's lowest order alone, in which a word
counts by the kinds of words before it. A language's bands limit the lowest order's below and above, and the whole model's
above. (The whole model's says nothing below: near copies of a clean text make each other's bigrams known, but hardly add
kinds.) Limits are fitted on all labelled rows (see fit): CLEAN_LOSS of the labelled clean rows that pass the base rules fall
outside, parted among the three ends so that the most labelled junk does. They are offsets from the medians of clean rows,
wider for texts under FULL_WORDS by the root of what they lack, as short texts scatter more. Languages of under
LEAST_LABELS such rows have quartiles of all that pass the base rules, FENCE interquartile ranges (of at least
LEAST_SPREAD) down and up.

Edge cases: null and empty texts have no words and fail the base rules; a null lang is a language of its own; ties and
repeated rows are scored alike; empty tables give no rows; very long texts are scored whole.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import discard, drop_kept, input_bytes, materialize, materialize_freed, new_path, read, release, small_enough
from lexloom.llm.substring_dedup import U, mixed, word_names

FENCE, LEAST_SPREAD, FULL_WORDS = 3.0, 0.01, 200
CLEAN_LOSS, LEAST_LABELS = 0.01, 100
MIN_WORDS, MAX_REPEAT = 50, 50
#: Characters that a task takes in before it sends a slice, or names words together.
SLICE, PART = 24_000_000, 1_000_000
#: Rows of a batch that are Python values together.
ROWS = 500
#: Words that are scored together, more only for a longer text.
TOKENS = 500_000
#: Bytes of input files to a bucket.
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 6
#: Turns in which slices ask the bigrams' buckets. More take less disk, and each makes all slices anew from their state.
TURNS = 2
#: Bits kept of a word's name, and of a bigram's hash; the hash's upper bits give its bucket.
KEY_BITS = 56
NAME = U((1 << 48) - 1)
_STATS = 5  # of a word: times a context, kinds that follow by total of 1, 2, more, kinds that precede


def pack(x: np.ndarray) -> bytes:
    """Whole numbers by planes of their bytes, compressed: high planes that are 0 take no room."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def pack_ascending(x: np.ndarray) -> bytes:
    return pack(np.diff(x.astype(np.int64), prepend=0))


def unpack_ascending(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw))


def _put(folder: str, parts: list[bytes]) -> str:
    """A new file of these parts; a task that runs twice writes two, and its rows name one."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    name = uuid.uuid4().hex
    with store.open_output_stream(f"{path}/{name}") as f:
        for p in parts:
            f.write(p)
    return name


def _get(folder: str, name: str, at: int = 0, size: int | None = None) -> bytes:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{path}/{name}") as f:
        return f.read() if size is None else f.read_at(size, at)


def language_name(lang: str | None) -> int:
    return zlib.crc32(b"" if lang is None else b"l" + lang.encode()) + 1


class Slice:
    """Texts of one language: words (distinct names, the frequent first; the text's start is one), token (their numbers), docs."""

    def __init__(self, words: np.ndarray, token: np.ndarray, lengths: np.ndarray, docs: np.ndarray):
        self.words, self.token, self.lengths, self.docs = words, token, lengths, docs

    @classmethod
    def of(cls, lang: str | None, names: np.ndarray, lengths: np.ndarray, docs: np.ndarray) -> Slice:
        start = mixed(np.array([language_name(lang)], U))
        words, token, n = np.unique(np.r_[start, mixed(names ^ start)] & NAME, return_inverse=True, return_counts=True)
        rank = np.argsort(-n, kind="stable")
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        return cls(words[rank], place[token], lengths, docs)  # token[0] is the text's start

    def store(self, folder: str) -> str:
        parts = [pack(x) for x in (self.words, self.token, self.lengths, self.docs.ravel())]
        return _put(folder, [np.array([len(x) for x in parts], "<i8").tobytes(), *parts])

    @classmethod
    def load(cls, folder: str, name: str) -> Slice:
        raw = _get(folder, name)
        ends = np.cumsum([32, *np.frombuffer(raw, "<i8", 4)]).tolist()
        words, token, lengths, docs = (unpack(raw[a:b]) for a, b in zip(ends, ends[1:]))
        return cls(words.view(U), token, lengths, docs.reshape(-1, 8))

    def count(self, buckets: int) -> None:
        """Distinct bigrams in order of their buckets and keys: before, after (word numbers), n, key; cut, where buckets begin."""
        after = self.token[1:]
        before = self.token[:-1].copy()
        begins = (np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]
        before[begins] = self.token[0]
        kinds, self.place, n = np.unique(before << 32 | after, return_inverse=True, return_counts=True)
        before, after = kinds >> 32, kinds & 0xFFFFFFFF
        key = mixed(self.words[before] * U(0x9E3779B97F4A7C15) + self.words[after]) >> U(64 - KEY_BITS)
        order = np.argsort(key, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.place = back[self.place]
        self.before, self.after, self.n, self.key = before[order], after[order], n[order], key[order]
        bucket = (self.key >> U(KEY_BITS - 32)) * U(buckets) >> U(32)
        self.cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=U))

    def log_probabilities(self, n, stats, d2, d1, c1, c2, _3, _4, kinds, total) -> np.ndarray:
        """Sums of log probabilities of each text's words under the model of all other texts, and under its lowest order.

        n: total of each bigram; stats: _STATS of each word; d2 and d1: discounts; c1 and c2: words that one and two
        kinds precede; kinds: words that any precedes; total: kinds of bigrams."""
        rest = (d1[1] * c1 + d1[2] * c2 + d1[3] * (kinds - c1 - c2)) / max(total, 1)
        mass, ends = stats[:, 1:4] @ d2[1:], np.cumsum(self.lengths)
        out = np.zeros((2, len(ends)))
        # texts are independent here: some at a time
        part = np.searchsorted(ends, np.arange(TOKENS, ends[-1] if len(ends) else 0, TOKENS)) + 1
        for a, b in zip([0, *part.tolist()], [*part.tolist(), len(ends)]):
            lo, hi = ends[a] - self.lengths[a] if a < b else 0, ends[b - 1] if a < b else 0
            if lo == hi:
                continue
            doc = np.repeat(np.arange(b - a), self.lengths[a:b])
            # a text's distinct bigrams, k times each; without the text a bigram has `left`
            own, k = np.unique(doc * len(self.key) + self.place[lo:hi], return_counts=True)
            doc, gram = own // len(self.key), own % len(self.key)
            left = n[gram] - k
            kind, gone = np.minimum(left, 3), left == 0
            _, at = np.unique(doc * len(self.words) + self.before[gram], return_inverse=True)
            times = stats[self.before[gram], 0] - np.bincount(at, k)[at]
            # a context that other texts have keeps a kind; the bound only matters if two bigrams have one key
            back = np.maximum(mass[self.before[gram]] - np.bincount(at, d2[np.minimum(n[gram], 3)] - d2[kind])[at], d2[1:].min())
            _, at = np.unique(doc * len(self.words) + self.after[gram], return_inverse=True)
            follows = np.maximum(stats[self.after[gram], 4] - np.bincount(at, gone)[at].astype(np.int64), 0)
            others = np.maximum(total - np.bincount(doc, gone, b - a), 1)[doc]
            lower = (follows - d1[np.minimum(follows, 3)]) / others + rest / max(kinds, 1)
            some = np.maximum(times, 1)
            p = np.where(times > 0, (left - d2[kind]) / some + back / some * lower, lower)
            out[:, a:b] = [np.bincount(doc, k * np.log(x), b - a) for x in (p, lower)]
        return out

    def deal_words(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(the words in order of their buckets and names, where buckets begin)."""
        bucket = self.words % U(buckets)
        order = np.lexsort((self.words, bucket))
        return order, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=U))


ASK = "bucket long, slice string, lang string, keys binary, counts binary"
ANSWER = "slice string, lang string, bucket long, path string, at long, size long, sums array<long>"


def _asks(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary())
    columns = zip(*rows) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["bucket", "slice", "lang", "keys", "counts"])


def _bigram_asks(s: Slice, name: str, lang: str | None, turn: int) -> pa.RecordBatch:
    """A row for each of the turn's buckets that a counted slice has bigrams in; for bucket 0 always."""
    rows = [(b, name, lang, pack_ascending(s.key[x:y]), pack(s.n[x:y])) for b, (x, y) in enumerate(zip(s.cut, s.cut[1:])) if b % TURNS == turn and (x < y or b == 0)]
    return _asks(rows)


def gather(folder: str, buckets: int, slice_chars: int = SLICE):
    """mapInArrow: (doc_id, lang, text, text_key) -> ASK, the first turn's rows of each slice; stores the slices."""

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            names, lengths, docs = (np.concatenate(x) for x in zip(*parts))
            s = Slice.of(lang, names, lengths.astype("<i8"), docs.astype("<i8"))
            name = s.store(folder)
            s.count(buckets)
            yield _bigram_asks(s, name, lang, 0)

    def named(part: dict, held: dict) -> None:
        for lang, rows in part.items():
            names, bounds = word_names([t.encode() for _, t, _ in rows])
            docs = np.array([(i if i is not None else 0, i is None, k, *base_counts(t)) for i, t, k in rows], np.int64)
            held.setdefault(lang, []).append((names, np.diff(bounds), docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        held, part, size, small = {}, {}, 0, 0
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
            for i, lang, t, k in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text", "text_key"))):
                part.setdefault(lang, []).append((i, t or "", k))
                small += len(t or "") + 50
                if small >= PART:
                    named(part, held)
                    size, small, part = size + small, 0, {}
                    if size >= slice_chars:
                        yield from flush(held)
                        held, size = {}, 0
        named(part, held)
        yield from flush(held)
        release()

    return run


def ask_bigrams(folder: str, buckets: int, turn: int):
    """mapInArrow: (slice, lang) -> ASK, a later turn's rows of each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, lang in zip(*(batch.column(c).to_pylist() for c in ("slice", "lang"))):
                s = Slice.load(folder, name)
                s.count(buckets)
                yield _bigram_asks(s, name, lang, turn)
        release()

    return run


def _by_language(table: pa.Table) -> Iterator[tuple[str | None, list[str], list[bytes], list[bytes]]]:
    found: dict = {}
    for row in zip(*(table.column(c).to_pylist() for c in ("lang", "slice", "keys", "counts"))):
        found.setdefault(row[0], []).append(row[1:])
    for lang, rows in found.items():
        yield lang, *map(list, zip(*rows))


def _answers(folder: str, bucket: int, found: list[tuple]) -> pa.Table:
    """found: (slice, lang, answer, sums) -> ANSWER; the answers go to one file."""
    ends = np.cumsum([0, *(len(f[2]) for f in found)]).tolist()
    path = _put(folder, [f[2] for f in found])
    columns = [[f[0] for f in found], [f[1] for f in found], [bucket] * len(found), [path] * len(found), ends[:-1], [len(f[2]) for f in found], [f[3] for f in found]]
    types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["slice", "lang", "bucket", "path", "at", "size", "sums"])


def _counts_of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def add_bigrams(folder: str):
    def add(table: pa.Table) -> pa.Table:
        found = []
        for lang, slices, keys, counts in _by_language(table):
            keys = [unpack_ascending(k) for k in keys]
            n = np.concatenate([unpack(c) for c in counts])
            _, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            total = np.bincount(place, n, len(first)).astype(np.int64)
            answer = total[place] * 2
            answer[first] += 1
            sums, at = _counts_of_counts(total), 0
            for s, k in zip(slices, keys):
                found.append((s, lang, pack(answer[at : at + len(k)]), sums))
                at, sums = at + len(k), [0] * 4
        return _answers(folder, table.column("bucket")[0].as_py(), found)

    return add


def _read_answers(folder: str, answers: list[dict]) -> np.ndarray:
    return np.concatenate([unpack(_get(folder, a["path"], a["at"], a["size"])) for a in sorted(answers, key=lambda a: a["bucket"])])


def ask_words(folder: str, buckets: int):
    """mapInArrow: (slice, lang, _bigrams) -> ASK, each slice's words with their _STATS sums from owned bigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, lang, answers in zip(*(batch.column(c).to_pylist() for c in ("slice", "lang", "_bigrams"))):
                s = Slice.load(folder, name)
                s.count(buckets)
                answer = _read_answers(folder, answers)
                kind, own, size = np.minimum(answer >> 1, 3), answer & 1 == 1, len(s.words)
                stats = np.stack([np.bincount(s.before, s.n, size), *(np.bincount(s.before[own & (kind == k)], minlength=size) for k in (1, 2, 3)), np.bincount(s.after[own], minlength=size)])
                order, cut = s.deal_words(buckets)
                yield _asks([(b, name, lang, pack_ascending(s.words[order[x:y]]), pack(stats[:, order[x:y]].ravel().astype(np.int64))) for b, (x, y) in enumerate(zip(cut, cut[1:])) if x < y])
        release()

    return run


def add_words(folder: str):
    def add(table: pa.Table) -> pa.Table:
        found = []
        for lang, slices, keys, counts in _by_language(table):
            keys = [unpack_ascending(k) for k in keys]
            words, place = np.unique(np.concatenate(keys), return_inverse=True)
            stats = np.concatenate([unpack(c).reshape(_STATS, -1) for c in counts], axis=1)
            total = np.stack([np.bincount(place, x, len(words)) for x in stats]).astype("<i8")
            n, at = total[-1], 0
            sums = [*_counts_of_counts(n), int((n > 0).sum()), int(n.sum())]
            for s, k in zip(slices, keys):
                found.append((s, lang, pack(total[:, place[at : at + len(k)]].T.ravel()), sums))
                at, sums = at + len(k), [0] * 6
        return _answers(folder, table.column("bucket")[0].as_py(), found)

    return add


def discounts(c1: float, c2: float, c3: float, c4: float) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2 and more; halves where the counts of counts give none."""
    if not (c1 and c2 and c3):
        return np.array([0, 0.5, 0.5, 0.5])
    y = c1 / (c1 + 2 * c2)
    found = [1 - 2 * y * c2 / c1, 2 - 3 * y * c3 / c2, 3 - 4 * y * c4 / c3]
    return np.array([0, *(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), found))])


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    word_chars = len(text) - (len(raw) - len(raw.translate(None, b" \t\n\v\f\r")))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\v\f\r")]
    windows = list(zip(words, words[1:], words[2:]))
    repeat = 0
    if len(set(windows)) < len(windows):
        times, mark = Counter(windows), bytearray(n)
        for i, w in enumerate(windows):
            if times[w] > 1:
                mark[i : i + 3] = b"\1\1\1"
        repeat = sum(mark)
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeat


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def scorer(folder: str, buckets: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = ("slice", "lang", "_bigrams", "_words", "_c2", "_c1")
            for name, lang, bigrams, words, c2, c1 in zip(*(batch.column(c).to_pylist() for c in columns)):
                s = Slice.load(folder, name)
                s.count(buckets)
                n = _read_answers(folder, bigrams) >> 1
                order, _ = s.deal_words(buckets)
                stats = np.empty((len(order), _STATS), np.int64)
                stats[order] = _read_answers(folder, words).reshape(-1, _STATS)
                sums = s.log_probabilities(n, stats, discounts(*c2), discounts(*c1[:4]), *c1)
                log_ppl = [[None if not k else round(-x / k, 4) for x, k in zip(row, s.lengths.tolist())] for row in sums.tolist()]
                ids = pa.array(s.docs[:, 0], mask=s.docs[:, 1] == 1)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([lang] * len(ids), pa.string()), *(pa.array(c) for c in s.docs[:, 2:].T), *(pa.array(x, pa.float64()) for x in log_ppl)],
                    ["doc_id", "lang", "text_key", *COUNTS, "log_perplexity", "log_continuation"],
                )
        release()

    return score


def scores(docs: DataFrame, slice_chars: int = SLICE) -> DataFrame:
    """Per document (doc_id, lang, text): doc_id, lang, text_key (a hash of the text), base counts, log_perplexity and
    log_continuation (under the whole model, and under its lowest order); written."""
    docs = docs.select("doc_id", "lang", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    if input_bytes(docs) > 1 << 50:  # Catalyst doesn't know; a written table's size is known
        docs = materialize(docs, "texts")
    folder = new_path(docs.sparkSession, "perplexity")
    buckets = max(LEAST_BUCKETS, -(-input_bytes(docs) // BUCKET_BYTES))

    def answered(asks: DataFrame, add, label: str) -> DataFrame:
        return materialize_freed(asks.groupBy("bucket").applyInArrow(add(folder), ANSWER), label)

    # a slice's row is small and its work is not: rows are dealt to as many tasks as there are buckets
    turns = [answered(docs.mapInArrow(gather(folder, buckets, slice_chars), ASK), add_bigrams, "bigrams")]
    slices = turns[0].where("bucket = 0").select("slice", "lang").repartition(buckets, "slice")
    turns += [answered(slices.mapInArrow(ask_bigrams(folder, buckets, k), ASK), add_bigrams, "bigrams") for k in range(1, TURNS)]
    bigrams = reduce(DataFrame.unionByName, turns)

    def answers(found: DataFrame, name: str) -> DataFrame:
        return found.groupBy("slice", "lang").agg(F.collect_list(F.struct("bucket", "path", "at", "size")).alias(name))

    def sums(found: DataFrame, name: str, n: int) -> DataFrame:
        return found.groupBy(F.col("lang").alias(f"_l{name}")).agg(F.array(*(F.sum(F.col("sums")[k]) for k in range(n))).alias(name))

    words = answered(answers(bigrams, "_bigrams").repartition(buckets, "slice").mapInArrow(ask_words(folder, buckets), ASK), add_words, "words")
    both = answers(bigrams, "_bigrams").join(answers(words, "_words").drop("lang"), "slice")
    for found, name, n in ((bigrams, "_c2", 4), (words, "_c1", 6)):
        both = both.join(small_enough(materialize(sums(found, name, n), "sums")), F.col("lang").eqNullSafe(F.col(f"_l{name}")))
    schema = "doc_id long, lang string, text_key long, " + ", ".join(f"{c} long" for c in COUNTS) + ", log_perplexity double, log_continuation double"
    dealt = both.select("slice", "lang", "_bigrams", "_words", "_c2", "_c1").repartition(buckets, "slice")
    scored = materialize(dealt.mapInArrow(scorer(folder, buckets), schema), "scored")
    discard(docs.sparkSession, *turns, words, folder)
    return scored


def fit(continuation: np.ndarray, whole: np.ndarray, words: np.ndarray, clean: np.ndarray) -> tuple[float, float, float, float, float]:
    """(median and offsets down and up for the lowest order, median and offset up for the whole model), for texts of
    FULL_WORDS and more: CLEAN_LOSS of the clean rows fall outside, as much junk as can be. The loss is parted in fifths.

    Of arrays; fitted() does the same over tables."""
    middle = [float(np.median(x[clean])) for x in (continuation, whole)]
    width = np.sqrt(np.maximum(1.0, FULL_WORDS / np.maximum(words, 1)))
    z, y = (continuation - middle[0]) / width, (whole - middle[1]) / width
    best = (-1, 0.0, 0.0, 0.0)
    for i in range(6):
        for j in range(6 - i):
            low = float(np.quantile(z[clean], CLEAN_LOSS * i / 5))
            high = float(np.quantile(z[clean], 1 - CLEAN_LOSS * j / 5))
            top = float(np.quantile(y[clean], 1 - CLEAN_LOSS * (5 - i - j) / 5))
            best = max(best, (int(((z < low) | (z > high) | (y > top))[~clean].sum()), low, high, top))
    return middle[0], best[1], best[2], middle[1], best[3]


BAND = "_lang string, _middle double, _down double, _up double, _whole double, _top double"
#: Offsets are counted by steps of this width first, and by value only in the steps that hold a limit.
STEP = 0.001
#: What fit asks for: kind of offset (0 of the lowest order, 1 of the whole model) and quantile; down, up and top in fifths of the loss.
ASKED = [*((0, CLEAN_LOSS * i / 5) for i in range(6)), *((0, 1 - CLEAN_LOSS * i / 5) for i in range(6)), *((1, 1 - CLEAN_LOSS * i / 5) for i in range(6))]


def _ends(total: int) -> list[tuple[int, int, float]]:
    """(kind, rank below, part of the way to the next) of each quantile in ASKED of so many values."""
    at = [(kind, q * (total - 1)) for kind, q in ASKED]
    return [(kind, int(x), x - int(x)) for kind, x in at]


def limit_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (_lang, _total, _steps of (kind, step, n)) -> the steps that hold a value asked for, with the values before them."""
    out = []
    for batch in batches:
        for lang, total, steps in zip(*(batch.column(c).to_pylist() for c in ("_lang", "_total", "_steps"))):
            wanted = {(kind, min(r + d, total - 1)) for kind, r, _ in _ends(total) for d in (0, 1)}
            for kind in (0, 1):
                found = sorted((x["step"], x["n"]) for x in steps if x["kind"] == kind)
                ends = np.cumsum([n for _, n in found])
                for i in sorted({int(np.searchsorted(ends, r, "right")) for k, r in wanted if k == kind}):
                    out.append((lang, kind, found[i][0], int(ends[i] - found[i][1])))
    types = (pa.string(), pa.int32(), pa.int64(), pa.int64())
    columns = zip(*out) if out else [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["_lang", "_kind", "_step", "_before"])


def limit_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (_lang, _total, _values of (kind, before, value, n)) -> _lang and the quantiles in ASKED; values are those
    of limit_steps, before is the number of values before their step."""
    out = []
    for batch in batches:
        for lang, total, values in zip(*(batch.column(c).to_pylist() for c in ("_lang", "_total", "_values"))):
            known = []
            for kind in (0, 1):
                found = sorted((x["before"], x["value"], x["n"]) for x in values if x["kind"] == kind)
                before, value, n = (np.array(x) for x in zip(*found))
                within = np.cumsum(n) - n
                first = np.r_[True, before[1:] != before[:-1]]  # a step's least value
                begins = before + within - np.maximum.accumulate(np.where(first, within, 0))
                known.append((begins, value))
            limits = []
            for kind, r, part in _ends(total):
                begins, value = known[kind]
                low, high = (value[np.searchsorted(begins, min(x, total - 1), "right") - 1] for x in (r, r + 1))
                limits.append(float(low + (high - low) * part))
            out.append((lang, limits))
    columns = zip(*out) if out else [[]] * 2
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.list_(pa.float64())))], ["_lang", "_limits"])


def fitted(held: DataFrame) -> DataFrame:
    """BAND: fit's five numbers of each language of LEAST_LABELS clean rows and more, from all rows.

    held (written): lang, x and y (log perplexity under the lowest order and under the whole model), n_words, clean. Numbers of
    values are summed up by language; a task holds those by step, or by value within the steps that hold a limit."""
    # x and y have four places, so that the exact percentiles hold a bounded number of distinct values
    middles = held.where("clean").groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_total"), F.percentile("x", F.lit(0.5)).alias("_middle"), F.percentile("y", F.lit(0.5)).alias("_whole"))
    middles = materialize(middles.where(F.col("_total") >= LEAST_LABELS), "middles")
    width = F.sqrt(F.greatest(F.lit(1.0), FULL_WORDS / F.greatest("n_words", F.lit(1))))
    placed = held.join(small_enough(middles), F.col("lang").eqNullSafe(F.col("_lang")))
    placed = placed.select("_lang", "clean", ((F.col("x") - F.col("_middle")) / width).alias("_z"), ((F.col("y") - F.col("_whole")) / width).alias("_y"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in enumerate(("_z", "_y")))))
    counts = placed.where("clean").select("_lang", each.alias("_v")).select("_lang", "_v.*").groupBy("_lang", "kind", "value").agg(F.count("*").alias("n"))
    counts = materialize(counts.withColumn("step", F.floor(F.col("value") / STEP)), "offsets")

    def by_language(rows: DataFrame, columns: tuple, name: str) -> DataFrame:
        found = rows.groupBy(F.col("_lang").alias("_l")).agg(F.collect_list(F.struct(*columns)).alias(name))
        return found.join(small_enough(middles.select("_lang", "_total")), F.col("_l").eqNullSafe(F.col("_lang"))).select("_lang", "_total", name)

    steps = counts.groupBy("_lang", "kind", "step").agg(F.sum("n").alias("n"))
    steps = by_language(steps, ("kind", "step", "n"), "_steps").mapInArrow(limit_steps, "_lang string, _kind int, _step long, _before long")
    steps = small_enough(materialize(steps.withColumnRenamed("_lang", "_l"), "steps"))
    values = counts.join(steps, F.col("_lang").eqNullSafe(F.col("_l")) & (F.col("kind") == F.col("_kind")) & (F.col("step") == F.col("_step")))
    values = by_language(values.withColumnRenamed("_before", "before"), ("kind", "before", "value", "n"), "_values")
    limits = materialize(values.mapInArrow(limit_values, "_lang string, _limits array<double>"), "limits").withColumnRenamed("_lang", "_l")
    junk = placed.where("not clean").join(small_enough(limits), F.col("_lang").eqNullSafe(F.col("_l")))
    at = F.col("_limits")
    parts = [(i, 6 + j, 12 + 5 - i - j) for i in range(6) for j in range(6 - i)]
    outside = [F.sum(((F.col("_z") < at[i]) | (F.col("_z") > at[j]) | (F.col("_y") > at[k])).cast("long")) for i, j, k in parts]
    outside = junk.groupBy(F.col("_lang").alias("_j")).agg(F.array(*outside).alias("_n"))
    out = limits.join(small_enough(materialize(outside, "outside")), F.col("_l").eqNullSafe(F.col("_j")), "left").join(small_enough(middles), F.col("_l").eqNullSafe(F.col("_lang")))
    best = [F.struct(F.coalesce(F.col("_n")[m], F.lit(0)).alias("n"), at[i].alias("low"), at[j].alias("high"), at[k].alias("top")) for m, (i, j, k) in enumerate(parts)]
    out = out.withColumn("_best", F.array_max(F.array(*best)))
    return out.select("_lang", "_middle", F.col("_best.low").alias("_down"), F.col("_best.high").alias("_up"), "_whole", F.col("_best.top").alias("_top"))


def bands(scored: DataFrame, labels: DataFrame | None) -> DataFrame:
    """BAND: a row for each language; fit's five numbers, from all rows that have a label."""
    # rounded, so that the exact percentiles hold a bounded number of distinct values
    passed = scored.where("not base_failed").select("lang", F.round("log_continuation", 3).alias("_x"), F.round("log_perplexity", 3).alias("_y"))
    at = F.array(*(F.lit(q) for q in (0.25, 0.5, 0.75)))
    quartiles = passed.groupBy(F.col("lang").alias("_lang")).agg(F.percentile("_x", at).alias("_q"), F.percentile("_y", at).alias("_r"))
    q, r = F.col("_q"), F.col("_r")
    spread, rise = (F.greatest(x[2] - x[0], F.lit(LEAST_SPREAD)) * FENCE for x in (q, r))
    found = quartiles.select("_lang", q[1].alias("_middle"), (q[0] - spread - q[1]).alias("_down"), (q[2] + spread - q[1]).alias("_up"), r[1].alias("_whole"), (r[2] + rise - r[1]).alias("_top"))
    if labels is None:
        return found
    # one label for each id, the lesser of several; all rows of an id have it. By shuffle at every size, as both sides grow
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), "quality").where("_id is not null and quality is not null")
    known = materialize(known.groupBy("_id").agg(F.min("quality").alias("quality")), "labelled")
    held = scored.where("not base_failed").select("doc_id", "lang", F.col("log_continuation").alias("x"), F.col("log_perplexity").alias("y"), "n_words")
    held = held.hint("merge").join(known, F.col("doc_id") == F.col("_id"))
    own = materialize(fitted(materialize(held.select("lang", "x", "y", "n_words", (F.col("quality") == 1).alias("clean")), "held")), "fitted")
    return found.join(small_enough(own.select(F.col("_lang").alias("_own"))), F.col("_lang").eqNullSafe(F.col("_own")), "left_anti").unionByName(own)


def judged(docs: DataFrame, labels: DataFrame | None = None, slice_chars: int = SLICE) -> DataFrame:
    """Per document: doc_id, lang, text_key, counts, base_failed, both log perplexities, the bands' lower, upper and top, kept.

    labels: doc_id and quality, 1 for clean rows and 0 for junk."""
    scored = scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text"), slice_chars)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    found = materialize(bands(scored, labels), "bands")
    out = scored.join(small_enough(found), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    width = F.sqrt(F.greatest(F.lit(1.0), FULL_WORDS / F.greatest("n_words", F.lit(1))))
    out = out.withColumns({"lower": F.col("_middle") + F.col("_down") * width, "upper": F.col("_middle") + F.col("_up") * width, "top": F.col("_whole") + F.col("_top") * width})
    inside = F.col("log_continuation").between(F.col("lower"), F.col("upper")) & (F.col("log_perplexity") <= F.col("top"))
    return out.drop("_lang", "_middle", "_down", "_up", "_whole", "_top").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "log_perplexity", "log_continuation", "lower", "upper", "top")


def keep_good(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """docs without those rejected. Rows are known by doc_id, lang and the text's hash; all rows of a kind go or stay."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"))
    rows = packed.select(*(F.col("_doc")[c].alias(c) for c in ("doc_id", "lang", "text")))
    bad = judged(rows, labels).where("not kept").select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), "text_key").distinct()
    bad = materialize(bad, "rejected")
    same = F.col("_doc.doc_id").cast("long").eqNullSafe(F.col("_id")) & F.col("_doc.lang").eqNullSafe(F.col("_lang")) & (F.xxhash64(F.coalesce("_doc.text", F.lit(""))) == F.col("text_key"))
    # a hint keeps one plan at every size: rows meet the rejected ones by shuffle
    return packed.hint("merge").join(bad, same, "left_anti").select("_doc.*")
