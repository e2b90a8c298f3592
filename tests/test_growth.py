"""Queries whose memory, time or shuffle grew too fast: what they do now, and that results are as before."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex

from lexloom import plans
from lexloom.functions import chunks, columns, grounding, plain, randoms, sketches, stems
from lexloom.operators import near_dup, retrieval
from lexloom.streaming import json_repair as json_stream

LETTERS = list("ab Z0 9_.,;:'\"-\r\n\t  ‍́é中文カกำ각🇫🇷👩·אߺ\x0b﻿­#ßİΣ!?")


def _texts(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return ["", " ", "a", "a b c", *("".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 90))) for _ in range(n))]


def test_results_leave_in_slices(spark):
    long = pa.array([None, *["x" * (columns.SIZE // 2)] * 5, "y"])
    assert [len(x) for x in columns._slices(iter([long]))] == [3, 2, 2]
    assert [len(x) for x in columns._slices(iter([pa.array(range(2_500))]))] == [1_000, 1_000, 500]
    texts = [None, *_texts(30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(1)
    got = rows.select("id", columns.spans(plain.word_bounds, "t").alias("s"), columns.lift(len, "int", "t").alias("n")).collect()
    for r in got:
        t = texts[r.id]
        assert (None if r.s is None else [tuple(x) for x in r.s], r.n) == ((None, None) if t is None else (plain.word_bounds(t), len(t)))


def test_word_bounds_are_those_of_all_breaks():
    for t in _texts(3_000):
        at = sorted({0, len(t), *(m.start() for m in regex.finditer(r"(?w)\b", t))})
        assert plain.word_bounds(t) == list(zip(at, at[1:]))
        assert plain.words(t) == [t[a:b] for a, b in zip(at, at[1:])]


def test_words_are_cut_without_a_match_object_each(monkeypatch):
    monkeypatch.setattr(plain, "_BREAK", None)
    assert plain.words("Hello, world!") == ["Hello", ",", " ", "world", "!"]


def _simhash(text: str, bits: int) -> int:
    prime, h0 = ((1 << 40) + 0x1B3, 0xCBF29CE484222325) if bits == 64 else ((1 << 88) + 0x13B, 0x6C62272E07BB014262B821756295C58D)
    votes = [0] * bits
    for w in plain.real_words(text):
        h = h0
        for byte in w.encode():
            h = (h ^ byte) * prime % (1 << bits)
        for i in range(bits):
            votes[i] += 1 if h >> i & 1 else -1
    return sum(1 << i for i, v in enumerate(votes) if v > 0)


def test_simhash_hashes_each_token_once(monkeypatch):
    for t in [*_texts(200), "one two three four " * 9 + "w" * 100]:
        assert all(plain.simhash(t, bits) == _simhash(t, bits) for bits in (64, 128)) and plain.simhash(t, 128, 2) == _simhash(t, 128)
    asked = Counter()
    monkeypatch.setattr(plain, "_kept_fnv", lambda w, bits: asked.update([w]) or plain._fnv(w, bits))
    plain.simhash("a b a b a " * 500, 128)
    assert asked == {"a": 1, "b": 1}


def test_words_of_simple_texts():
    rng = random.Random(3)
    some = list("aZ09_.,;: \r\nés") * 12 + [chr(i) for i in range(256)]
    for _ in range(20_000):
        t = "".join(rng.choice(some) for _ in range(rng.randint(0, 9)))
        assert plain.words(t) == [w for w in plain._APART.split(t) if w]


def test_near_duplicates_by_simhash_make_no_pairs(spark, monkeypatch):
    labels, rng = [], random.Random(6)
    real = near_dup.written
    monkeypatch.setattr(near_dup, "written", lambda df, label: labels.append(label) or real(df, label))
    monkeypatch.setattr(near_dup, "BLOCK", 40)
    base = [rng.choice("abcdef") + str(i) for i in range(60)]
    texts = [None, ""]
    for _ in range(200):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(60)] = "z" + str(rng.randint(0, 9))
        texts.append(" ".join(w))
    got = near_dup.dedup_near_dup(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 0.9, "simhash").collect()
    kept, want = [], {}
    sigs = [plain.simhash(t or "") for t in texts]
    for i, s in enumerate(sigs):
        want[i] = next((k for k in kept if (sigs[k] ^ s).bit_count() <= 6), i)
        if want[i] == i:
            kept.append(i)
    assert {r.id: r.keep_id for r in got} == want and len(kept) > 3
    assert "links" not in labels


def test_seeded_tokens_are_made_together():
    rng = random.Random(7)
    seeds = [0, 1, 42, -1, *(rng.randrange(-(2**63), 2**63) for _ in range(60))]
    for letters, n in ((randoms.B62, 22), ("abcdef", 12), ("x", 3), ("abc", 0), (randoms.HEX_LOWER, 17)):
        assert randoms.random_strings(n, letters, seeds) == [randoms.random_string(n, letters, s) for s in seeds]
    assert randoms.random_strings(4, "ab", []) == []


@pytest.mark.parametrize("name", ["random_b64url", "random_hex", "random_string"])
def test_tokens_of_a_table_go_by_slices(spark, monkeypatch, name):
    def never(*_, **__):
        raise AssertionError("a call a row")

    monkeypatch.setattr(randoms, "random_string", never)
    monkeypatch.setattr(randoms, name, never) if hasattr(randoms, name) else None
    got = plans.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert got.count() == 1_000 and got.where("value IS NULL").count() == 0


def test_streams_of_a_table_are_not_taken_one_at_a_time(spark):
    rows = [("a", 1, "2]", True), ("a", 0, "[1, ", False), ("a", None, "x", True), (None, 0, "x", True), ("b", 0, None, True), ("c", 0, "[", None), ("d", 2, "}", True), ("d", 0, "{", False)]
    found = json_stream.repair_json_stream(spark.createDataFrame(rows, "stream_id string, seq long, chunk string, last boolean"))
    assert sorted(tuple(r) for r in found.collect()) == [("a", "[1, 2]", 2, True), ("b", "", 1, True)]
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()


def test_draws_are_those_of_numpy():
    rng = random.Random(8)
    keys = [0, 1, 2**63 - 1, 2**63, *(rng.randrange(2**64) for _ in range(40))]
    for seed in (0, 7, 2**63 + 5):
        with np.errstate(invalid="ignore"):
            want = [np.random.Generator(np.random.Philox(key=[seed, k])).random(81).tolist() for k in keys]
        assert sketches.philox(seed, np.array(keys, np.uint64), 81).tolist() == want


def test_weighted_signatures_with_few_kept_draws(monkeypatch):
    want = [sketches.weighted_minhash_signature(t, 16) for t in _texts(60)]
    monkeypatch.setattr(sketches, "TOKENS", 5)
    monkeypatch.setattr(sketches, "_kept_draws", lambda n, seed: few)
    few = sketches._Draws(16, 0)
    few.table = few.table[:7].copy()
    assert [sketches.weighted_minhash_signature(t, 16) for t in _texts(60)] == want


def test_a_word_is_stemmed_once():
    stems._kept_stem.cache_clear()
    assert stems.apply_terms("Running runs running " * 50, "english") == "run run run " * 50
    assert stems._kept_stem.cache_info().misses == 3


def test_chunk_quality_folds_a_chunk_once(monkeypatch):
    text = "One two three. Four five six! Seven eight? Nine ten eleven twelve. Last one here."
    spans = plain.chunk_by_sentences(text, 3)
    seen = Counter()
    monkeypatch.setattr(chunks, "shingles", lambda t: seen.update([t]) or plain.shingles(t), raising=False)
    got = chunks.chunk_quality(spans, text)
    whole = [(a, b, next((c for c in sorted(spans) if c[0] <= a and c[1] >= b), None)) for a, b in plain.sentence_bounds(text)]
    dice = [plain.shingle_dice(text[a:b], text[slice(*c)]) for a, b, c in whole if c]
    assert got["cohesion"] == sum(dice) / len(dice)
    assert all(seen[text[a:b]] == 1 for a, b in spans)


def test_maps_are_taken_together():
    rng = np.random.default_rng(1)
    for n in (1, 5, 900):
        x = rng.integers(0, sketches.P61, n, np.uint64)
        want = [int(sketches._affine(a, b, x).min()) for a, b in sketches._maps(128, 0)]
        assert sketches._least(128, 0, x).tolist() == want == sketches._least(128, 0, x, 64).tolist()


def test_windows_are_compared_together():
    rng = random.Random(9)
    for n in (1, 7, 60, 64, 65):
        claim, source = ("".join(rng.choice("abcdé") for _ in range(k)) for k in (n, 3 * n + 5))
        score = grounding._scorer(claim, source)
        want = [plain.similarity_ratio(claim, w) * (n + len(w)) / (2 * n) for w in (source[i : i + n] for i in range(len(source)))]
        assert list(score(range(len(source)))) == want


def test_tokens_are_framed_once():
    for t in _texts(100):
        tokens = [w.encode() for w in plain.fold(t)]
        assert sketches._hashes(t, 3) == {sketches._hash(tokens[i : i + 3]) for i in range(len(tokens) - 2)}


def test_truncation_looks_no_further_than_its_cut(monkeypatch):
    for t in _texts(500):
        ends = [b for _, b in plain.word_bounds(t) if b <= 30]
        assert plain.truncate_to_bounds(t, 30) == (t if len(t) <= 30 else t[: ends[-1]].rstrip() if ends else "")
    monkeypatch.setattr(plain, "word_bounds", None)
    assert plain.truncate_to_bounds("ab " * 1_000, 7) == "ab ab"


def test_tf_idf_packs_counts_by_term(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TOKENS", 7)
    rng = random.Random(10)
    rows = [(rng.choice([None, *range(9)]), rng.choice([None, "", *(" ".join(rng.choice("abcde") for _ in range(rng.randint(1, 12))) for _ in range(9))])) for _ in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.term): (r.tf, r.df, round(r.score, 9)) for r in retrieval.tf_idf(docs).collect()}
    tf = Counter((i, w) for i, t in rows for w in (t or "").split())
    df = Counter(w for _, w in tf)
    assert got == {(i, w): (n, df[w], round(n * (np.log((1 + len(rows)) / (1 + df[w])) + 1), 9)) for (i, w), n in tf.items()}
    words = pa.array([["a", "b", "a"], None, ["a"], ["b"]], pa.list_(pa.string()))
    found = retrieval._postings(iter([pa.RecordBatch.from_arrays([pa.array([1, 1, 1, 2]), words], ["doc_id", "words"])]))
    assert sorted((r["term"], r["docs"], r["tfs"]) for b in found for r in b.to_pylist()) == [("a", [1], [3]), ("b", [1], [1]), ("b", [2], [1])]


def test_shingle_sets_are_ordered_by_few_counts(spark):
    sets = spark.createDataFrame([(1, [-5, 3, 1 << 60]), (2, [3]), (3, [])], "id long, sig array<long>")
    counts = near_dup._bucket_counts(sets.select("sig"))
    n = np.frombuffer(counts.value, np.int64)
    assert n.sum() == 4 and len(n) == 1 << near_dup.BITS and n[0] == 2
    got = {r.id: (r.n, r.keys) for r in sets.mapInArrow(near_dup._prefixes(counts, 0.6), "id long, n long, keys array<long>").collect()}
    assert got == {1: (3, [-5, 1 << 60]), 2: (1, [3]), 3: (0, [])}
