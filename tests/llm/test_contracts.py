"""The queries' columns over a whole small table, and the pipeline's stages, against brute force."""

import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lexloom.llm import mixing, quality, registry, secrets
from lexloom.llm.substring_dedup import mixed

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_op1(spark, texts):
    got = registry.QUERIES["op1_shard"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        raw = (texts[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    by = {k: sorted(r.slot for r in got if r.shard == k) for k in range(16)}
    assert all(s == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = {(r.doc_id, r.shard, r.slot) for r in registry.QUERIES["op1_shard"](spark, FOLDER).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}


def test_op2(spark, texts):
    for r in registry.QUERIES["op2_quality"](spark, FOLDER).collect():
        t = texts[r.doc_id].text or ""
        w = WORD.findall(t)
        windows = Counter(zip(w, w[1:], w[2:]))
        repeat = len({j for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for j in (i, i + 1, i + 2)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), repeat)
        assert r.n_dup_lines == sum(n - 1 for n in Counter(lines).values())
        assert r.base_failed == (len(w) < 50 or 100 * repeat > 50 * len(w)) and not (r.kept and r.base_failed)
        if not r.base_failed:
            assert r.kept == (r.lower <= r.log_continuation <= r.upper and r.log_perplexity <= r.top)


def _ids(path, end, text):
    from tokenizers import Tokenizer

    if path not in _ids.__dict__:
        _ids.__dict__[path] = Tokenizer.from_file(path)
    return [*_ids.__dict__[path].encode(text or "", add_special_tokens=False).ids, end]


def _check_pieces(got, ids_of):
    """Pieces tile each document's ids, only longer ones are cut, sequences are gapless and hold 1024 at most."""
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    places = {}
    for i, pieces in by.items():
        ids, at = ids_of[i], 0
        for k, p in enumerate(sorted(pieces, key=lambda p: p.piece)):
            assert (p.piece, p.start) == (k, at) and (p.length == 1024 or k == 0)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
            places.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert at == len(ids) and len(pieces) == -(-len(ids) // 1024)
    for s in places.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 1024
    return len(places)


def test_op7(spark, texts):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    ids = {i: _ids(path, 2, r.text) for i, r in texts.items()}
    got = registry.QUERIES["op7_pack"](spark, FOLDER).collect()
    assert {r.doc_id for r in got} == set(ids)
    assert _check_pieces(got, ids) <= -(-sum(map(len, ids.values())) // 1024) + 3


def test_op8_spans(spark, texts):
    for r in registry.QUERIES["op8_secret_scan"](spark, FOLDER).collect():
        spans = []
        for k, rule in enumerate(secrets.RULES):
            for m in re.finditer(rule.pattern, texts[r.doc_id].text or ""):
                if len(m[rule.group]) >= rule.least:
                    spans.append((m.start(), k, f"{rule.kind}:{m.start()}:{m.end()}"))
        assert r.spans == ",".join(s for _, _, s in sorted(spans))


def _targets(sizes):
    """By source: weights 5, 2, 1 in code point order, null last; 150 % of all words, none above twice its own."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), {s for s in names if not sizes[s]}
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s for s in rest if share[s] > 2 * sizes[s]}
        if not over:
            return share | {s: 2 * sizes[s] for s in full}
        full |= over


def test_op9(spark, texts):
    got = registry.QUERIES["op9_mix"](spark, FOLDER).collect()
    size = {i: len(WORD.findall(r.text or "")) for i, r in texts.items()}
    sizes, taken = Counter(), Counter()
    for i, r in texts.items():
        sizes[r.source] += size[i]
    target = _targets(dict(sizes))
    for r in got:
        s = texts[r.doc_id].source
        taken[s] += r.taken
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[s]) and abs(r.target - target[s]) < 1e-6 and r.taken <= 2 * r.size
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK for s in sizes)


def test_op9_does_not_depend_on_the_layout(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(7, F.xxhash64("text")).write.parquet(f"{tmp_path}/documents.parquet")
    one, two = ({(r.doc_id, r.taken) for r in registry.QUERIES["op9_mix"](spark, d).collect()} for d in (FOLDER, str(tmp_path)))
    assert one == two


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    more = docs.limit(40).withColumn("doc_id", F.col("doc_id") + 10_000).withColumn("text", F.upper("text"))
    odd = spark.createDataFrame([(None, None, None, None, None), (20_000, "", "en", "s", 0), (None, "a b", "en", None, 3)], docs.schema)
    # an extra column of a name that stages use
    table = docs.unionByName(more).unionByName(odd).withColumn("_sha", F.lit(1)).withColumn("_n", F.lit("x"))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    folder = str(tmp_path)
    before, frames = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, folder)
        after.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert after.columns == before.columns
        frames.append(after.collect())
        before = after
    start = table.collect()
    good = {(r.doc_id, r.lang, r.text_key) for r in quality.judged(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).where("kept").collect()}
    key = lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    kept = [r for r in start if (r.doc_id, r.lang, signed(key(r.text))) in good]
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert kept and order(kept) == order(frames[0])
    # exact dedup: the largest doc_id of each text
    best = {}
    for r in frames[0]:
        best[_low(r.text)] = max(best.get(_low(r.text), -1), -1 if r.doc_id is None else r.doc_id)
    assert sorted(r.doc_id for r in frames[1]) == sorted(best.values())
    # near dedup: classes of fingerprints two bits apart or fewer, each by its smallest doc_id
    prints = {}
    for r in frames[1]:
        w = WORD.findall(_low(r.text))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints[r.doc_id] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    label = {i: i for i in prints}
    for _ in prints:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
        if not changed:
            break
    assert sorted(r.doc_id for r in frames[2]) == sorted(set(label.values()))
    # mixing: targets met, words from the documents, in their order
    texts = {r.doc_id: r for r in frames[2]}
    sizes, taken = Counter(), Counter()
    for r in frames[2]:
        sizes[r.source] += len(WORD.findall(r.text))
    for r in frames[3]:
        taken[r.source] += len(WORD.findall(r.text))
        left = iter(WORD.findall(texts[r.doc_id].text))
        assert all(w in left for w in WORD.findall(r.text)) and r.n_chars == len(r.text) and r.source == texts[r.doc_id].source
    assert all(abs(taken[s] - t) <= 2 * mixing.BLOCK for s, t in _targets(dict(sizes)).items())
    # packing: all ids of all rows, each document's passes told apart by their ids
    want = Counter()
    for r in frames[3]:
        ids = _ids(path, 2, r.text)
        head = len(ids) - (-(-len(ids) // 1024) - 1) * 1024
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        want.update((r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in frames[4])
    by = {}
    for r in frames[4]:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(n for _, n in s) <= 1024
    # run() does the same; an empty table stays empty
    assert order(corpus_pipeline.run(spark, folder).drop("sequence_id", "offset").collect()) == order(tuple(r[:5]) for r in frames[4])


def test_pipeline_fits_bands_on_all_labels(spark, tmp_path, monkeypatch):
    # scores by reckoning: 60,000 labelled rows; the stage keeps those that a fit on all of them keeps
    import corpus_pipeline

    n = 60_000
    rng = np.random.default_rng(4)
    clean, x, y = rng.random(n) < 0.9, np.round(rng.normal(6, 0.2, n), 4), np.round(rng.normal(7, 0.3, n), 4)
    x = np.where(clean, x, np.round(x + rng.choice([-0.6, 0.6], n), 4))
    numbers = {"doc_id": np.arange(n), "lang": ["en"] * n, "log_perplexity": y, "log_continuation": x, **{c: np.full(n, 300 * (c == "n_words")) for c in quality.COUNTS}}
    spark.createDataFrame(pa.table(numbers)).withColumn("text_key", F.xxhash64(F.lit("t"))).write.parquet(f"{tmp_path}/scored")
    spark.createDataFrame(pa.table({"doc_id": np.arange(n), "quality": clean.astype(int)})).write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(quality, "scores", lambda docs, slice_chars: spark.read.parquet(f"{tmp_path}/scored"))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("t").alias("text"))
    got = {r.doc_id for r in corpus_pipeline.keep_good(spark, docs, str(tmp_path)).collect()}
    middle, low, high, whole, top = quality.fit(x, y, np.full(n, 300), clean)
    assert got == set(np.flatnonzero((middle + low <= x) & (x <= middle + high) & (y <= whole + top)).tolist())


def test_pipeline_counts_each_bigram():
    # millions of kinds: with 36 bits in each of six buckets some were taken for one, and so not counted
    rng = np.random.default_rng(5)
    words = rng.integers(0, 5_000, 3_000_000)
    s = quality.Slice.of("en", mixed(words.astype(np.uint64)), np.array([len(words)]), np.zeros((1, 8), np.int64))
    s.count(6)
    kinds = 1 + len(np.unique(words[:-1] * 5_000 + words[1:]))  # the first word follows the text's start
    assert len(s.key) == kinds == sum(len(np.unique(quality.unpack_ascending(quality.pack_ascending(s.key[a:b])))) for a, b in zip(s.cut, s.cut[1:]))
    assert s.cut[0] == 0 and s.cut[-1] == kinds and np.diff(s.cut).min() > kinds / 7


def test_pipeline_scores_are_finite():
    # two bigrams with one key lose a kind of their words: scores stay finite, as they are what limits are fitted on
    rng = np.random.default_rng(6)
    lengths = np.array([700, 0, 1_300])
    s = quality.Slice.of("en", mixed(rng.integers(0, 400, 2_000).astype(np.uint64)), lengths, np.zeros((3, 8), np.int64))
    s.count(3)
    times, follow = np.bincount(s.before, s.n, len(s.words)), np.bincount(s.before, minlength=len(s.words))
    stats = np.stack([times, follow, 0 * follow, 0 * follow, np.bincount(s.after, minlength=len(s.words))], 1).astype(np.int64)
    stats[::3, 1:] -= 1
    d = np.array([0, 0.5, 0.7, 0.9])
    assert np.isfinite(s.log_probabilities(s.n, stats, d, d, 9, 5, 3, 1, 400, len(s.n))).all()


def test_quality_asks_buckets_in_turns(spark, monkeypatch):
    # disk: a turn's shuffle files hold its share of the buckets, and are gone before the next turn
    store, write, turns = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), quality.materialize_freed, []

    def shuffled():
        files = store.getAllFiles()
        return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}

    def watched(df, label):
        before, out = shuffled(), write(df, label)
        for _ in range(50):  # files are deleted by other threads
            if not shuffled() - before:
                break
            time.sleep(0.2)
        assert not shuffled() - before
        turns.append((label, {r.bucket for r in out.select("bucket").collect()}))
        return out

    monkeypatch.setattr(quality, "materialize_freed", watched)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, "xx", "one"), (-2, "yy", None)], docs.schema))  # hardly a bucket each
    assert quality.scores(docs, 100_000).count() == docs.count()
    asked = [found for label, found in turns if label == "bigrams"]
    assert [label for label, _ in turns] == ["bigrams"] * quality.TURNS + ["words"] and quality.TURNS > 1
    assert sum(map(len, asked)) == len(set().union(*asked)) == quality.LEAST_BUCKETS
    assert max(map(len, asked)) <= -(-quality.LEAST_BUCKETS // quality.TURNS)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
