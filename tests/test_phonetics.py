"""Published vectors of the name codes, deep JSON, and weighted sketches and fusions."""

import pytest
from pyspark.sql import functions as F

from lexloom.functions import json_repair, phonetics, plain, sketches
from lexloom.functions.columns import lift
from lexloom.operators import retrieval


@pytest.mark.parametrize(
    "name, codes",
    [("jumped", ("JMPT", "AMPT")), ("Smith", ("SM0", "XMT")), ("Schmidt", ("XMT", "SMT")), ("Alexander", ("ALKS", "ALKS")), ("José", ("JS", "AS")), ("Björk", ("PJRK", "PJRK")), ("Xavier", ("SF", "SFR")), ("Thumb", ("0M", "TM")), ("accident", ("AKST", "AKST")), ("", ("", "")), ("12345", ("", ""))],
)
def test_double_metaphone(name, codes):
    assert phonetics.double_metaphone(name) == codes and phonetics.metaphone(name) == codes[0]


@pytest.mark.parametrize(
    "name, codes",
    [("AUERBACH", ["097400", "097500"]), ("OHRBACH", ["097400", "097500"]), ("LIPSHITZ", ["874400"]), ("LIPPSZYC", ["874400", "874500"]), ("Moskowitz", ["645740"]), ("Peters", ["734000", "739400"]), ("Jackson", ["154600", "145460", "454600", "445460"]), ("Rosokhovatsets", ["945744"]), ("", ["000000"]), ("日本語", ["000000"])],
)
def test_daitch_mokotoff(name, codes):
    assert phonetics.daitch_mokotoff(name) == codes


def test_name_codes_never_fail():
    import random

    rng = random.Random(3)
    for _ in range(5_000):
        word = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ é'") for _ in range(rng.randint(0, 12)))
        assert all(len(c) <= 4 for c in phonetics.double_metaphone(word))
        assert all(len(c) == 6 and c.isdigit() for c in phonetics.daitch_mokotoff(word))


def test_deep_json(spark):
    deep = ["[" * 100_000, "[" * 1_000, '{"a":' * 600, "[" * 100_000 + "]" * 100_000, "[" * 50 + "1"]
    assert [json_repair.repair_json(x) for x in deep] == ["", "", "", "", "[" * 50 + "1" + "]" * 50]
    assert plain.content_hash(deep[3]) is None
    frame = spark.createDataFrame(list(enumerate(deep)), "id long, t string")
    got = frame.select("id", lift(json_repair.repair_json, "string", "t").alias("r"), lift(plain.content_hash, "string", "t").alias("h")).orderBy("id").collect()
    assert [r.r for r in got] == ["", "", "", "", "[" * 50 + "1" + "]" * 50] and all(r.h is None for r in got)


def test_word_count_is_the_number_of_bounds():
    for t in ("", "a", "a b", "Hello, world!", " \r\n", "é漢字 x​", "🇩🇪🇫🇷 ok"):
        assert plain.word_count(t) == len(plain.word_bounds(t))


def test_weighted(spark):
    a, b = sketches.weighted_minhash_signature("a b c d"), sketches.weighted_minhash_signature("a b c e")
    assert sketches.minhash_weighted_jaccard(a, a) == 1 and 0.3 < sketches.minhash_weighted_jaccard(a, b) < 0.9
    with pytest.raises(ValueError):
        sketches.minhash_weighted_jaccard(a, b[:-1])
    lists = spark.createDataFrame([("x", 1, "a", 3.0), ("x", 2, "b", 1.0), ("y", 1, "b", 9.0)], "list_id string, pos int, id string, score double")
    got = {r.id: r.score for r in retrieval.rank_fuse(lists, 60, {"y": 3.0}).collect()}
    assert got == {"a": 1 / 61, "b": pytest.approx(1 / 62 + 3 / 61)}
    assert [r.id for r in retrieval.score_fuse(lists, "linear", {"y": 3.0}, k=1).collect()] == ["b"]
    with pytest.raises(ValueError):
        retrieval.rank_fuse(lists, weights={"x": 0.0})
    with pytest.raises(ValueError):
        retrieval.score_fuse(lists, weights={"x": float("inf")}).select(F.col("id"))
