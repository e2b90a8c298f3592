"""Fixed cases of the functions."""

import random

from lexloom.functions import native as N
from lexloom.functions import plain as P
from pyspark.sql import functions as F


def test_segments():
    assert P.word_bounds("Hello, world!") == [(0, 5), (5, 6), (6, 7), (7, 12), (12, 13)]
    assert P.sentence_bounds("One. Two? Three.")[:2] == [(0, 5), (5, 10)]
    assert P.chunk_text("cats are cute and cats are fun", 12) == [(0, 8), (8, 17), (17, 26), (26, 30)]
    for f in (P.word_bounds, P.sentence_bounds):
        for t in ("", " ", "a\r\nb", "x. y? z"):
            assert "".join(t[a:b] for a, b in f(t)) == t


def test_pairs():
    assert P.jaro_winkler("martha", "marhta") == 0.9611111111111111
    assert P.similarity_ratio("kitten", "sitting") == 0.6153846153846154
    assert P.jaro("", "") == 1.0 and P.similarity_ratio("", "") == 1.0
    assert P.refined_soundex("Robert") == "R901096"


def test_matches_is_the_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert P._matches(a, b) == table[-1][-1]


def test_normalize(spark):
    got = spark.range(1).select(N.normalize(F.lit("line one  \n\n\n\nline two\r\n")), N.normalize(F.lit(None).cast("string"))).first()
    assert tuple(got) == ("line one\n\nline two", None)


def test_misc():
    assert P.extract_code_blocks("hi\n```py\nprint(1)\n```\n") == [("py", "print(1)\n", 3, 22)]
    assert P.find_unescaped(b'a\\"b"', b'"') == 4
    assert not P.json_is_valid("1e400") and P.json_is_valid('{"a": [1]}')
    assert P.replace_many("the then", {"the": "X", "then": "Y"}) == "X Y"
    assert P.ndcg_at_k(["cat-a", "dog-b", "bird-c", "fish-d"], {"cat-a": 1, "bird-c": 1, "whale-e": 1}) == 0.7039180890341347
