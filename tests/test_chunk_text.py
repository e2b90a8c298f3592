"""chunk_text looks near its cuts only; here against the whole text's breaks."""

import random
from bisect import bisect_right

from lexloom.functions import plain


def _whole(text, n):
    ends = [b for a, b in plain.word_bounds(text) if not text[a:b].isspace()]
    clusters, out, at = sorted(plain._clusters(text)), [], 0
    while at < len(text):
        stop = len(text)
        if stop - at > n:
            k = bisect_right(ends, at + n) - 1
            stop = ends[k] if k >= 0 and ends[k] > at else clusters[bisect_right(clusters, at + n) - 1]
            stop = stop if stop > at else clusters[bisect_right(clusters, at)]
        out.append((at, stop))
        at = stop
    return out


def test_chunks_are_those_of_the_whole_text():
    rng = random.Random(1)
    signs = "ab  \n\r.,'é漢字́‍ 🇩🇪👩🚀1x_"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 400))) for _ in range(500)]
    texts += ["x" * 2_000, " " * 700 + "a " * 400, "wordless" * 100 + " end"]
    for t in texts:
        for n in (1, 7, 40, 300):
            assert plain.chunk_text(t, n) == _whole(t, n)
