"""How much of one text another supports: weighted longest common subsequences of words (ROUGE-W, f(k) = k ** 1.2)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np

from lexloom.functions.plain import fold, sentence_bounds, similarity_ratio, word_bounds

POWER = 1.2
#: Words scanned of a text, terms of a query.
MAX_WORDS, MAX_TERMS = 16_384, 128
#: Windows looked at again by is_grounded, and the similarity that they need.
CANDIDATES, LEAST_SCORE = 64, 0.5
#: Windows compared together.
WINDOWS = 4_096


def terms(text: str) -> list[str]:
    return [w for w in fold(text) if any(c.isalnum() for c in w)]


def weighted_lcs(a: list[str], b: list[str]) -> float:
    """The best weight of common runs, a run of k words weighing k ** POWER; two rows of the table at a time."""
    gain = [(k + 1) ** POWER - k**POWER for k in range(min(len(a), len(b)) + 1)]
    weight, run = [0.0] * (len(b) + 1), [0] * (len(b) + 1)
    for x in a:
        new_weight, new_run = [0.0], [0]
        for j, y in enumerate(b):
            best, length = max(weight[j + 1], new_weight[j]), 0
            if x == y and weight[j] + gain[run[j]] >= best:
                best, length = weight[j] + gain[run[j]], run[j] + 1
            new_weight.append(best)
            new_run.append(length)
        weight, run = new_weight, new_run
    return weight[-1]


def _share(weight: float, n: int) -> float:
    return (weight / n**POWER) ** (1 / POWER) if n else 0.0


def f1(query: list[str], text: list[str]) -> float:
    w = weighted_lcs(query, text)
    precision, recall = _share(w, len(text)), _share(w, len(query))
    return 2 * precision * recall / (precision + recall) if w else 0.0


def grounding_coverage(source: str, text: str) -> float:
    s, t = terms(source)[:MAX_WORDS], terms(text)[:MAX_WORDS]
    return _share(weighted_lcs(s, t), len(s))


def ground_sentences(text: str, query: str) -> dict:
    q, found = terms(query)[:MAX_TERMS], []
    for a, b in sentence_bounds(text):
        found.append({"text": text[a:b], "start": a, "end": b, "score": f1(q, terms(text[a:b]))})
    return {"sentences": found, "score": max((s["score"] for s in found), default=0.0)}


def _clamp(text: str, start: int, end: int, max_chars: int) -> int:
    """An end at a word's end, within max_chars of start; one word at least."""
    if end - start <= max_chars:
        return end
    ends = [start + b for a, b in word_bounds(text[start:end]) if not text[start + a : start + b].isspace()]
    inside = [e for e in ends if e - start <= max_chars]
    return inside[-1] if inside else ends[0] if ends else end


def highlight(query: str, text: str, max_snippets: int = 3, max_chars: int = 400) -> dict:
    """The sentences that share words with the query, best first, none overlapping."""
    if max_chars <= 0:
        raise ValueError("max_chars must be positive")
    q, found = terms(query)[:MAX_TERMS], []
    known = set(q)
    for a, b in sentence_bounds(text):
        b = _clamp(text, a, b, max_chars)
        words = terms(text[a:b])
        if known.intersection(words):
            found.append({"text": text[a:b], "start": a, "end": b, "score": f1(q, words)})
    found.sort(key=lambda s: (-s["score"], s["start"]))
    return {"snippets": found[:max_snippets], "score": found[0]["score"] if found and max_snippets else 0.0}


def _scorer(claim: str, source: str) -> Callable:
    """Similarity of a claim to the windows of its length at given starts; what a window at the end lacks counts as different.

    Rows of bits as in plain._matches, for claims of 64 characters at most those of all windows at once."""
    n = len(claim)
    if n > 64:
        return lambda starts: (similarity_ratio(claim, w) * (n + len(w)) / (2 * n) for w in (source[i : i + n] for i in starts))
    where: dict[str, int] = {}
    for i, c in enumerate(claim):
        where[c] = where.get(c, 0) | 1 << i
    # zeros behind the end match nothing
    masks = np.array([*(where.get(c, 0) for c in source), *[0] * n], np.uint64)
    full, one = np.uint64((1 << n) - 1), np.uint64(1)

    def scores(starts: Sequence[int]) -> Iterable[float]:
        at, row = np.fromiter(starts, np.int64, len(starts)), np.zeros(len(starts), np.uint64)
        for k in range(n):
            x = row | masks[at + k]
            row = x & ((x - (row << one | one)) ^ x) & full
        both = n + np.minimum(n, len(source) - at)
        return (2 * np.bitwise_count(row).astype(np.int64) / both * both / (2 * n)).tolist()

    return scores


def is_grounded(claim: str, source: str, fuzzy: bool = False, threshold: float = 0.85) -> bool:
    """claim occurs in source; fuzzy: or some window of its length is as similar.

    Windows stand half a length apart; around the CANDIDATES best of at least LEAST_SCORE they stand a sixteenth apart."""
    if not claim or claim in source:
        return True
    if not fuzzy:
        return False
    n, size = len(claim), len(source)
    if size <= n:
        return similarity_ratio(claim, source) >= threshold if source else threshold <= 0

    score = _scorer(claim, source)
    found, seen = [], set()
    step = max(1, n // 2)
    starts = range(0, max(size - n, 0) + step, step)  # the last is the first window that reaches the end
    together = WINDOWS if n <= 64 else 1
    for first in range(0, len(starts), together):
        some = starts[first : first + together]
        scores = list(score(some))
        if any(s >= threshold for s in scores):
            return True
        for s, i in zip(scores, some):
            if s >= LEAST_SCORE and source[i : i + n] not in seen:  # equal windows take one seat
                seen.add(source[i : i + n])
                found.append((s, i))
    for _, i in sorted(found, key=lambda x: (-x[0], x[1]))[:CANDIDATES]:
        low, high = max(0, i - n // 2), min(i + n // 2, size - n)
        if any(s >= threshold for s in score([*range(low, high, max(1, n // 16)), high])):
            return True
    return False


def grounding_report(text: str, sources: list[str], query: str | None = None, threshold: float = 0.85) -> dict:
    found = []
    for a, b in sentence_bounds(text):
        best, score = None, 0.0
        for i, source in enumerate(sources):
            s = highlight(text[a:b], source, 1)["score"]
            if s > score:
                best, score = i, s
        found.append({"text": text[a:b], "start": a, "end": b, "best_source": best, "score": score, "grounded": best is not None and score >= threshold})
    n, scores, good = len(found), [s["score"] for s in found], sum(s["grounded"] for s in found)
    return {
        "sentences": found,
        "aggregate": {
            "grounded_ratio": good / n if n else 0.0,
            "grounded": good,
            "sentences": n,
            "mean_score": sum(scores) / n if n else 0.0,
            "best_score": max(scores, default=0.0),
            "coverage": grounding_coverage(text, "\n".join(sources)) if sources else 0.0,
            "query_score": ground_sentences(text, query)["score"] if query else 0.0,
        },
    }
