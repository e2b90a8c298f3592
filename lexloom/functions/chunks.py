"""Chunks by a hierarchy of separators or by token budgets, content-defined chunks, and how well chunks keep sentences."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Sequence
from functools import lru_cache
from itertools import accumulate

from lexloom.functions.plain import _clusters, sentence_bounds, shingles, word_bounds

Span = tuple[int, int]
_HEADING = re.compile(r"^ {0,3}#{1,6}(?:[ \t]|$)", re.M)
_FENCED = re.compile(r"^ {0,3}(`{3,}|~{3,}).*?(?:^ {0,3}\1|\Z)", re.M | re.S)
_DEFAULT = ("heading", None)


def _split(text: str, a: int, b: int, level: str) -> list[Span]:
    """Parts of a stretch at one level; what separates paragraphs or literal parts is in none of them."""
    part = text[a:b]
    if level == "heading":
        inside = [m.span() for m in _FENCED.finditer(part)]
        cuts = [m.start() for m in _HEADING.finditer(part) if not any(x <= m.start() < y for x, y in inside)]
        out = list(zip([0, *cuts], [*cuts, len(part)]))
        out = [(x, x + len(part[x:y].rstrip("\r\n")) if y < len(part) else y) for x, y in out]
    elif level == "sentence":
        out = sentence_bounds(part)
    elif level == "word":
        out = [(x, y) for x, y in word_bounds(part)]
    else:
        out, last = [], 0
        for m in re.finditer(r"(?:\r\n|\n|\r){2,}" if level == "paragraph" else re.escape(level), part):
            out.append((last, m.start()))
            last = m.end()
        out.append((last, len(part)))
    return [(a + x, a + y) for x, y in out if x < y]


def chunk_hierarchical(text: str, max_chars: int, separators: Sequence[str | None] | None = None, overlap: int = 0) -> list[Span]:
    """Parts of the coarsest level, joined with their neighbours while they fit; those too long fall to the next level.

    None stands for paragraphs, sentences and words; headings always part. At last, text is cut at clusters.
    """
    if max_chars <= 0 or not 0 <= overlap < max_chars:
        raise ValueError("max_chars must be positive, overlap below it")
    levels: list[str] = []
    for s in _DEFAULT if separators is None or list(separators) == [None] else separators:
        levels += ["paragraph", "sentence", "word"] if s is None else [s]

    def cut(a: int, b: int, depth: int) -> list[Span]:
        if b - a <= max_chars and (depth >= len(levels) or levels[depth] != "heading"):
            return [(a, b)]
        if depth >= len(levels):
            edges, out = sorted(a + c for c in _clusters(text[a:b])), []
            while a < b:
                k = bisect_right(edges, a + max_chars) - 1
                end = edges[k] if edges[k] > a else edges[bisect_right(edges, a)]
                out.append((a, end))
                a = end
            return out
        joins, out = levels[depth] != "heading", []
        for x, y in _split(text, a, b, levels[depth]):
            if joins and out and out[-1][2] and y - out[-1][0] <= max_chars:
                out[-1] = (out[-1][0], y, True)
            elif y - x <= max_chars and joins:
                out.append((x, y, True))
            else:
                out += [(p, q, False) for p, q in cut(x, y, depth + 1)]
        return [(x, y) for x, y, _ in out]

    spans = cut(0, len(text), 0) if text else []
    return [(max(0, a - overlap) if i else a, b) for i, (a, b) in enumerate(spans)] if overlap else spans


def _pack(text: str, count: Callable[[int, int], int], max_tokens: int, overlap: int | float) -> list[Span]:
    if max_tokens <= 0:
        raise ValueError("max_tokens must be positive")
    keep = int(overlap * max_tokens) if isinstance(overlap, float) else overlap
    if not 0 <= keep < max_tokens:
        raise ValueError("overlap must be below max_tokens")
    units: list[Span] = []
    for a, b in sentence_bounds(text):
        if count(a, b) <= max_tokens:
            units.append((a, b))
            continue
        start = a
        for x, y in word_bounds(text[a:b]):
            if text[a + x : a + y].isspace() and units and units[-1][1] == a + x and a + x > start:
                units[-1] = (units[-1][0], a + y)
            else:
                units.append((a + x, a + y))
    out, i = [], 0
    while i < len(units):
        j = i + 1
        while j < len(units) and count(units[i][0], units[j][1]) <= max_tokens:
            j += 1
        out.append((units[i][0], units[j - 1][1]))
        if j == len(units):
            break
        back = j
        while keep and back - 1 > i and count(units[back - 1][0], units[j - 1][1]) <= keep:
            back -= 1
        i = back
    return out


def chunk_to_budget(text: str, token_counter: Callable[[str], int], max_tokens: int, overlap: int | float = 0) -> list[Span]:
    """Sentences, or words of those too long, while the counter finds at most max_tokens in the chunk itself."""
    return _pack(text, lambda a, b: token_counter(text[a:b]), max_tokens, overlap)


def chunk_to_offsets(text: str, token_offsets: Sequence[Span], max_tokens: int, overlap: int | float = 0) -> list[Span]:
    """The same by given token spans: those that lie within a chunk count."""
    starts, ends = [a for a, _ in token_offsets], [b for _, b in token_offsets]
    return _pack(text, lambda a, b: max(0, bisect_right(ends, b) - bisect_left(starts, a)), max_tokens, overlap)


def chunk_quality(chunks: Sequence[Span], text: str, tau: int = 0) -> dict[str, float]:
    """integrity: share of sentences that no chunk's edge cuts; cohesion: mean Dice of sentences and chunks holding them."""
    if tau < 0 or any(not 0 <= a <= b <= len(text) for a, b in chunks):
        raise ValueError("spans must lie within the text, tau must not be negative")
    sentences, edges = sentence_bounds(text), sorted({e for c in chunks for e in c})
    crossed = sum(bisect_left(edges, b - tau) > bisect_right(edges, a + tau) for a, b in sentences)
    ordered = sorted(chunks)
    # of the chunks that begin early enough, the first that reaches far enough: how far any up to each reaches only grows
    reach = list(accumulate((b for _, b in ordered), max))
    dice, last, held = [], None, set()
    for a, b in sentences:
        k = bisect_left(reach, b)
        if k < bisect_right(ordered, (a, len(text))):
            if k != last:
                last, held = k, shingles(text[slice(*ordered[k])])
            own = shingles(text[a:b])
            dice.append(2 * len(own & held) / (len(own) + len(held)) if own or held else 1.0)
    return {"integrity": 1 - crossed / len(sentences) if sentences else 1.0, "cohesion": sum(dice) / len(dice) if dice else 0.0}


@lru_cache(maxsize=1)
def _gear() -> list[int]:
    return [int.from_bytes(hashlib.md5(bytes([i]) * 64).digest()[:8], "big") for i in range(256)]


def chunk_cdc(data: bytes, min_size: int = 4096, avg_size: int = 16384, max_size: int = 65534) -> list[Span]:
    """Spans cut where a rolling gear hash has given zero bits: more bits before avg_size, fewer after it."""
    if not 0 < min_size <= avg_size <= max_size:
        raise ValueError("sizes must ascend")
    bits = max(2, avg_size.bit_length() - 1)
    strict, loose = (((1 << n) - 1) << (48 - n) for n in (bits + 1, bits - 1))
    gear, out, start, full = _gear(), [], 0, (1 << 64) - 1
    while start < len(data):
        end, h, at = min(len(data), start + max_size), 0, start + min_size
        while at < end:
            h = (h << 1) + gear[data[at]] & full
            at += 1
            if not h & (strict if at - start < avg_size else loose):
                break
        out.append((start, min(at, end)))
        start = min(at, end)
    return out
