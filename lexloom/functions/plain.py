"""Functions that no built-in expresses, on plain Python values; `columns` lifts them to Spark.

Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import html
import json
import math
import re
import unicodedata
import urllib.parse
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Sequence
from functools import lru_cache
from itertools import accumulate

import numpy as np
import regex

_BREAK = regex.compile(r"(?w)\b")
_APART = regex.compile(r"(?wV1)\b")
# texts of ASCII and Latin letters without apostrophes, whose breaks have a simple rule
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIMPLE = re.compile(rf"[\x00-\x26\x28-\x7f{_LATIN}]*")
_SEGMENT = re.compile(rf"[{_LATIN}0-9_]+(?:(?:(?<=[{_LATIN}])[:.](?=[{_LATIN}])|(?<=[0-9])[,;.](?=[0-9]))[{_LATIN}0-9_]+)*| +|\r\n|[\x00-\x7f]")
_SENTENCE = regex.compile(r"[.!?…。！？]+[\"'’”)\]]*[ \t ]*(?:\r\n|[\n\r  ])?|\r\n|[\n\r  ]")


# --- segments
def words(text: str) -> list[str]:
    return _SEGMENT.findall(text) if _SIMPLE.fullmatch(text) else [w for w in _APART.split(text) if w]


def word_bounds(text: str) -> list[tuple[int, int]]:
    ends = list(accumulate(map(len, words(text))))
    return list(zip([0, *ends], ends))


def real_words(text: str) -> list[str]:
    return [w for w in words(text) if not w.isspace()]


def word_count(text: str) -> int:
    if not text:
        return 0
    # breaks at both ends of the text count as one
    return sum(1 for _ in _BREAK.finditer(text)) - 1


def sentence_bounds(text: str) -> list[tuple[int, int]]:
    """A sentence ends after its closing marks and the blanks behind, or at a line end; not before a lower-case letter, nor inside a number."""
    out, last = [], 0
    for m in _SENTENCE.finditer(text):
        end, nxt = m.end(), text[m.end() : m.end() + 1]
        stop = m[0][:1]
        if stop == "." and nxt and not m[0][-1].isspace():
            continue
        if stop == "." and m[0].rstrip(" \t ") == "." and nxt.islower() and m[0][-1] not in "\r\n":
            continue
        if end > last:
            out.append((last, end))
            last = end
    if last < len(text):
        out.append((last, len(text)))
    return out


def sentence_count(text: str) -> int:
    return len(sentence_bounds(text))


# --- cleanup and codecs
def html_unescape(text: str) -> str:
    return html.unescape(text)


def dedent(text: str) -> str:
    lines = text.split("\n")
    solid = [x for x in lines if x and not x.isspace()]
    margin = ""
    if solid:
        low, high = min(solid), max(solid)
        while len(margin) < min(len(low), len(high)) and low[len(margin)] == high[len(margin)] and low[len(margin)] in " \t":
            margin += low[len(margin)]
    return "\n".join("" if not x or x.isspace() else x[len(margin) :] for x in lines)


def decode_utf16(raw: bytes, errors: str = "strict", byteorder: str = "native") -> str | None:
    try:
        return bytes(raw).decode({"native": "utf-16", "little": "utf-16-le", "big": "utf-16-be"}[byteorder], errors)
    except UnicodeDecodeError:
        return None


def utf16_is_valid(raw: bytes, byteorder: str = "native") -> bool:
    return decode_utf16(raw, "strict", byteorder) is not None


def b64_decode(text: str, validate: bool = True) -> bytes | None:
    try:
        return base64.b64decode(text, validate=validate)
    except (binascii.Error, ValueError):
        return None


def unquote(text: str) -> str:
    return urllib.parse.unquote(text)


def unquote_plus(text: str) -> str:
    return urllib.parse.unquote_plus(text)


def find_unescaped(haystack: bytes, needle: bytes) -> int:
    """The first place of needle with an even number of backslashes before it, or -1."""
    at = haystack.find(needle)
    while at >= 0:
        first = at
        while first and haystack[first - 1] == 92:
            first -= 1
        if (at - first) % 2 == 0:
            return at
        at = haystack.find(needle, at + 1)
    return -1


def contains_unescaped(haystack: bytes, needle: bytes) -> bool:
    return find_unescaped(haystack, needle) >= 0


def detect_encoding(raw: bytes) -> str:
    """A guess: byte order marks, valid UTF-8, zero bytes in every second place, else a Western code page."""
    raw = bytes(raw)
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")):
        if raw.startswith(mark):
            return name
    try:
        raw.decode()
        return "UTF-8"
    except UnicodeDecodeError:
        pass
    if len(raw) > 3 and raw[1::2].count(0) > len(raw) // 4:
        return "UTF-16LE"
    if len(raw) > 3 and raw[::2].count(0) > len(raw) // 4:
        return "UTF-16BE"
    return "windows-1252"


# --- hashes
def content_hash(text: str) -> str | None:
    """SHA-256 of a JSON text in canonical form: sorted keys, no spaces, ASCII; none for what is no JSON or nests too deep."""
    try:
        return hashlib.sha256(json.dumps(json.loads(text), sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    except (ValueError, RecursionError):
        return None


# --- JSON and fences


def json_is_valid(text: str) -> bool:
    def bad(x):
        raise ValueError(x)

    def finite(x):
        if math.isinf(float(x)):
            raise ValueError(x)

    try:
        json.loads(text, parse_constant=bad, parse_float=finite)
        return True
    except (ValueError, RecursionError):
        return False


_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[ \t]*([^\n`]*)\n(.*?)(?:^ {0,3}\1[`~]*[ \t]*$\n?|\Z)", re.M | re.S)


def extract_code_blocks(text: str) -> list[tuple[str | None, str, int, int]]:
    return [((m[2].split() or [None])[0], m[3], m.start(), m.end()) for m in _FENCE.finditer(text)]


def strip_code_fences(text: str) -> str:
    inner = text.strip()
    m = _FENCE.fullmatch(inner)
    return m[3] if m else text


# --- pairs
def _matches(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit rows."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row, full = 0, (1 << len(a)) - 1
    for c in b:
        x = row | where.get(c, 0)
        y = (row << 1 | 1) & full
        row = x & ((x - y) ^ x) & full
    return row.bit_count()


def similarity_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 2 * _matches(a, b) / total if total else 1.0


def get_close_matches(word: str, possibilities: Sequence[str], n: int = 3, cutoff: float = 0.6) -> list[str]:
    scored = [(similarity_ratio(word, p), p) for p in possibilities]
    return [p for s, p in sorted((x for x in scored if x[0] >= cutoff), reverse=True)[:n]]


def jaro(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used) if u]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    s = jaro(a, b)
    if s <= 0.7:
        return s
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return s + same * 0.1 * (1 - s)


# --- patterns
def matcher(patterns: Sequence[str]) -> Callable[[str], list[tuple[int, int, int]]]:
    """Leftmost-longest matches without overlap: (start, end, number of the pattern)."""
    first: dict[str, int] = {}
    for i, p in enumerate(patterns):
        if not p:
            raise ValueError("empty pattern")
        first.setdefault(p, i)
    either = re.compile("|".join(re.escape(p) for p in sorted(first, key=len, reverse=True)) or r"(?!)")
    return lambda text: [(m.start(), m.end(), first[m[0]]) for m in either.finditer(text)]


def replace_many(text: str, replacements: dict[str, str], mask: str | None = None) -> str:
    names, out, last = list(replacements), [], 0
    for a, b, i in matcher(names)(text):
        new = replacements[names[i]]
        out += [text[last:a], new if mask is None else new[: b - a].ljust(b - a, mask)]
        last = b
    return "".join([*out, text[last:]])


def first_invalid_charset(items: Sequence[str], rest: str, first: str | None = None) -> int:
    head, tail = set(rest if first is None else first), set(rest)
    for i, x in enumerate(items):
        if not x or x[0] not in head or not tail.issuperset(x[1:]):
            return i
    return -1


# --- cutting
def _clusters(text: str) -> set[int]:
    return {m.start() for m in regex.finditer(r"\X", text)} | {len(text)}


def truncate_ellipsis(text: str, max_chars: int) -> str:
    if len(text) <= max_chars:
        return text
    if max_chars <= 0:
        return ""
    return text[: max(c for c in _clusters(text) if c <= max_chars - 1)] + "…"


def truncate_to_bounds(text: str, max_chars: int, boundary: str = "word") -> str:
    if len(text) <= max_chars:
        return text
    last = 0
    # breaks come in order: those beyond the cut aren't looked for
    for b in (m.start() for m in _BREAK.finditer(text)) if boundary == "word" else (b for _, b in sentence_bounds(text)):
        if b > max_chars:
            break
        last = b
    return text[:last].rstrip()


def _windows(spans: list[tuple[int, int]], n: int, overlap: int) -> list[tuple[int, int]]:
    out, i = [], 0
    while i < len(spans):
        part = spans[i : i + n]
        out.append((part[0][0], part[-1][1]))
        if i + n >= len(spans):
            break
        i += n - overlap
    return out


def chunk_by_words(text: str, n: int, overlap: int = 0) -> list[tuple[int, int]]:
    return _windows([(a, b) for a, b in word_bounds(text) if not text[a:b].isspace()], n, overlap)


def chunk_by_sentences(text: str, n: int, overlap: int = 0) -> list[tuple[int, int]]:
    return _windows([(a, b) for a, b in sentence_bounds(text) if not text[a:b].isspace()], n, overlap)


def chunk_by_lines(text: str, n: int, overlap: int = 0) -> list[tuple[int, int]]:
    spans = [m.span() for m in re.finditer(r"[^\r\n]+", text) if not m[0].isspace()]
    return _windows(spans, n, overlap)


def chunk_by_paragraphs(text: str, n: int, overlap: int = 0) -> list[tuple[int, int]]:
    last, spans = 0, []
    for m in re.finditer(r"(?:\r\n|\n|\r){2,}", text):
        spans.append((last, m.start()))
        last = m.end()
    spans.append((last, len(text)))
    return _windows([s for s in spans if s[0] < s[1]], n, overlap)


def _last_word_end(text: str, at: int, limit: int) -> int:
    """The last break in (at, limit] whose segment isn't white space, or 0. Looks at the text's end first, then further back."""
    width = 96
    while True:
        # breaks at the very beginning of the look may be none in the whole text
        low = max(0, limit - width)
        sure = low + 16 if low else 0
        best, last = 0, 0
        for m in _BREAK.finditer(text, low):
            b = m.start()
            if b > limit:
                break
            if b > at and b > sure and not (text[b - 1].isspace() and text[last:b].isspace()):
                best = b
            if b >= sure:
                last = b
        if best or sure <= at:
            return best
        width *= 4


def chunk_text(text: str, max_chars: int, overlap: int = 0, boundary: str = "word") -> list[tuple[int, int]]:
    """Spans of at most max_chars that end at a boundary where one is in reach, else at a cluster; nothing is left out."""
    ends: list[int] = []
    if boundary != "word" and len(text) > max_chars:
        ends = sorted({b for a, b in sentence_bounds(text) if not text[a:b].isspace()})
    clusters: list[int] = []
    out, at = [], 0
    while at < len(text):
        stop = len(text)
        if stop - at > max_chars:
            if boundary == "word":
                stop = _last_word_end(text, at, at + max_chars)
            else:
                k = bisect_right(ends, at + max_chars) - 1
                stop = ends[k] if k >= 0 else 0
            if stop <= at:
                clusters = clusters or sorted(_clusters(text))
                stop = clusters[bisect_right(clusters, at + max_chars) - 1]
            if stop <= at:
                stop = clusters[bisect_right(clusters, at)]
        out.append((at, stop))
        if stop == len(text):
            break
        at = max(at + 1, stop - overlap) if overlap else stop
    return out


# --- phonetics
_REFINED = dict(zip("abcdefghijklmnopqrstuvwxyz", "01360240043788015936020505"))


def refined_soundex(text: str) -> str:
    letters = [c for c in text.lower() if "a" <= c <= "z"]
    if not letters:
        return ""
    out, last = letters[0].upper(), ""
    for c in letters:
        code = _REFINED[c]
        if code != last:
            out += code
        last = code
    return out


# --- shingles and grounding
def fold(text: str) -> list[str]:
    return [w if w.isascii() else unicodedata.normalize("NFC", w) for w in map(str.lower, real_words(text))]


def shingles(text: str, width: int = 3) -> set[tuple[str, ...]]:
    w = fold(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def exact_shingles(text: str, width: int = 3) -> set[tuple[str, ...]]:
    """Shingles of full width only: none in a shorter text."""
    w = fold(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def shingle_jaccard(a: str, b: str, width: int = 3) -> float:
    x, y = shingles(a, width), shingles(b, width)
    return len(x & y) / len(x | y) if x | y else 1.0


def shingle_dice(a: str, b: str, width: int = 3) -> float:
    x, y = shingles(a, width), shingles(b, width)
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0


def _fnv(token: str, bits: int) -> bytes:
    prime, h = ((1 << 40) + 0x1B3, 0xCBF29CE484222325) if bits == 64 else ((1 << 88) + 0x13B, 0x6C62272E07BB014262B821756295C58D)
    mask = (1 << bits) - 1
    for byte in token.encode():
        h = (h ^ byte) * prime & mask
    return h.to_bytes(bits // 8, "little")


#: Hashes of short tokens are kept, as texts share most of them.
_kept_fnv = lru_cache(maxsize=1 << 16)(_fnv)


def simhash(text: str, bits: int = 64, block: int = 4_096) -> int:
    """FNV-1a of every token, a vote per bit."""
    times = Counter(real_words(text))
    tokens, votes = list(times), np.zeros(bits)
    for i in range(0, len(tokens), block):
        some = tokens[i : i + block]
        hashes = b"".join((_kept_fnv if len(w) <= 64 else _fnv)(w, bits) for w in some)
        ones = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(len(some), -1), axis=1, bitorder="little")
        votes += np.fromiter((times[w] for w in some), float, len(some)) @ ones.astype(float)
    return int.from_bytes(np.packbits(2 * votes > times.total(), bitorder="little").tobytes(), "little")


def is_grounded(claim: str, source: str) -> bool:
    return claim in source


# --- metrics
def ndcg_at_k(ranked: Sequence, gains: dict, k: int | None = None) -> float:
    seen, unique = set(), []
    for x in ranked:
        if x not in seen:
            seen.add(x)
            unique.append(x)
    k = len(unique) if k is None else k
    got = sum(gains.get(x, 0.0) / math.log2(i + 2) for i, x in enumerate(unique[:k]))
    best = sum(g / math.log2(i + 2) for i, g in enumerate(sorted(gains.values(), reverse=True)[:k]))
    return got / best if best else 0.0
