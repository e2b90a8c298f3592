"""MinHash signatures and their estimates; whole signatures at once in numpy.

A sketch of fewer tokens than a shingle has is EMPTY in every row, as 2**64 - 1, which a signed long shows as -1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import xxhash

from lexloom.functions.plain import fold

P61 = (1 << 61) - 1
EMPTY = (1 << 64) - 1
_U, _M32 = np.uint64, np.uint64(0xFFFFFFFF)


def split_mix(seed: int) -> Iterator[int]:
    """The SplitMix64 stream of a seed."""
    state = seed % (1 << 64)
    while True:
        state = (state + 0x9E3779B97F4A7C15) % (1 << 64)
        z = (state ^ state >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
        z = (z ^ z >> 27) * 0x94D049BB133111EB % (1 << 64)
        yield z ^ z >> 31


@lru_cache(maxsize=8)
def _maps(n: int, seed: int) -> list[tuple[int, int]]:
    stream = split_mix(seed)
    return [(next(stream) % (P61 - 1) + 1, next(stream) % P61) for _ in range(n)]


def _affine(a: int, b: int, x: np.ndarray) -> np.ndarray:
    """(a * x + b) mod 2**61 - 1 of values below it, by 32-bit halves, as 2**61 is 1 and 2**64 is 8."""
    ah, al, xh, xl = _U(a >> 32), _U(a & 0xFFFFFFFF), x >> _U(32), x & _M32
    mid, low = ah * xl + al * xh, al * xl
    s = ah * xh * _U(8) + (mid >> _U(29)) + ((mid & _U((1 << 29) - 1)) << _U(32)) + (low & _U(P61)) + (low >> _U(61)) + _U(b)
    s = (s & _U(P61)) + (s >> _U(61))
    return np.where(s >= _U(P61), s - _U(P61), s)


def _hash(window: list[bytes]) -> int:
    framed = b"".join(len(t).to_bytes(8, "little") + t for t in window)
    return xxhash.xxh64_intdigest(len(window).to_bytes(8, "little") + framed, seed=0)


def _hashes(text: str, size: int) -> set[int]:
    """_hash of each shingle of a text: its tokens are framed once."""
    framed = [len(t).to_bytes(8, "little") + t for t in map(str.encode, fold(text))]
    head, digest = size.to_bytes(8, "little"), xxhash.xxh64_intdigest
    return {digest(head + b"".join(w)) for w in zip(*(framed[i:] for i in range(size)))}


@lru_cache(maxsize=8)
def _halves(n: int, seed: int) -> tuple[np.ndarray, ...]:
    """Columns of a >> 32, 8 * (a >> 32), the low half of a, and b."""
    a, b = (np.array(x, np.uint64)[:, None] for x in zip(*_maps(n, seed)))
    return a >> _U(32), (a >> _U(32)) * _U(8), a & _M32, b


def _least(n: int, seed: int, x: np.ndarray, cells: int = 16_384) -> np.ndarray:
    """The least value of each of n maps over all x: _affine of many maps at a time, in as much memory as caches hold."""
    least = np.full(n, EMPTY, np.uint64)
    halves = _halves(n, seed)
    wide = min(len(x), cells)
    high = max(1, cells // wide)
    s, mid, low = (np.empty((high, wide), np.uint64) for _ in range(3))
    for first in range(0, len(x), wide):
        part = x[first : first + wide]
        xh, xl = part >> _U(32), part & _M32
        for i in range(0, n, high):
            ah, ah8, al, b = (h[i : i + high] for h in halves)
            at = np.s_[: len(ah), : len(part)]
            s_, m_, l_ = s[at], mid[at], low[at]
            np.multiply(ah, xl, out=m_)
            np.multiply(al, xh, out=l_)
            m_ += l_
            np.multiply(ah8, xh, out=s_)
            np.right_shift(m_, _U(29), out=l_)
            s_ += l_
            m_ &= _U((1 << 29) - 1)
            m_ <<= _U(32)
            s_ += m_
            s_ += b
            np.multiply(al, xl, out=l_)
            np.right_shift(l_, _U(61), out=m_)
            s_ += m_
            l_ &= _U(P61)
            s_ += l_
            np.right_shift(s_, _U(61), out=m_)
            s_ &= _U(P61)
            s_ += m_
            # below the modulus the difference wraps to above it
            np.subtract(s_, _U(P61), out=m_)
            np.minimum(s_, m_, out=s_)
            np.minimum(least[i : i + high], s_.min(axis=1), out=least[i : i + high])
    return least


def minhash_signature(text: str, num_perm: int = 128, shingle_size: int = 3, seed: int = 0, bits: int | None = None) -> list[int]:
    hashes = _hashes(text, shingle_size)
    if not hashes:
        out = [EMPTY] * num_perm
    else:
        x = np.fromiter(hashes, np.uint64, len(hashes))
        x = (x & _U(P61)) + (x >> _U(61))
        x = np.where(x >= _U(P61), x - _U(P61), x)
        out = _least(num_perm, seed, x).tolist()
    return out if bits is None else [v & ((1 << bits) - 1) for v in out]


def _mixed(state: np.ndarray) -> np.ndarray:
    """The output of SplitMix64 at a state already advanced."""
    z = (state ^ (state >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def superminhash_signature(text: str, num_perm: int = 128, shingle_size: int = 3, seed: int = 0, block: int = 4_096) -> list[int]:
    """SuperMinHash (Ertl 2017) of a text's shingles, each row the bits of a double.

    A shingle's own stream deals a permutation of the rows, step by step; its j-th row gets j plus a uniform draw, and a row
    keeps its least value. As that is a minimum, blocks of shingles go through each step together, in any order, until the
    step is above all rows.
    """
    hashes = sorted(_hashes(text, shingle_size))
    least = np.full(num_perm, np.inf)
    frame = (2).to_bytes(8, "little") + (seed % (1 << 64)).to_bytes(8, "little")
    step = _U(0x9E3779B97F4A7C15)
    for first in range(0, len(hashes), block):
        some = hashes[first : first + block]
        state = np.fromiter((xxhash.xxh64_intdigest(frame + h.to_bytes(8, "little")) for h in some), np.uint64, len(some))
        rows, at = np.tile(np.arange(num_perm), (len(some), 1)), np.arange(len(some))
        for j in range(num_perm):
            if j > least.max():
                break
            state = state + step
            draw = np.minimum(((_mixed(state) >> _U(11)).astype(float) + 0.5) * 2.0**-53, np.nextafter(1.0, 0.0))
            state = state + step
            k = j + (_mixed(state) % _U(num_perm - j)).astype(np.int64)
            chosen = rows[at, k]
            rows[at, k] = rows[:, j]
            np.minimum.at(least, chosen, draw + j)
    return [EMPTY] * num_perm if not hashes else [int(v) for v in least.view(np.uint64)]


def signed(values: list[int]) -> list[int]:
    return [v - (1 << 64) if v >> 63 else v for v in values]


def minhash_jaccard(a: list[int], b: list[int], bits: int | None = None) -> float:
    """Share of equal rows; with b-bit rows, less the agreement that chance gives."""
    if len(a) != len(b) or not len(a):
        raise ValueError("signatures must be of one length, and not empty")
    same = sum(x == y for x, y in zip(a, b)) / len(a)
    if bits is None:
        return same
    chance = 2.0**-bits
    return max(0.0, (same - chance) / (1 - chance))


def _high(a: int, x: np.ndarray) -> np.ndarray:
    """The high half of a * x."""
    ah, al, xh, xl = _U(a >> 32), _U(a & 0xFFFFFFFF), x >> _U(32), x & _M32
    mid = ah * xl
    low = (al * xl >> _U(32)) + (mid & _M32)
    cross = al * xh
    low += cross & _M32
    return ah * xh + (mid >> _U(32)) + (cross >> _U(32)) + (low >> _U(32))


def philox(seed: int, keys: np.ndarray, n: int) -> np.ndarray:
    """n doubles for each key: those of numpy's Philox(key=[seed, key]), which takes pairs that need both integer types as floats."""
    pairs = np.full(len(keys), seed % (1 << 64), np.uint64), keys
    mixed = (pairs[0] >> _U(63)) != (pairs[1] >> _U(63))
    with np.errstate(invalid="ignore"):
        first, second = (np.where(mixed, x.astype(float).astype(np.uint64), x)[:, None] for x in pairs)
    a = np.tile(np.arange(1, -(-n // 4) + 1, dtype=np.uint64), (len(keys), 1))
    b, c, d = (np.zeros_like(a) for _ in range(3))
    with np.errstate(over="ignore"):
        for _ in range(10):
            low_a, low_c = a * _U(0xD2E7470EE14C6C93), c * _U(0xCA5A826395121157)
            a, b, c, d = _high(0xCA5A826395121157, c) ^ b ^ first, low_c, _high(0xD2E7470EE14C6C93, a) ^ d ^ second, low_a
            first, second = first + _U(0x9E3779B97F4A7C15), second + _U(0xBB67AE8584CAA73B)
    return (np.stack([a, b, c, d], axis=2).reshape(len(keys), -1)[:, :n] >> _U(11)) * 2.0**-53


class _Draws:
    """r, log c and beta of tokens, by their hashes. Those made last are kept, as texts share most of their tokens."""

    def __init__(self, num_perm: int, seed: int) -> None:
        self.num_perm, self.seed, self.at = num_perm, seed, {}
        self.table = np.empty((max(TOKENS, (1 << 20) // num_perm), 3, num_perm))

    def of(self, keys: list[int]) -> np.ndarray:
        """A row for each of TOKENS keys at most."""
        new = [k for k in keys if k not in self.at]
        if len(self.at) + len(new) > len(self.table):
            self.at.clear()
            new = keys
        new = list(dict.fromkeys(new))
        if new:
            u = philox(self.seed, np.array(new, np.uint64), 5 * self.num_perm)
            u = np.maximum(u.reshape(-1, 5, self.num_perm), 1e-300)
            rows = self.table[len(self.at) : len(self.at) + len(new)]
            rows[:, 0], rows[:, 1], rows[:, 2] = -np.log(u[:, 0] * u[:, 1]), np.log(-np.log(u[:, 2] * u[:, 3])), u[:, 4]
            self.at |= {k: i for i, k in enumerate(new, len(self.at))}
        return self.table[np.fromiter((self.at[k] for k in keys), np.int64, len(keys))]


#: Tokens whose draws are made together.
TOKENS = 4_096
_kept_draws = lru_cache(maxsize=2)(_Draws)


def weighted_minhash_signature(text: str, num_perm: int = 128, seed: int = 0) -> list[tuple[int, int]]:
    """Consistent weighted sampling (Ioffe 2010) of a text's tokens by their counts: (token hash, level) a row.

    The draws are this package's own: equal in every run, comparable with each other only.
    """
    counts = Counter(fold(text))
    keys, times = [xxhash.xxh64_intdigest(t) for t in counts], np.fromiter(counts.values(), float, len(counts))
    least, out = np.full(num_perm, np.inf), [(EMPTY, 0)] * num_perm
    for first in range(0, len(keys), TOKENS):
        some = keys[first : first + TOKENS]
        r, log_c, beta = _kept_draws(num_perm, seed).of(some).swapaxes(0, 1)
        level = np.floor(np.log(times[first : first + TOKENS])[:, None] / r + beta)
        score = log_c - (r * (level - beta) + r)
        for i, k in enumerate(np.argmin(score, axis=0).tolist()):
            if score[k, i] < least[i]:
                least[i], out[i] = score[k, i], (some[k], int(level[k, i]))
    return out


def minhash_weighted_jaccard(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> float:
    """Share of rows equal in both hash and level."""
    if len(a) != len(b) or not len(a):
        raise ValueError("signatures must be of one length, and not empty")
    return sum(tuple(x) == tuple(y) for x, y in zip(a, b)) / len(a)
