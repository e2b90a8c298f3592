"""Random tokens and UUIDs: from the system's generator, or from a seeded ChaCha20 stream (for tests, never for secrets)."""

from __future__ import annotations

import os
import struct
import time
import uuid
from collections.abc import Iterator, Sequence

import numpy as np

HEX_LOWER = "0123456789abcdef"
HEX_UPPER = "0123456789ABCDEF"
HEX_MIXED = "0123456789abcdefABCDEF"
B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
B64URL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"


def _key(seed: int) -> bytes:
    """A 32-byte key from a 64-bit seed: eight PCG32 outputs."""
    state, out = seed % (1 << 64), b""
    for _ in range(8):
        state = (state * 6364136223846793005 + 11634580027462260723) % (1 << 64)
        x, turn = ((state >> 18 ^ state) >> 27) & 0xFFFFFFFF, state >> 59
        out += struct.pack("<I", (x >> turn | x << (-turn & 31)) & 0xFFFFFFFF)
    return out


def _block(key: bytes, count: int) -> bytes:
    start = [*struct.unpack("<4I", b"expand 32-byte k"), *struct.unpack("<8I", key), count & 0xFFFFFFFF, count >> 32, 0, 0]
    s = start[:]

    def quarter(a: int, b: int, c: int, d: int) -> None:
        for x, y, z, turn in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
            s[x] = (s[x] + s[y]) & 0xFFFFFFFF
            v = s[z] ^ s[x]
            s[z] = (v << turn | v >> (32 - turn)) & 0xFFFFFFFF

    for _ in range(10):
        for i in range(4):
            quarter(i, 4 + i, 8 + i, 12 + i)
        for i in range(4):
            quarter(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4)
    return struct.pack("<16I", *((x + y) & 0xFFFFFFFF for x, y in zip(s, start)))


def _bytes(seed: int | None) -> Iterator[bytes]:
    """Eight random bytes at a time."""
    if seed is None:
        while True:
            yield os.urandom(8)
    key, count = _key(seed), 0
    while True:
        block = _block(key, count)
        yield from (block[i : i + 8] for i in range(0, 64, 8))
        count += 1


def random_string(length: int, alphabet: str, seed: int | None = None) -> str:
    """Uniform over the alphabet: products whose low half falls short are drawn again."""
    if length < 0 or not alphabet:
        raise ValueError("length must not be negative, alphabet not empty")
    n, source, out = len(alphabet), _bytes(seed), []
    short = (1 << 64) % n
    while len(out) < length:
        high, low = divmod(int.from_bytes(next(source), "little") * n, 1 << 64)
        if low >= short:
            out.append(alphabet[high])
    return "".join(out)


def _keys(seeds: np.ndarray) -> list[np.ndarray]:
    """_key of many seeds: eight arrays of words."""
    state, out = seeds.copy(), []
    for _ in range(8):
        state = state * np.uint64(6364136223846793005) + np.uint64(11634580027462260723)
        x, turn = ((state >> np.uint64(18) ^ state) >> np.uint64(27)).astype(np.uint32), (state >> np.uint64(59)).astype(np.uint32)
        out.append(x >> turn | x << (-turn & np.uint32(31)))
    return out


def _blocks(keys: list[np.ndarray], counts: int) -> np.ndarray:
    """The first `counts` of _block of many keys: a row for each 64-bit draw."""
    n, number = len(keys[0]), np.repeat(np.arange(counts, dtype=np.uint64), len(keys[0]))
    start = np.zeros((4, 4, n * counts), np.uint32)
    start[0] = np.array(struct.unpack("<4I", b"expand 32-byte k"), np.uint32)[:, None]
    start[1:3] = np.tile(np.stack(keys), counts).reshape(2, 4, -1)
    start[3, 0], start[3, 1] = number & np.uint64(0xFFFFFFFF), number >> np.uint64(32)
    a, b, c, d = start.copy()
    for i in range(20):
        for x, y, z, turn in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
            x += y
            z ^= x
            high = z << np.uint32(turn)
            z >>= np.uint32(32 - turn)
            z |= high
        # every second round goes along the diagonals
        turn = (1, 2, 3) if i % 2 == 0 else (3, 2, 1)
        b, c, d = (np.roll(x, -k, axis=0) for x, k in zip((b, c, d), turn))
    words = np.concatenate((a, b, c, d)) + start.reshape(16, -1)
    draws = words[::2] | words[1::2].astype(np.uint64) << np.uint64(32)
    return draws.reshape(8, counts, n).swapaxes(0, 1).reshape(8 * counts, n)


def random_strings(length: int, alphabet: str, seeds: Sequence[int]) -> list[str]:
    """random_string of many seeds, all rows of a block at once."""
    if length < 0 or not alphabet:
        raise ValueError("length must not be negative, alphabet not empty")
    n, short, letters = np.uint64(len(alphabet)), np.uint64((1 << 64) % len(alphabet)), np.array(list(alphabet), object)
    keys = _keys(np.array([x % (1 << 64) for x in seeds], np.uint64))
    out, again = np.empty((len(seeds), length), object), np.zeros(len(seeds), bool)
    for i, x in enumerate(_blocks(keys, -(-length // 8))[:length]):
        high = ((x >> np.uint64(32)) * n + ((x & np.uint64(0xFFFFFFFF)) * n >> np.uint64(32))) >> np.uint64(32)
        out[:, i] = letters[high.astype(np.int64)]
        again |= x * n < short
    return [random_string(length, alphabet, x) if redo else "".join(row) for x, row, redo in zip(seeds, out.tolist(), again.tolist())]


def random_hex(length: int, seed: int | None = None) -> str:
    return random_string(length, HEX_LOWER, seed)


def random_b62(length: int, seed: int | None = None) -> str:
    return random_string(length, B62, seed)


def random_b64url(length: int, seed: int | None = None) -> str:
    return random_string(length, B64URL, seed)


def uuid4_bytes(seed: int | None = None) -> bytes:
    source = _bytes(seed)
    return uuid.UUID(bytes=next(source) + next(source), version=4).bytes


def uuid4(seed: int | None = None) -> str:
    return str(uuid.UUID(bytes=uuid4_bytes(seed)))


def uuid7_bytes() -> bytes:
    raw = bytearray((time.time_ns() // 1_000_000).to_bytes(6, "big") + os.urandom(10))
    raw[6], raw[8] = 0x70 | raw[6] & 15, 0x80 | raw[8] & 63
    return bytes(raw)


def uuid7() -> str:
    return str(uuid.UUID(bytes=uuid7_bytes()))
