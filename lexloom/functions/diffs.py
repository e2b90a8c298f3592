"""Shortest edit scripts between two sequences, as (tag, i1, i2, j1, j2)."""

from __future__ import annotations

from collections.abc import Sequence


def _script(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """The matched places (i, j) of a greedy shortest edit script (Myers 1986)."""
    n, m, reach, trail = len(a), len(b), {1: 0}, []
    for d in range(n + m + 1):
        trail.append(dict(reach))
        for k in range(-d, d + 1, 2):
            down = k == -d or (k != d and reach[k - 1] < reach[k + 1])
            x = reach[k + 1] if down else reach[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= n and x - k >= m:
                break
        else:
            continue
        break
    matched, x, y = [], n, m
    for d in range(len(trail) - 1, -1, -1):
        before, k = trail[d], x - y
        prev = k + 1 if k == -d or (k != d and before[k - 1] < before[k + 1]) else k - 1
        from_x = before[prev] if d else 0
        from_y = from_x - prev if d else 0
        while x > from_x and y > from_y:
            x, y = x - 1, y - 1
            matched.append((x, y))
        x, y = from_x, from_y
    return matched[::-1]


def diff_opcodes(a: Sequence, b: Sequence) -> list[tuple[str, int, int, int, int]]:
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    inner = _script(a[head : len(a) - tail], b[head : len(b) - tail])
    same = [(i, i) for i in range(head)] + [(i + head, j + head) for i, j in inner] + [(len(a) - tail + i, len(b) - tail + i) for i in range(tail)]
    out: list[tuple[str, int, int, int, int]] = []
    i = j = 0
    for x, y in [*same, (len(a), len(b))]:
        if x > i or y > j:
            out.append(("replace" if x > i and y > j else "delete" if x > i else "insert", i, x, j, y))
        if x < len(a) and y < len(b):
            if out and out[-1][0] == "equal":
                out[-1] = ("equal", out[-1][1], x + 1, out[-1][3], y + 1)
            else:
                out.append(("equal", x, x + 1, y, y + 1))
        i, j = x + 1, y + 1
    return out


def diff_opcodes_lines(a: str, b: str) -> list[tuple[str, int, int, int, int]]:
    split = lambda t: t.removesuffix("\n").split("\n") if t else []
    mark = lambda t: [x + "\n" for x in split(t)[:-1]] + ([split(t)[-1] + "\n" * t.endswith("\n")] if t else [])
    return diff_opcodes(mark(a), mark(b))
