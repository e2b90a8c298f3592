"""Boolean trigram queries of regular expressions.

A query is a list of clauses, each a set of lower-case ASCII trigrams: a text can match only if, for some clause, its
lower-cased form has all of the clause's trigrams. None means that no trigram is mandatory.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from itertools import product

#: Exact string sets and clause lists beyond these sizes are given up for weaker, still valid queries.
MAX_EXACT, MAX_CLAUSES = 64, 64


def _trigrams(s: str) -> frozenset[str]:
    s = s.lower()
    return frozenset(s[i : i + 3] for i in range(len(s) - 2) if s[i : i + 3].isascii())


def _both(a, b):
    """The conjunction of two queries."""
    if a is None or b is None:
        return b if a is None else a
    out = {x | y for x, y in product(a, b)}
    return out if len(out) <= MAX_CLAUSES else (a if len(a) <= len(b) else b)


def _either(queries):
    """The disjunction; None if any has no mandatory trigram."""
    out: set = set()
    for q in queries:
        if q is None:
            return None
        out |= q
    # a clause that contains another adds nothing
    out = {c for c in out if not any(d < c for d in out)}
    return out if len(out) <= MAX_CLAUSES else None


def _of(exact: set[str]):
    return _either([{t} if (t := _trigrams(s)) else None for s in exact]) if exact else None


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < 8:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(tree) -> tuple[set[str] | None, object]:
    """(all strings it can match, or None if they are too many; its query)."""
    run: set[str] = {""}
    whole, query = True, None

    def flush(exact: set[str]):
        nonlocal run, query, whole
        query = _both(query, _of(run))
        run, whole = exact, False

    for op, arg in tree:
        exact, inner = None, None
        if op is C.LITERAL:
            exact = {chr(arg).lower()}
        elif op is C.IN:
            exact = _class(arg)
        elif op is C.SUBPATTERN:
            exact, inner = _walk(arg[-1])
        elif op is C.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            exact = set().union(*(p[0] for p in parts)) if all(p[0] is not None for p in parts) else None
            inner = _either([p[1] if p[0] is None else _both(p[1], _of(p[0])) for p in parts])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, sub = arg
            one, inner = _walk(sub)
            if one is not None and high <= 4 and len(one) ** int(high) <= MAX_EXACT:
                exact = set().union(*({"".join(p) for p in product(one, repeat=n)} for n in range(low, int(high) + 1)))
            elif one is not None and low > 0 and len(one) ** min(low, 4) <= MAX_EXACT:
                n = min(low, 4)
                query = _both(query, _of({a + "".join(p) for a in run for p in product(one, repeat=n)})) if len(run) * len(one) ** n <= MAX_EXACT else query
                inner = None
            if low == 0:
                inner = None
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue
        if exact is not None and len(exact) <= MAX_EXACT and len(run) * len(exact) <= MAX_EXACT:
            run = {a + b for a in run for b in exact}
        elif exact is not None and len(exact) <= MAX_EXACT:
            flush(set(exact))
        else:
            query = _both(query, inner)
            flush({""})
    query = _both(query, _of(run))
    return (run if whole else None), query


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The Boolean trigram query of a pattern as a disjunction of conjunctions, or None if it must scan fully."""
    query = _walk(parser.parse(pattern))[1]
    return None if query is None else sorted(query, key=sorted)
