"""Plain functions as columns: Arrow batches in and out, null in, null out.

A batch of texts is small, what is made of it can be many times as large. So results leave a worker in slices: ROWS rows,
or those of about SIZE characters, at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

ROWS, SIZE = 1_000, 1 << 18


def _slices(batches: Iterator) -> Iterator[list[tuple]]:
    """The rows of batches, each an array or a tuple of arrays, in slices."""
    for batch in batches:
        rows, size = [], 0
        for row in zip(*(batch if isinstance(batch, tuple) else (batch,))):
            rows.append(tuple(x.as_py() for x in row))
            size += sum(len(x) for x in rows[-1] if hasattr(x, "__len__"))
            if size >= SIZE or len(rows) == ROWS:
                yield rows
                rows, size = [], 0
        if rows:
            yield rows


def _sliced(f: Callable[[list[tuple]], pa.Array], kind: str, *args: Column | str) -> Column:
    """f, of the rows of a slice, as a column."""

    def run(batches: Iterator) -> Iterator[pa.Array]:
        yield from map(f, _slices(batches))

    return F.arrow_udf(run, kind, ArrowUDFType.SCALAR_ITER)(*args)


def lift(f: Callable, kind: str, *args: Column | str, **fixed) -> Column:
    """f applied to one or two columns; `kind` is its result's type."""
    if kind.startswith("struct<"):  # a struct travels in an array of one, so that it may be null
        boxed = lift(lambda *x, **k: [f(*x, **k)], f"array<{kind}>", *args, **fixed)
        return F.get(boxed, F.lit(0))
    return lift_many(lambda rows: [f(*x, **fixed) for x in rows], kind, *args)


def lift_many(f: Callable, kind: str, *args: Column | str) -> Column:
    """The same for an f of many rows at once: a list of tuples without nulls -> a list of values."""
    arrow = to_arrow_type(DataType.fromDDL(kind))

    def run(rows: list[tuple]) -> pa.Array:
        found = iter(f([x for x in rows if None not in x]))
        return pa.array([None if None in x else next(found) for x in rows], arrow, from_pandas=True)

    return _sliced(run, kind, *args)


SPANS = "array<struct<start:int,end:int>>"


def spans(f: Callable, text: Column | str, **fixed) -> Column:
    """(start, end) pairs of f: they are many, so that they go to flat arrays."""

    def run(rows: list[tuple]) -> pa.Array:
        found = [None if t is None else f(t, **fixed) for (t,) in rows]
        flat = [x for pairs in found if pairs for x in pairs]
        ends = list(accumulate((len(x or ()) for x in found), initial=0))
        offsets = pa.array([None if x is None else a for x, a in zip(found, ends)] + ends[-1:], pa.int32())
        pair = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], pa.int32()) for i in (0, 1)], ["start", "end"])
        return pa.ListArray.from_arrays(offsets, pair)

    return _sliced(run, SPANS, text)
