"""Helpers that the training-data operators share.

Words are maximal runs of characters other than space, tab, LF, VT, FF and CR.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.scratch import discard, materialize, materialize_freed, new_path, shared_dir  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = {ord(c): c.lower() for c in UPPER}
#: A side is broadcast only up to so many rows and bytes of files, measured first; beyond, the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 8 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df (a written table, so that counting reads footers only) with a broadcast hint if it's small, else as it is."""
    return F.broadcast(df) if input_bytes(df) <= size and df.count() <= rows else df


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def unique_name(taken: Iterable[str], base: str) -> str:
    """A column name that clashes with none, whatever the case."""
    low, name = {t.lower() for t in taken}, base
    while name.lower() in low:
        name += "_"
    return name


_KEPT: list = []


def kept(most: int) -> Callable:
    """lru_cache for what lives on in a Python worker from task to task, until a task of another kind drops it."""

    def cached(function: Callable) -> Callable:
        _KEPT.append(lru_cache(maxsize=most)(function))
        return _KEPT[-1]

    return cached


def drop_kept() -> None:
    """Give up what earlier tasks of other kinds keep in this Python worker: executors have more workers than tasks at a
    time, all of them live on, and each has its own."""
    for function in _KEPT:
        function.cache_clear()
    release()


def release() -> None:
    """Give memory that a Python worker has freed back to the machine; workers live on between tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size of the input in bytes (file sizes for tables read from files), at least 1."""
    return max(1, int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
