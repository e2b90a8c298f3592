"""JSON that arrives in chunks, repaired once a stream of chunks is whole."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexloom.functions.columns import lift
from lexloom.functions.json_repair import repair_json

OUT = "stream_id string, value string, chunks long, ended boolean"
STATE = "seqs array<long>, chunks array<string>, last long"


def _take(chunks: Iterable[tuple], held: dict[int, str], last: int) -> int:
    """Put chunks, (seq, chunk, last), into held; the last chunk's seq, -1 if it isn't known."""
    for seq, chunk, end in chunks:
        held.setdefault(int(seq), chunk if isinstance(chunk, str) else "")
        if last < 0 and not pd.isna(end) and bool(end):
            last = int(seq)
    return last


def _whole(held: dict[int, str], last: int) -> tuple[int, bool]:
    """(how many chunks there are before one is missing, are these all)."""
    size = 0
    while size in held and (last < 0 or size <= last):
        size += 1
    return size, last >= 0 and size == last + 1


def repair_json_stream(chunks: DataFrame, idle: str = "10 minutes") -> DataFrame:
    """(stream_id, seq from 0, chunk, last) -> a row (stream_id, value, chunks, ended) a stream.

    A stream ends when its chunk marked last and all before it are there, in whatever order they came, or when nothing came
    for `idle` of processing time; then ended is false and value is the repair of the chunks up to the first one that is
    missing. A repeated seq counts once, the first that came; null chunks are empty; rows without stream_id or seq are no
    chunks. An id that comes again after its end begins anew. State holds a stream's chunks until its end and no longer.
    A table that isn't streaming has no idle time: streams without an end give no row there. As idle time needs batches
    without data, a query with the trigger availableNow does not end by itself; use processingTime or once.
    """

    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def joined(held: dict, size: int, ended: bool) -> dict:
        return {"value": repair_json("".join(held[i] for i in range(size))), "chunks": size, "ended": ended}

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, texts, last = state.get if state.exists else ([], [], -1)
        held = dict(zip(map(int, seqs), texts))
        for frame in () if state.hasTimedOut else frames:
            last = _take(zip(frame["seq"], frame["chunk"], frame["last"]), held, last)
        size, ended = _whole(held, last)
        if ended or state.hasTimedOut:
            if state.exists:
                state.remove()
            yield pd.DataFrame([{"stream_id": key[0], **joined(held, size, ended)}])
        else:
            state.update((list(held), list(held.values()), last))
            state.setTimeoutDuration(idle_ms)

    def at_once(chunks: list[dict]) -> dict | None:
        held = {}
        size, ended = _whole(held, _take((c.values() for c in chunks), held, -1))
        return joined(held, size, ended) if ended else None

    rows = chunks.selectExpr("cast(stream_id AS string) AS stream_id", "cast(seq AS long) AS seq", "cast(chunk AS string) AS chunk", "last")
    streams = rows.where("stream_id IS NOT NULL AND seq IS NOT NULL").groupBy("stream_id")
    if chunks.isStreaming:
        return streams.applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
    # streams are many and short: they go to Python in batches, not one at a time
    found = streams.agg(F.collect_list(F.struct("seq", "chunk", "last")).alias("_c")).select("stream_id", lift(at_once, "struct<value:string,chunks:long,ended:boolean>", "_c").alias("_r"))
    return found.where("_r IS NOT NULL").select("stream_id", "_r.*")
