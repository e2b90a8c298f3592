"""Chunks of JSON through Structured Streaming, batch by batch."""

import json

from lexloom.functions.json_repair import repair_json
from lexloom.streaming.json_repair import repair_json_stream

SCHEMA = "stream_id string, seq long, chunk string, last boolean"


def test_streams_of_chunks(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    batches = [
        [("a", 0, '{"x": [1', False), ("b", 2, "}", True), ("c", 0, "[1, 2", False), (None, 0, "z", True), ("d", 0, None, True)],
        [("a", 1, ", 2", True), ("b", 0, '{"k": ', False), ("c", 2, "lost]", False)],
        [("b", 1, "'v'", False), ("b", 1, "other", False), ("a", 0, "[3", True)],
    ]
    for n, rows in enumerate(batches):
        lines = [json.dumps(dict(zip(("stream_id", "seq", "chunk", "last"), r))) for r in rows]
        (source / f"{n}.json").write_text("\n".join(lines))
        chunks = spark.readStream.schema(SCHEMA).json(str(source))
        query = repair_json_stream(chunks, "1 hour").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start()
        assert query.awaitTermination(60)
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == sorted([("a", '{"x": [1, 2]}', 2, True), ("b", '{"k": "v"}', 3, True), ("a", "[3]", 1, True), ("d", repair_json(""), 1, True)])


def test_a_table_of_chunks(spark):
    rows = [("a", 1, "2]", True), ("a", 0, "[1, ", False), ("open", 0, "[", False)]
    found = repair_json_stream(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(r) for r in found] == [("a", "[1, 2]", 2, True)]
    assert repair_json_stream(spark.createDataFrame([], SCHEMA)).count() == 0
