"""Token-ID output: flat unsigned integer files plus 64-bit document offsets, memory-mapped when read.

`write_token_files` range-partitions documents by doc_id, sorts each partition and writes it as three flat files in a
folder that all executors share: `NNNNN-T.ids` (token ids, 2 or 4 bytes by the vocabulary's size), `NNNNN-T.docs`
(doc_id, a flag for null and the number of ids of each document) and, after a pass of prefix sums over the partitions'
totals, the base of each part. A document's 64-bit offset is its part's base plus the sum of the counts before it. Each
attempt of a task writes files of its own (T), and only those that the task's result names are read, so lost executors
and repeated tasks do no harm.

Edge cases: null text is empty (its ids are the end id alone); a null doc_id comes first; equal doc_ids
go by a hash of the text; an empty table has no parts.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import input_bytes, materialize, new_path, read, release
from lexloom.llm.tokens import encoder, slices

#: Bytes of input files to a part, at most.
PART_BYTES = 64 << 20
ENTRY = np.dtype([("doc_id", "<i8"), ("null", "<i8"), ("n", "<i8")])
PARTS = pa.schema([("part", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Values:
    """A file's values, by ranges: memory-mapped where the store is a local one, else each range is read as it's asked for."""

    def __init__(self, uri: str, dtype):
        store, self.path = _filesystem(uri)
        self.dtype = np.dtype(dtype)
        self.size = store.get_file_info(self.path).size // self.dtype.itemsize
        self.map = np.memmap(self.path, self.dtype, "r") if self.size and store.type_name == "local" else None
        self.file = None if self.map is not None or not self.size else store.open_input_file(self.path)

    def __getitem__(self, some: slice) -> np.ndarray:
        if not self.size:
            return np.empty(0, self.dtype)
        if self.map is not None:
            return self.map[some]
        a, b = some.start, min(some.stop, self.size)
        return np.frombuffer(self.file.read_at((b - a) * self.dtype.itemsize, a * self.dtype.itemsize), self.dtype)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int, width: int, partitions: int) -> DataFrame:
    """Write docs (doc_id, text) in ascending doc_id order under `folder`; returns the parts: part, name, n_docs, n_ids, base."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary, end_id, width), TaskContext.get().partitionId()
        name, docs_seen, ids_seen = f"{part:05d}-{uuid.uuid4().hex}", 0, 0
        store, path = _filesystem(folder)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{name}.ids") as ids_file, store.open_output_stream(f"{path}/{name}.docs") as docs_file:
            for batch in batches:
                for some in slices(batch):
                    ids, bounds = encode(some.column("text"))
                    keys, entries = some.column("doc_id"), np.zeros(len(some), ENTRY)
                    entries["null"], entries["doc_id"] = keys.is_null().to_numpy(False), keys.fill_null(0).to_numpy()
                    entries["n"] = np.diff(bounds)
                    ids_file.write(ids.tobytes())
                    docs_file.write(entries.tobytes())
                    docs_seen, ids_seen = docs_seen + len(some), ids_seen + len(ids)
        release()
        if docs_seen:
            yield pa.RecordBatch.from_arrays([[part], [name], [docs_seen], [ids_seen]], schema=PARTS)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the text's hash parts rows of one doc_id, however many
    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = rows.repartitionByRange(partitions, *key).sortWithinPartitions(*key)
    parts = materialize(ordered.mapInArrow(write, "part long, name string, n_docs long, n_ids long"), "parts")
    # one row for each part, some thousands at most
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read_token_files(parts: DataFrame, folder: str, width: int, partitions: int) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of its ids as 32-bit little-endian integers)."""
    dtype = f"<u{width}"

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, entries = _Values(f"{folder}/{row['name']}.ids", dtype), _Values(f"{folder}/{row['name']}.docs", ENTRY)
                before = 0
                for i in range(0, entries.size, 10_000):
                    some = entries[i : i + 10_000]
                    end = before + np.cumsum(some["n"])
                    start = end - some["n"]
                    crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(start.tolist(), end.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some["doc_id"], mask=some["null"].astype(bool)), pa.array(start + row["base"]), pa.array(some["n"]), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    before = int(end[-1])

    return parts.repartition(partitions, "part").mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder, docs = new_path(spark, "tokens"), read(spark, sf_dir, "documents")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs) // PART_BYTES)
    parts = write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"), 1, 2, partitions)
    return read_token_files(parts, folder, 2, partitions)
