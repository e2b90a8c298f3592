"""Sharding by a two-pass external shuffle.

Pass 1 scatters whole records into buckets of bounded memory by a seeded hash of doc_id and text (one Spark shuffle,
which spills as it needs). Pass 2 takes one bucket at a time, puts it in a fixed order (by doc_id, text and a hash of all
columns but maps), shuffles it by Fisher-Yates with a generator seeded by the bucket, and writes it. A bucket's records follow those of the buckets before it (prefix sums of
bucket counts), and shards are equal ranges of that order, so that row counts differ by one at most. A lost task's
bucket is shuffled again with the same outcome.

Edge cases: a null text has size 1 and the crc32 of nothing, 0; a null doc_id hashes like a value; repeated rows are
records like others; empty tables give empty shards; all columns travel in a struct, so that no name can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import input_bytes, materialize, new_path, read

SHARDS, SEED = 16, 7
#: Bytes of input files to a bucket; uncompressed records take a few times as much memory.
BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 8


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of 0..n-1: position i swaps with a uniform one of i..n-1."""
    order, rng = np.arange(n), np.random.default_rng([seed, bucket])
    for i, j in enumerate((rng.random(n) * (n - np.arange(n))).astype(np.int64)):
        order[i], order[i + j] = order[i + j], order[i]
    return order


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write docs to path/shard=K/; returns the written rows: record (a struct of docs' columns), slot, shard."""
    buckets = max(LEAST_BUCKETS, -(-input_bytes(docs) // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(buckets))
    counts = materialize(docs.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n")), "buckets")
    # one row for each bucket
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_base"))
    total = counts.agg(F.sum("_n")).first()[0] or 0

    def shuffle(table: pa.Table, base: pa.Table) -> pa.Table:
        if not len(table):
            return pa.schema([]).empty_table()
        table = table.combine_chunks()
        bucket, base = table.column("_bucket")[0].as_py(), base.column("_base")[0].as_py()
        key = pa.table({"id": table.column("record").combine_chunks().field("doc_id"), "crc": table.column("_crc"), "all": table.column("_all")})
        table = table.take(pa.compute.sort_indices(key, [("id", "ascending"), ("crc", "ascending"), ("all", "ascending")]))
        table = table.take(pa.array(fisher_yates(len(table), seed, bucket)))
        at = base + np.arange(len(table))
        shard = (shards * (at + 1) - 1) // total
        return pa.table({"record": table.column("record"), "slot": pa.array(at - total * shard // shards), "shard": pa.array(shard, pa.int32())})

    whole = F.xxhash64(*(F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and t != "variant"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record"), bucket.alias("_bucket"), F.crc32("text").alias("_crc"), whole.alias("_all"))
    kind = f"record {rows.schema['record'].dataType.simpleString()}, slot long, shard int"
    # a bucket meets its base in the one shuffle that there is
    met = rows.groupBy("_bucket").cogroup(materialize(bases, "bases").groupBy("_bucket")).applyInArrow(shuffle, kind)
    met.write.partitionBy("shard").parquet(path)
    spark = docs.sparkSession
    return spark.read.schema(kind).parquet(path)


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = write_shards(read(spark, sf_dir, "documents"), new_path(spark, "shards"))
    text = F.coalesce("record.text", F.lit(""))
    return written.select(
        F.col("record.doc_id").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
