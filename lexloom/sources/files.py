"""Document files as rows: path, format, and their text; a file that can't be read gives its error, not a failed job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import office
from lexloom.functions.columns import lift
from lexloom.functions.markup import sniff

#: Bytes of the largest file that is read.
MAX_BYTES = 32 << 20


def read_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, length, content) of all files below a folder or pattern; content is null beyond max_bytes.

    The bound on length is pushed into the scan, so that larger files are listed but never opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.where(F.col("length") <= max_bytes).select("path", "length", "content")
    large = files.where(F.col("length") > max_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return small.unionAll(large)


def read_documents(spark: SparkSession, path: str, plain: bool = False, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, format, value, error): Markdown, or plain text, by what the content is, else by the file's ending."""
    files = read_files(spark, path, max_bytes)
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    ending = F.when(ending.isin("tsv"), "csv").when(ending.isin("htm", "xhtml"), "html").otherwise(F.nullif(ending, F.lit("")))
    found = files.withColumn("format", F.coalesce(sniff(F.col("content")), ending))
    done = lift(lambda d, k: office.converted(d, k, plain), "struct<value:string,error:string>", "content", "format")
    why = F.when(F.col("content").isNull(), "larger than max_bytes").when(F.col("format").isNull(), "unknown format").otherwise(F.col("_d.error"))
    return found.withColumn("_d", done).select("path", "format", F.col("_d.value").alias("value"), why.alias("error"))
