"""Chunk folders and file trees as relations, and sinks that never overwrite (O-19, O-23, O-27, O-54, O-61, O-202)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.integrity import chunk_path, parse_chunk_path


def file_tree(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path, size, modified[, content]) of all files below a folder, by Spark's reader of binary files;
    without the content only names and sizes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    cols = [F.col("path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("modified")]
    return files.select(*cols, *(["content"] if content else []))


def chunk_files(spark: SparkSession, root: str) -> DataFrame:
    """(data_id, sn, valid, size, modified) of a chunk folder; other files are left out."""
    files = file_tree(spark, root).where(F.col("path").rlike(r"/\d+_\d+$"))
    return files.select(*parse_chunk_path(F.col("path")), "size", "modified")


def stale_files(files: DataFrame, now: int, delay: int) -> DataFrame:
    """Files of a temporary area older than the delay, a day at least."""
    return files.where(F.col("modified") < now - max(delay, 86400))


def upload_order(files: DataFrame) -> DataFrame:
    return files.orderBy("size", "path")


def write_new(df: DataFrame, path: str) -> None:
    """Write Parquet where nothing is yet; an existing path raises."""
    df.write.mode("errorifexists").parquet(path)


def chunk_names(chunks: DataFrame) -> DataFrame:
    return chunks.select("*", chunk_path(F.col("data_id"), F.col("sn")).alias("path"))
