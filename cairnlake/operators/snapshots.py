"""Snapshots: stats, listing, reading, restoring (O-58 to O-60, O-70, O-99, O-105, O-237 to O-243).

A snapshot freezes (obj_id, path, data_id, size, mtime) of a bucket's live objects; paths come from the
object tree.  Times are compared in seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def take(path: DataFrame, snapshot_id: int) -> DataFrame:
    """The rows of a snapshot taken now."""
    return path.where("pid >= 0").select(F.lit(snapshot_id).cast("long").alias("snapshot_id"), F.col("id").alias("obj_id"), "path", F.col("did").alias("data_id"), F.col("s").alias("size"), F.col("m").alias("mtime"))


def stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"))


def newest(snap: DataFrame, bucket: int, limit: int = 0, offset: int = 0) -> DataFrame:
    """A bucket's snapshots, newest first; the offset counts only with a limit."""
    rows = snap.where(F.col("bucket_id") == bucket).orderBy(F.desc("created_at"), F.desc("id"))
    return rows.offset(offset).limit(limit) if limit > 0 else rows


def files(rows: DataFrame, path: DataFrame, snapshot_id: int, prefix: str, lazy_version: int | None = None) -> DataFrame:
    """Files of a snapshot below a prefix: frozen rows, or for a lazy one the live objects as of its time."""
    if lazy_version is not None:
        found = path.where((F.col("pid") >= 0) & (F.col("m") <= lazy_version)).select(F.col("id").alias("obj_id"), "path", F.col("s").alias("size"))
    else:
        found = rows.where(F.col("snapshot_id") == snapshot_id).select("obj_id", "path", "size")
    return found.where(F.col("path").startswith(prefix)).orderBy("path")


def restore(path: DataFrame, rows: DataFrame, snapshot_id: int) -> DataFrame:
    """(path, data_id, size, mtime, status): the snapshot's rows come back (0), what it lacks is deleted (1)."""
    then = rows.where(F.col("snapshot_id") == snapshot_id).select("path", "data_id", "size", "mtime", F.lit(0).alias("status"))
    now = path.where("pid >= 0").select("path", F.col("did").alias("live_data"), F.col("s").alias("live_size"), F.col("m").alias("live_m"))
    met = now.join(then, "path", "full")
    return met.select("path", F.coalesce("data_id", "live_data").alias("data_id"), F.coalesce("size", "live_size").alias("size"), F.coalesce("mtime", "live_m").alias("mtime"), F.coalesce("status", F.lit(1)).alias("status"))


def mark_shared(data: DataFrame, rows: DataFrame, flag: int = 1 << 17) -> DataFrame:
    """Blocks that a snapshot holds get a copy-on-write flag."""
    held = rows.select(F.col("data_id").alias("id")).distinct().withColumn("held", F.lit(True))
    return data.join(held, "id", "left").select("id", F.when(F.col("held"), F.col("k").bitwiseOR(flag)).otherwise(F.col("k")).alias("k"))
