"""Scans, point reads and pages (O-01 to O-18, O-28 to O-30, O-81)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_ids(df: DataFrame, ids: Sequence, column: str = "id") -> DataFrame:
    """Rows whose key is among a list of ids (pushed to the scan as an IN filter); missing ids give none."""
    return df.where(F.col(column).isin(list(ids)))


def offset_page(df: DataFrame, order: Sequence[Column | str], offset: int, limit: int) -> DataFrame:
    """A page in a total order; a limit of 0 or less takes all rows."""
    page = df.orderBy(*order).offset(offset) if offset else df.orderBy(*order)
    return page.limit(limit) if limit > 0 else df


def with_total(page: DataFrame, whole: DataFrame) -> DataFrame:
    """Adds the number of rows of the whole listing to each row of its page."""
    return page.crossJoin(F.broadcast(whole.agg(F.count(F.lit(1)).alias("total"))))  # one row


def live(df: DataFrame) -> DataFrame:
    """Objects that are not deleted."""
    return df.where("pid >= 0")


def deleted(df: DataFrame) -> DataFrame:
    return df.where("pid < 0")


def children(obj: DataFrame, pid: int, also_deleted: bool = False) -> DataFrame:
    return obj.where(F.col("pid").isin(pid, -pid) if also_deleted else F.col("pid") == pid)


def versions(version: DataFrame, file_id: int) -> DataFrame:
    """Full versions of a file, newest first; equal times by descending id."""
    return version.where((F.col("t") == 3) & (F.col("pid") == file_id)).orderBy(F.desc("m"), F.desc("id"))
