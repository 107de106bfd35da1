"""Integrity: scrub, orphans, gaps, chunk paths (O-22, O-23, O-89 to O-91, O-111 to O-113, O-129,
O-137, O-158, O-195, O-196)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the id of the empty block, which has no chunk file.
EMPTY_ID = 4708888888888


def chunk_name(data_id: Column, sn: Column) -> Column:
    return F.concat(data_id.cast("string"), F.lit("_"), sn.cast("string"))


def chunk_path(data_id: Column, sn: Column) -> Column:
    """Folders from characters 22-24 and 9-24 of the name's upper-case MD5, then the name."""
    name = chunk_name(data_id, sn)
    h = F.upper(F.md5(name))
    return F.concat_ws("/", F.substring(h, 22, 3), F.substring(h, 9, 16), name)


def parse_chunk_path(path: Column) -> list[Column]:
    """data_id, sn and whether the folders agree with the name."""
    name = F.regexp_extract(path, r"(\d+_\d+)$", 1)
    data_id, sn = F.split_part(name, F.lit("_"), F.lit(1)).cast("long"), F.split_part(name, F.lit("_"), F.lit(2)).cast("int")
    return [data_id.alias("data_id"), sn.alias("sn"), path.endswith(chunk_path(data_id, sn)).alias("valid")]


def chunk_summary(chunk: DataFrame) -> DataFrame:
    """Per block: chunk files, largest number, bytes, and whether numbers run from 0 without gaps."""
    sums = chunk.groupBy("data_id").agg(F.count_distinct("sn").alias("chunks"), F.max("sn").alias("last_sn"), F.min("sn").alias("first_sn"), F.sum("size").cast("long").alias("held"))
    return sums.select("data_id", F.col("chunks").cast("long").alias("chunks"), F.col("last_sn").cast("long").alias("last_sn"), "held", ((F.col("first_sn") == 0) & (F.col("last_sn") + 1 == F.col("chunks"))).alias("contiguous"))


def prefix_size(chunk: DataFrame) -> DataFrame:
    """Bytes of each block up to its first gap."""
    nth = F.row_number().over(Window.partitionBy("data_id").orderBy("sn")) - 1
    return chunk.withColumn("nth", nth).where("sn = nth").groupBy("data_id").agg(F.sum("size").cast("long").alias("size"))


def orphan_files(chunk: DataFrame, data: DataFrame) -> DataFrame:
    """Blocks with chunk files but without a row."""
    return chunk.select("data_id").distinct().join(data.select(F.col("id").alias("data_id")), "data_id", "left_anti")


def missing_files(data: DataFrame, chunk: DataFrame) -> DataFrame:
    """Blocks with a row but without a chunk file; the empty block has none by design."""
    return data.where(F.col("id") != EMPTY_ID).join(chunk.select(F.col("data_id").alias("id")), "id", "left_anti").select("id")


def unreferenced(chunk: DataFrame, data: DataFrame, ref: DataFrame) -> DataFrame:
    """Blocks with chunk files that have no row or no live reference, with the reason."""
    live = ref.where("pid >= 0").select(F.col("did").alias("data_id")).distinct().withColumn("used", F.lit(True))
    rows = data.select(F.col("id").alias("data_id")).withColumn("known", F.lit(True))
    met = chunk.select("data_id").distinct().join(rows, "data_id", "left").join(live, "data_id", "left")
    reason = F.when(F.col("known").isNull(), "no row").when(F.col("used").isNull(), "no reference")
    return met.select("data_id", reason.alias("reason")).where("reason IS NOT NULL")


def scrub(data: DataFrame, chunk: DataFrame) -> DataFrame:
    """(id, category): corrupted (no file, a gap), mismatched (another size), orphaned (no row)."""
    met = data.select("id", "s").join(chunk_summary(chunk), F.col("id") == F.col("data_id"), "full")
    category = F.when(F.col("id").isNull(), "orphaned").when(F.col("data_id").isNull(), "corrupted").when(~F.col("contiguous"), "corrupted").when(F.col("held") != F.col("s"), "mismatched")
    return met.where(F.coalesce("id", "data_id") != EMPTY_ID).select(F.coalesce("id", "data_id").alias("id"), category.alias("category")).where("category IS NOT NULL")


def dirty(data: DataFrame, chunk: DataFrame) -> DataFrame:
    """Blocks with files that are gapped or of another size."""
    met = data.select("id", "s").join(chunk_summary(chunk), F.col("id") == F.col("data_id"))
    return met.where(~F.col("contiguous") | (F.col("held") != F.col("s"))).select("id", F.when(~F.col("contiguous"), "gap").otherwise("size").alias("reason"))


def fix_plan(issues: DataFrame, ref: DataFrame) -> DataFrame:
    """What to do about each issue: orphaned files go; rows of corrupted or mismatched blocks go only
    when nothing live refers to them."""
    used = ref.where("pid >= 0").select(F.col("did").alias("id")).distinct().withColumn("used", F.lit(True))
    action = F.when(F.col("category") == "orphaned", "delete files").when(F.col("used").isNull(), "delete row").otherwise("keep")
    return issues.join(used, "id", "left").select("id", "category", action.alias("action"))
