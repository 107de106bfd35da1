"""Version retention (O-121 to O-127, O-86's pattern, O-193, O-216, O-251, O-252)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise


def split_versions(version: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Full versions and journals."""
    return version.where("t = 3"), version.where("t = 4")


def dependencies(version: DataFrame) -> DataFrame:
    """(base, journals): how many journals build on each base."""
    return version.where("t = 4 AND base > 0").groupBy("base").agg(F.count(F.lit(1)).alias("journals"), F.min("id").alias("first_journal"))


def window_rule(version: DataFrame, width: int) -> DataFrame:
    """Full versions that are not the newest of their file's window and that no journal builds on."""
    rank = F.row_number().over(Window.partitionBy("pid", F.floor(F.col("m") / width)).orderBy(F.desc("m"), F.desc("id")))
    older = version.where("t = 3").withColumn("rank", rank).where("rank > 1")
    return older.join(dependencies(version).select(F.col("base").alias("id")), "id", "left_anti").select("id", "pid")


def max_versions_rule(version: DataFrame, deleted: DataFrame, most: int, least_full: int) -> DataFrame:
    """Beyond the newest ``most`` versions of a file the older ones go, except bases of journals and
    full versions needed to keep ``least_full``.  What is kept depends on what was kept before, so the
    rule walks each file's versions once, newest first (one file's versions are one group)."""
    needed = dependencies(version).select(F.col("base").alias("id"), F.lit(True).alias("needed"))
    rows = version.where("t IN (3, 4)").join(deleted.select("id"), "id", "left_anti").join(needed, "id", "left")

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        out, kept, full = [], 0, 0
        if len(part) > most:
            for id_, pid, t, need in part.sort_values(["m", "id"], ascending=False)[["id", "pid", "t", "needed"]].itertuples(index=False, name=None):
                if kept >= most and not (t == 3 and (need is True or full <= least_full)):
                    out.append((id_, pid))
                else:
                    kept, full = kept + 1, full + (t == 3)
        return pd.DataFrame(out, columns=["id", "pid"]).astype("int64")

    return rows.select("id", "pid", "t", "m", F.col("needed")).groupBy("pid").applyInPandas(walk, "id long, pid long")


def simple_max_versions(version: DataFrame, most: int) -> DataFrame:
    """The rule without exceptions: everything beyond the newest ``most`` of a file."""
    rank = F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("m"), F.desc("id")))
    return version.where("t IN (3, 4)").withColumn("rank", rank).where(F.col("rank") > most).select("id", "pid")


def max_journals_rule(version: DataFrame, deleted: DataFrame, most: int) -> DataFrame:
    """(base, id) of the oldest journals to merge into bases that have too many: the excess, two at least."""
    order = Window.partitionBy("base")
    rows = version.where("t = 4 AND base > 0").join(deleted.select("id"), "id", "left_anti")
    rows = rows.select("base", "id", F.row_number().over(order.orderBy("m", "id")).alias("nth"), F.count(F.lit(1)).over(order).alias("n"))
    return rows.where((F.col("n") > most) & (F.col("nth") <= F.greatest(F.col("n") - most, F.lit(2)))).select("base", "id")


def retention(version: DataFrame, width: int, most: int, least_full: int, journals: int) -> DataFrame:
    """(id, pid, rule) of all versions that go or merge; later rules see what earlier ones delete."""
    first = materialise(window_rule(version, width))
    second = materialise(max_versions_rule(version, first, most, least_full))
    gone = first.unionByName(second)
    third = max_journals_rule(version, gone, journals).join(version.select("id", "pid"), "id")
    tagged = first.withColumn("rule", F.lit("window")).unionByName(second.withColumn("rule", F.lit("versions"))).unionByName(third.select("id", "pid", F.lit("journals").alias("rule")))
    return tagged.dropDuplicates(["id"])


def retention_stats(plan: DataFrame) -> DataFrame:
    return plan.groupBy("rule").agg(F.count(F.lit(1)).alias("versions"), F.count_distinct("pid").alias("files"))


def merged_versions(merge: DataFrame, version: DataFrame) -> DataFrame:
    """The version row that each merge of journals into a base leaves: the size and time of the newest
    journal merged, the base's file."""
    met = merge.join(version.select("id", "m", "s", "pid"), "id")
    return met.groupBy("base").agg(F.first("pid").alias("pid"), F.max("m").alias("m"), F.max_by("s", F.struct("m", "id")).alias("s"), F.count(F.lit(1)).alias("merged"))
