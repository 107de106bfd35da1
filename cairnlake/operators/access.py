"""Permissions, buckets and usage (O-71, O-72, O-94, O-104, O-107, O-109, O-118, O-170, O-226, O-229)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Permission bits.
DATA_READ, DATA_WRITE, DATA_DELETE, META_READ, META_WRITE, META_DELETE = (1 << i for i in range(6))
READ, WRITE, DELETE = DATA_READ | META_READ, DATA_WRITE | META_WRITE, DATA_DELETE | META_DELETE
ALL = READ | WRITE | DELETE
#: Roles.
USER, ADMIN = 0, 1


def allows(perm: Column, action: int) -> Column:
    return perm.bitwiseAND(action) == action


def visible_buckets(acl: DataFrame, bkt: DataFrame, uid: int) -> DataFrame:
    return acl.where(F.col("uid") == uid).join(bkt, F.col("bkt_id") == F.col("id")).select("id", "n", "perm").orderBy("id")


def grants(acl: DataFrame, bkt: DataFrame, action: int) -> DataFrame:
    """Per bucket, how many users may do the action."""
    counts = acl.where(allows(F.col("perm"), action)).groupBy("bkt_id").agg(F.count(F.lit(1)).alias("users"))
    return bkt.select("id", "n").join(counts, F.col("id") == F.col("bkt_id"), "left").select("id", "n", F.coalesce("users", F.lit(0)).cast("long").alias("users"))


def login(usr: DataFrame, acl: DataFrame, bkt: DataFrame, name: str) -> DataFrame:
    """The user with the buckets that any permission opens."""
    user = usr.where(F.col("usr") == name).select(F.col("id").alias("uid"), "role", "usr")
    return user.join(acl, "uid", "left").join(bkt.select(F.col("id").alias("bkt_id"), F.col("n").alias("bucket")), "bkt_id", "left").select("uid", "role", "usr", "bkt_id", "bucket", "perm")


def apply_usage(bkt: DataFrame, deltas: DataFrame) -> DataFrame:
    """Add the summed deltas (bkt_id, u, ru, lu, ds) to the counters, never below 0."""
    sums = deltas.groupBy("bkt_id").agg(*[F.sum(c).alias(f"d_{c}") for c in ("u", "ru", "lu", "ds")])
    met = bkt.join(sums, F.col("id") == F.col("bkt_id"), "left")
    return met.select("id", *[F.greatest(F.lit(0), F.col(c) + F.coalesce(f"d_{c}", F.lit(0))).cast("long").alias(c) for c in ("u", "ru", "lu", "ds")])


def filesystem_stats(bkt: DataFrame, block: int = 4096, unlimited: int = 1 << 40) -> DataFrame:
    """Blocks of the volume, free blocks, and an estimate of files at 1 MiB each."""
    total = F.when(F.col("q") >= 0, F.col("q")).otherwise(F.lit(unlimited))
    return bkt.select("id", F.floor(total / block).cast("long").alias("blocks"), F.greatest(F.lit(0), F.floor((total - F.col("ru")) / block)).cast("long").alias("free"), F.greatest(F.lit(1), F.floor(F.col("lu") / 1048576)).cast("long").alias("files"))


def storage_class(deduplicated: Column) -> Column:
    return F.when(deduplicated, "REDUCED_REDUNDANCY").otherwise("STANDARD")
