"""Deduplication: probes, duplicate groups, references and their rewriting (O-36, O-87, O-88, O-92,
O-101, O-102, O-110, O-114, O-115, O-221)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGEST = ("os", "h", "x", "s0", "s1", "s2", "s3")


def probe(data: DataFrame, probes: DataFrame) -> DataFrame:
    """Answer each probe (pos, os, h, x, s0..s3) with ``ref``: 0 without size or header hash; 1 for a
    header-only probe that hits; the block's id (the largest) for a full probe that hits; for a miss 0
    at its first place and -(first place) - 1 at later equal probes.

    (os, h) are the join's equi keys; the rest of the predicate stays a residual of the same join."""
    header_only = (F.col("a.x") == 0) | (F.col("a.s0") == 0)
    full = F.lit(True)
    for c in ("x", "s0", "s1", "s2", "s3"):
        full = full & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    valid = probes.where("os != 0 AND h != 0")
    hits = valid.alias("a").join(data.alias("b"), (F.col("a.os") == F.col("b.os")) & (F.col("a.h") == F.col("b.h")) & (header_only | full))
    found = hits.groupBy(F.col("a.pos").alias("pos")).agg(F.max("b.id").alias("hit"))
    joined = probes.join(found, "pos", "left")
    size = (F.col("os") == 0) | (F.col("h") == 0)
    answered = joined.where(size | F.col("hit").isNotNull())
    ref = F.when(size, 0).otherwise(F.when((F.col("x") == 0) | (F.col("s0") == 0), 1).otherwise(F.col("hit")))
    # First places are asked by the probes that miss alone, by an aggregation with partial minima.
    missed = joined.where(~size & F.col("hit").isNull()).select("pos", *DIGEST)
    first = missed.groupBy(*DIGEST).agg(F.min("pos").alias("first"))
    behind = missed.join(first, list(DIGEST)).select("pos", F.when(F.col("pos") == F.col("first"), 0).otherwise(-F.col("first") - 1).cast("long").alias("ref"))
    return answered.select("pos", ref.cast("long").alias("ref")).unionByName(behind)


def equal_block(data: DataFrame, contents: DataFrame) -> DataFrame:
    """(pos, ref) of contents (pos, os, h, x, s0..s3): the largest id of a block that is equal in size and all hashes, 0 if
    there is none.  Unlike a probe, empty contents equal each other, and so do missing ones (null)."""
    last = data.groupBy(*[F.col(c).alias(f"of_{c}") for c in DIGEST]).agg(F.max("id").alias("hit"))
    same = F.lit(True)
    for c in DIGEST:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return contents.join(last, same, "left").select("pos", F.coalesce("hit", F.lit(0)).cast("long").alias("ref"))


def fast_probe(data: DataFrame, probes: DataFrame, chunk_size: int) -> DataFrame:
    """Probes above the chunk size must find their header (a semi-join on two columns) before the full
    probe; smaller ones go to the full probe at once.  Returns (pos, ref), 0 where nothing is found."""
    large = probes.where(F.col("os") > chunk_size)
    survivors = large.join(data.select("os", "h").distinct(), ["os", "h"], "left_semi").select(*probes.columns)
    asked = survivors.unionByName(probes.where(F.col("os") <= chunk_size))
    answered = probe(data, asked).where("ref > 0")
    return probes.select("pos").join(answered, "pos", "left").select("pos", F.coalesce("ref", F.lit(0)).cast("long").alias("ref"))


def resolve_batch(ids: DataFrame) -> DataFrame:
    """Replace a negative id -i - 1 by the id at place i of the same batch (pos, id)."""
    back = ids.select((-F.col("pos") - 1).alias("id"), F.col("id").alias("target"))
    return ids.join(back, "id", "left").select("pos", F.when(F.col("id") < 0, F.col("target")).otherwise(F.col("id")).alias("id"))


def numbered(table: DataFrame, key: str, width: int = 1_000_000) -> DataFrame:
    """The table with ``pos``, its place from 0 by a key of whole numbers without repeats.  Places are counted within ranges
    of ``width`` keys and only the ranges' counts are summed in one task."""
    ranged = table.withColumn("range", F.expr(f"{key} div {width}"))
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("range").orderBy(key)) - 1
    return ranged.withColumn("nth", nth).join(counts.select("range", before.alias("before")), "range").select(*table.columns, (F.col("before") + F.col("nth")).alias("pos"))


def duplicate_groups(data: DataFrame, strict: bool = False) -> DataFrame:
    """Groups of blocks with equal size and hashes: count, least id as master, bytes a merge frees.
    ``strict`` keeps only positive hashes, as signed comparison of unsigned values would."""
    usable = F.expr("os > 0 AND h > 0 AND x > 0 AND s0 != 0") if strict else F.expr("os > 0 AND h != 0 AND x != 0 AND s0 != 0")
    groups = data.where(usable).groupBy(*DIGEST).agg(F.count(F.lit(1)).alias("cnt"), F.min("id").alias("master"))
    return groups.where("cnt > 1").withColumn("freed", (F.col("cnt") - 1) * F.col("os"))


def duplicate_members(data: DataFrame, groups: DataFrame) -> DataFrame:
    """(master, id) of all members of the groups: a join, so that no group is gathered in one row."""
    keys = [data[c] == groups[c] for c in DIGEST]
    condition = keys[0]
    for k in keys[1:]:
        condition = condition & k
    return data.join(groups, condition).select(groups["master"], data["id"])


def reference_counts(ids: DataFrame, obj: DataFrame) -> DataFrame:
    """Live references of each id, 0 where none."""
    counts = obj.where("pid >= 0").groupBy("did").agg(F.count(F.lit(1)).alias("refs"))
    return ids.select("id").join(counts, F.col("id") == F.col("did"), "left").select("id", F.coalesce("refs", F.lit(0)).cast("long").alias("refs"))


def remap(obj: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rewrite references by a mapping (old, new)."""
    met = obj.join(mapping, F.col("did") == F.col("old"), "left")
    return met.select(*[F.coalesce("new", "did").alias("did") if c == "did" else F.col(c) for c in obj.columns])


def dedup_savings(obj: DataFrame) -> DataFrame:
    """Bytes of live file objects whose block was referenced by an object before, per block."""
    sums = obj.where("t = 2 AND pid >= 0 AND did > 0").groupBy("did").agg(F.count(F.lit(1)).alias("n"), (F.sum("s") - F.min_by("s", "id")).cast("long").alias("saved"))
    return sums.where("n > 1").select("did", "saved")


def merge_plan(data: DataFrame, has_file: DataFrame) -> DataFrame:
    """(old, new, freed): duplicates to rewrite to their group's master, the least id with a file."""
    held = data.join(has_file.select(F.col("id").alias("file_id")), F.col("id") == F.col("file_id"), "left")
    masters = held.where("os > 0 AND h != 0 AND x != 0 AND s0 != 0").groupBy(*DIGEST).agg(F.min("file_id").alias("new"), F.count(F.lit(1)).alias("cnt")).where("cnt > 1 AND new IS NOT NULL")
    met = held.join(masters.drop("cnt"), list(DIGEST))
    return met.where("id != new").select(F.col("id").alias("old"), "new", F.when(F.col("file_id").isNotNull(), F.col("os")).otherwise(0).cast("long").alias("freed"))


def merge_totals(data: DataFrame) -> DataFrame:
    """Duplicate groups and freed bytes by bucket, and over all (null bucket)."""
    groups = data.where("os > 0 AND h != 0 AND x != 0 AND s0 != 0").groupBy("bkt_id", *DIGEST).agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")
    return groups.rollup("bkt_id").agg(F.count(F.lit(1)).alias("groups"), F.sum((F.col("cnt") - 1) * F.col("os")).cast("long").alias("freed"))
