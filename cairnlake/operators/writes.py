"""Changes as DataFrame rewrites: upserts, updates, deletes (O-32 to O-60, O-217 to O-239)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, batch: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """Rows of the batch replace rows with equal keys; within the batch the last by ``order`` wins.
    Untouched rows of the table go through an anti-join and are not sorted."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    fresh = batch.withColumn("last", last).where("last = 1").select(*table.columns)
    return table.join(fresh.select(*keys), list(keys), "left_anti").select(*table.columns).unionByName(fresh)


def replace_into(obj: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Put objects, unique by id and by (pid, n): the last of the batch wins over the batch and the
    table.  Returns the new table and (seq, id) with id 0 for rows that lost within the batch."""
    by_id = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq")))
    by_name = F.row_number().over(Window.partitionBy("pid", "n").orderBy(F.desc("seq")))
    won = batch.withColumn("a", by_id).where("a = 1").withColumn("b", by_name).where("b = 1").drop("a", "b")
    kept = obj.join(won.select("id"), "id", "left_anti").join(won.select("pid", "n"), ["pid", "n"], "left_anti").select(*obj.columns)
    answers = batch.select("seq", "id").join(won.select("seq", F.lit(True).alias("won")), "seq", "left")
    return kept.unionByName(won.select(*obj.columns)), answers.select("seq", F.when(F.col("won"), F.col("id")).otherwise(0).alias("id"))


def partial_update(table: DataFrame, changes: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Set the named fields where the change has a value; other columns and rows stay."""
    new = changes.select(*keys, *[F.col(f).alias(f"new_{f}") for f in fields])
    met = table.join(new, list(keys), "left")
    return met.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns])


def name_conflicts(obj: DataFrame) -> DataFrame:
    """(pid, n) held by several live objects: what an update must not leave."""
    return obj.where("pid >= 0").groupBy("pid", "n").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")


def delete(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return table.join(keys.select(*on), list(on), "left_anti").select(*table.columns)


def soft_delete(obj: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Flip the parent (0 becomes -1) and set the time; a name that the bin has at that parent already,
    or gets twice, is suffixed by the time and, after the first, by a number."""
    gone = obj.join(ids.select("id"), "id", "left_semi").withColumn("pid", F.when(F.col("pid") == 0, -1).otherwise(-F.col("pid")))
    held = obj.where("pid < 0").select("pid", "n").distinct().withColumn("held", F.lit(True))
    nth = F.row_number().over(Window.partitionBy("pid", "n").orderBy("id"))
    met = gone.join(held, ["pid", "n"], "left").withColumn("nth", nth + F.when(F.col("held"), 1).otherwise(0))
    base, ext = F.regexp_extract("n", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("n", r"^.*?(\.[^.]*)?$", 1)
    number = F.when(F.col("nth") > 2, F.concat(F.lit("_"), (F.col("nth") - 1).cast("string"))).otherwise("")
    name = F.when(F.col("nth") > 1, F.concat(base, F.lit(f"_{now}"), number, ext)).otherwise(F.col("n"))
    moved = met.select(*[name.alias("n") if c == "n" else F.lit(now).cast("long").alias("m") if c == "m" else F.col(c) for c in obj.columns])
    return obj.join(ids.select("id"), "id", "left_anti").select(*obj.columns).unionByName(moved)


def permanent_delete(obj: DataFrame, data: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects without the deleted ones, and blocks that only deleted objects referred to (id, os):
    references are counted over the whole batch, so two deleted objects of one block free it."""
    gone = obj.join(ids.select("id"), "id", "left_semi")
    kept = obj.join(ids.select("id"), "id", "left_anti").select(*obj.columns)
    lost = gone.where("did > 0").select(F.col("did").alias("id")).distinct()
    freed = lost.join(kept.where("pid >= 0").select(F.col("did").alias("id")), "id", "left_anti")
    return kept, data.join(freed, "id", "left_semi").where("pi = 0").select("id", "os")


def clean_recycled(obj: DataFrame, data: DataFrame, now: int, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """As above for what was deleted more than so many days ago."""
    old = obj.where((F.col("pid") < 0) & (F.col("m") <= now - days * 86400))
    return permanent_delete(obj, data, old.select("id"))


def quota_check(puts: DataFrame, bkt: DataFrame) -> DataFrame:
    """(seq, accepted) of puts (seq, bkt_id, size): rejected when usage and everything put before in
    the batch would pass a quota; a negative quota never rejects."""
    used = F.sum("size").over(Window.partitionBy("bkt_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    met = puts.join(bkt.select(F.col("id").alias("bkt_id"), "q", "ru"), "bkt_id")
    return met.select("seq", "bkt_id", (~((F.col("q") >= 0) & (F.col("ru") + used > F.col("q")))).alias("accepted"))


def promote_versions(obj: DataFrame, version: DataFrame) -> DataFrame:
    """Files take data id, size and time of their newest full version if its data id is larger."""
    newest = version.where("t = 3").groupBy(F.col("pid").alias("id")).agg(F.max_by(F.struct("did", "s", "m"), "did").alias("v"))
    met = obj.join(newest, "id", "left").withColumn("up", F.coalesce(F.col("v.did") > F.col("did"), F.lit(False)))
    return met.select(*[F.when(F.col("up"), F.col(f"v.{c}")).otherwise(F.col(c)).alias(c) if c in ("did", "s", "m") else F.col(c) for c in obj.columns])


def put_objects(obj: DataFrame, data: DataFrame, batch: DataFrame, first_id: int) -> tuple[DataFrame, DataFrame]:
    """Put a batch (pos, id, pid, did, s, m, t, n) of objects: id 0 becomes ``first_id`` + pos, an empty name the
    id, and a parent -i - 1 the id at place i of the batch.  Files take data id, size (the block's) and time of
    the version of largest data id put below them, if it is larger than theirs.  Returns all objects, and the
    counters (logical, saved): bytes of files put, and of those whose block another live object refers to."""
    given = batch.withColumn("id", F.when(F.col("id") == 0, F.col("pos") + first_id).otherwise(F.col("id")))
    places = given.select((-F.col("pos") - 1).alias("pid"), F.col("id").alias("parent"))
    name = F.when(F.col("n") == "", F.col("id").cast("string")).otherwise(F.col("n"))
    columns = ["id", "pid", "did", "s", "m", "t", "n"]
    put = given.join(places, "pid", "left").withColumn("n", name).withColumn("pid", F.coalesce("parent", "pid")).select(*columns)
    best = put.where("t = 3 AND pid > 0 AND did > 0").groupBy(F.col("pid").alias("id")).agg(F.max_by(F.struct("did", "m"), "did").alias("v"))
    sized = best.join(data.select(F.col("id").alias("block"), "os"), F.col("v.did") == F.col("block"), "left").select("id", "v", "os")
    met = obj.select(*columns).unionByName(put).join(sized, "id", "left")
    up = F.coalesce((F.col("t") == 2) & (F.col("v.did") > F.col("did")), F.lit(False))
    new = {"did": F.col("v.did"), "s": F.coalesce("os", "s"), "m": F.col("v.m")}
    done = met.select(*[F.when(up, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in columns])
    refs = done.where("pid >= 0").groupBy("did").agg(F.count(F.lit(1)).alias("refs"))
    files = put.where("t = 2 AND s > 0").join(refs, "did", "left")
    saved = F.sum(F.when((F.col("did") > 0) & (F.col("refs") > 1), F.col("s")).otherwise(0))
    return done, files.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("long").alias("logical"), F.coalesce(saved, F.lit(0)).cast("long").alias("saved"))


def rename_conflicts(obj: DataFrame, batch: DataFrame, template: str = "({})") -> DataFrame:
    """(id, n) under the policy *rename*: names that live objects or earlier rows of the batch hold get
    the next free number among names of that form."""
    held = obj.where("pid >= 0").select("pid", "n").distinct().withColumn("held", F.lit(1))
    nth = F.row_number().over(Window.partitionBy("pid", "n").orderBy("seq")) - 1
    met = batch.join(held, ["pid", "n"], "left").withColumn("k", nth + F.coalesce("held", F.lit(0)))
    before, after = template.split("{}")
    return met.select("id", F.when(F.col("k") > 0, F.concat("n", F.lit(before), F.col("k").cast("string"), F.lit(after))).otherwise(F.col("n")).alias("n"))


def resolve_conflicts(obj: DataFrame, batch: DataFrame, policy: str) -> DataFrame:
    """(id, target, action) of a batch (seq, id, pid, n) under cover, skip or throw: what an existing
    live name does to a put."""
    held = obj.where("pid >= 0").groupBy("pid", "n").agg(F.min("id").alias("existing"))
    word = {"cover": "version", "skip": "skip", "throw": "error"}[policy]
    met = batch.join(held, ["pid", "n"], "left")
    return met.select("id", F.coalesce("existing", "id").alias("target"), F.when(F.col("existing").isNull(), "create").otherwise(word).alias("action"))


def set_where(table: DataFrame, condition: Column, **values: Column) -> DataFrame:
    return table.select(*[F.when(condition, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])
