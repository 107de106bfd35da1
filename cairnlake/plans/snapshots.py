"""Snapshots."""

from pyspark.sql import functions as F

from ..catalog import EPOCH
from ..operators import snapshots
from . import query


@query("o028_snapshot_by_id", "snap", sql="SELECT * FROM snap WHERE id = 3")
def _(s):
    return s.snap.where("id = 3")


@query("o029_snapshot_by_name", "snap", sql="SELECT * FROM snap WHERE (bucket_id, name) IN (SELECT (bucket_id, name) FROM snap WHERE id = 5)")
def _(s):
    key = s.snap.where("id = 5").select("bucket_id", "name")
    return s.snap.join(key, ["bucket_id", "name"], "left_semi")


@query("o030_list_snapshots", "snap", sql="SELECT * FROM snap WHERE bucket_id = 4 ORDER BY created_at DESC, id DESC LIMIT 3 OFFSET 1")
def _(s):
    return snapshots.newest(s.snap, 4, 3, 1)


@query("o058_take_snapshot", "path", sql="SELECT 9::BIGINT AS snapshot_id, id AS obj_id, path, did AS data_id, s AS size, m AS mtime FROM path WHERE pid >= 0")
def _(s):
    return snapshots.take(s.path, 9)


@query("o059_delete_snapshots", "snapobj", "snap", sql="SELECT o.* FROM snapobj o WHERE snapshot_id NOT IN (SELECT id FROM snap WHERE status = 2)")
def _(s):
    return s.snapobj.join(s.snap.where("status = 2").select(F.col("id").alias("snapshot_id")), "snapshot_id", "left_anti")


@query("o060_restore", "snapobj", sql="""SELECT coalesce(o.path, p.path) AS path, coalesce(o.data_id, p.did) AS data_id, coalesce(o.size, p.s) AS size, coalesce(o.mtime, p.m) AS mtime, CASE WHEN o.path IS NULL THEN 1 ELSE 0 END AS status
  FROM (SELECT * FROM path WHERE pid >= 0) p FULL JOIN (SELECT * FROM snapobj WHERE snapshot_id = 1) o ON o.path = p.path""")
def _(s):
    return snapshots.restore(s.path, s.snapobj, 1)


@query("o099_restore_match", "snapobj", sql="SELECT p.id, o.obj_id FROM path p JOIN snapobj o USING (path) WHERE o.snapshot_id = 2")
def _(s):
    return s.path.select("id", "path").join(s.snapobj.where("snapshot_id = 2").select("path", "obj_id"), "path").select("id", "obj_id")


@query("o070_snapshot_prefix", "snapobj", sql="SELECT obj_id, path, size FROM snapobj WHERE snapshot_id = 1 AND starts_with(path, 'src1')")
def _(s):
    return snapshots.files(s.snapobj, s.path, 1, "src1")


@query("o241_lazy_files", "path", sql=f"SELECT id AS obj_id, path, s AS size FROM path WHERE pid >= 0 AND m <= {EPOCH + 400000} AND starts_with(path, 'src')")
def _(s):
    return snapshots.files(s.snapobj, s.path, 1, "src", lazy_version=EPOCH + 400000)


@query("o242_snapshot_files", "snapobj", "snap", sql=f"SELECT s.id AS snapshot_id, count(o.obj_id) AS frozen, (SELECT count(*) FROM path WHERE pid >= 0 AND m <= {EPOCH + 300000}) AS lazy FROM (SELECT id FROM snap WHERE id IN (1, 2)) s LEFT JOIN snapobj o ON o.snapshot_id = s.id GROUP BY s.id")
def _(s):
    lazy = snapshots.files(s.snapobj, s.path, 0, "", lazy_version=EPOCH + 300000).agg(F.count(F.lit(1)).alias("lazy"))
    frozen = s.snap.where("id IN (1, 2)").select(F.col("id").alias("snapshot_id")).join(s.snapobj, "snapshot_id", "left").groupBy("snapshot_id").agg(F.count("obj_id").alias("frozen"))
    return frozen.crossJoin(F.broadcast(lazy))  # one row


@query("o105_snapshot_stats", "snapobj", sql="SELECT snapshot_id, count(*) AS file_count, coalesce(sum(size), 0)::BIGINT AS total_size FROM snapobj GROUP BY snapshot_id")
def _(s):
    return snapshots.stats(s.snapobj)


@query("o237_snapshot_insert_check", "snap", sql="SELECT bucket_id, name, count(*) AS rows FROM (SELECT bucket_id, name FROM snap UNION ALL SELECT bucket_id, name FROM snap WHERE id % 4 = 0) GROUP BY ALL HAVING count(*) > 1")
def _(s):
    both = s.snap.unionByName(s.snap.where("id % 4 = 0"))
    return both.groupBy("bucket_id", "name").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


@query("o238_snapshot_update", "snapobj", "snap", sql="SELECT id, CASE WHEN f > 0 THEN 1 ELSE status END AS status, coalesce(f, 0) AS file_count FROM snap LEFT JOIN (SELECT snapshot_id, count(*) AS f FROM snapobj GROUP BY 1) ON id = snapshot_id")
def _(s):
    met = s.snap.join(snapshots.stats(s.snapobj), F.col("id") == F.col("snapshot_id"), "left")
    return met.select("id", F.when(F.col("file_count") > 0, 1).otherwise(F.col("status")).alias("status"), F.coalesce("file_count", F.lit(0)).alias("file_count"))


@query("o239_delete_snapshot_rows", "snapobj", sql="SELECT * FROM snapobj WHERE snapshot_id != 1")
def _(s):
    return s.snapobj.where("snapshot_id != 1")


@query("o240_mark_deleted", "path", sql="SELECT path, CASE WHEN pid >= 0 THEN 1 ELSE 0 END AS status FROM path")
def _(s):
    return s.path.select("path", F.when(F.col("pid") >= 0, 1).otherwise(0).alias("status"))


@query("o243_mark_shared", "data", "snapobj", sql="SELECT id, CASE WHEN id IN (SELECT data_id FROM snapobj) THEN k | 131072 ELSE k END AS k FROM data")
def _(s):
    return snapshots.mark_shared(s.data, s.snapobj)
