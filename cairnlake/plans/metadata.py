"""Buckets, users and object metadata."""

from pyspark.sql import functions as F

from ..catalog import DIRS, EPOCH, FILES
from ..operators import access, hierarchy, writes
from . import query


@query("o094_visible_buckets", "acl", "bkt", sql="SELECT id, n, perm FROM acl JOIN bkt ON id = bkt_id WHERE uid = 21")
def _(s):
    return access.visible_buckets(s.acl, s.bkt, 21)


@query("o104_admin_count", "usr", sql="SELECT role, count(*) AS users FROM usr GROUP BY role")
def _(s):
    return s.usr.groupBy("role").agg(F.count(F.lit(1)).alias("users"))


@query("o225_bucket_grants", "acl", "bkt", sql="SELECT b.id, b.n, count(a.uid) AS users FROM bkt b LEFT JOIN acl a ON a.bkt_id = b.id AND (perm & 9) = 9 GROUP BY b.id, b.n")
def _(s):
    return access.grants(s.acl, s.bkt, access.READ)


@query("o225_create_bucket", "acl", "bkt", sql="SELECT bkt_id, uid, perm FROM acl UNION ALL SELECT 1000 + id, 1, 63 FROM bkt WHERE id <= 3")
def _(s):
    new = s.bkt.where("id <= 3").select((F.col("id") + 1000).alias("bkt_id"), F.lit(1).cast("long").alias("uid"), F.lit(access.ALL).alias("perm"))
    return s.acl.unionByName(new)


@query("o224_delete_bucket", "bkt", sql="SELECT id, n FROM bkt WHERE id NOT IN (3, 4)")
def _(s):
    return writes.delete(s.bkt, s.bkt.where("id IN (3, 4)"), ["id"]).select("id", "n")


@query("o226_login", "usr", "acl", "bkt", sql="SELECT u.id AS uid, role, usr, a.bkt_id, b.n AS bucket, perm FROM usr u LEFT JOIN acl a ON a.uid = u.id LEFT JOIN bkt b ON b.id = a.bkt_id WHERE usr = 'Customer#000000021' OR usr = (SELECT min(usr) FROM usr)")
def _(s):
    first = s.usr.agg(F.min("usr").alias("usr")).unionByName(s.usr.where("usr = 'Customer#000000021'").select("usr")).distinct()
    user = s.usr.join(first, "usr").select(F.col("id").alias("uid"), "role", "usr")
    return user.join(s.acl, "uid", "left").join(s.bkt.select(F.col("id").alias("bkt_id"), F.col("n").alias("bucket")), "bkt_id", "left").select("uid", "role", "usr", "bkt_id", "bucket", "perm")


@query("o227_create_user", "usr", sql="SELECT * FROM usr UNION ALL SELECT 2000000000, 0, 'new', 'new'")
def _(s):
    return s.usr.unionByName(s.spark.createDataFrame([(2000000000, 0, "new", "new")], "id long, role int, usr string, name string"))


@query("o228_update_user", "usr", sql="SELECT id, role, usr, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'N' ELSE name END AS name FROM usr")
def _(s):
    changes = s.usr.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, "N").alias("name"))
    return writes.partial_update(s.usr, changes, ["id"], ["name"])


@query("o229_bucket_by_name", "acl", "bkt", sql="SELECT id, n, perm FROM acl JOIN bkt ON id = bkt_id WHERE uid = 21 AND n >= 'A'")
def _(s):
    return access.visible_buckets(s.acl, s.bkt, 21).where("n >= 'A'")


@query("o230_list_buckets", "acl", "bkt", sql="SELECT n AS name, count(*) AS owners FROM acl JOIN bkt ON id = bkt_id WHERE (perm & 63) = 63 GROUP BY n")
def _(s):
    return s.acl.where(access.allows(F.col("perm"), access.ALL)).join(s.bkt, F.col("id") == F.col("bkt_id")).groupBy(F.col("n").alias("name")).agg(F.count(F.lit(1)).alias("owners"))


@query("o231_head_object", "path", sql="""SELECT path, s, strftime(make_timestamp(m * 1000000), '%a, %d %b %Y %H:%M:%S GMT') AS modified, '"' || lower(to_hex(did)) || '"' AS etag FROM path WHERE pid >= 0""")
def _(s):
    from ..functions import text

    return s.path.where("pid >= 0").select("path", "s", text.http_date(F.col("m")).alias("modified"), text.etag(F.col("did")).alias("etag"))


@query("o217_rename", "obj", sql=f"SELECT id, CASE WHEN id = {FILES + 5} THEN 'renamed' ELSE n END AS n FROM obj")
def _(s):
    return writes.set_where(s.obj, F.col("id") == FILES + 5, n=F.lit("renamed")).select("id", "n")


@query("o218_move", "obj", sql=f"SELECT id, CASE WHEN id % 10 = 3 AND t = 2 THEN {DIRS + 1} ELSE pid END AS pid FROM obj")
def _(s):
    return writes.set_where(s.obj, (F.col("id") % 10 == 3) & (F.col("t") == 2), pid=F.lit(DIRS + 1).cast("long")).select("id", "pid")


@query("o219_recycle", "obj", sql=f"SELECT id, CASE WHEN (id IN ({DIRS + 2}, {DIRS + 4}) OR pid IN ({DIRS + 2}, {DIRS + 4})) AND pid >= 0 THEN CASE WHEN pid = 0 THEN -1 ELSE -pid END ELSE pid END AS pid FROM obj")
def _(s):
    roots = s.spark.createDataFrame([(DIRS + 2,), (DIRS + 4,)], "root long")
    gone = hierarchy.descend(s.obj.where("pid >= 0"), roots).select(F.col("node").alias("id")).distinct()
    return writes.soft_delete(s.obj, s.obj.where("pid >= 0").join(gone, "id", "left_semi"), EPOCH).select("id", "pid")


@query("o220_create_version", "obj", sql=f"SELECT id, pid, did, s, m, t, n FROM obj UNION ALL SELECT id + 500000000, id, did, s, {EPOCH + 9}, 3, '{EPOCH + 9}' FROM obj WHERE t = 2 AND pid > 0 AND id % 13 = 0")
def _(s):
    cols = ["id", "pid", "did", "s", "m", "t", "n"]
    new = s.obj.where("t = 2 AND pid > 0 AND id % 13 = 0").select((F.col("id") + 500000000).alias("id"), F.col("id").alias("pid"), "did", "s", F.lit(EPOCH + 9).cast("long").alias("m"), F.lit(3).alias("t"), F.lit(str(EPOCH + 9)).alias("n"))
    return s.obj.select(*cols).unionByName(new)


@query("o232_copy_objects", "obj", sql=f"SELECT did, count(*) AS refs FROM (SELECT did FROM obj WHERE pid >= 0 UNION ALL SELECT did FROM obj WHERE pid = {DIRS + 1}) WHERE did > 0 GROUP BY did")
def _(s):
    copies = s.obj.where(F.col("pid") == DIRS + 1).withColumn("id", F.col("id") + 600000000).withColumn("pid", F.lit(DIRS + 5).cast("long"))
    return s.obj.where("pid >= 0").unionByName(copies).where("did > 0").groupBy("did").agg(F.count(F.lit(1)).alias("refs"))


@query("o233_move_objects", "obj", sql=f"SELECT id, CASE WHEN pid = {DIRS + 1} THEN {DIRS + 2} ELSE pid END AS pid, CASE WHEN pid = {DIRS + 1} THEN 'moved_' || n ELSE n END AS n FROM obj")
def _(s):
    here = F.col("pid") == DIRS + 1
    return writes.set_where(s.obj, here, pid=F.lit(DIRS + 2).cast("long"), n=F.concat(F.lit("moved_"), "n")).select("id", "pid", "n")


@query("o234_part_uploads", sql="SELECT user_id AS upload, event_id % 20 AS part, arg_max(event_id, (ts, event_id)) AS body FROM events GROUP BY ALL")
def _(s):
    return s.table("events").groupBy(F.col("user_id").alias("upload"), (F.col("event_id") % 20).alias("part")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("body"))


@query("o222_put_objects", "obj", sql="SELECT id + 1 AS id, CASE WHEN id % 2 = 0 THEN (id + 1)::VARCHAR ELSE n END AS n FROM obj WHERE t = 2")
def _(s):
    return s.obj.where("t = 2").select((F.col("id") + 1).alias("id"), F.when(F.col("id") % 2 == 0, (F.col("id") + 1).cast("string")).otherwise(F.col("n")).alias("n"))


@query("o223_put_bytes", "bkt", sql="SELECT id, q, ru, q < 0 OR ru + 1000000 <= q AS accepted FROM bkt")
def _(s):
    ok = writes.quota_check(s.bkt.select(F.col("id").alias("seq"), F.col("id").alias("bkt_id"), F.lit(1000000).alias("size")), s.bkt)
    return s.bkt.join(ok, F.col("id") == F.col("seq")).select("id", "q", "ru", "accepted")
