"""Scans and point reads."""

from pyspark.sql import functions as F

from ..catalog import DIRS, FILES
from ..operators import scan
from . import query

IDS = [FILES + i for i in (3, 17, 150, 151, 999999)]
_IN = f"({', '.join(map(str, IDS))})"


@query("o001_list_all_data", "data", sql="SELECT *, (SELECT count(*) FROM data) AS total FROM data ORDER BY id LIMIT 50 OFFSET 20")
def _(s):
    return scan.with_total(scan.offset_page(s.data, ["id"], 20, 50), s.data)


@query("o002_get_data", "data", sql="SELECT * FROM data WHERE id = 42")
def _(s):
    return scan.by_ids(s.data, [42])


@query("o003_get_objects", "obj", sql=f"SELECT * FROM obj WHERE id IN {_IN}")
def _(s):
    return scan.by_ids(s.obj, IDS)


@query("o004_list_buckets", "bkt", sql="SELECT * FROM bkt")
def _(s):
    return s.bkt.orderBy("id")


@query("o005_get_buckets", "bkt", sql="SELECT * FROM bkt WHERE id IN (2, 5, 9, 99)")
def _(s):
    return scan.by_ids(s.bkt, [2, 5, 9, 99]).orderBy("id")


@query("o006_objects_by_type", "obj", sql="SELECT *, (SELECT count(*) FROM obj WHERE t = 2 AND pid >= 0) AS total FROM obj WHERE t = 2 AND pid >= 0 ORDER BY id LIMIT 100 OFFSET 10")
def _(s):
    rows = scan.live(s.obj).where("t = 2")
    return scan.with_total(scan.offset_page(rows, ["id"], 10, 100), rows)


@query("o007_children", "obj", sql=f"SELECT *, (SELECT count(*) FROM obj WHERE pid = {DIRS + 3}) AS total FROM obj WHERE pid = {DIRS + 3} ORDER BY id LIMIT 20 OFFSET 5")
def _(s):
    rows = scan.children(s.obj, DIRS + 3)
    return scan.with_total(scan.offset_page(rows, ["id"], 5, 20), rows)


@query("o008_raw_children", "obj", sql=f"SELECT id, pid, did, s, m, t, n, e FROM obj WHERE abs(pid) = {DIRS + 3}")
def _(s):
    return scan.children(s.obj, DIRS + 3, also_deleted=True).select("id", "pid", "did", "s", "m", "t", "n", "e")


@query("o009_raw_object", "obj", sql=f"SELECT * FROM obj WHERE id = {FILES + 7}")
def _(s):
    return scan.by_ids(s.obj, [FILES + 7])


@query("o010_objects_by_data", "obj", sql="SELECT * FROM obj WHERE did = 1")
def _(s):
    return scan.by_ids(s.obj, [1], "did")


@query("o011_versions", "version", sql="SELECT * FROM version WHERE t = 3 AND pid = 5")
def _(s):
    return scan.versions(s.version, 5)


@query("o012_users", "usr", sql="SELECT * FROM usr WHERE id IN (1, 50, 77, 123456789)")
def _(s):
    return scan.by_ids(s.usr, [1, 50, 77, 123456789])


@query("o013_user_by_login", "usr", sql="SELECT * FROM usr WHERE usr = (SELECT min(usr) FROM usr)")
def _(s):
    return s.usr.join(F.broadcast(s.usr.agg(F.min("usr").alias("usr"))), "usr").select(*s.usr.columns)  # one row


@query("o014_all_users", "usr", sql="SELECT * FROM usr")
def _(s):
    return s.usr


@query("o015_acl_of_bucket", "acl", sql="SELECT * FROM acl WHERE bkt_id = 4")
def _(s):
    return s.acl.where("bkt_id = 4")


@query("o016_acl_of_user", "acl", sql="SELECT * FROM acl WHERE uid = 12")
def _(s):
    return s.acl.where("uid = 12").orderBy("bkt_id")


@query("o017_xattr_get", "attr", sql="SELECT * FROM attr WHERE id = 9 AND k = 'source'")
def _(s):
    return s.attr.where("id = 9 AND k = 'source'")


@query("o018_xattr_keys", "attr", sql="SELECT id, string_agg(k, ',' ORDER BY k) AS keys FROM attr GROUP BY id")
def _(s):
    return s.attr.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("k")), ",").alias("keys"))


@query("o081_offset_page", "data", sql="SELECT id, os FROM data ORDER BY os DESC, id LIMIT 30 OFFSET 15")
def _(s):
    return scan.offset_page(s.data, [F.desc("os"), F.asc("id")], 15, 30).select("id", "os")


@query("o092_semi_join_ids", "obj", "ref", sql="SELECT id, n FROM obj WHERE did IN (SELECT did FROM ref)")
def _(s):
    return s.obj.join(s.ref.select("did"), "did", "left_semi").select("id", "n")


@query("o103_listing_totals", "obj", sql="SELECT pid, count(*) AS total FROM obj WHERE pid >= 0 GROUP BY pid")
def _(s):
    return scan.live(s.obj).groupBy("pid").agg(F.count(F.lit(1)).alias("total"))


@query("o134_union_pages", "obj", sql="SELECT id, n, 'live' AS side FROM obj WHERE pid >= 0 UNION ALL SELECT id, n, 'deleted' FROM obj WHERE pid < 0")
def _(s):
    rows = [d.select("id", "n", F.lit(x).alias("side")) for d, x in ((scan.live(s.obj), "live"), (scan.deleted(s.obj), "deleted"))]
    return rows[0].unionByName(rows[1])


@query("o135_id_difference", "obj", sql="SELECT id FROM obj EXCEPT SELECT id FROM obj WHERE pid < 0")
def _(s):
    return s.obj.select("id").join(scan.deleted(s.obj).select("id"), "id", "left_anti")


@query("o121_distinct_ids", "obj", sql="SELECT DISTINCT did FROM obj")
def _(s):
    return s.obj.select("did").distinct()
