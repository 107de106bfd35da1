"""Changes."""

from pyspark.sql import functions as F

from ..catalog import EPOCH, FILES
from ..operators import dedup, writes
from . import query

NOW = EPOCH + 5_000_000


def _seq(df, seq):
    return df.withColumn("seq", seq)


@query("o032_put_data", "data", sql="SELECT id, CASE WHEN id % 10 = 0 THEN s + 2 ELSE s END AS s, CASE WHEN id % 10 = 0 THEN 33 ELSE k END AS k FROM data UNION ALL SELECT id + 5000000, s, k FROM data WHERE id % 25 = 0")
def _(s):
    hit = s.data.where("id % 10 = 0")
    batch = _seq(hit.withColumn("s", F.col("s") + 1), F.lit(1)).unionByName(_seq(hit.withColumn("s", F.col("s") + 2).withColumn("k", F.lit(33).cast("long")), F.lit(2)))
    batch = batch.unionByName(_seq(s.data.where("id % 25 = 0").withColumn("id", F.col("id") + 5000000), F.lit(3)))
    return writes.upsert(s.data, batch, ["id"]).select("id", "s", "k")


#: A batch for the object table: new objects with names that live ones hold, one name twice, one id twice.
_BATCH = f"""batch AS (SELECT id + 50000000 AS id, pid, did, s, m, t, n, e, md, id * 3 AS seq FROM obj WHERE t = 2 AND pid > 0 AND id % 9 = 0
  UNION ALL SELECT id + 60000000, pid, did, s, m, t, n, e, md, id * 3 + 1 FROM obj WHERE t = 2 AND pid > 0 AND id % 18 = 0
  UNION ALL SELECT id, pid, did, s, m, t, 'fresh_' || n, e, md, id * 3 + 2 FROM obj WHERE t = 2 AND pid > 0 AND id % 11 = 0)"""
_WON = "w1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS a FROM batch) WHERE a = 1), won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid, n ORDER BY seq DESC) AS b FROM w1) WHERE b = 1)"


def _batch(s):
    live = s.obj.where("t = 2 AND pid > 0")
    one = _seq(live.where("id % 9 = 0"), F.col("id") * 3).withColumn("id", F.col("id") + 50000000)
    two = _seq(live.where("id % 18 = 0"), F.col("id") * 3 + 1).withColumn("id", F.col("id") + 60000000)
    three = _seq(live.where("id % 11 = 0"), F.col("id") * 3 + 2).withColumn("n", F.concat(F.lit("fresh_"), "n"))
    return one.unionByName(two).unionByName(three)


@query("o033_replace_into", "obj", sql=f"{_BATCH}, {_WON} SELECT id, pid, n FROM obj WHERE id NOT IN (SELECT id FROM won) AND (pid, n) NOT IN (SELECT (pid, n) FROM won) UNION ALL SELECT id, pid, n FROM won")
def _(s):
    return writes.replace_into(s.obj, _batch(s))[0].select("id", "pid", "n")


@query("o033_replace_answers", "obj", sql=f"{_BATCH}, {_WON} SELECT seq, CASE WHEN seq IN (SELECT seq FROM won) THEN id ELSE 0 END AS id FROM batch")
def _(s):
    return writes.replace_into(s.obj, _batch(s))[1]


@query("o034_put_data_and_object", "data", "obj", sql="SELECT 'data' AS part, count(*) AS rows, sum(s)::BIGINT AS bytes FROM (SELECT s FROM data UNION ALL SELECT s FROM data WHERE id % 20 = 0) UNION ALL SELECT 'obj', count(*), sum(s)::BIGINT FROM (SELECT s FROM obj UNION ALL SELECT s FROM obj WHERE t = 2 AND id % 20 = 0)")
def _(s):
    new_data = _seq(s.data.where("id % 20 = 0").withColumn("id", F.col("id") + 7000000), F.lit(1))
    new_obj = _seq(s.obj.where("t = 2 AND id % 20 = 0").withColumn("id", F.col("id") + 70000000), F.lit(1))
    out = [writes.upsert(t, b, ["id"]).agg(F.count(F.lit(1)).alias("rows"), F.sum("s").cast("long").alias("bytes")).select(F.lit(n).alias("part"), "rows", "bytes") for n, t, b in (("data", s.data, new_data), ("obj", s.obj, new_obj))]
    return out[0].unionByName(out[1])


@query("o035_partial_update", "obj", sql=f"SELECT id, CASE WHEN id % 8 = 0 THEN {NOW} ELSE m END AS m, CASE WHEN id % 16 = 0 THEN 'x' || n ELSE n END AS n FROM obj")
def _(s):
    changes = s.obj.where("id % 8 = 0").select("id", F.lit(NOW).cast("long").alias("m"), F.when(F.col("id") % 16 == 0, F.concat(F.lit("x"), "n")).alias("n"))
    return writes.partial_update(s.obj, changes, ["id"], ["m", "n"]).select("id", "m", "n")


@query("o035_name_conflicts", "obj", sql="SELECT pid, n, count(*) AS cnt FROM (SELECT pid, CASE WHEN t = 2 THEN substr(n, 1, 6) ELSE n END AS n FROM obj WHERE pid >= 0) GROUP BY ALL HAVING count(*) > 1")
def _(s):
    return writes.name_conflicts(s.obj.withColumn("n", F.when(F.col("t") == 2, F.substring("n", 1, 6)).otherwise(F.col("n"))))


@query("o037_delete_data", "data", sql="SELECT id FROM data WHERE id % 6 != 2")
def _(s):
    return writes.delete(s.data, s.data.where("id % 6 = 2"), ["id"]).select("id")


#: Names are shortened so that deletions collide with the bin and with each other.
_SHORT = "o AS (SELECT id, pid, did, s, m, t, CASE WHEN t = 2 THEN 'f' || id % 3 || '.txt' ELSE n END AS n, e, md FROM obj)"


def _short(s):
    return s.obj.withColumn("n", F.when(F.col("t") == 2, F.concat(F.lit("f"), (F.col("id") % 3).cast("string"), F.lit(".txt"))).otherwise(F.col("n")))


@query("o038_soft_delete", "obj", sql=f"""{_SHORT}, g AS (SELECT *, CASE WHEN pid = 0 THEN -1 ELSE -pid END AS np FROM o WHERE id % 12 = 5 AND pid >= 0),
  h AS (SELECT g.*, row_number() OVER (PARTITION BY np, n ORDER BY id) + CASE WHEN (np, n) IN (SELECT (pid, n) FROM o WHERE pid < 0) THEN 1 ELSE 0 END AS nth FROM g)
  SELECT id, pid, n, m FROM o WHERE NOT (id % 12 = 5 AND pid >= 0) UNION ALL
  SELECT id, np, CASE WHEN nth > 1 THEN (CASE WHEN contains(n, '.') THEN string_split(n, '.')[1] ELSE n END) || '_{NOW}' || CASE WHEN nth > 2 THEN '_' || (nth - 1) ELSE '' END || CASE WHEN contains(n, '.') THEN '.txt' ELSE '' END ELSE n END, {NOW} FROM h""")
def _(s):
    o = _short(s)
    return writes.soft_delete(o, o.where("id % 12 = 5 AND pid >= 0"), NOW).select("id", "pid", "n", "m")


@query("o132_recycle_names", "obj", sql=f"{_SHORT} SELECT pid, n, count(*) AS cnt, max(nth) AS last FROM (SELECT abs(pid) AS pid, n, row_number() OVER (PARTITION BY abs(pid), n ORDER BY id) AS nth FROM o) GROUP BY ALL")
def _(s):
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("pid", "n").orderBy("id"))
    return _short(s).withColumn("pid", F.abs("pid")).withColumn("nth", nth).groupBy("pid", "n").agg(F.count(F.lit(1)).alias("cnt"), F.max("nth").alias("last"))


@query("o039_hard_delete", "obj", "attr", sql=f"SELECT 'obj' AS part, count(*) AS rows FROM obj WHERE id != {FILES + 9} UNION ALL SELECT 'attr', count(*) FROM attr WHERE id != 9")
def _(s):
    ids = s.spark.createDataFrame([(FILES + 9, 9)], "id long, doc long")
    a = writes.delete(s.obj, ids, ["id"]).agg(F.count(F.lit(1)).alias("rows")).select(F.lit("obj").alias("part"), "rows")
    return a.unionByName(writes.delete(s.attr, ids.select(F.col("doc").alias("id")), ["id"]).agg(F.count(F.lit(1)).alias("rows")).select(F.lit("attr").alias("part"), "rows"))


@query("o040_batch_hard_delete", "obj", sql="SELECT id FROM obj WHERE id % 7 != 1")
def _(s):
    return writes.delete(s.obj, s.obj.where("id % 7 = 1"), ["id"]).select("id")


_FREED = "kept AS (SELECT * FROM obj WHERE NOT ({gone})), freed AS (SELECT id, os FROM data WHERE pi = 0 AND id IN (SELECT did FROM obj WHERE {gone} AND did > 0) AND id NOT IN (SELECT did FROM kept WHERE pid >= 0))"


@query("o042_permanent_delete", "data", "obj", sql=f"{_FREED.format(gone='id % 4 = 1 AND t = 2')} SELECT * FROM freed")
def _(s):
    return writes.permanent_delete(s.obj, s.data, s.obj.where("id % 4 = 1 AND t = 2"))[1]


@query("o043_permanent_delete_batch", "data", "obj", sql=f"{_FREED.format(gone='did % 2 = 0 AND t = 2')} SELECT count(*) AS blocks, coalesce(sum(os), 0)::BIGINT AS bytes, (SELECT count(*) FROM kept) AS kept FROM freed")
def _(s):
    kept, freed = writes.permanent_delete(s.obj, s.data, s.obj.where("did % 2 = 0 AND t = 2"))
    sums = freed.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("os"), F.lit(0)).cast("long").alias("bytes"))
    return sums.crossJoin(kept.agg(F.count(F.lit(1)).alias("kept")))  # one row each


@query("o201_clean_recycled", "data", "obj", sql=f"{_FREED.format(gone=f'pid < 0 AND m <= {EPOCH + 600000}')} SELECT * FROM freed")
def _(s):
    return writes.clean_recycled(s.obj, s.data, EPOCH + 600000 + 7 * 86400)[1]


@query("o203_delayed_delete", "data", "obj", sql="SELECT id FROM data WHERE id NOT IN (SELECT did FROM obj WHERE pid >= 0) AND id NOT IN (SELECT did FROM obj WHERE pid >= 0 AND id % 2 = 0)")
def _(s):
    now = writes.delete(s.data, s.obj.where("pid >= 0").select(F.col("did").alias("id")), ["id"])
    return writes.delete(now, s.obj.where("pid >= 0 AND id % 2 = 0").select(F.col("did").alias("id")), ["id"]).select("id")


@query("o044_xattr_set", "attr", sql="SELECT id, k, CASE WHEN k = 'lang' AND id % 5 = 0 THEN 'xx' ELSE v END AS v FROM attr UNION ALL SELECT id, 'tag', 'new' FROM attr WHERE k = 'lang' AND id % 5 = 0")
def _(s):
    hit = s.attr.where("k = 'lang' AND id % 5 = 0")
    batch = _seq(hit.withColumn("v", F.lit("xx")), F.lit(1)).unionByName(_seq(hit.withColumn("k", F.lit("tag")).withColumn("v", F.lit("new")), F.lit(2)))
    return writes.upsert(s.attr, batch, ["id", "k"])


@query("o045_xattr_delete", "attr", sql="SELECT * FROM attr WHERE NOT (k = 'source' AND id % 3 = 0)")
def _(s):
    return writes.delete(s.attr, s.attr.where("k = 'source' AND id % 3 = 0"), ["id", "k"])


@query("o046_acl_put", "acl", sql="SELECT bkt_id, uid, CASE WHEN uid % 6 = 0 THEN 63 WHEN uid % 6 = 1 THEN 5 ELSE perm END AS perm FROM acl")
def _(s):
    batch = s.acl.where("uid % 6 < 2").withColumn("perm", F.when(F.col("uid") % 6 == 0, 0).otherwise(5))
    batch = _seq(batch.withColumn("perm", F.when(F.col("perm") == 0, 63).otherwise(F.col("perm"))), F.lit(1))
    return writes.upsert(s.acl, batch, ["bkt_id", "uid"])


@query("o047_acl_delete", "acl", sql="SELECT * FROM acl WHERE uid % 9 != 0")
def _(s):
    return writes.delete(s.acl, s.acl.where("uid % 9 = 0"), ["bkt_id", "uid"])


@query("o048_acl_delete_bucket", "acl", sql="SELECT * FROM acl WHERE bkt_id != 4")
def _(s):
    return s.acl.where("bkt_id != 4")


@query("o049_user_put", "usr", sql="SELECT id, CASE WHEN id % 10 = 0 THEN 1 ELSE role END AS role, usr, name FROM usr UNION ALL SELECT id + 1000000000, role, usr || '-2', name FROM usr WHERE id % 100 = 0")
def _(s):
    batch = _seq(s.usr.where("id % 10 = 0").withColumn("role", F.lit(1)), F.lit(1))
    batch = batch.unionByName(_seq(s.usr.where("id % 100 = 0").withColumn("id", F.col("id") + 1000000000).withColumn("usr", F.concat("usr", F.lit("-2"))), F.lit(2)))
    return writes.upsert(s.usr, batch, ["id"])


@query("o050_user_update", "usr", sql="SELECT id, role, usr, CASE WHEN id % 4 = 0 THEN 'n' || id ELSE name END AS name FROM usr")
def _(s):
    return writes.partial_update(s.usr, s.usr.where("id % 4 = 0").select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name")), ["id"], ["name"])


@query("o051_user_delete", "usr", sql="SELECT * FROM usr WHERE id % 30 != 0")
def _(s):
    return writes.delete(s.usr, s.usr.where("id % 30 = 0"), ["id"])


@query("o052_bucket_put", "bkt", sql="SELECT id, n, CASE WHEN id % 3 = 0 THEN 4194304 ELSE cs END AS cs FROM bkt UNION ALL SELECT 1000, 'NEW', 10485760")
def _(s):
    batch = _seq(s.bkt.where("id % 3 = 0").withColumn("cs", F.lit(4194304).cast("long")), F.lit(1))
    new = _seq(s.bkt.where("id = 1").withColumn("id", F.lit(1000).cast("long")).withColumn("n", F.lit("NEW")), F.lit(2))
    return writes.upsert(s.bkt, batch.unionByName(new), ["id"]).select("id", "n", "cs")


@query("o053_quota_update", "bkt", sql="SELECT id, CASE WHEN id = 7 THEN 12345 ELSE q END::BIGINT AS q FROM bkt")
def _(s):
    return writes.set_where(s.bkt, F.col("id") == 7, q=F.lit(12345).cast("long")).select("id", "q")


@query("o056_quota_check", "bkt", sql="""SELECT seq, bkt_id, NOT (q >= 0 AND ru + used > q) AS accepted FROM (SELECT c_custkey AS seq, c_nationkey + 1 AS bkt_id, sum(c_custkey % 1000 * 3000) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) AS used FROM customer) JOIN bkt ON id = bkt_id""")
def _(s):
    puts = s.table("customer").select(F.col("c_custkey").alias("seq"), (F.col("c_nationkey") + 1).alias("bkt_id"), (F.col("c_custkey") % 1000 * 3000).alias("size"))
    return writes.quota_check(puts, s.bkt)


#: For every live file a new one without id and name, a version below that, and a version below the file itself.
_OBJECTS = """k AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS k FROM obj WHERE t = 2 AND pid > 0),
  b AS (SELECT 3 * k AS pos, 0 AS id, pid, did, s, m, 2 AS t, '' AS n FROM k UNION ALL SELECT 3 * k + 1, 0, -3 * k - 1, did + 1, 0, m + 1, 3, 'v' FROM k UNION ALL SELECT 3 * k + 2, id + 500000000, id, did + 2, 0, m + 2, 3, '' FROM k),
  i AS (SELECT pos, CASE WHEN id = 0 THEN 7000000000000 + pos ELSE id END AS id, pid, did, s, m, t, n FROM b),
  r AS (SELECT i.id, coalesce(p.id, i.pid) AS pid, i.did, i.s, i.m, i.t, CASE WHEN i.n = '' THEN i.id::VARCHAR ELSE i.n END AS n FROM i LEFT JOIN i p ON p.pos = -i.pid - 1),
  v AS (SELECT pid AS id, max(did) AS did, arg_max(m, did) AS m FROM r WHERE t = 3 AND pid > 0 AND did > 0 GROUP BY pid),
  e AS (SELECT id, pid, did, s, m, t, n FROM obj UNION ALL SELECT id, pid, did, s, m, t, n FROM r),
  done AS (SELECT e.id, e.pid, CASE WHEN u THEN x.did ELSE e.did END AS did, CASE WHEN u THEN coalesce(x.os, e.s) ELSE e.s END AS s, CASE WHEN u THEN x.m ELSE e.m END AS m, e.t, e.n
           FROM (SELECT e.*, coalesce(e.t = 2 AND v.did > e.did, false) AS u FROM e LEFT JOIN v USING (id)) e LEFT JOIN (SELECT v.*, os FROM v LEFT JOIN data d ON d.id = v.did) x ON x.id = e.id)"""


def _objects(s):
    k = dedup.numbered(s.obj.where("t = 2 AND pid > 0"), "id").withColumn("k", F.col("pos") * 3)
    zero, columns = F.lit(0).cast("long"), ["pos", "id", "pid", "did", "s", "m", "t", "n"]
    new = k.withColumns({"pos": F.col("k"), "id": zero, "n": F.lit("")}).select(*columns)
    below = k.withColumns({"pos": F.col("k") + 1, "id": zero, "pid": -F.col("k") - 1, "did": F.col("did") + 1, "s": zero, "m": F.col("m") + 1, "t": F.lit(3), "n": F.lit("v")}).select(*columns)
    own = k.withColumns({"pos": F.col("k") + 2, "id": F.col("id") + 500000000, "pid": F.col("id"), "did": F.col("did") + 2, "s": zero, "m": F.col("m") + 2, "t": F.lit(3), "n": F.lit("")}).select(*columns)
    return writes.put_objects(s.obj, s.data, new.unionByName(below).unionByName(own), 7000000000000)


@query("o057_object_put", "data", "obj", sql=f"{_OBJECTS} SELECT * FROM done")
def _(s):
    return _objects(s)[0]


@query("o057_put_counters", "data", "obj", sql=f"{_OBJECTS}, refs AS (SELECT did, count(*) AS refs FROM done WHERE pid >= 0 GROUP BY did) SELECT coalesce(sum(s), 0)::BIGINT AS logical, coalesce(sum(s) FILTER (did > 0 AND refs > 1), 0)::BIGINT AS saved FROM r LEFT JOIN refs USING (did) WHERE t = 2 AND s > 0")
def _(s):
    return _objects(s)[1]


@query("o093_promote_versions", "version", sql="""f AS (SELECT pid AS id, min(id) AS did, 0::BIGINT AS s, 0::BIGINT AS m FROM version GROUP BY pid), v AS (SELECT pid, arg_max((did, s, m), did) AS v FROM version WHERE t = 3 GROUP BY pid)
  SELECT f.id, CASE WHEN v.v[1] > f.did THEN v.v[1] ELSE f.did END AS did, CASE WHEN v.v[1] > f.did THEN v.v[2] ELSE f.s END AS s, CASE WHEN v.v[1] > f.did THEN v.v[3] ELSE f.m END AS m FROM f LEFT JOIN v ON v.pid = f.id""")
def _(s):
    zero = F.lit(0).cast("long")
    files = s.version.groupBy(F.col("pid").alias("id")).agg(F.min("id").alias("did")).select("id", "did", zero.alias("s"), zero.alias("m"))
    return writes.promote_versions(files, s.version)


_PUT = f"{_SHORT}, p AS (SELECT id AS seq, id + 80000000 AS id, pid, n FROM o WHERE t = 2 AND pid > 0 AND id % 5 = 0 UNION ALL SELECT id, id + 90000000, pid, 'only_' || id FROM o WHERE t = 2 AND pid > 0 AND id % 50 = 1)"


def _put(s):
    live = _short(s).where("t = 2 AND pid > 0")
    a = live.where("id % 5 = 0").select(F.col("id").alias("seq"), (F.col("id") + 80000000).alias("id"), "pid", "n")
    return a.unionByName(live.where("id % 50 = 1").select(F.col("id").alias("seq"), (F.col("id") + 90000000).alias("id"), "pid", F.concat(F.lit("only_"), F.col("id").cast("string")).alias("n")))


@query("o133_rename_on_conflict", "obj", sql=f"{_PUT} SELECT id, CASE WHEN k > 0 THEN n || '(' || k || ')' ELSE n END AS n FROM (SELECT id, n, row_number() OVER (PARTITION BY pid, n ORDER BY seq) - 1 + CASE WHEN (pid, n) IN (SELECT (pid, n) FROM o WHERE pid >= 0) THEN 1 ELSE 0 END AS k FROM p)")
def _(s):
    return writes.rename_conflicts(_short(s), _put(s))


@query("o169_conflict_policy", "obj", sql=f"{_PUT} SELECT p.id, coalesce(h.x, p.id) AS target, CASE WHEN h.x IS NULL THEN 'create' ELSE 'version' END AS action FROM p LEFT JOIN (SELECT pid, n, min(id) AS x FROM o WHERE pid >= 0 GROUP BY ALL) h ON p.pid = h.pid AND p.n = h.n")
def _(s):
    return writes.resolve_conflicts(_short(s), _put(s), "cover")


@query("o055_chunk_delete_plan", "blk", sql="SELECT data_id, sn FROM chunk WHERE data_id NOT IN (SELECT id FROM blk)")
def _(s):
    return s.chunk.join(s.blk.select(F.col("id").alias("data_id")), "data_id", "left_anti").select("data_id", "sn")


