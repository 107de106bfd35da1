"""Duplicate groups, probes, references, and the joins on them."""

from pyspark.sql import functions as F

from ..operators import dedup
from . import query

_GROUP = "os, h, x, s0, s1, s2, s3"
_USABLE = "os > 0 AND h != 0 AND x != 0 AND s0 != 0"
#: Probes: every third block as it is, header-only ones, ones without size, new contents (each twice).
_PROBES = """probes AS (SELECT id * 4 AS pos, os, h, x, s0, s1, s2, s3 FROM data WHERE id % 3 = 0 UNION ALL SELECT id * 4 + 1, os, h, 0, 0, 0, 0, 0 FROM data WHERE id % 5 = 0
  UNION ALL SELECT id * 4 + 2, 0, h, x, s0, s1, s2, s3 FROM data WHERE id % 7 = 0 UNION ALL SELECT id * 4 + 3, os + 1, h, x, s0, s1, s2, s3 FROM data WHERE id % 11 = 0)"""


def _probes(s):
    zero = F.lit(0).cast("long")

    def some(mod, at, **new):
        return s.data.where(f"id % {mod} = 0").select((F.col("id") * 4 + at).alias("pos"), *[new.get(c, F.col(c)).alias(c) for c in dedup.DIGEST])

    blank = dict.fromkeys(("x", "s0", "s1", "s2", "s3"), zero)
    return some(3, 0).unionByName(some(5, 1, **blank)).unionByName(some(7, 2, os=zero)).unionByName(some(11, 3, os=F.col("os") + 1))


_HIT = "LEFT JOIN data b ON a.os = b.os AND a.h = b.h AND (a.x = 0 OR a.s0 = 0 OR (a.x = b.x AND a.s0 = b.s0 AND a.s1 = b.s1 AND a.s2 = b.s2 AND a.s3 = b.s3)) AND a.os != 0 AND a.h != 0"


@query("o087_dedup_probe", "data", sql=f"""{_PROBES}, hit AS (SELECT a.pos, max(b.id) AS hit FROM probes a {_HIT} GROUP BY a.pos)
  SELECT pos, CASE WHEN os = 0 OR h = 0 THEN 0 WHEN hit IS NOT NULL THEN CASE WHEN x = 0 OR s0 = 0 THEN 1 ELSE hit END WHEN pos = first THEN 0 ELSE -first - 1 END::BIGINT AS ref
  FROM (SELECT *, min(pos) OVER (PARTITION BY {_GROUP}) AS first FROM probes) JOIN hit USING (pos)""")
def _(s):
    return dedup.probe(s.data, _probes(s))


@query("o088_fast_probe", "data", sql=f"""{_PROBES}, hit AS (SELECT a.pos, max(b.id) AS hit FROM (SELECT * FROM probes p WHERE os <= 3000 OR EXISTS (SELECT 1 FROM data d WHERE d.os = p.os AND d.h = p.h)) a {_HIT} GROUP BY a.pos)
  SELECT pos, CASE WHEN os = 0 OR h = 0 OR hit IS NULL THEN 0 WHEN x = 0 OR s0 = 0 THEN 1 ELSE hit END::BIGINT AS ref FROM probes LEFT JOIN hit USING (pos)""")
def _(s):
    return dedup.fast_probe(s.data, _probes(s), 3000)


@query("o221_resolve_batch", "data", sql="""ids AS (SELECT row_number() OVER (ORDER BY id) - 1 AS pos, CASE WHEN id % 4 = 3 THEN -(row_number() OVER (ORDER BY id) - 2) - 1 ELSE id END AS id FROM data)
  SELECT a.pos, CASE WHEN a.id < 0 THEN b.id ELSE a.id END AS id FROM ids a LEFT JOIN ids b ON a.id = -b.pos - 1""")
def _(s):
    rows = dedup.numbered(s.data.select("id"), "id")
    return dedup.resolve_batch(rows.select("pos", F.when(F.col("id") % 4 == 3, -(F.col("pos") - 1) - 1).otherwise(F.col("id")).alias("id")))


@query("o101_duplicate_groups", "data", sql=f"SELECT {_GROUP}, count(*) AS cnt, min(id) AS master, ((count(*) - 1) * os)::BIGINT AS freed FROM data WHERE {_USABLE} GROUP BY {_GROUP} HAVING count(*) > 1")
def _(s):
    return dedup.duplicate_groups(s.data).orderBy("master")


@query("o101_duplicate_groups_strict", "data", sql=f"SELECT min(id) AS master, count(*) AS cnt FROM data WHERE os > 0 AND h > 0 AND x > 0 AND s0 != 0 GROUP BY {_GROUP} HAVING count(*) > 1")
def _(s):
    return dedup.duplicate_groups(s.data, strict=True).select("master", "cnt")


@query("o101_group_members", "data", sql=f"SELECT master, id FROM (SELECT id, min(id) OVER g AS master, count(*) OVER g AS cnt FROM data WHERE {_USABLE} WINDOW g AS (PARTITION BY {_GROUP})) WHERE cnt > 1")
def _(s):
    return dedup.duplicate_members(s.data, dedup.duplicate_groups(s.data))


@query("o102_reference_counts", "data", "obj", sql="SELECT d.id, count(o.id) AS refs FROM data d LEFT JOIN obj o ON o.did = d.id AND o.pid >= 0 GROUP BY d.id")
def _(s):
    return dedup.reference_counts(s.data, s.obj)


@query("o036_remap_references", "obj", "data", sql=f"SELECT o.id, coalesce(m.new, o.did) AS did FROM obj o LEFT JOIN (SELECT id AS old, min(id) OVER (PARTITION BY {_GROUP}) AS new FROM data) m ON o.did = m.old")
def _(s):
    return dedup.remap(s.obj, dedup.merge_plan(s.data, s.data).select("old", "new")).select("id", "did")


@query("o110_dedup_savings", "obj", sql="SELECT did, sum(s)::BIGINT AS saved FROM (SELECT did, s, row_number() OVER (PARTITION BY did ORDER BY id) AS nth FROM obj WHERE t = 2 AND pid >= 0 AND did > 0) WHERE nth > 1 GROUP BY did")
def _(s):
    return dedup.dedup_savings(s.obj)


@query("o114_merge_plan", "data", sql=f"""g AS (SELECT id, os, CASE WHEN id % 6 != 1 THEN id END AS f, min(CASE WHEN id % 6 != 1 THEN id END) OVER (PARTITION BY {_GROUP}) AS new, count(*) OVER (PARTITION BY {_GROUP}) AS cnt FROM data WHERE {_USABLE})
  SELECT id AS old, new, CASE WHEN f IS NOT NULL THEN os ELSE 0 END AS freed FROM g WHERE cnt > 1 AND new IS NOT NULL AND id != new""")
def _(s):
    return dedup.merge_plan(s.data, s.data.where("id % 6 != 1"))


@query("o115_merge_totals", "data", sql=f"SELECT bkt_id, count(*) AS groups, sum((cnt - 1) * os)::BIGINT AS freed FROM (SELECT bkt_id, os, count(*) AS cnt FROM data WHERE {_USABLE} GROUP BY bkt_id, {_GROUP} HAVING count(*) > 1) GROUP BY ROLLUP (bkt_id)")
def _(s):
    return dedup.merge_totals(s.data)


@query("o095_package_members", "data", "obj", sql="SELECT pi, count(*) AS blocks, count(*) FILTER (refs > 0) AS valid, coalesce(sum(os) FILTER (refs > 0), 0)::BIGINT AS bytes FROM (SELECT d.pi, d.os, (SELECT count(*) FROM obj o WHERE o.did = d.id AND o.pid >= 0) AS refs FROM data d WHERE pi > 0) GROUP BY pi")
def _(s):
    met = s.data.where("pi > 0").join(dedup.reference_counts(s.data, s.obj), "id")
    used = F.col("refs") > 0
    return met.groupBy("pi").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(used).alias("valid"), F.coalesce(F.sum(F.when(used, F.col("os"))), F.lit(0)).cast("long").alias("bytes"))


@query("o096_pending_merge", "path", sql="SELECT path AS key, 'stored' AS origin FROM path WHERE pid >= 0 UNION ALL SELECT key, 'pending' FROM (SELECT 'src0/doc_' || doc_id || '.' || lang AS key FROM documents WHERE doc_id % 40 < 2) WHERE key NOT IN (SELECT path FROM path WHERE pid >= 0)")
def _(s):
    pending = s.table("documents").where("doc_id % 40 < 2").select(F.concat(F.lit("src0/doc_"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang")).alias("key"))
    stored = s.path.where("pid >= 0").select(F.col("path").alias("key"))
    return stored.withColumn("origin", F.lit("stored")).unionByName(pending.join(stored, "key", "left_anti").withColumn("origin", F.lit("pending")))


@query("o100_multipart_complete", "content", sql="SELECT data_id, count(*) AS parts, count(c.sn) AS found, count(*) = count(c.sn) AS complete FROM (SELECT data_id, sn + (data_id % 9 = 0)::INT AS sn FROM content) r LEFT JOIN content c USING (data_id, sn) GROUP BY data_id")
def _(s):
    wanted = s.content.select("data_id", (F.col("sn") + (F.col("data_id") % 9 == 0).cast("int")).alias("sn"))
    met = wanted.join(s.content.select("data_id", "sn", F.lit(1).alias("has")), ["data_id", "sn"], "left")
    return met.groupBy("data_id").agg(F.count(F.lit(1)).alias("parts"), F.count("has").alias("found"), (F.count(F.lit(1)) == F.count("has")).alias("complete"))
