"""Journals, byte ranges, versions and retention."""

from pyspark.sql import functions as F

from ..operators import intervals, retention
from . import query

_ISLANDS = """marked AS (SELECT *, off + len AS fin, max(off + len) OVER (PARTITION BY file_id ORDER BY off, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM journal),
  numbered AS (SELECT *, sum(CASE WHEN reach IS NULL OR off > reach THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY off, fin ROWS UNBOUNDED PRECEDING) AS island FROM marked),
  runs AS (SELECT file_id, min(off) AS a, max(fin) AS b FROM numbered GROUP BY file_id, island)"""
_BYTES = "bytes AS (SELECT file_id, seq, unnest(range(off, off + len)) AS p FROM journal)"


@query("o116_modified_bytes", "journal", sql=f"{_BYTES} SELECT file_id, count(DISTINCT p) AS modified FROM bytes GROUP BY file_id")
def _(s):
    return intervals.modified_bytes(s.journal)


@query("o117_modified_chunks", "journal", sql=f"{_BYTES} SELECT DISTINCT file_id, p // 64 AS sn FROM bytes WHERE p < 9000")
def _(s):
    return intervals.modified_chunks(s.journal, 64, 9000)


@query("o178_merge_entries", "journal", sql=f'{_ISLANDS} SELECT file_id, a AS start, b AS "end" FROM runs')
def _(s):
    return intervals.coverage(s.journal)


@query("o179_merge_writes", "journal", sql=f'{_ISLANDS} SELECT file_id, count(*) AS runs, sum(b - a)::BIGINT AS bytes FROM runs GROUP BY file_id')
def _(s):
    return intervals.coverage(s.journal).groupBy("file_id").agg(F.count(F.lit(1)).alias("runs"), F.sum(F.col("end") - F.col("start")).cast("long").alias("bytes"))


@query("o182_write_ranges", "journal", sql=f"{_ISLANDS} SELECT file_id, max(b) AS size, min(a) AS first FROM runs GROUP BY file_id")
def _(s):
    return intervals.coverage(s.journal).groupBy("file_id").agg(F.max("end").alias("size"), F.min("start").alias("first"))


@query("o183_complete_chunks", "journal", sql=f"{_BYTES} SELECT file_id, p // 16 AS sn FROM bytes GROUP BY ALL HAVING count(DISTINCT p) = 16")
def _(s):
    return intervals.complete_chunks(s.journal, 16)


@query("o184_truncate", "journal", sql="SELECT file_id, seq, off, least(len, 3005 - off) AS len FROM journal WHERE off < 3005")
def _(s):
    return intervals.truncate(s.journal, 3005)


def _reads(s):
    return s.journal.select(F.col("seq").alias("read_id"), "file_id", F.greatest(F.lit(0), F.col("off") - 700).alias("off"), F.lit(1500).cast("long").alias("len"))


@query("o097_overlay", "journal", sql=f"""{_BYTES}, r AS (SELECT seq AS read_id, file_id, unnest(range(greatest(0, off - 700), greatest(0, off - 700) + 1500)) AS p FROM journal)
  SELECT read_id, seq, count(*) AS n FROM (SELECT r.read_id, r.p, max(b.seq) AS seq FROM r LEFT JOIN bytes b ON r.file_id = b.file_id AND r.p = b.p GROUP BY ALL) GROUP BY ALL""")
def _(s):
    return intervals.pieces(_reads(s), s.journal, 512).groupBy("read_id", "seq").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("n"))


@query("o181_range_read", "journal", sql=f"""{_BYTES}, r AS (SELECT seq AS read_id, file_id, unnest(range(greatest(0, off - 700), greatest(0, off - 700) + 1500)) AS p FROM journal)
  SELECT r.read_id, count(DISTINCT r.p) FILTER (b.p IS NOT NULL) AS written, count(DISTINCT r.p) AS asked FROM r LEFT JOIN bytes b ON r.file_id = b.file_id AND r.p = b.p GROUP BY r.read_id""")
def _(s):
    n = F.col("end") - F.col("start")
    return intervals.pieces(_reads(s), s.journal, 512).groupBy("read_id").agg(F.sum(F.when(F.col("seq").isNotNull(), n).otherwise(0)).cast("long").alias("written"), F.sum(n).cast("long").alias("asked"))


@query("o186_journal_triggers", "journal", sql="SELECT file_id, count(*) AS entries, sum(len)::BIGINT AS bytes, CASE WHEN sum(len) > 1700 THEN 'flush' WHEN count(*) > 64 THEN 'snapshot' ELSE 'none' END AS due FROM journal WHERE seq <= 100000000 GROUP BY file_id")
def _(s):
    return intervals.journal_state(s.journal, 100000000, 64, 1700)


@query("o250_free_memory", "journal", sql="SELECT file_id, bytes FROM (SELECT *, coalesce(sum(bytes) OVER (ORDER BY bytes DESC, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM (SELECT file_id, sum(len)::BIGINT AS bytes FROM journal GROUP BY file_id)) WHERE freed < 20000")
def _(s):
    return intervals.free_memory(s.journal.groupBy("file_id").agg(F.sum("len").cast("long").alias("bytes")), 20000)


@query("o190_changed_chunks", "journal", sql=f"{_BYTES}, c AS (SELECT DISTINCT file_id, p // 1024 AS sn FROM bytes), f AS (SELECT DISTINCT file_id FROM journal) SELECT f.file_id, sn, (f.file_id, sn) IN (SELECT (file_id, sn) FROM c) AS replaced FROM f, (SELECT unnest(range(0, 10)) AS sn)")
def _(s):
    changed = intervals.modified_chunks(s.journal, 1024).withColumn("replaced", F.lit(True))
    every = s.journal.select("file_id").distinct().select("file_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("sn"))
    return every.join(changed, ["file_id", "sn"], "left").select("file_id", "sn", F.coalesce("replaced", F.lit(False)).alias("replaced"))


_W = 86400
_DEPS = "deps AS (SELECT base, count(*) AS journals, min(id) AS first_journal FROM version WHERE t = 4 AND base > 0 GROUP BY base)"
_RULE1 = f"{_DEPS}, rule1 AS (SELECT id, pid FROM (SELECT *, row_number() OVER (PARTITION BY pid, m // {_W} ORDER BY m DESC, id DESC) AS rank FROM version WHERE t = 3) WHERE rank > 1 AND id NOT IN (SELECT base FROM deps))"


@query("o122_window_rule", "version", sql=f"{_RULE1} SELECT * FROM rule1")
def _(s):
    return retention.window_rule(s.version, _W)


@query("o123_max_versions", "version", sql="SELECT id, pid FROM (SELECT id, pid, row_number() OVER (PARTITION BY pid ORDER BY m DESC, id DESC) AS rank FROM version WHERE t IN (3, 4)) WHERE rank > 8")
def _(s):
    return retention.simple_max_versions(s.version, 8)


#: The rule of most versions walks each file's versions, newest first; what is kept decides what goes.
_RULE2 = f"""{_RULE1},
  v AS (SELECT id, pid, t, id IN (SELECT base FROM deps) AS needed, row_number() OVER (PARTITION BY pid ORDER BY m DESC, id DESC) AS k, count(*) OVER (PARTITION BY pid) AS n FROM version WHERE t IN (3, 4) AND id NOT IN (SELECT id FROM rule1)),
  w(id, pid, k, gone, kept, fulls) AS (SELECT id, pid, k, false, 1, (t = 3)::INT FROM v WHERE k = 1 AND n > 8
    UNION ALL SELECT v.id, v.pid, v.k, w.kept >= 8 AND NOT (t = 3 AND (needed OR w.fulls <= 2)),
      w.kept + CASE WHEN w.kept >= 8 AND NOT (t = 3 AND (needed OR w.fulls <= 2)) THEN 0 ELSE 1 END, w.fulls + CASE WHEN t = 3 AND NOT (w.kept >= 8 AND NOT (needed OR w.fulls <= 2)) THEN 1 ELSE 0 END FROM w JOIN v ON v.pid = w.pid AND v.k = w.k + 1)"""


@query("o123_max_versions_exact", "version", recursive=True, sql=f"{_RULE2} SELECT id, pid FROM w WHERE gone")
def _(s):
    return retention.max_versions_rule(s.version, retention.window_rule(s.version, _W), 8, 2)


@query("o124_max_journals", "version", sql="SELECT base, id FROM (SELECT base, id, row_number() OVER (PARTITION BY base ORDER BY m, id) AS nth, count(*) OVER (PARTITION BY base) AS n FROM version WHERE t = 4 AND base > 0) WHERE n > 2 AND nth <= greatest(n - 2, 2)")
def _(s):
    return retention.max_journals_rule(s.version, s.version.where("false"), 2)


@query("o125_retention", "version", recursive=True, sql=f"""{_RULE2}, gone AS (SELECT id, pid, 'window' AS rule FROM rule1 UNION ALL SELECT id, pid, 'versions' FROM w WHERE gone),
  j AS (SELECT id, pid, row_number() OVER (PARTITION BY base ORDER BY m, id) AS nth, count(*) OVER (PARTITION BY base) AS n FROM version WHERE t = 4 AND base > 0 AND id NOT IN (SELECT id FROM gone))
  SELECT * FROM gone UNION ALL SELECT id, pid, 'journals' FROM j WHERE n > 2 AND nth <= greatest(n - 2, 2)""")
def _(s):
    return retention.retention(s.version, _W, 8, 2, 2)


@query("o120_retention_stats", "version", sql=f"{_RULE1} SELECT 'window' AS rule, count(*) AS versions, count(DISTINCT pid) AS files FROM rule1")
def _(s):
    return retention.retention_stats(retention.window_rule(s.version, _W).withColumn("rule", F.lit("window")))


@query("o126_split_versions", "version", sql="SELECT id, pid, m, CASE t WHEN 3 THEN 'full' ELSE 'journal' END AS side FROM version WHERE t IN (3, 4)")
def _(s):
    full, journals = retention.split_versions(s.version)
    return full.withColumn("side", F.lit("full")).unionByName(journals.withColumn("side", F.lit("journal"))).select("id", "pid", "m", "side")


@query("o127_dependencies", "version", sql=f"{_DEPS} SELECT * FROM deps")
def _(s):
    return retention.dependencies(s.version)


@query("o098_version_chain", "version", recursive=True, sql="chain(id, root, depth) AS (SELECT id, id, 0 FROM version WHERE t = 3 UNION ALL SELECT v.id, c.root, c.depth + 1 FROM chain c JOIN version v ON v.t = 4 AND v.base = c.id) SELECT root, count(*) AS members, max(depth) AS depth FROM chain GROUP BY root")
def _(s):
    from ..operators import hierarchy

    links = s.version.where("t = 4").select("id", F.col("base").alias("pid"))  # a full version hangs below nothing, not below the one numbered 0
    down = hierarchy.descend(links, s.version.where("t = 3").select(F.col("id").alias("root")))
    return down.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.max("level").alias("depth"))


@query("o251_merged_versions", "version", sql="""m AS (SELECT base, id FROM (SELECT base, id, row_number() OVER (PARTITION BY base ORDER BY m, id) AS nth, count(*) OVER (PARTITION BY base) AS n FROM version WHERE t = 4 AND base > 0) WHERE n > 2 AND nth <= greatest(n - 2, 2))
  SELECT m.base, any_value(v.pid) AS pid, max(v.m) AS m, arg_max(v.s, (v.m, v.id)) AS s, count(*) AS merged FROM m JOIN version v ON v.id = m.id GROUP BY m.base""")
def _(s):
    return retention.merged_versions(retention.max_journals_rule(s.version, s.version.where("false"), 2), s.version)


@query("o252_delete_versions", "version", sql=f"{_RULE1} SELECT id, pid, t, m FROM version WHERE id NOT IN (SELECT id FROM rule1)")
def _(s):
    return s.version.join(retention.window_rule(s.version, _W).select("id"), "id", "left_anti").select("id", "pid", "t", "m")


@query("o249_recover_journals", "journal", "version", sql="SELECT file_id, count(*) AS entries, max(off + len) AS size FROM journal WHERE file_id IN (SELECT pid FROM version WHERE t = 3 AND s > 0) GROUP BY file_id")
def _(s):
    files = s.version.where("t = 3 AND s > 0").select(F.col("pid").alias("file_id"))
    return s.journal.join(files, "file_id", "left_semi").groupBy("file_id").agg(F.count(F.lit(1)).alias("entries"), F.max(F.col("off") + F.col("len")).alias("size"))
