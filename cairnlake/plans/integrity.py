"""Scrub and its parts."""

from pyspark.sql import functions as F

from ..operators import integrity
from . import query

_SUM = "sums AS (SELECT data_id, count(DISTINCT sn) AS chunks, max(sn)::BIGINT AS last_sn, min(sn) AS first_sn, sum(size)::BIGINT AS held FROM chunk GROUP BY data_id)"
_GAP = "NOT (first_sn = 0 AND last_sn + 1 = chunks)"
_ISSUES = f"""{_SUM}, issues AS (SELECT * FROM (SELECT coalesce(id, data_id) AS id, CASE WHEN id IS NULL THEN 'orphaned' WHEN data_id IS NULL OR {_GAP} THEN 'corrupted' WHEN held != s THEN 'mismatched' END AS category
  FROM blk FULL JOIN sums ON id = data_id) WHERE category IS NOT NULL)"""


@query("o022_chunk_scan", "chunk", sql="SELECT sn, size FROM chunk WHERE data_id = (SELECT min(l_orderkey) FROM lineitem)")
def _(s):
    first = s.table("lineitem").agg(F.min("l_orderkey").alias("data_id"))
    return s.chunk.join(F.broadcast(first), "data_id").select("sn", "size")  # one row


@query("o023_chunk_paths", "chunk", sql="""SELECT data_id, sn::INT AS sn, data_id % 17 != 0 AS valid FROM chunk""")
def _(s):
    path = integrity.chunk_path(F.col("data_id"), F.col("sn"))
    moved = F.when(F.col("data_id") % 17 == 0, F.concat(F.lit("000/0/"), F.substring_index(path, "/", -1))).otherwise(path)
    return s.chunk.select(moved.alias("path")).select(*integrity.parse_chunk_path(F.col("path")))


@query("o158_chunk_path", "chunk", sql="SELECT data_id, sn, substr(upper(md5(data_id || '_' || sn)), 22, 3) || '/' || substr(upper(md5(data_id || '_' || sn)), 9, 16) || '/' || data_id || '_' || sn AS path FROM chunk")
def _(s):
    return s.chunk.select("data_id", "sn", integrity.chunk_path(F.col("data_id"), F.col("sn")).alias("path"))


@query("o089_orphan_files", "chunk", "blk", sql="SELECT DISTINCT data_id FROM chunk WHERE data_id NOT IN (SELECT id FROM blk)")
def _(s):
    return integrity.orphan_files(s.chunk, s.blk)


@query("o090_missing_files", "blk", sql="SELECT id FROM blk WHERE id NOT IN (SELECT data_id FROM chunk)")
def _(s):
    return integrity.missing_files(s.blk, s.chunk)


@query("o091_orphan_chunks", "blk", "ref", sql="SELECT data_id, CASE WHEN data_id NOT IN (SELECT id FROM blk) THEN 'no row' ELSE 'no reference' END AS reason FROM (SELECT DISTINCT data_id FROM chunk) WHERE data_id NOT IN (SELECT id FROM blk) OR data_id NOT IN (SELECT did FROM ref WHERE pid >= 0)")
def _(s):
    return integrity.unreferenced(s.chunk, s.blk, s.ref)


@query("o111_chunk_summary", "chunk", sql=f"{_SUM} SELECT data_id, chunks, last_sn, held, NOT ({_GAP}) AS contiguous FROM sums")
def _(s):
    return integrity.chunk_summary(s.chunk)


@query("o112_dirty_scan", "blk", sql=f"{_SUM} SELECT id, CASE WHEN {_GAP} THEN 'gap' ELSE 'size' END AS reason FROM blk JOIN sums ON id = data_id WHERE {_GAP} OR held != s")
def _(s):
    return integrity.dirty(s.blk, s.chunk)


@query("o113_prefix_size", "chunk", sql="SELECT data_id, sum(size)::BIGINT AS size FROM (SELECT *, row_number() OVER (PARTITION BY data_id ORDER BY sn) - 1 AS nth FROM chunk) WHERE sn = nth GROUP BY data_id")
def _(s):
    return integrity.prefix_size(s.chunk)


@query("o129_contiguity", "chunk", sql="SELECT data_id, min(sn) AS first_sn, max(sn) AS last_sn FROM (SELECT data_id, sn, sn - row_number() OVER (PARTITION BY data_id ORDER BY sn) AS island FROM chunk) GROUP BY data_id, island")
def _(s):
    from pyspark.sql import Window

    island = F.col("sn") - F.row_number().over(Window.partitionBy("data_id").orderBy("sn"))
    return s.chunk.withColumn("island", island).groupBy("data_id", "island").agg(F.min("sn").alias("first_sn"), F.max("sn").alias("last_sn")).drop("island")


@query("o137_issue_categories", "blk", sql=f"{_ISSUES} SELECT category, count(*) AS blocks FROM issues GROUP BY category")
def _(s):
    return integrity.scrub(s.blk, s.chunk).groupBy("category").agg(F.count(F.lit(1)).alias("blocks"))


@query("o195_scrub", "blk", sql=f"{_ISSUES} SELECT * FROM issues")
def _(s):
    return integrity.scrub(s.blk, s.chunk)


@query("o196_fix_plan", "blk", "ref", sql=f"{_ISSUES} SELECT id, category, CASE WHEN category = 'orphaned' THEN 'delete files' WHEN id NOT IN (SELECT did FROM ref WHERE pid >= 0) THEN 'delete row' ELSE 'keep' END AS action FROM issues")
def _(s):
    return integrity.fix_plan(integrity.scrub(s.blk, s.chunk), s.ref)
