"""Packages, usage and scheduled jobs."""

from pyspark.sql import functions as F

from ..operators import access, listing, packing
from . import query

_VALID = "valid AS (SELECT * FROM data WHERE pi > 0 AND id IN (SELECT did FROM obj WHERE pid >= 0)), files AS (SELECT pi, (sum(os) + pi % 3 * 100)::BIGINT AS size FROM data WHERE pi > 0 GROUP BY pi)"
_HOLES = f"""{_VALID}, gaps AS (SELECT pi, coalesce(max(po + os) OVER (PARTITION BY pi ORDER BY po, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, po FROM valid),
  holes AS (SELECT pi, start::BIGINT AS start, (po - start)::BIGINT AS size FROM gaps WHERE po > start UNION ALL
    SELECT f.pi, coalesce(e.fin, 0)::BIGINT, (f.size - coalesce(e.fin, 0))::BIGINT FROM files f LEFT JOIN (SELECT pi, max(po + os) AS fin FROM valid GROUP BY pi) e ON e.pi = f.pi WHERE f.size > coalesce(e.fin, 0))"""


def _files(s):
    return s.data.where("pi > 0").groupBy("pi").agg((F.sum("os") + F.first("pi") % 3 * 100).cast("long").alias("size"))


def _holes(s):
    return packing.holes(packing.valid_blocks(s.data, s.obj), _files(s))


@query("o128_package_holes", "data", "obj", sql=f"{_HOLES} SELECT * FROM holes")
def _(s):
    return _holes(s)


@query("o130_compaction_offsets", "data", "obj", sql=f"{_VALID} SELECT id, pi, coalesce(sum(os) OVER (PARTITION BY pi ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS new_po FROM valid")
def _(s):
    return packing.offsets(packing.valid_blocks(s.data, s.obj), "pi").select("id", "pi", "new_po")


@query("o131_flush_offsets", "data", sql="SELECT id, bkt_id, coalesce(sum(os) OVER (PARTITION BY bkt_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS new_po FROM data WHERE pi = 0")
def _(s):
    return packing.offsets(s.data.where("pi = 0"), "bkt_id").select("id", "bkt_id", "new_po")


@query("o119_average_size", "data", sql="SELECT bkt_id, (sum(os) // count(*))::BIGINT AS average FROM data WHERE pi = 0 GROUP BY bkt_id")
def _(s):
    return s.data.where("pi = 0").groupBy("bkt_id").agg(F.floor(F.sum("os") / F.count(F.lit(1))).cast("long").alias("average"))


def _small(s):
    return s.data.where("pi = 0").select("bkt_id", "id", F.col("os").alias("size"))


_ORDERED = "f AS (SELECT bkt_id, id, os AS size, row_number() OVER (PARTITION BY bkt_id ORDER BY os, id) AS k FROM data WHERE pi = 0)"


@query("o199_next_fit", "data", recursive=True, sql=f"""{_ORDERED}, p(bkt_id, id, size, k, package, total) AS (SELECT bkt_id, id, size, k, 0::BIGINT, size::BIGINT FROM f WHERE k = 1
  UNION ALL SELECT f.bkt_id, f.id, f.size, f.k, p.package + CASE WHEN p.total > 0 AND p.total + f.size > 30000 THEN 1 ELSE 0 END, CASE WHEN p.total > 0 AND p.total + f.size > 30000 THEN f.size ELSE p.total + f.size END FROM p JOIN f ON f.bkt_id = p.bkt_id AND f.k = p.k + 1)
  SELECT bkt_id, id, size, package FROM p""")
def _(s):
    return packing.next_fit(_small(s), 30000)


@query("o200_push_packages", "data", recursive=True, sql=f"""{_ORDERED}, p(bkt_id, id, size, k, package, off, grp, total, n) AS (SELECT bkt_id, id, size, k, CASE WHEN size >= 30000 THEN NULL ELSE 0 END::BIGINT, CASE WHEN size >= 30000 THEN NULL ELSE 0 END::BIGINT, 0::BIGINT, CASE WHEN size >= 30000 THEN 0 ELSE size END::BIGINT, CASE WHEN size >= 30000 THEN 0 ELSE 1 END FROM f WHERE k = 1
  UNION ALL SELECT f.bkt_id, f.id, f.size, f.k, CASE WHEN p.total + f.size > 30000 OR p.n >= 5 OR f.size >= 30000 THEN NULL ELSE p.grp END, CASE WHEN p.total + f.size > 30000 OR p.n >= 5 OR f.size >= 30000 THEN NULL ELSE p.total END,
    CASE WHEN p.total + f.size > 30000 OR p.n >= 5 OR f.size >= 30000 THEN p.grp + CASE WHEN p.n > 0 THEN 1 ELSE 0 END ELSE p.grp END, CASE WHEN p.total + f.size > 30000 OR p.n >= 5 OR f.size >= 30000 THEN 0 ELSE p.total + f.size END, CASE WHEN p.total + f.size > 30000 OR p.n >= 5 OR f.size >= 30000 THEN 0 ELSE p.n + 1 END
  FROM p JOIN f ON f.bkt_id = p.bkt_id AND f.k = p.k + 1) SELECT bkt_id, id, size, package, off AS "offset" FROM p""")
def _(s):
    return packing.push_packages(_small(s), 30000, 5)


def _bucketed_holes(s):
    return _holes(s).select((F.col("pi") % 5).alias("bkt_id"), "pi", "start", F.col("size") * 4)


@query("o198_best_fit", "data", "obj")
def _(s):
    holes = _bucketed_holes(s).toDF("bkt_id", "pi", "start", "size")
    return packing.best_fit(holes, _small(s))


@query("o235_fill_plan", "data", "obj")
def _(s):
    holes = _bucketed_holes(s).toDF("bkt_id", "pi", "start", "size")
    moved = packing.best_fit(holes, _small(s)).select("id", F.col("pi").alias("new_pi"), F.col("po").alias("new_po"))
    return s.data.join(moved, "id").select("id", "os", "new_pi", "new_po")


@query("o197_defragment", "data", "obj", sql=f"""{_HOLES} SELECT pi, (SELECT count(*) FROM valid v WHERE v.pi = f.pi) AS valid, coalesce((SELECT sum(os) FROM valid v WHERE v.pi = f.pi), 0)::BIGINT AS kept,
  coalesce((SELECT sum(size) FROM holes h WHERE h.pi = f.pi), 0)::BIGINT AS reclaim, (SELECT count(*) FROM valid v WHERE v.pi = f.pi) = 0 AS drop FROM files f""")
def _(s):
    valid = packing.valid_blocks(s.data, s.obj).groupBy("pi").agg(F.count(F.lit(1)).alias("valid"), F.sum("os").cast("long").alias("kept"))
    empty = _holes(s).groupBy("pi").agg(F.sum("size").cast("long").alias("reclaim"))
    met = _files(s).select("pi").join(valid, "pi", "left").join(empty, "pi", "left")
    zero = F.lit(0).cast("long")
    return met.select("pi", F.coalesce("valid", zero).alias("valid"), F.coalesce("kept", zero).alias("kept"), F.coalesce("reclaim", zero).alias("reclaim"), (F.coalesce("valid", zero) == 0).alias("drop"))


_DELTAS = "(SELECT c_nationkey + 1 AS bkt_id, c_custkey % 7 * 1000 - 4000 AS u, c_custkey % 5 * 1000 - 3000 AS ru, c_custkey % 3 * 1000 - 900 AS lu, 10 AS ds FROM customer)"


def _deltas(s):
    k = F.col("c_custkey")
    return s.table("customer").select((F.col("c_nationkey") + 1).alias("bkt_id"), (k % 7 * 1000 - 4000).alias("u"), (k % 5 * 1000 - 3000).alias("ru"), (k % 3 * 1000 - 900).alias("lu"), F.lit(10).alias("ds"))


@query("o107_apply_usage", "bkt", sql=f"SELECT id, greatest(0, u + coalesce(du, 0))::BIGINT AS u, greatest(0, ru + coalesce(dr, 0))::BIGINT AS ru, greatest(0, lu + coalesce(dl, 0))::BIGINT AS lu, greatest(0, ds + coalesce(dd, 0))::BIGINT AS ds FROM bkt LEFT JOIN (SELECT bkt_id, sum(u) AS du, sum(ru) AS dr, sum(lu) AS dl, sum(ds) AS dd FROM {_DELTAS} GROUP BY bkt_id) ON bkt_id = id")
def _(s):
    return access.apply_usage(s.bkt, _deltas(s))


@query("o108_accumulate_deltas", sql=f"SELECT bkt_id::BIGINT AS bkt_id, sum(u)::BIGINT AS u, sum(ru)::BIGINT AS ru FROM {_DELTAS} GROUP BY bkt_id")
def _(s):
    return _deltas(s).groupBy(F.col("bkt_id").cast("long").alias("bkt_id")).agg(F.sum("u").cast("long").alias("u"), F.sum("ru").cast("long").alias("ru"))


@query("o109_current_usage", "bkt", sql=f"SELECT id, greatest(0, ru + coalesce(dr, 0))::BIGINT AS ru FROM bkt LEFT JOIN (SELECT bkt_id, sum(ru) AS dr FROM {_DELTAS} GROUP BY bkt_id) ON bkt_id = id")
def _(s):
    return access.apply_usage(s.bkt, _deltas(s)).select("id", "ru")


@query("o118_filesystem_stats", "bkt", sql="SELECT id, floor(CASE WHEN q >= 0 THEN q ELSE 1099511627776 END / 4096)::BIGINT AS blocks, greatest(0, floor((CASE WHEN q >= 0 THEN q ELSE 1099511627776 END - ru) / 4096))::BIGINT AS free, greatest(1, floor(lu / 1048576))::BIGINT AS files FROM bkt")
def _(s):
    return access.filesystem_stats(s.bkt)


@query("o204_scheduled_buckets", "bkt", sql="SELECT b.id, e.hours FROM bkt b, (SELECT count(DISTINCT date_trunc('hour', ts)) AS hours FROM events WHERE hour(ts) IN (2, 3)) e WHERE b.ru > 0 AND b.ru > b.lu AND (b.ru - b.lu) * 100.0 / b.ru >= 10")
def _(s):
    from ..functions import cron

    hours = s.table("events").where(cron.matches(F.col("ts"), "* 2-3 * * *")).agg(F.count_distinct(F.date_trunc("hour", "ts")).alias("hours"))
    return s.bkt.where(listing.fragmented(F.col("ru"), F.col("lu"), 10)).select("id").crossJoin(F.broadcast(hours))  # one row


@query("o236_delayed_delete_plan", "data", "obj", sql="SELECT id, os, 1600000000 + 5 AS due FROM data WHERE pi = 0 AND id NOT IN (SELECT did FROM obj WHERE pid >= 0)")
def _(s):
    gone = s.data.where("pi = 0").join(s.obj.where("pid >= 0").select(F.col("did").alias("id")), "id", "left_anti")
    return gone.select("id", "os", F.lit(1600000005).alias("due"))


@query("o202_stale_files", "chunk", sql="SELECT data_id, sn FROM chunk WHERE 1600000000 + data_id < 1600000000 + 90000 - 86400")
def _(s):
    from ..sources.files import stale_files

    return stale_files(s.chunk.withColumn("modified", F.lit(1_600_000_000) + F.col("data_id")), 1_600_090_000, 3600).select("data_id", "sn")
