"""Streaming jobs over the tables: each runs to the end of its input and returns what it emitted."""

from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from ..streaming import jobs
from . import query


def _drain(df, mode):
    """Run a streaming query over all input that there is, into a table in the shared folder, and read it:
    in mode *complete* each batch replaces the table, in mode *append* it adds to it."""
    path, spark, schema = shared_dir(df.sparkSession), df.sparkSession, df.schema
    write = "overwrite" if mode == "complete" else "append"

    def put(batch, _):
        batch.write.mode(write).parquet(f"{path}/rows")

    run = df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/rows")


def _events(s):
    schema = s.table("events").schema
    return s.spark.readStream.schema(schema).option("pathGlobFilter", "*").parquet(f"{s.dir}/[e]vents.parquet")


@query("o208_usage_stream", sql="SELECT user_id % 10 AS bkt_id, sum(event_id % 7)::BIGINT AS u, sum(event_id % 5)::BIGINT AS ru, sum(event_id % 3)::BIGINT AS lu, count(*) AS ds FROM events GROUP BY 1")
def _(s):
    k = F.col("event_id")
    deltas = _events(s).select((F.col("user_id") % 10).alias("bkt_id"), (k % 7).alias("u"), (k % 5).alias("ru"), (k % 3).alias("lu"), F.lit(1).cast("long").alias("ds"))
    return _drain(jobs.usage_totals(deltas), "complete")


@query("o216_retention_stream", sql="SELECT user_id AS pid, floor(epoch(date_trunc('day', ts)))::BIGINT AS day, arg_max(event_id, (ts, event_id)) AS id, count(*) AS versions FROM events WHERE event_type = 'purchase' GROUP BY 1, 2")
def _(s):
    versions = _events(s).where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.col("user_id").alias("pid"), F.lit(3).alias("t"), F.col("ts").cast("timestamp").alias("ts"))
    found = _drain(jobs.retained_versions(versions), "complete")
    return found.select("pid", F.unix_seconds("window.start").alias("day"), "id", "versions")


@query("o209_journal_thresholds", "journal", recursive=True, sql="""v AS (SELECT file_id, len, row_number() OVER (PARTITION BY file_id ORDER BY seq) AS k FROM journal),
  w(file_id, k, entries, bytes, due) AS (SELECT file_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::VARCHAR FROM (SELECT DISTINCT file_id FROM journal)
    UNION ALL SELECT v.file_id, v.k, CASE WHEN w.due IS NULL THEN w.entries ELSE 0 END + 1, CASE WHEN w.due IS NULL THEN w.bytes ELSE 0 END + v.len,
      CASE WHEN CASE WHEN w.due IS NULL THEN w.bytes ELSE 0 END + v.len > 900 THEN 'flush' WHEN CASE WHEN w.due IS NULL THEN w.entries ELSE 0 END + 1 > 40 THEN 'snapshot' END
    FROM w JOIN v ON v.file_id = w.file_id AND v.k = w.k + 1)
  SELECT file_id, entries, bytes, due FROM w WHERE due IS NOT NULL""")
def _(s):
    writes = _events(s).select(F.col("user_id").alias("file_id"), F.col("event_id").alias("seq"), (1 + F.col("event_id") % 50).alias("len"))
    return _drain(jobs.journal_thresholds(writes, 40, 900, idle_ms=None), "append")


@query("o206_admission", sql="SELECT doc_id AS id, strlen(text) > 3500 AS direct FROM documents")
def _(s):
    puts = s.table("documents").select(F.col("doc_id").alias("id"), F.octet_length("text").alias("size"))
    small, large = jobs.admit(puts, 10000)
    return small.select("id", F.lit(False).alias("direct")).unionByName(large.select("id", F.lit(True).alias("direct")))


@query("o205_batch_writer", sql="SELECT event_id AS id, strlen(props)::BIGINT AS size FROM events")
def _(s):
    path = shared_dir(s.spark)

    def flush(batch, number):  # a batch that is tried again replaces its own folder
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    puts = _events(s).select(F.col("event_id").alias("id"), F.octet_length("props").cast("long").alias("size"))
    jobs.buffered_writes(puts, flush, None, f"{path}/state").awaitTermination()
    return s.spark.read.schema(puts.schema).parquet(f"{path}/rows").select("id", "size")
