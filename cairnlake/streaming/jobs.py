"""Streaming jobs (O-205 to O-213, O-216): micro-batches in place of flush timers, keyed state in place of
in-memory tables.  All run on any streaming source with the stated columns; state lives in the
query's checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_table(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A Parquet folder as a stream; the batch size takes the place of a rate limiter."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def buffered_writes(stream: DataFrame, flush: Callable[[DataFrame, int], None], every: str | None, checkpoint: str):
    """The batch writer: every trigger flushes what came, through ``flush(batch, number)``.  Without a time it
    flushes what there is, and ends."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.trigger(**trigger).option("checkpointLocation", checkpoint).foreachBatch(flush).start()


def admit(puts: DataFrame, buffer_bytes: int, share: float = 0.35) -> tuple[DataFrame, DataFrame]:
    """Puts that go through the buffer, and those too large for it."""
    large = F.col("size") > int(buffer_bytes * share)
    return puts.where(~large), puts.where(large)


def usage_totals(deltas: DataFrame) -> DataFrame:
    """Running counters by bucket; for output mode *update* or *complete*."""
    return deltas.groupBy("bkt_id").agg(*[F.sum(c).alias(c) for c in ("u", "ru", "lu", "ds")])


def retained_versions(versions: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """The newest full version of each file and tumbling window of event time ``ts``; a window closes when
    the watermark passes it."""
    newest = F.max_by(F.col("id"), F.struct("ts", "id"))
    return versions.where("t = 3").withWatermark("ts", late).groupBy("pid", F.window("ts", width)).agg(newest.alias("id"), F.count(F.lit(1)).alias("versions"))


def journal_thresholds(writes: DataFrame, max_entries: int, max_bytes: int, idle_ms: int | None = 30_000) -> DataFrame:
    """Emits (file_id, entries, bytes, due) whenever a journal passes a threshold or has been idle; what
    is due empties it.  Input: file_id, seq, len; within a micro-batch writes count in the order of seq.  Without ``idle_ms`` there is no timeout, so that a run over
    what is available ends."""
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entries, size = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], entries, size, "idle")], columns=["file_id", "entries", "bytes", "due"])
            return
        out = []
        for n in pd.concat(list(parts)).sort_values("seq")["len"]:
            entries, size = entries + 1, size + int(n)
            due = "flush" if size > max_bytes else "snapshot" if entries > max_entries else None
            if due:
                out.append((key[0], entries, size, due))
                entries, size = 0, 0
        state.update((entries, size))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["file_id", "entries", "bytes", "due"])

    return writes.select("file_id", "seq", "len").groupBy("file_id").applyInPandasWithState(step, "file_id long, entries long, bytes long, due string", "entries long, bytes long", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def pending_deletions(requests: DataFrame) -> DataFrame:
    """Deletions with a deadline that a later request can cancel: input key, ts (event time), action
    (*delete* or *cancel*), deadline_s.  Emits (key, due) once the watermark passes the deadline; the
    caller sets the watermark on ts."""
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (due,) = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "due": [due]})
            return
        rows = pd.concat(list(parts)).sort_values("ts")
        for ts, action, wait in rows[["ts", "action", "deadline_s"]].itertuples(index=False, name=None):
            if action == "cancel":
                if state.exists:
                    state.remove()
            else:
                due = int(ts.timestamp()) + int(wait)
                state.update((due,))
        if state.exists:
            (due,) = state.get
            state.setTimeoutTimestamp(max(due * 1000, state.getCurrentWatermarkMs() + 1))

    return requests.groupBy("key").applyInPandasWithState(step, "key string, due long", "due long", "append", GroupStateTimeout.EventTimeTimeout)
