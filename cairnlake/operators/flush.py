"""Files under journals: chunks built from base and writes, reads through the overlay, flushes, pending puts
(O-27, O-31, O-54, O-61, O-185, O-187, O-192, O-205, O-207, O-210 to O-212, O-245, O-246, O-256).

Bytes are laid over each other by the built-in ``overlay``, a chunk at a time, so a file is never one row
before a caller asks for whole files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grown_sizes(base: DataFrame, writes: DataFrame) -> DataFrame:
    """(file_id, size) of all files with writes (file_id, off, body): the base's size (file_id, size) or the
    end of the last write, whichever is larger."""
    ends = writes.groupBy("file_id").agg(F.max(F.col("off") + F.octet_length("body")).alias("top"))
    met = ends.join(base.select("file_id", F.col("size").alias("was")), "file_id", "left")
    return met.select("file_id", F.greatest("top", F.coalesce("was", F.lit(0))).cast("long").alias("size"))


def generate_chunks(wanted: DataFrame, base: DataFrame, writes: DataFrame, chunk: int) -> DataFrame:
    """(file_id, sn, bytes) of the wanted chunks (file_id, sn, size of the file): base chunks
    (file_id, sn, bytes), zeros where there is none, and the writes (file_id, seq, off, body) over them by seq."""
    end = F.col("off") + F.octet_length("body")
    parts = writes.where(F.octet_length("body") > 0).withColumn("sn", F.explode(F.sequence(F.floor(F.col("off") / chunk), F.floor((end - 1) / chunk))))
    start = F.greatest(F.col("off"), F.col("sn") * chunk)
    body = F.substring(F.col("body"), (start - F.col("off") + 1).cast("int"), F.least(end - start, F.lit(chunk)).cast("int"))
    body = F.substring(body, F.lit(1), F.least(end - start, (F.col("sn") + 1) * chunk - start).cast("int"))
    cut = parts.select("file_id", "sn", "seq", (start - F.col("sn") * chunk).cast("int").alias("at"), body.alias("body"))
    ordered = cut.join(wanted.select("file_id", "sn"), ["file_id", "sn"], "left_semi").groupBy("file_id", "sn").agg(F.array_sort(F.collect_list(F.struct("seq", "at", "body"))).alias("over"))
    met = wanted.join(base.select("file_id", "sn", "bytes"), ["file_id", "sn"], "left").join(ordered, ["file_id", "sn"], "left")
    size = F.least(F.lit(chunk), F.col("size") - F.col("sn") * chunk).cast("int")
    held = F.rpad(F.coalesce("bytes", F.unhex(F.lit(""))), size, F.unhex(F.lit("00")))
    laid = F.aggregate(F.coalesce("over", F.slice("over", 1, 0)), held, lambda a, w: F.overlay(a, w["body"], w["at"] + 1, F.octet_length(w["body"])))
    return met.select("file_id", "sn", F.when(F.col("over").isNull(), held).otherwise(laid).alias("bytes"))


def all_chunks(sizes: DataFrame, chunk: int) -> DataFrame:
    """(file_id, sn, size) of all chunks of files (file_id, size)."""
    last = F.ceil(F.col("size") / chunk).cast("long") - 1
    return sizes.where("size > 0").select("file_id", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("sn"), "size")


def rewrite_small_files(base: DataFrame, writes: DataFrame, chunk: int, limit: int) -> DataFrame:
    """(file_id, bytes) of files with writes whose size stays at or below ``limit``: rewritten whole."""
    sizes = grown_sizes(base.groupBy("file_id").agg(F.sum(F.octet_length("bytes")).alias("size")), writes).where(F.col("size") <= limit)
    chunks = generate_chunks(all_chunks(sizes, chunk), base, writes.join(sizes.select("file_id"), "file_id", "left_semi"), chunk)
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("sn", "bytes"))), F.unhex(F.lit("")), lambda a, p: F.concat(a, p["bytes"]))
    return chunks.groupBy("file_id").agg(joined.alias("bytes"))


def read_ranges(reads: DataFrame, sizes: DataFrame, base: DataFrame, writes: DataFrame, chunk: int) -> DataFrame:
    """(read_id, bytes) of reads (read_id, file_id, off, len) through the overlay, clipped to the file's size
    (file_id, size).  Only chunks under a read are built, each once."""
    clipped = reads.join(sizes, "file_id").select("read_id", "file_id", "size", F.col("off").alias("a"), F.least("size", F.col("off") + F.col("len")).alias("b")).where("a < b")
    asked = clipped.withColumn("sn", F.explode(F.sequence(F.floor(F.col("a") / chunk), F.floor((F.col("b") - 1) / chunk))))
    chunks = generate_chunks(asked.select("file_id", "sn", "size").distinct(), base, writes, chunk)
    start = F.greatest(F.col("a") - F.col("sn") * chunk, F.lit(0)).cast("int")
    stop = F.least(F.col("b") - F.col("sn") * chunk, F.lit(chunk)).cast("int")
    parts = asked.join(chunks, ["file_id", "sn"]).select("read_id", "sn", F.substring(F.col("bytes"), start + 1, stop - start).alias("part"))
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("sn", "part"))), F.unhex(F.lit("")), lambda a, p: F.concat(a, p["part"]))
    return parts.groupBy("read_id").agg(joined.alias("bytes"))


def full_flush(journals: DataFrame, max_entries: int, max_snapshots: int) -> DataFrame:
    """Adds ``full``: whether a journal (entries, snapshots) is due for a full flush."""
    return journals.withColumn("full", (F.col("entries") >= max_entries) | (F.col("snapshots") >= max_snapshots))


def snapshot_objects(journals: DataFrame, version: DataFrame) -> DataFrame:
    """A version row of type 4 for each journal (file_id, entries, size, did): below its file, on the newest
    full version before it (0 if none), as large as the file is after the writes."""
    newest = version.where("t = 3").groupBy(F.col("pid").alias("file_id")).agg(F.max_by(F.struct(F.col("id").alias("base"), F.col("s").alias("held")), F.struct("m", "id")).alias("v"))
    met = journals.join(newest, "file_id", "left")
    return met.select(F.col("file_id").alias("pid"), "did", F.lit(4).alias("t"), F.greatest("size", F.coalesce("v.held", F.lit(0))).cast("long").alias("s"), F.coalesce("v.base", F.lit(0)).cast("long").alias("base"), "entries")


def inactive(journals: DataFrame, now: int, idle: int, memory: int) -> DataFrame:
    """Journals (file_id, entries, bytes, modified) to drop: empty ones idle for ``idle`` seconds, others
    idle twice as long that hold more than ``memory`` bytes."""
    quiet = F.lit(now) - F.col("modified")
    return journals.where(((F.col("entries") == 0) & (quiet >= idle)) | ((F.col("entries") > 0) & (quiet >= 2 * idle) & (F.col("bytes") > memory)))


def pending_bytes(pending: DataFrame) -> DataFrame:
    """(id, bytes) read back from write buffers: the pending puts (buffer, id, bytes) lie in their buffer one
    behind the other by id, and each is cut out at its offset."""
    before = Window.partitionBy("buffer").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    placed = pending.select("buffer", "id", F.octet_length("bytes").alias("size"), F.coalesce(F.sum(F.octet_length("bytes")).over(before), F.lit(0)).cast("int").alias("at"))
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("id", "bytes"))), F.unhex(F.lit("")), lambda a, p: F.concat(a, p["bytes"]))
    buffers = pending.groupBy("buffer").agg(joined.alias("held"))
    return placed.join(buffers, "buffer").select("id", F.substring(F.col("held"), F.col("at") + 1, F.col("size")).alias("bytes"))


def flush_times(puts: DataFrame, window: int) -> DataFrame:
    """(flush, rows, bytes) of puts (ts in seconds, size): a put waits for the next end of a window, and a
    window without puts flushes nothing."""
    flush = (F.floor(F.col("ts") / window) + 1) * window
    return puts.groupBy(flush.cast("long").alias("flush")).agg(F.count(F.lit(1)).alias("rows"), F.sum("size").cast("long").alias("bytes"))


def scheduled_deletions(requests: DataFrame) -> DataFrame:
    """(key, deadline): deletions that stand after all requests (key, ts, id, action, wait); a later request
    for the key replaces one, a later *cancel* ends it."""
    last = requests.groupBy("key").agg(F.max_by(F.struct("action", (F.col("ts") + F.col("wait")).alias("deadline")), F.struct("ts", "id")).alias("last"))
    return last.where("last.action = 'delete'").select("key", "last.deadline")


def sweep(scheduled: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Deletions whose deadline is past, and those that still wait."""
    return scheduled.where(F.col("deadline") < now), scheduled.where(F.col("deadline") >= now)


def create_exclusive(chunks: DataFrame, batch: DataFrame) -> DataFrame:
    """(seq, written) of a batch (seq, data_id, sn): a chunk is written unless it exists or an earlier row of
    the batch has written it."""
    first = batch.groupBy("data_id", "sn").agg(F.min("seq").alias("first"))
    held = chunks.select("data_id", "sn").distinct().withColumn("held", F.lit(True))
    met = batch.join(first, ["data_id", "sn"]).join(held, ["data_id", "sn"], "left")
    return met.select("seq", (F.col("held").isNull() & (F.col("seq") == F.col("first"))).alias("written"))


def upload_batches(listing: DataFrame, size: int) -> DataFrame:
    """(id, kind, batch) of a tree's listing (id, parent, bytes, is_dir): directories, files and empty files
    apart, each parent's entries of a kind in batches of ``size`` by id."""
    kind = F.when(F.col("is_dir"), "dir").when(F.col("bytes") == 0, "empty").otherwise("file")
    nth = F.row_number().over(Window.partitionBy("parent", "kind").orderBy("id")) - 1
    return listing.withColumn("kind", kind).select("id", "parent", "kind", F.floor(nth / size).cast("long").alias("batch"))


def download_plan(below: DataFrame, size: int) -> DataFrame:
    """(id, path, page) of files below a node (id, parent, path): the pages in which a listing by id reads
    each directory."""
    nth = F.row_number().over(Window.partitionBy("parent").orderBy("id")) - 1
    return below.select("id", "path", F.floor(nth / size).cast("long").alias("page"))


def journal_route(writes: DataFrame) -> DataFrame:
    """Adds ``journal``: whether a write (off, did, size of its file, has_journal, temporary, chunked) goes to
    the file's journal: not in temporary files, beside a chunked writer or in files without data; else when it
    is no write at the start, or the file has a journal, or it appends."""
    plain = ~F.col("temporary") & ~F.col("chunked") & (F.col("did") > 0)
    return writes.withColumn("journal", plain & ((F.col("off") != 0) | F.col("has_journal") | ((F.col("off") == F.col("size")) & (F.col("size") > 0))))


def oldest_writes(writes: DataFrame, many: int) -> DataFrame:
    """The first writes of each file by seq: one batch of a merge in batches."""
    nth = F.row_number().over(Window.partitionBy("file_id").orderBy("seq"))
    return writes.withColumn("nth", nth).where(F.col("nth") <= many).drop("nth")
