"""Files under journals, flushes, pending puts, trees to and from disk."""

from pyspark.sql import functions as F

from ..catalog import CONTENT_CHUNK, FILES
from ..functions import cron, payload, secrets
from ..operators import flush, hierarchy, intervals
from ..sources.shared import materialise, spread
from . import query
from .payload import _writes

_C = CONTENT_CHUNK
#: The byte that each place of a file with writes has: the last write's, else the base's, else zero.
_OVER = """w AS (SELECT file_id, p, arg_max(seq % 10, seq) AS c FROM (SELECT file_id, seq, unnest(range(off, off + len)) AS p FROM journal {only}) GROUP BY ALL),
  b AS (SELECT id AS file_id, unnest(range(0, octet_length(bytes))) AS p, unnest(regexp_extract_all(hex(bytes), '..')) AS x FROM text WHERE id IN (SELECT file_id FROM journal)),
  z AS (SELECT file_id, max(off + len) AS top FROM journal {only} GROUP BY file_id),
  f AS (SELECT file_id, greatest(top, coalesce(octet_length(t.bytes), 0))::BIGINT AS size FROM z LEFT JOIN text t ON t.id = file_id),
  a AS (SELECT file_id, size, unnest(range(0, size)) AS p FROM f),
  m AS (SELECT a.file_id, a.size, a.p, CASE WHEN c IS NOT NULL THEN '3' || c ELSE coalesce(x, '00') END AS x FROM a LEFT JOIN w ON w.file_id = a.file_id AND w.p = a.p LEFT JOIN b ON b.file_id = a.file_id AND b.p = a.p)"""


def _base(s):
    """Base chunks of the files that have journals: the document of the same number."""
    return s.content.select(F.col("data_id").alias("file_id"), F.col("sn").cast("long").alias("sn"), "bytes").join(s.journal.select("file_id").distinct(), "file_id", "left_semi")


def _sizes(s, writes):
    return flush.grown_sizes(s.text.select(F.col("id").alias("file_id"), F.octet_length("bytes").alias("size")), writes)


def _sum():
    return F.md5("bytes").alias("sum")


@query("o245_generate_chunks", "journal", "text", sql=f"{_OVER.format(only='')} SELECT file_id, p // {_C} AS sn, md5(unhex(string_agg(x, '' ORDER BY p))) AS sum FROM m GROUP BY ALL")
def _(s):
    writes = _writes(s)
    return flush.generate_chunks(flush.all_chunks(_sizes(s, writes), _C), _base(s), writes, _C).select("file_id", "sn", _sum())


@query("o192_merge_by_chunk", "journal", "text", sql=f"""{_OVER.format(only='WHERE seq % 2 = 0')}, t AS (SELECT DISTINCT file_id, p // {_C} AS sn FROM w)
  SELECT file_id, p // {_C} AS sn, md5(unhex(string_agg(x, '' ORDER BY p))) AS sum FROM m WHERE (file_id, p // {_C}) IN (SELECT (file_id, sn) FROM t) GROUP BY ALL""")
def _(s):
    merged = _writes(s).where("seq % 2 = 0")
    touched = intervals.modified_chunks(s.journal.where("seq % 2 = 0"), _C).select("file_id", F.col("sn").cast("long").alias("sn"))
    return flush.generate_chunks(touched.join(_sizes(s, merged), "file_id"), _base(s), merged, _C).select("file_id", "sn", _sum())


@query("o246_small_file_flush", "journal", "text", sql=f"{_OVER.format(only='')} SELECT file_id, size, md5(unhex(string_agg(x, '' ORDER BY p))) AS sum FROM m WHERE size <= 9990 GROUP BY ALL")
def _(s):
    return flush.rewrite_small_files(_base(s), _writes(s), _C, 9990).select("file_id", F.octet_length("bytes").cast("long").alias("size"), _sum())


@query("o031_path_reader", "journal", "text", "path", sql=f"""{_OVER.format(only='')}, r AS (SELECT seq AS read_id, path.path, file_id, unnest(range(greatest(0, off - 100), greatest(0, off - 100) + 300)) AS p FROM journal JOIN path ON path.id = file_id + {FILES} WHERE pid >= 0)
  SELECT read_id, r.path, md5(unhex(string_agg(x, '' ORDER BY r.p))) AS sum FROM r JOIN m ON m.file_id = r.file_id AND m.p = r.p GROUP BY ALL""")
def _(s):
    live = s.path.where("pid >= 0").select((F.col("id") - FILES).alias("file_id"), "path")
    asked = s.journal.select(F.col("seq").alias("read_id"), "file_id", F.greatest(F.lit(0), F.col("off") - 100).alias("off"), F.lit(300).cast("long").alias("len")).join(live, "file_id")
    writes = _writes(s)
    got = flush.read_ranges(asked.drop("path"), _sizes(s, writes), _base(s), writes, _C)
    return got.join(asked.select("read_id", "path"), "read_id").select("read_id", "path", _sum())


_STATE = "SELECT file_id, count(*) AS entries, (SELECT count(*) FROM version v WHERE v.t = 4 AND v.pid = file_id) AS snapshots FROM journal GROUP BY file_id"


@query("o187_full_flush", "journal", "version", sql=f"SELECT *, entries >= 12 OR snapshots >= 4 AS \"full\" FROM ({_STATE})")
def _(s):
    entries = s.journal.groupBy("file_id").agg(F.count(F.lit(1)).alias("entries"))
    snapshots = s.version.where("t = 4").groupBy(F.col("pid").alias("file_id")).agg(F.count(F.lit(1)).alias("n"))
    met = entries.join(snapshots, "file_id", "left").select("file_id", "entries", F.coalesce("n", F.lit(0)).cast("long").alias("snapshots"))
    return flush.full_flush(met, 12, 4)


@query("o185_journal_snapshot", "journal", "version", sql="""j AS (SELECT file_id, count(*) AS entries, max(off + len) AS size, max(seq) AS did FROM journal GROUP BY file_id HAVING count(*) > 5)
  SELECT file_id AS pid, did, 4 AS t, greatest(size, coalesce((SELECT arg_max(s, (m, id)) FROM version v WHERE t = 3 AND v.pid = file_id), 0))::BIGINT AS s,
         coalesce((SELECT arg_max(id, (m, id)) FROM version v WHERE t = 3 AND v.pid = file_id), 0)::BIGINT AS base, entries FROM j""")
def _(s):
    due = s.journal.groupBy("file_id").agg(F.count(F.lit(1)).alias("entries"), F.max(F.col("off") + F.col("len")).alias("size"), F.max("seq").alias("did")).where("entries > 5")
    return flush.snapshot_objects(due, s.version)


@query("o210_inactive_journals", "version", "journal", sql="""f AS (SELECT pid AS file_id, max(m) AS modified FROM version GROUP BY pid), j AS (SELECT file_id, count(*) AS entries, sum(len)::BIGINT AS bytes FROM journal WHERE seq % 3 = 0 GROUP BY file_id),
  n AS (SELECT max(m) - 86400 AS now FROM version), g AS (SELECT f.file_id, coalesce(entries, 0)::BIGINT AS entries, coalesce(bytes, 0)::BIGINT AS bytes, modified FROM f LEFT JOIN j USING (file_id))
  SELECT file_id, entries, bytes FROM g, n WHERE (entries = 0 AND now - modified >= 900) OR (entries > 0 AND now - modified >= 1800 AND bytes > 60)""")
def _(s):
    modified = s.version.groupBy(F.col("pid").alias("file_id")).agg(F.max("m").alias("modified"))
    held = s.journal.where("seq % 3 = 0").groupBy("file_id").agg(F.count(F.lit(1)).alias("entries"), F.sum("len").cast("long").alias("bytes"))
    now = modified.agg(F.max("modified")).first()[0]
    zero = F.lit(0).cast("long")
    met = modified.join(held, "file_id", "left").select("file_id", F.coalesce("entries", zero).alias("entries"), F.coalesce("bytes", zero).alias("bytes"), "modified")
    return flush.inactive(met, (now or 0) - 86400, 900, 60).select("file_id", "entries", "bytes")


@query("o256_pending_bytes", "text", sql="SELECT id, md5(bytes) AS sum FROM text")
def _(s):
    return flush.pending_bytes(s.text.select(F.floor(F.col("id") / 20).alias("buffer"), "id", "bytes")).select("id", _sum())


def _puts(s):
    return s.table("events").select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.octet_length("props").alias("size"))


@query("o207_flush_times", sql="SELECT (floor(epoch(ts))::BIGINT // 600 + 1) * 600 AS flush, count(*) AS rows, sum(strlen(props))::BIGINT AS bytes FROM events GROUP BY 1")
def _(s):
    return flush.flush_times(_puts(s), 600)


_REQUESTS = "r AS (SELECT user_id AS key, floor(epoch(ts))::BIGINT AS ts, event_id AS id, CASE WHEN event_type = 'error' THEN 'cancel' ELSE 'delete' END AS action, event_id % 7 * 3600 AS wait FROM events), l AS (SELECT key, arg_max(action, (ts, id)) AS action, arg_max(ts + wait, (ts, id)) AS deadline FROM r GROUP BY key), d AS (SELECT key, deadline FROM l WHERE action = 'delete')"


def _requests(s):
    k = F.col("event_id")
    return s.table("events").select(F.col("user_id").alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), k.alias("id"), F.when(F.col("event_type") == "error", "cancel").otherwise("delete").alias("action"), (k % 7 * 3600).alias("wait"))


@query("o211_scheduled_deletions", sql=f"WITH {_REQUESTS} SELECT * FROM d")
def _(s):
    return flush.scheduled_deletions(_requests(s))


@query("o212_deadline_sweep", sql=f"WITH {_REQUESTS} SELECT key, deadline, deadline < (SELECT max(ts) FROM r) AS due FROM d")
def _(s):
    now = _requests(s).agg(F.max("ts")).first()[0] or 0
    due, waiting = flush.sweep(flush.scheduled_deletions(_requests(s)), now)
    return due.withColumn("due", F.lit(True)).unionByName(waiting.withColumn("due", F.lit(False)))


@query("o054_create_exclusive", "chunk", sql="""c AS (SELECT data_id, sn FROM chunk WHERE data_id % 3 = 0), b AS (SELECT l_orderkey * 100 + l_linenumber * 10 + g AS seq, l_orderkey AS data_id, l_linenumber - 1 AS sn FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), (SELECT unnest([0, 1]) AS g))
  SELECT seq, (data_id, sn) NOT IN (SELECT (data_id, sn) FROM c) AND seq = min(seq) OVER (PARTITION BY data_id, sn) AS written FROM b""")
def _(s):
    twice = F.explode(F.array(F.lit(0), F.lit(1)))
    rows = s.chunk.select("data_id", "sn", twice.alias("g"))
    batch = rows.select((F.col("data_id") * 100 + (F.col("sn") + 1) * 10 + F.col("g")).alias("seq"), "data_id", "sn")
    return flush.create_exclusive(s.chunk.where("data_id % 3 = 0"), batch)


@query("o027_local_tree", "tree", sql="SELECT id, pid AS parent, kind, (row_number() OVER (PARTITION BY pid, kind ORDER BY id) - 1) // 50 AS batch FROM (SELECT id, pid, CASE WHEN id < 20000000000 THEN 'dir' WHEN s < 10 THEN 'empty' ELSE 'file' END AS kind FROM tree)")
def _(s):
    listing = s.tree.select("id", F.col("pid").alias("parent"), F.when(F.col("s") < 10, 0).otherwise(F.col("s")).alias("bytes"), (F.col("id") < 20000000000).alias("is_dir"))
    return flush.upload_batches(listing, 50)


@query("o061_download_tree", "tree", recursive=True, sql="""paths(id, pid, path) AS (SELECT id, pid, n FROM tree WHERE pid = 0 AND n = 'ASIA' UNION ALL SELECT t.id, t.pid, p.path || '/' || t.n FROM paths p JOIN tree t ON t.pid = p.id)
  SELECT id, path, (row_number() OVER (PARTITION BY pid ORDER BY id) - 1) // 3 AS page FROM paths WHERE pid > 0""")
def _(s):
    below = hierarchy.paths(s.tree, below="ASIA").join(s.tree.select("id", F.col("pid").alias("parent")), "id")
    return flush.download_plan(below, 3)


#: Schedules, and the values that each field stands for.
_SCHEDULES = ("* * * * *", "0 3 * * 0", "5,10-12,10 0-2 1,31 1-3 1-5")


@query("o076_cron_parse", sql="""SELECT 0 AS schedule, field, value FROM (VALUES ('minute', 0, 59), ('hour', 0, 23), ('day', 1, 31), ('month', 1, 12), ('weekday', 0, 6)) v(field, a, b), LATERAL (SELECT unnest(range(a, b + 1))::INT AS value)
  UNION ALL SELECT 1, field, value FROM (VALUES ('minute', 0, 0), ('hour', 3, 3), ('day', 1, 31), ('month', 1, 12), ('weekday', 0, 0)) v(field, a, b), LATERAL (SELECT unnest(range(a, b + 1))::INT AS value)
  UNION ALL SELECT 2, field, unnest(list)::INT FROM (VALUES ('minute', [5, 10, 11, 12]), ('hour', [0, 1, 2]), ('day', [1, 31]), ('month', [1, 2, 3]), ('weekday', [1, 2, 3, 4, 5])) v(field, list)""")
def _(s):
    names = ("minute", "hour", "day", "month", "weekday")
    rows = [(i, name, value) for i, text in enumerate(_SCHEDULES) for name, values in zip(names, cron.parse(text)) for value in values]
    return s.spark.createDataFrame(rows, "schedule int, field string, value int")


_KINDS = (payload.ZSTD, payload.GZIP, payload.SNAPPY, payload.BROTLI)


def _stored(s):
    """Every document, under one codec each and, every other one, encrypted."""
    key = bytes(range(32))
    out = None
    for i, codec in enumerate(_KINDS):
        part = s.text.where(F.col("id") % 8 == i).select("id", payload.process(F.col("bytes"), codec).alias("p"))
        part = part.unionByName(s.text.where(F.col("id") % 8 == i + 4).select("id", payload.process(F.col("bytes"), codec, key).alias("p")))
        out = part if out is None else out.unionByName(part)
    return out.select("id", "p.bytes", "p.kind"), key


@query("o161_unprocess", "text", sql="SELECT id, md5(bytes) AS sum FROM text")
def _(s):
    stored, key = _stored(s)
    return stored.select("id", F.md5(payload.unprocess_any(F.col("bytes"), F.col("kind"), _KINDS, key)).alias("sum"))


@query("o255_download", "text", "path", sql=f"SELECT id, path, octet_length(t.bytes)::BIGINT AS size, md5(t.bytes) AS sum FROM (SELECT id - {FILES} AS id, path FROM path WHERE pid >= 0) JOIN text t USING (id)")
def _(s):
    stored, key = _stored(s)
    stored = materialise(stored)  # read for its chunks and for its kinds
    last = F.greatest(F.ceil(F.octet_length("bytes") / _C) - 1, F.lit(0)).cast("int")
    cut = stored.select("id", "kind", "bytes", F.explode(F.sequence(F.lit(0), last)).alias("sn"))
    chunks = cut.select(F.col("id").alias("data_id"), "sn", F.substring(F.col("bytes"), F.col("sn") * _C + 1, F.lit(_C)).alias("bytes"))
    read = payload.assemble(chunks).select(F.col("data_id").alias("id"), "bytes").join(stored.select("id", "kind"), "id")
    body = payload.unprocess_any(F.col("bytes"), F.col("kind"), _KINDS, key)
    files = read.select("id", body.alias("bytes")).join(s.path.where("pid >= 0").select((F.col("id") - FILES).alias("id"), "path"), "id")
    return files.select("id", "path", F.octet_length("bytes").cast("long").alias("size"), _sum())


@query("o156_xxh3_vectors", sql="SELECT * FROM (VALUES ('', 3244421341483603138), ('a', -1817709641818812897), ('abc', 8696274497037089104)) v(content, x)")
def _(s):
    rows = s.spark.createDataFrame([("",), ("a",), ("abc",)], "content string")
    return rows.select("content", payload.xxh3(F.encode("content", "UTF-8")).alias("x"))


@query("o193_merge_in_batches", "journal", "text", sql=f"{_OVER.format(only='WHERE seq IN (SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY file_id ORDER BY seq) AS k FROM journal) WHERE k <= 5)')} SELECT file_id, p // {_C} AS sn, md5(unhex(string_agg(x, '' ORDER BY p))) AS sum FROM m GROUP BY ALL")
def _(s):
    writes = flush.oldest_writes(_writes(s), 5)
    return flush.generate_chunks(flush.all_chunks(_sizes(s, writes), _C), _base(s), writes, _C).select("file_id", "sn", _sum())


@query("o247_wal_append", "journal", sql="SELECT file_id, seq, seq % 17 != 0 AS valid FROM journal")
def _(s):
    kept = _writes(s).withColumn("sum", payload.xxh3(F.col("body")))
    read = kept.withColumn("body", F.when(F.col("seq") % 17 == 0, F.concat("body", F.unhex(F.lit("00")))).otherwise(F.col("body")))
    return read.select("file_id", "seq", (payload.xxh3(F.col("body")) == F.col("sum")).alias("valid"))


@query("o248_wal_snapshot", "journal", sql="SELECT file_id, count(*) AS entries, max(off + len) AS size, (16 + sum(16 + len))::BIGINT AS bytes FROM journal GROUP BY file_id")
def _(s):
    packed = payload.pack_journals(_writes(s)).select("file_id", F.octet_length("raw").cast("long").alias("bytes"))
    sums = s.journal.groupBy("file_id").agg(F.count(F.lit(1)).alias("entries"), F.max(F.col("off") + F.col("len")).alias("size"))
    return sums.join(packed, "file_id")


@query("o194_wal_recovery", "journal", sql="SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY seq) - 1 AS nth, off, len, md5(repeat((seq % 10)::VARCHAR, len::INT)) AS sum FROM journal WHERE seq <= (SELECT max(seq) // 2 FROM journal)")
def _(s):
    half = s.journal.agg(F.expr("max(seq) div 2")).first()[0] or 0
    snapshot = payload.pack_journals(_writes(s).where(F.col("seq") <= half))  # later entries are in no snapshot
    return payload.unpack_journals(snapshot).select("file_id", "nth", "off", "len", F.md5("body").alias("sum"))


@query("o254_journal_route", "journal", "data", sql="""SELECT seq, coalesce(seq % 11 != 0 AND seq % 13 != 0 AND d.id > 0 AND (j.o != 0 OR seq % 2 = 0 OR (j.o = d.s AND d.s > 0)), false) AS journal
  FROM (SELECT seq, file_id, CASE WHEN seq % 3 = 0 THEN 0 ELSE off END AS o FROM journal) j LEFT JOIN data d ON d.id = file_id""")
def _(s):
    k = F.col("seq")
    files = s.data.select(F.col("id").alias("file_id"), F.col("id").alias("did"), F.col("s").alias("size"))
    rows = s.journal.select("seq", "file_id", F.when(k % 3 == 0, 0).otherwise(F.col("off")).alias("off"), (k % 2 == 0).alias("has_journal"), (k % 11 == 0).alias("temporary"), (k % 13 == 0).alias("chunked"))
    met = flush.journal_route(rows.join(files, "file_id", "left").withColumn("did", F.coalesce("did", F.lit(0))))
    return met.select("seq", F.coalesce("journal", F.lit(False)).alias("journal"))


_KEY = bytes(range(32))


@query("o163_encrypt", "text", sql="SELECT id, octet_length(bytes) + 28 AS size, md5(bytes) AS sum FROM text")
def _(s):
    kept = s.text.select("id", F.aes_encrypt("bytes", F.lit(_KEY)).alias("bytes"))
    return kept.select("id", F.octet_length("bytes").cast("long").alias("size"), F.md5(F.aes_decrypt("bytes", F.lit(_KEY))).alias("sum"))


@query("o164_encrypt_names", "obj", sql="SELECT id, 2 * (strlen(n) + 28) AS size, n FROM obj")
def _(s):
    kept = s.obj.select("id", secrets.encrypt_name(F.col("n"), _KEY).alias("kept"))
    return kept.select("id", F.length("kept").cast("long").alias("size"), secrets.decrypt_name(F.col("kept"), _KEY).alias("n"))


@query("o165_decrypt_names", "obj", sql="SELECT id, n FROM obj")
def _(s):
    kept = s.obj.select("id", F.when(F.col("id") % 2 == 0, secrets.encrypt_name(F.col("n"), _KEY)).otherwise(F.col("n")).alias("kept"))
    return kept.select("id", secrets.decrypt_name(F.col("kept"), _KEY).alias("n"))


@query("o171_passwords", "usr", sql="SELECT id, true AS fits, false AS other FROM usr")
def _(s):
    salt = F.unhex(F.md5(F.encode("usr", "UTF-8")))
    kept = spread(s.usr.select("id", "usr"), "id").select("id", "usr", secrets.hash_password(F.col("usr"), salt, 1000 + F.col("id") % 50).alias("kept"))
    return kept.select("id", secrets.verify_password(F.col("usr"), F.col("kept")).alias("fits"), secrets.verify_password(F.concat("usr", F.lit("x")), F.col("kept")).alias("other"))


#: Published vectors of PBKDF2 with HMAC-SHA1, the first 16 bytes.
@query("o171_vectors", sql="SELECT * FROM (VALUES (1, '0c60c80f961f0e71f3a9b524af601206'), (4096, '4b007901b765489abead49d926f721d0')) v(rounds, hash)")
def _(s):
    rows = s.spark.createDataFrame([(1,), (4096,)], "rounds int")
    return rows.select("rounds", F.lower(F.hex(secrets.derived(F.lit("password"), F.encode(F.lit("salt"), "UTF-8"), F.col("rounds")))).alias("hash"))


@query("o172_key_errors", "usr", sql="SELECT id, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 7 = 0 THEN 'key missing' WHEN id % 3 = 1 THEN CASE WHEN k <= 16 THEN 'AES256 needs more than 16 bytes' END ELSE CASE WHEN k != 16 THEN 'SM4 needs 16 bytes' END END AS error FROM (SELECT id, strlen(substr(usr, 1, (14 + id % 5)::INT)) AS k FROM usr)")
def _(s):
    way = F.element_at(F.array(F.lit(0), F.lit(payload.AES256), F.lit(payload.SM4)), (F.col("id") % 3 + 1).cast("int"))
    key = F.when(F.col("id") % 7 == 0, "").otherwise(F.substring(F.col("usr"), F.lit(1), (14 + F.col("id") % 5).cast("int")))
    return s.usr.select("id", secrets.key_error(way, key).alias("error"))


@query("o146_quotes", "usr", sql="SELECT id, replace(replace(usr, '#', chr(39)), chr(39), chr(39) || chr(39)) AS literal FROM usr")
def _(s):
    return s.usr.select("id", secrets.quoted(F.replace("usr", F.lit("#"), F.lit("'"))).alias("literal"))


@query("o176_new_ids", "obj", sql="SELECT count(*) AS rows, count(DISTINCT id) AS ids FROM obj")
def _(s):
    return s.obj.select(F.monotonically_increasing_id().alias("id")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"))
