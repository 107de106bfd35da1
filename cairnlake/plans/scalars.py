"""Scalar functions."""

from pyspark.sql import functions as F

from ..functions import cron, text
from ..operators import access
from . import query

_ODD = "(SELECT id, CASE id % 6 WHEN 0 THEN '/' || path || '//' WHEN 1 THEN '//' || path WHEN 2 THEN replace(path, '/', '//') WHEN 3 THEN '///' WHEN 4 THEN '' ELSE path END AS p FROM path)"


def _odd(s):
    k = F.col("id") % 6
    p = F.when(k == 0, F.concat(F.lit("/"), "path", F.lit("//"))).when(k == 1, F.concat(F.lit("//"), "path")).when(k == 2, F.regexp_replace("path", "/", "//")).when(k == 3, "///").when(k == 4, "").otherwise(F.col("path"))
    return s.path.select("id", p.alias("p"))


@query("o147_split_path", "path", sql=f"SELECT id, array_to_string(list_filter(string_split(p, '/'), lambda x: x != ''), '|') AS parts FROM {_ODD}")
def _(s):
    return _odd(s).select("id", F.array_join(text.split_path(F.col("p")), "|").alias("parts"))


@query("o148_base_name", "path", sql=f"SELECT id, CASE WHEN p = '' THEN '.' WHEN rtrim(p, '/') = '' THEN '/' ELSE string_split(rtrim(p, '/'), '/')[-1] END AS base FROM {_ODD}")
def _(s):
    return _odd(s).select("id", text.base_name(F.col("p")).alias("base"))


@query("o149_dir_name", "path", sql=f"""SELECT id, CASE WHEN p = '' THEN '.' WHEN rtrim(p, '/') = '' THEN '/' WHEN NOT contains(rtrim(p, '/'), '/') THEN '.'
  WHEN rtrim(regexp_replace(rtrim(p, '/'), '[^/]*$', ''), '/') = '' THEN '/' ELSE rtrim(regexp_replace(rtrim(p, '/'), '[^/]*$', ''), '/') END AS dir FROM {_ODD}""")
def _(s):
    return _odd(s).select("id", text.dir_name(F.col("p")).alias("dir"))


@query("o150_trim_prefix", "path", sql="SELECT id, CASE WHEN starts_with(path, 'src1') THEN substr(path, 5) ELSE path END AS rest FROM path")
def _(s):
    return s.path.select("id", text.trim_prefix(F.col("path"), "src1").alias("rest"))


@query("o151_etag", "data", sql="""SELECT id, '"' || lower(to_hex(id * 1000003)) || '"' AS etag FROM data""")
def _(s):
    return s.data.select("id", text.etag(F.col("id") * 1000003).alias("etag"))


@query("o152_http_date", "obj", sql="SELECT id, strftime(make_timestamp(m * 1000000), '%a, %d %b %Y %H:%M:%S GMT') AS modified FROM obj")
def _(s):
    return s.obj.select("id", text.http_date(F.col("m")).alias("modified"))


_RANGES = "(SELECT id, s, CASE id % 7 WHEN 0 THEN 'bytes=0-99' WHEN 1 THEN 'bytes=500-' WHEN 2 THEN 'bytes=-300' WHEN 3 THEN 'bytes=10-5' WHEN 4 THEN 'bytes=-' WHEN 5 THEN 'bytes=900000-' ELSE 'items=1-2' END AS h FROM data)"


def _ranges(s):
    heads = ["bytes=0-99", "bytes=500-", "bytes=-300", "bytes=10-5", "bytes=-", "bytes=900000-", "items=1-2"]
    return s.data.select("id", "s", F.get(F.array(*map(F.lit, heads)), (F.col("id") % 7).cast("int")).alias("h"))


_START = "CASE id % 7 WHEN 0 THEN CASE WHEN s > 0 THEN 0 END WHEN 1 THEN CASE WHEN s > 500 THEN 500 END WHEN 2 THEN CASE WHEN s > 0 THEN greatest(0, s - 300) END WHEN 5 THEN CASE WHEN s > 900000 THEN 900000 END END"
_END = f"CASE WHEN {_START} IS NOT NULL THEN CASE id % 7 WHEN 0 THEN least(99, s - 1) ELSE s - 1 END END"


@query("o155_parse_range", "data", sql=f"SELECT id, ({_START})::BIGINT AS first, ({_END})::BIGINT AS last FROM {_RANGES}")
def _(s):
    r = text.parse_range(F.col("h"), F.col("s"))
    return _ranges(s).select("id", r["start"].alias("first"), r["end"].alias("last"))


@query("o153_content_range", "data", sql=f"SELECT id, 'bytes ' || ({_START}) || '-' || ({_END}) || '/' || s AS header FROM {_RANGES} WHERE {_START} IS NOT NULL")
def _(s):
    r = text.parse_range(F.col("h"), F.col("s"))
    return _ranges(s).where(r.isNotNull()).select("id", text.content_range(r["start"], r["end"], F.col("s")).alias("header"))


@query("o154_content_length", "data", sql="SELECT id, s::VARCHAR AS header FROM data")
def _(s):
    return s.data.select("id", F.col("s").cast("string").alias("header"))


@query("o075_cron_match", sql="SELECT event_id FROM events WHERE minute(ts) BETWEEN 0 AND 29 AND hour(ts) IN (2, 3, 4, 22) AND dayofweek(ts) BETWEEN 1 AND 5")
def _(s):
    return s.table("events").where(cron.matches(F.col("ts"), "0-29 2-4,22 * * 1-5")).select("event_id")


@query("o174_kind_bits", "data", sql="SELECT id, k | 32 AS added, k & ~1 AS cleared FROM data")
def _(s):
    return s.data.select("id", text.set_flags(F.col("k"), 32).alias("added"), text.clear_flags(F.col("k"), 1).alias("cleared"))


@query("o173_codec_names", "data", sql="SELECT id, CASE WHEN k & 16 != 0 THEN 'SNAPPY' WHEN k & 32 != 0 THEN 'ZSTD' WHEN k & 64 != 0 THEN 'GZIP' WHEN k & 128 != 0 THEN 'BR' ELSE '' END AS codec FROM data")
def _(s):
    from ..functions.payload import BROTLI, CODEC_NAMES, GZIP, SNAPPY, ZSTD

    name = F.lit("")
    for flag in (BROTLI, GZIP, ZSTD, SNAPPY):
        name = F.when(text.has_flags(F.col("k"), flag), CODEC_NAMES[flag]).otherwise(name)
    return s.data.select("id", name.alias("codec"))


@query("o170_storage_class", "bkt", sql="SELECT id, CASE WHEN ds > 0 THEN 'REDUCED_REDUNDANCY' ELSE 'STANDARD' END AS class FROM bkt")
def _(s):
    return s.bkt.select("id", access.storage_class(F.col("ds") > 0).alias("class"))


@query("o166_encode_extra", "version", sql="SELECT id, id + 7 AS data_id, base AS base_id, s AS entries FROM version WHERE t = 4")
def _(s):
    coded = s.version.where("t = 4").select("id", text.encode_journal_extra(F.col("id") + 7, F.col("base"), F.col("s")).alias("e"))
    return coded.select("id", text.journal_extra(F.col("e")).alias("x")).select("id", "x.*")


@query("o167_decode_extra", "version", sql="""SELECT id, CASE WHEN id % 3 = 2 THEN NULL ELSE id + 9007199254740993 END AS data_id, CASE WHEN id % 3 = 2 THEN NULL ELSE base END AS base_id, CASE WHEN id % 3 = 2 THEN NULL ELSE 5 END::BIGINT AS entries FROM version WHERE t = 4""")
def _(s):
    k, did = F.col("id") % 3, F.col("id") + 9007199254740993
    json = F.format_string('{"journalDataID":%d,"baseVersionID":%d,"entryCount":5}', did, F.col("base"))
    extra = F.when(k == 0, json).when(k == 1, text.encode_journal_extra(did, F.col("base"), F.lit(5))).otherwise("broken")
    return s.version.where("t = 4").select("id", text.journal_extra(extra).alias("x")).select("id", "x.data_id", "x.base_id", "x.entries")


@query("o168_base_version", "version", sql="SELECT id, CASE WHEN id % 2 = 0 THEN base ELSE 0 END AS base_id FROM version WHERE t = 4")
def _(s):
    extra = F.when(F.col("id") % 2 == 0, text.encode_journal_extra(F.col("id"), F.col("base"), F.lit(1))).otherwise("?")
    return s.version.where("t = 4").select("id", F.coalesce(text.journal_extra(extra)["base_id"], F.lit(0)).cast("long").alias("base_id"))
