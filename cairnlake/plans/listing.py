"""Listings, filters and paging."""

from pyspark.sql import functions as F

from ..catalog import DIRS, EPOCH
from ..operators import access, listing
from . import query

_KEYS = "SELECT path AS key FROM path WHERE pid >= 0"


def _keys(s):
    return s.path.where("pid >= 0").select(F.col("path").alias("key"))


@query("o062_name_match", "obj", sql=r"SELECT id, n, n ILIKE 'DOC\_1%.?r' ESCAPE '\' OR n ILIKE 'DOC\_1%._r' ESCAPE '\' AS wild, n = 'src1' AS exact FROM obj")
def _(s):
    return s.obj.select("id", "n", listing.name_matches(F.col("n"), "DOC_1*.?r").alias("wild"), listing.name_matches(F.col("n"), "src1").alias("exact"))


def _page(name, order, first, cursor_sql, where="", cursor=None, count=40):
    sql = f"SELECT *, {cursor_sql} AS cursor FROM (SELECT * FROM obj WHERE pid = {DIRS + 2} {where} ORDER BY {first} LIMIT {count})"

    @query(name, "obj", sql=sql)
    def _(s):
        return listing.list_objects(s.obj, DIRS + 2, order=order, cursor=cursor, count=count)[0]


_page("o063_list_directory", "id", "id", "id::VARCHAR")
_page("o079_keyset_size_down", "-size", "s DESC, id", "s || ':' || id", f"AND (s < 2000 OR (s = 2000 AND id > {5}))", "2000:5")
_page("o079_keyset_mtime_up", "+mtime", "m, id", "m || ':' || id", f"AND (m > {EPOCH + 200000} OR (m = {EPOCH + 200000} AND id > 7))", f"{EPOCH + 200000}:7")
_page("o080_cursor_name_down", "-name", "n DESC", "n", "AND n < 'doc_6'", "doc_6")


@query("o063_directory_total", "obj", sql=f"SELECT count(*) AS total FROM obj WHERE pid = {DIRS + 2} AND n ILIKE 'doc\\_%.en' ESCAPE '\\' AND t = 2")
def _(s):
    return listing.list_objects(s.obj, DIRS + 2, word="doc_*.en", kind=2)[1]


@query("o064_list_recycled", "obj", sql="SELECT *, m || ':' || id AS cursor FROM (SELECT * FROM obj WHERE pid < 0 ORDER BY m DESC, id LIMIT 100)")
def _(s):
    return listing.list_recycled(s.obj, order="-mtime", count=100)


@query("o065_deleted_before", "obj", sql=f"SELECT * FROM obj WHERE pid < 0 AND m <= {EPOCH + 500000} ORDER BY m, id LIMIT 50")
def _(s):
    return listing.deleted_before(s.obj, EPOCH + 500000, 50)


@query("o066_small_unpackaged", "data", sql="SELECT id, os FROM data WHERE pi = 0 AND os > 0 AND os < 8000 ORDER BY id")
def _(s):
    return listing.small_unpackaged(s.data, 8000).select("id", "os").orderBy("id")


@query("o067_brief", "obj", sql="SELECT id, s, m, t, n, md FROM obj")
def _(s):
    return listing.brief(s.obj, 1)


@query("o068_ignore_globs", "obj", sql=r"SELECT id, regexp_matches(n, '^doc_[^/]*[05]\.[^/][sn]$') OR regexp_matches(n, '^src[1-3]$') AS ignored FROM obj")
def _(s):
    return s.obj.select("id", listing.ignored(F.col("n"), "doc_*[05].?[sn];src[1-3]").alias("ignored"))


@query("o069_prefix_filter", "path", sql="SELECT path FROM path WHERE starts_with(path, 'src1/doc_2')")
def _(s):
    return s.path.where(F.col("path").startswith("src1/doc_2")).select("path")


@query("o071_permission", "acl", sql="SELECT bkt_id, uid, (perm & 9) = 9 AS may_read, (perm & 18) = 18 AS may_write, (perm & 36) = 36 AS may_delete FROM acl")
def _(s):
    return s.acl.select("bkt_id", "uid", *[access.allows(F.col("perm"), a).alias(n) for a, n in ((access.READ, "may_read"), (access.WRITE, "may_write"), (access.DELETE, "may_delete"))])


@query("o072_role_filter", "usr", "acl", sql="SELECT bkt_id, uid, role FROM acl JOIN usr ON uid = id WHERE role = 1 OR (perm & 63) = 63")
def _(s):
    met = s.acl.join(s.usr, F.col("uid") == F.col("id"))
    return met.where((F.col("role") == access.ADMIN) | access.allows(F.col("perm"), access.ALL)).select("bkt_id", "uid", "role")


@query("o073_compressible_names", "obj", sql="SELECT id, lower(n) NOT SIMILAR TO '.*\\.(7z|gz|zip|png|jpg|mp4)' AND s > 0 AS compressible FROM obj")
def _(s):
    return s.obj.select("id", listing.compressible(F.col("n"), F.expr("CASE WHEN s > 0 THEN X'00' ELSE X'' END")).alias("compressible"))


@query("o074_fragmented", "bkt", sql="SELECT id, ru > 0 AND ru > lu AND (ru - lu) * 100.0 / nullif(ru, 0) >= 20 AS fragmented FROM bkt")
def _(s):
    return s.bkt.select("id", F.coalesce(listing.fragmented(F.col("ru"), F.col("lu"), 20), F.lit(False)).alias("fragmented"))


@query("o077_kind_flags", "data", sql="SELECT id, (k & 65536) != 0 AS sparse, (k & 240) != 0 AS compressed, (k & 14) != 0 AS encrypted FROM data")
def _(s):
    return s.data.select("id", *[(F.col("k").bitwiseAND(m) != 0).alias(n) for m, n in ((65536, "sparse"), (240, "compressed"), (14, "encrypted"))])


@query("o078_order_fields", "obj", sql="SELECT id, t, n FROM obj ORDER BY t DESC, id LIMIT 25")
def _(s):
    return listing.keyset_page(s.obj, "-type", count=25).select("id", "t", "n")


@query("o082_s3_list", "path", sql="SELECT key, 'content' AS kind, (SELECT count(*) FROM path WHERE pid >= 0 AND path > 'src1/') > 60 AS truncated FROM (SELECT path AS key FROM path WHERE pid >= 0 AND path > 'src1/' ORDER BY path LIMIT 60)")
def _(s):
    return listing.s3_list(_keys(s), marker="src1/", max_keys=60)


@query("o136_common_prefixes", "path", sql=f"SELECT DISTINCT split_part(key, '/', 1) || '/' AS key, 'prefix' AS kind, false AS truncated FROM ({_KEYS})")
def _(s):
    return listing.s3_list(_keys(s), delimiter="/")


@query("o083_list_uploads", sql="SELECT 'o' || o_orderkey AS key, floor(epoch(o_orderdate))::BIGINT AS initiated FROM orders WHERE starts_with('o' || o_orderkey, 'o1') AND 'o' || o_orderkey > 'o12' ORDER BY 1, 2 LIMIT 1000")
def _(s):
    rows = s.table("orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("key"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("initiated"))
    return listing.list_uploads(rows, "o1", "o12")


@query("o084_list_parts", "chunk", sql="SELECT part, etag, (SELECT count(*) FROM content_parts WHERE part > 3) > 5 AS truncated, max(part) OVER () AS next_marker FROM (SELECT * FROM content_parts WHERE part > 3 ORDER BY part LIMIT 5)".replace("content_parts", "(SELECT s_suppkey AS part, lower(to_hex(s_suppkey)) AS etag FROM supplier)"))
def _(s):
    return listing.list_parts(s.table("supplier").select(F.col("s_suppkey").alias("part"), F.lower(F.hex("s_suppkey")).alias("etag")), 3, 5)


@query("o085_upload_order", "path", sql="SELECT path, s AS size FROM path ORDER BY s, path LIMIT 40")
def _(s):
    return s.path.select("path", F.col("s").alias("size")).orderBy("size", "path").limit(40)


@query("o086_cleanup_snapshots", "snap", sql=f"""SELECT id, bucket_id, CASE WHEN created_at < {EPOCH + 60 * 86400} - 20 * 86400 THEN 'expired' ELSE 'excess' END AS reason
  FROM (SELECT *, row_number() OVER (PARTITION BY bucket_id ORDER BY created_at DESC, id DESC) AS rank FROM snap) WHERE created_at < {EPOCH + 60 * 86400} - 20 * 86400 OR rank > 2""")
def _(s):
    return listing.cleanup_snapshots(s.snap, EPOCH + 60 * 86400, 20, 2)
