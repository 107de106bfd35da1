"""The store's relations, derived from the tables of a data directory.

``Store`` builds each relation with the DataFrame API; ``VIEWS`` states the same relations in SQL for
the oracles.  The relations (see the column notes) are:

data(id, bkt_id, s, os, h, x, s0..s3, k, pi, po)   content blocks: size, hashes, flags, package and offset
obj(id, pid, did, s, m, t, n, e, md)               object tree: parent (negative: deleted), block, size, time, type, name
attr(id, k, v), usr, acl, bkt                      attributes, users, permissions, buckets
version(id, pid, did, s, m, t, n, base)            versions and journals of files
chunk(bkt_id, data_id, sn, size), blk(id, bkt_id, s), ref(id, did, pid)   chunk files, the blocks they belong to, references
content(data_id, sn, bytes), text(id, bytes)       payload in chunks of CONTENT_CHUNK bytes, and whole
journal(file_id, seq, off, len)                    byte-range writes
snap, snapobj                                      snapshots and their rows
tree(id, pid, n, s, did)                           a deep object tree
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CONTENT_CHUNK = 1024
EPOCH = 1_600_000_000
#: Objects of documents start at this id, directories above DIRS.
FILES, DIRS = 1_000_000_000_000, 10


def signed_word(hex_digest: Column, i: int) -> Column:
    """The i-th 64-bit word of a hex digest, as a signed number."""
    return F.conv(F.substring(hex_digest, 1 + 16 * i, 16), 16, -10).cast("long")


def positive_hash(hex_digest: Column) -> Column:
    """The first 60 bits of a hex digest."""
    return F.conv(F.substring(hex_digest, 1, 15), 16, 10).cast("long")


class Store:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def data(self) -> DataFrame:
        size = F.octet_length("text").cast("long")
        sha = F.sha2(F.encode("text", "UTF-8"), 256)
        kind = F.when(F.col("lang") == "de", 33).when(F.col("lang") == "fr", 3).when(F.col("lang") == "es", 65537).otherwise(1)
        rows = self.table("documents").select(
            F.col("doc_id").alias("id"), (F.col("doc_id") % 5).alias("bkt_id"), size.alias("s"), size.alias("os"),
            positive_hash(F.md5(F.encode(F.substring("text", 1, 102400), "UTF-8"))).alias("h"), positive_hash(F.md5(F.encode("text", "UTF-8"))).alias("x"),
            *[signed_word(sha, i).alias(f"s{i}") for i in range(4)],
            kind.cast("long").alias("k"), F.when(size < 4096, F.floor(F.col("doc_id") / 50) + 1).otherwise(0).cast("long").alias("pi"),
        )
        before = Window.partitionBy("pi").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
        packed = rows.where("pi > 0").withColumn("po", F.coalesce(F.sum("os").over(before), F.lit(0)).cast("long"))
        return packed.unionByName(rows.where("pi = 0").withColumn("po", F.lit(0).cast("long")))

    @cached_property
    def dirs(self) -> DataFrame:
        rank = F.row_number().over(Window.orderBy("source"))
        return self.table("documents").select("source").distinct().select("source", (rank + DIRS).cast("long").alias("dir"))

    @cached_property
    def obj(self) -> DataFrame:
        docs = self.table("documents")
        toxic = self.table("labels").where("toxic = 1").select("doc_id").distinct().withColumn("gone", F.lit(True))
        first = docs.groupBy(F.md5(F.encode("text", "UTF-8")).alias("sum")).agg(F.min("doc_id").alias("did"))
        files = docs.withColumn("sum", F.md5(F.encode("text", "UTF-8"))).join(first, "sum").join(self.dirs, "source").join(toxic, "doc_id", "left")
        files = files.select(
            (F.col("doc_id") + FILES).alias("id"), F.when(F.col("gone"), -F.col("dir")).otherwise(F.col("dir")).alias("pid"), "did",
            F.octet_length("text").cast("long").alias("s"), (F.lit(EPOCH) + F.col("doc_id") * 7919 % 1000000).alias("m"), F.lit(2).alias("t"),
            F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang")).alias("n"), F.lit("").alias("e"), F.lit(420).cast("long").alias("md"),
        )
        zero = F.lit(0).cast("long")
        dirs = self.dirs.select(F.col("dir").alias("id"), zero.alias("pid"), zero.alias("did"), zero.alias("s"), F.lit(EPOCH).cast("long").alias("m"), F.lit(1).alias("t"), F.col("source").alias("n"), F.lit("").alias("e"), F.lit(493).cast("long").alias("md"))
        return files.unionByName(dirs)

    @cached_property
    def attr(self) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in ("lang", "source")])
        return self.table("documents").select(F.col("doc_id").alias("id"), F.inline(pairs))

    @cached_property
    def usr(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 50 == 0, 1).otherwise(0).alias("role"), F.col("c_name").alias("usr"), F.lower("c_name").alias("name"))

    @cached_property
    def acl(self) -> DataFrame:
        return self.table("customer").select((F.col("c_nationkey") + 1).cast("long").alias("bkt_id"), F.col("c_custkey").alias("uid"), (F.col("c_custkey") % 64).cast("int").alias("perm"))

    @cached_property
    def bkt(self) -> DataFrame:
        used = self.table("customer").groupBy("c_nationkey").agg(F.sum(F.floor(F.abs("c_acctbal") * 100)).cast("long").alias("u"))
        rows = self.table("nation").join(used, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_nationkey", "n_name", F.coalesce("u", F.lit(0)).cast("long").alias("u"))
        ru = F.floor(F.col("u") * 3 / 4).cast("long")
        return rows.select(
            (F.col("n_nationkey") + 1).cast("long").alias("id"), F.when(F.col("n_nationkey") % 5 == 0, -1).otherwise(F.col("u")).cast("long").alias("q"), "u", ru.alias("ru"),
            F.floor(F.col("u") * F.when(F.col("n_nationkey") % 2 == 0, 0.5).otherwise(0.8)).cast("long").alias("lu"), (F.col("u") - ru).alias("ds"), F.lit(10485760).cast("long").alias("cs"), F.col("n_name").alias("n"),
        )

    @cached_property
    def version(self) -> DataFrame:
        kind = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "view", 4).otherwise(2)
        rows = self.table("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("pid"), F.col("event_id").alias("did"), F.floor(F.abs("value") * 10).cast("long").alias("s"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("m"), kind.alias("t"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("n"))
        earlier = Window.partitionBy("pid").orderBy("m", "id").rowsBetween(Window.unboundedPreceding, -1)
        base = F.when(F.col("t") == 4, F.coalesce(F.last(F.when(F.col("t") == 3, F.col("id")), ignorenulls=True).over(earlier), F.lit(0))).otherwise(0)
        return rows.withColumn("base", base.cast("long"))

    @cached_property
    def chunk(self) -> DataFrame:
        rows = self.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.floor("l_quantity")).cast("long").alias("size"))
        return rows.select((F.col("l_orderkey") % 5).alias("bkt_id"), F.col("l_orderkey").alias("data_id"), (F.col("l_linenumber") - 1).alias("sn"), "size")

    @cached_property
    def blk(self) -> DataFrame:
        held = self.chunk.groupBy("data_id").agg(F.sum("size").alias("held"))
        rows = self.table("orders").where("o_orderkey % 13 != 0").select(F.col("o_orderkey").alias("id")).join(held, F.col("id") == F.col("data_id"), "left")
        return rows.select("id", (F.col("id") % 5).alias("bkt_id"), (F.coalesce("held", F.lit(0)) + F.when(F.col("id") % 10 == 0, 1).otherwise(0)).cast("long").alias("s"))

    @cached_property
    def ref(self) -> DataFrame:
        return self.table("orders").where("o_orderstatus != 'P'").select((F.col("o_orderkey") + FILES).alias("id"), F.col("o_orderkey").alias("did"), F.when(F.col("o_custkey") % 7 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("pid"))

    @cached_property
    def text(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("bytes"))

    @cached_property
    def content(self) -> DataFrame:
        last = F.greatest(F.ceil(F.octet_length("bytes") / CONTENT_CHUNK) - 1, F.lit(0)).cast("int")
        rows = self.text.select(F.col("id").alias("data_id"), "bytes", F.explode(F.sequence(F.lit(0), last)).alias("sn"))
        return rows.select("data_id", "sn", F.substring(F.col("bytes"), F.col("sn") * CONTENT_CHUNK + 1, F.lit(CONTENT_CHUNK)).alias("bytes"))

    @cached_property
    def journal(self) -> DataFrame:
        return self.table("events").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("seq"), (F.col("event_id") * 37 % 1000 * 10).alias("off"), (1 + F.col("event_id") % 50).alias("len"))

    @cached_property
    def snap(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").select(k.alias("id"), (F.col("s_nationkey") + 1).cast("long").alias("bucket_id"), F.col("s_name").alias("name"), (F.lit(EPOCH) + k * 86400).alias("created_at"), (k % 3).cast("int").alias("status"), (k % 2).cast("int").alias("is_lazy"))

    @cached_property
    def path(self) -> DataFrame:
        dirs = self.obj.where("t = 1").select(F.col("id").alias("dir"), F.col("n").alias("dn"))
        return self.obj.where("t = 2").join(dirs, F.abs("pid") == F.col("dir")).select("id", "pid", "did", "s", "m", F.concat("dn", F.lit("/"), "n").alias("path"))

    @cached_property
    def snapobj(self) -> DataFrame:
        return self.path.where("pid > 0 AND id % 3 != 0").select((F.col("id") % 2 + 1).alias("snapshot_id"), F.col("id").alias("obj_id"), "path", F.col("did").alias("data_id"), F.col("s").alias("size"), F.col("m").alias("mtime"))

    @cached_property
    def tree(self) -> DataFrame:
        def level(df: DataFrame, key: str, at: int, parent: str, parent_at: int, name: Column) -> DataFrame:
            return df.select((F.lit(at) + F.col(key)).cast("long").alias("id"), (F.lit(parent_at) + F.expr(parent)).cast("long").alias("pid"), name.alias("n"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("did"))

        big = 10_000_000_000
        leaf = self.chunk.select((F.lit(2 * big) + F.col("data_id") * 8 + F.col("sn")).cast("long").alias("id"), (F.lit(big) + F.col("data_id")).alias("pid"), F.concat(F.lit("l"), F.col("sn").cast("string")).alias("n"), F.col("size").alias("s"), F.col("data_id").alias("did"))
        return (
            level(self.table("region"), "r_regionkey", 1, "0", 0, F.col("r_name"))
            .unionByName(level(self.table("nation"), "n_nationkey", 100, "n_regionkey", 1, F.col("n_name")))
            .unionByName(level(self.table("customer"), "c_custkey", 10_000, "c_nationkey", 100, F.col("c_name")))
            .unionByName(level(self.table("orders"), "o_orderkey", big, "o_custkey", 10_000, F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))))
            .unionByName(leaf)
        )


def _word(i: int) -> str:
    u = f"('0x' || substr(sha256(text), {1 + 16 * i}, 16))::UBIGINT"
    return f"(CASE WHEN {u} > 9223372036854775807 THEN {u}::HUGEINT - 18446744073709551616::HUGEINT ELSE {u}::HUGEINT END)::BIGINT AS s{i}"


_BIG = 10_000_000_000
VIEWS = {
    "data": f"""SELECT id, bkt_id, s, os, h, x, s0, s1, s2, s3, k, pi, CASE WHEN pi > 0 THEN coalesce(sum(os) OVER (PARTITION BY pi ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE 0 END::BIGINT AS po
      FROM (SELECT doc_id AS id, doc_id % 5 AS bkt_id, strlen(text)::BIGINT AS s, strlen(text)::BIGINT AS os, ('0x' || substr(md5(substr(text, 1, 102400)), 1, 15))::BIGINT AS h, ('0x' || substr(md5(text), 1, 15))::BIGINT AS x,
      {", ".join(_word(i) for i in range(4))}, CASE lang WHEN 'de' THEN 33 WHEN 'fr' THEN 3 WHEN 'es' THEN 65537 ELSE 1 END::BIGINT AS k, CASE WHEN strlen(text) < 4096 THEN doc_id // 50 + 1 ELSE 0 END::BIGINT AS pi FROM documents)""",
    "dirs": f"SELECT source, (row_number() OVER (ORDER BY source) + {DIRS})::BIGINT AS dir FROM (SELECT DISTINCT source FROM documents)",
    "obj": f"""SELECT doc_id + {FILES} AS id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN -dir ELSE dir END AS pid, min(doc_id) OVER (PARTITION BY md5(text)) AS did, strlen(text)::BIGINT AS s,
      ({EPOCH} + doc_id * 7919 % 1000000)::BIGINT AS m, 2 AS t, 'doc_' || doc_id || '.' || lang AS n, '' AS e, 420::BIGINT AS md FROM documents JOIN dirs USING (source)
      UNION ALL SELECT dir, 0, 0, 0, {EPOCH}, 1, source, '', 493 FROM dirs""",
    "attr": "SELECT doc_id AS id, 'lang' AS k, lang AS v FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents",
    "usr": "SELECT c_custkey AS id, CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 0 END AS role, c_name AS usr, lower(c_name) AS name FROM customer",
    "acl": "SELECT (c_nationkey + 1)::BIGINT AS bkt_id, c_custkey AS uid, (c_custkey % 64)::INT AS perm FROM customer",
    "bkt": """SELECT (n_nationkey + 1)::BIGINT AS id, CASE WHEN n_nationkey % 5 = 0 THEN -1 ELSE u END::BIGINT AS q, u, floor(u * 3 / 4)::BIGINT AS ru, floor(u * CASE WHEN n_nationkey % 2 = 0 THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END)::BIGINT AS lu,
      u - floor(u * 3 / 4)::BIGINT AS ds, 10485760::BIGINT AS cs, n_name AS n FROM (SELECT n_nationkey, n_name, coalesce(sum(floor(abs(c_acctbal) * 100)), 0)::BIGINT AS u FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY ALL)""",
    "version": """SELECT id, pid, did, s, m, t, n, CASE WHEN t = 4 THEN coalesce(last_value(CASE WHEN t = 3 THEN id END IGNORE NULLS) OVER (PARTITION BY pid ORDER BY m, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE 0 END::BIGINT AS base
      FROM (SELECT event_id AS id, user_id AS pid, event_id AS did, floor(abs(value) * 10)::BIGINT AS s, floor(epoch(ts))::BIGINT AS m, CASE event_type WHEN 'purchase' THEN 3 WHEN 'view' THEN 4 ELSE 2 END AS t, 'v' || event_id AS n FROM events)""",
    "chunk": "SELECT l_orderkey % 5 AS bkt_id, l_orderkey AS data_id, l_linenumber - 1 AS sn, sum(floor(l_quantity))::BIGINT AS size FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "blk": "SELECT o_orderkey AS id, o_orderkey % 5 AS bkt_id, (coalesce(held, 0) + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END)::BIGINT AS s FROM orders LEFT JOIN (SELECT data_id, sum(size) AS held FROM chunk GROUP BY data_id) ON o_orderkey = data_id WHERE o_orderkey % 13 != 0",
    "ref": f"SELECT o_orderkey + {FILES} AS id, o_orderkey AS did, CASE WHEN o_custkey % 7 = 0 THEN -o_custkey ELSE o_custkey END AS pid FROM orders WHERE o_orderstatus != 'P'",
    "text": "SELECT doc_id AS id, encode(text) AS bytes FROM documents",
    "content": f"SELECT data_id, sn::INT AS sn, unhex(substr(hx, (2 * {CONTENT_CHUNK} * sn + 1)::INT, 2 * {CONTENT_CHUNK})) AS bytes FROM (SELECT id AS data_id, hex(bytes) AS hx, unnest(range(0, greatest(ceil(octet_length(bytes) / {CONTENT_CHUNK})::BIGINT, 1))) AS sn FROM text)",
    "journal": "SELECT user_id AS file_id, event_id AS seq, event_id * 37 % 1000 * 10 AS off, 1 + event_id % 50 AS len FROM events",
    "snap": f"SELECT s_suppkey AS id, (s_nationkey + 1)::BIGINT AS bucket_id, s_name AS name, {EPOCH} + s_suppkey * 86400 AS created_at, (s_suppkey % 3)::INT AS status, (s_suppkey % 2)::INT AS is_lazy FROM supplier",
    "path": "SELECT f.id, f.pid, f.did, f.s, f.m, d.n || '/' || f.n AS path FROM obj f JOIN obj d ON d.t = 1 AND d.id = abs(f.pid) WHERE f.t = 2",
    "snapobj": "SELECT id % 2 + 1 AS snapshot_id, id AS obj_id, path, did AS data_id, s AS size, m AS mtime FROM path WHERE pid > 0 AND id % 3 != 0",
    "tree": f"""SELECT (1 + r_regionkey)::BIGINT AS id, 0::BIGINT AS pid, r_name AS n, 0::BIGINT AS s, 0::BIGINT AS did FROM region UNION ALL SELECT 100 + n_nationkey, 1 + n_regionkey, n_name, 0, 0 FROM nation
      UNION ALL SELECT 10000 + c_custkey, 100 + c_nationkey, c_name, 0, 0 FROM customer UNION ALL SELECT {_BIG} + o_orderkey, 10000 + o_custkey, 'o' || o_orderkey, 0, 0 FROM orders
      UNION ALL SELECT {2 * _BIG} + data_id * 8 + sn, {_BIG} + data_id, 'l' || sn, size, data_id FROM chunk""",
}
_NEEDS = {"obj": ["dirs"], "blk": ["chunk"], "content": ["text"], "path": ["obj"], "snapobj": ["path"], "tree": ["chunk"]}


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    """The body with the named relations (and what they need) in front as common tables; the body may
    start with further ones, each ``name AS (...),`` up to its final SELECT."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    tables = ", ".join(f"{x} AS ({VIEWS[x]})" for x in order)
    body = body.strip()
    if not tables:
        return body
    more = ", " if not body.upper().startswith("SELECT") else " "
    return f"WITH {'RECURSIVE ' * recursive}{tables}{more}{body}"
