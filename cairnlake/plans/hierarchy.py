"""The object tree."""

from pyspark.sql import functions as F

from ..operators import hierarchy
from ..sources.shared import materialise
from . import query

_UP = """up(node, ancestor, level) AS (SELECT id, id, 0 FROM tree UNION ALL SELECT u.node, t.pid, u.level + 1 FROM up u JOIN tree t ON u.ancestor = t.id WHERE t.pid IN (SELECT id FROM tree))"""
_PATHS = "paths(id, path) AS (SELECT id, n FROM tree WHERE pid = 0 UNION ALL SELECT t.id, p.path || '/' || t.n FROM paths p JOIN tree t ON t.pid = p.id)"
_DOWN = "down(root, node, level) AS (SELECT id, id, 0 FROM tree WHERE id IN (103, 10007) UNION ALL SELECT d.root, t.id, d.level + 1 FROM down d JOIN tree t ON t.pid = d.node)"


@query("o106_roll_up", "tree", recursive=True, sql=f"{_UP} SELECT ancestor AS id, sum(s)::BIGINT AS total, max(did)::BIGINT AS newest_did FROM up JOIN tree ON node = id GROUP BY ancestor")
def _(s):
    return hierarchy.roll_up(s.tree)


@query("o138_path_to_id", "tree", recursive=True, sql=f"{_PATHS} SELECT id, path FROM paths")
def _(s):
    return hierarchy.paths(s.tree)


@query("o139_id_to_path", "tree", recursive=True, sql=f"{_PATHS} SELECT id AS node, path FROM paths")
def _(s):
    return hierarchy.id_paths(s.tree)


@query("o140_recursive_listing", "tree", recursive=True, sql=f"{_PATHS} SELECT DISTINCT CASE WHEN len(string_split(path, '/')) > 2 THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || '/' ELSE path END AS key, len(string_split(path, '/')) > 2 AS prefix FROM paths WHERE path LIKE 'EUROPE/%'")
def _(s):
    deep = F.size(F.split("path", "/")) > 2
    rows = hierarchy.paths(s.tree, below="EUROPE")
    return rows.select(F.when(deep, F.concat(F.substring_index("path", "/", 2), F.lit("/"))).otherwise(F.col("path")).alias("key"), deep.alias("prefix")).distinct()


@query("o141_path_lookup", "obj", "path", sql="SELECT id, path FROM path WHERE path IN ('src1/doc_1.en', 'src3/doc_3.fr', 'src0/none')")
def _(s):
    return s.path.where(F.col("path").isin("src1/doc_1.en", "src3/doc_3.fr", "src0/none")).select("id", "path")


@query("o142_make_dirs", "path", sql="""p AS (SELECT source || '/' || lang || '/' || doc_id % 3 || '/' AS dir FROM documents), w AS (SELECT DISTINCT array_to_string(string_split(trim(dir, '/'), '/')[1:k], '/') AS dir FROM p, (SELECT unnest([1, 2, 3]) AS k))
  SELECT dir FROM w WHERE dir NOT IN (SELECT n FROM obj WHERE t = 1)""")
def _(s):
    wanted = s.table("documents").select(F.concat_ws("/", "source", "lang", (F.col("doc_id") % 3).cast("string"), F.lit("")).alias("dir"))
    made = wanted.select(F.explode(hierarchy.path_prefixes(F.col("dir"))).alias("dir")).distinct()
    return made.join(s.obj.where("t = 1").select(F.col("n").alias("dir")), "dir", "left_anti")


@query("o143_pending_path", "tree", recursive=True, sql=f"{_PATHS} SELECT 90000000000 + id AS id, path || '/new' AS path FROM paths")
def _(s):
    return hierarchy.paths(s.tree).select((F.col("id") + 90000000000).alias("id"), F.concat("path", F.lit("/new")).alias("path"))


@query("o144_descendants", "tree", recursive=True, sql=f"{_DOWN} SELECT root, node, level FROM down")
def _(s):
    return hierarchy.descend(s.tree, s.spark.createDataFrame([(103,), (10007,)], "root long"))


@query("o041_recursive_delete", "tree", recursive=True, sql=f"{_DOWN} SELECT id, CASE WHEN id IN (SELECT node FROM down) THEN -pid ELSE pid END AS pid FROM tree")
def _(s):
    gone = hierarchy.descend(s.tree, s.spark.createDataFrame([(103,), (10007,)], "root long")).select(F.col("node").alias("id")).distinct().withColumn("gone", F.lit(True))
    return s.tree.join(gone, "id", "left").select("id", F.when(F.col("gone"), -F.col("pid")).otherwise(F.col("pid")).alias("pid"))


@query("o145_merge_versions", "version", sql="SELECT id, CASE WHEN pid % 10 = 3 THEN pid + 1 ELSE pid END AS pid, t FROM version WHERE t IN (3, 4)")
def _(s):
    return s.version.where("t IN (3, 4)").select("id", F.when(F.col("pid") % 10 == 3, F.col("pid") + 1).otherwise(F.col("pid")).alias("pid"), "t")


#: Every node moved below one customer, every customer below one of its orders, and every order below its region.
_MOVES = """moves AS (SELECT id, 10001 AS pid FROM tree UNION ALL SELECT pid, id FROM tree WHERE id BETWEEN 10000000000 AND 19999999999
  UNION ALL SELECT o.id, n.pid FROM tree o JOIN tree c ON o.pid = c.id JOIN tree n ON c.pid = n.id WHERE o.id BETWEEN 10000000000 AND 19999999999)"""


@query("o218_move_cycle_guard", "tree", recursive=True, sql=f"""{_UP}, {_MOVES}
  SELECT m.id, m.pid, u.node IS NOT NULL AS cycle FROM moves m LEFT JOIN up u ON u.node = m.pid AND u.ancestor = m.id""")
def _(s):
    tree = materialise(s.tree.select("id", "pid"))
    orders = tree.where("id BETWEEN 10000000000 AND 19999999999")
    up = tree.select(F.col("id").alias("pid"), F.col("pid").alias("next"))
    region = orders.select("id", "pid").join(up, "pid").select("id", F.col("next").alias("pid")).join(up, "pid").select("id", F.col("next").alias("pid"))
    moves = tree.select("id", F.lit(10001).cast("long").alias("pid")).unionByName(orders.select(F.col("pid").alias("id"), F.col("id").alias("pid"))).unionByName(region)
    return hierarchy.creates_cycle(tree, moves)
