"""The object tree: closures, paths, roll-ups (O-106, O-138 to O-145, O-41, O-144).

Each step climbs or descends one level by a join on ids and writes that level to the shared folder, so the
work is a join per level, however deep the tree is, and no row limit of recursive SQL applies.  A depth bound and the bound of distinct (node, ancestor) pairs guard
against cycles: with a cycle, climbing stops at ``depth`` levels if one is given, and else raises
when rows are left past DEPTH levels.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise

DEPTH = 64


def _rounds(depth: int | None) -> Iterator[int]:
    """Rounds of a walk: ``depth``; without it, until the caller stops, or raise past DEPTH levels."""
    yield from range(DEPTH + 1 if depth is None else depth)
    if depth is None:
        raise ValueError(f"the tree has more than {DEPTH} levels or a cycle; give a depth to stop there")


def climb(tree: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, ancestor, level) of the given nodes (column ``node``), themselves at level 0; the walk ends
    at a parent without a row.  All rows of the tree meet the given nodes once, for the first level; above it only
    nodes with children are joined."""
    steps = tree.select(F.col("id").alias("ancestor"), F.abs("pid").alias("up"))
    inner = materialise(steps.join(steps.select(F.col("up").alias("ancestor")).distinct(), "ancestor", "left_semi"))
    known = inner.select(F.col("ancestor").alias("up"))
    links = materialise(inner.join(known, "up", "left_semi"))
    at = materialise(start.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("level")))
    out = at
    for i in _rounds(depth):
        above = at.join(links, "ancestor") if i else at.join(steps, "ancestor").join(known, "up", "left_semi")
        at = materialise(above.select("node", F.col("up").alias("ancestor"), (F.col("level") + 1).alias("level")))
        if at.isEmpty():
            break
        out = out.unionByName(at)
    return out


def descend(tree: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(root, node, level) of everything below the roots (column ``root``), themselves at level 0."""
    links = materialise(tree.select(F.abs("pid").alias("parent"), F.col("id").alias("child")))
    at = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("level"))
    out = at
    for _ in _rounds(depth):
        at = materialise(at.join(links, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node"), (F.col("level") + 1).alias("level")))
        if at.isEmpty():
            break
        out = out.unionByName(at)
    return out


def roll_up(tree: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, total, newest_did): bytes and largest block id in and below every node.  Each round sends the
    sums of a level's children to their parents, so a row is sent once per level above it."""
    tree = materialise(tree.select("id", F.abs("pid").alias("pid"), "s", "did"))
    links = materialise(tree.select("id", "pid").join(tree.select(F.col("id").alias("pid")), "pid", "left_semi"))
    at = tree.select("id", "s", "did")
    out = at
    for _ in _rounds(depth):
        at = materialise(at.join(links, "id").groupBy(F.col("pid").alias("id")).agg(F.sum("s").alias("s"), F.max("did").alias("did")))
        if at.isEmpty():
            break
        out = out.unionByName(at)
    return out.groupBy("id").agg(F.sum("s").cast("long").alias("total"), F.max("did").alias("newest_did"))


def paths(tree: DataFrame, depth: int | None = None, below: str | None = None) -> DataFrame:
    """(id, path): names from the root down, joined by slashes; with ``below``, only of nodes under the top
    node of that name, which no other top node's children are joined for."""
    names = materialise(tree.select(F.col("id").alias("child"), F.abs("pid").alias("parent"), F.col("n").alias("name")))
    top = names.join(names.select(F.col("child").alias("parent")), "parent", "left_anti")
    top = top if below is None else top.where(F.col("name") == below)
    at = materialise(top.select(F.col("child").alias("id"), F.col("name").alias("path")))
    out = [at] if below is None else []
    for _ in _rounds(depth):
        at = materialise(at.join(names, F.col("id") == F.col("parent")).select(F.col("child").alias("id"), F.concat_ws("/", "path", "name").alias("path")))
        if at.isEmpty():
            break
        out.append(at)
    return reduce(DataFrame.unionByName, out or [at])


def id_paths(tree: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(node, path) of the given nodes (column ``node``), or of all.  Paths of nodes with children are made level by level
    from the top; every node then takes its parent's path once."""
    rows = materialise(tree.select("id", F.abs("pid").alias("parent"), F.col("n").alias("name")))
    inner = materialise(rows.join(rows.select(F.col("parent").alias("id")).distinct(), "id", "left_semi"))
    at = materialise(inner.join(inner.select(F.col("id").alias("parent")), "parent", "left_anti").select("id", F.col("name").alias("path")))
    above, children = at, inner.withColumnRenamed("id", "child")
    for _ in _rounds(None):
        at = materialise(at.join(children, F.col("id") == F.col("parent")).select(F.col("child").alias("id"), F.concat_ws("/", "path", "name").alias("path")))
        if at.isEmpty():
            break
        above = above.unionByName(at)
    if above.count() < inner.count():
        raise ValueError("the tree has a cycle")
    asked = rows if start is None else rows.join(start.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    met = asked.join(above.select(F.col("id").alias("parent"), "path"), "parent", "left")
    return met.select(F.col("id").alias("node"), F.concat_ws("/", "path", "name").alias("path"))


def path_prefixes(path: Column) -> Column:
    """All proper prefixes of a path and itself, as an array: what mkdir -p has to make."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def creates_cycle(tree: DataFrame, moves: DataFrame) -> DataFrame:
    """(id, pid, cycle) of moves (id, pid): a node must not move below itself."""
    ups = climb(tree, moves.select(F.col("pid").alias("node")).distinct()).select(F.col("node").alias("pid"), F.col("ancestor").alias("id"), F.lit(True).alias("cycle"))
    return moves.join(ups, ["id", "pid"], "left").select("id", "pid", F.coalesce("cycle", F.lit(False)).alias("cycle"))
