"""The whole-table forms against brute force."""

import pytest
from pyspark.sql import functions as F

from cairnlake import plans
from cairnlake.catalog import Store
from cairnlake.functions import payload
from cairnlake.operators import dedup, hierarchy, packing

DATA = "/root/testdata/sf0.001"
plans.load()


@pytest.fixture(scope="module")
def store(spark):
    return Store(spark, DATA)


@pytest.fixture(scope="module")
def parents(store):
    return {r.id: (abs(r.pid), r.n) for r in store.tree.collect()}


def plain_paths(parents):
    out = {}
    for node in parents:
        names, at = [], node
        while at in parents:
            names.append(parents[at][1])
            at = parents[at][0]
        out[node] = "/".join(reversed(names))
    return out


def test_id_to_path_of_every_node(spark, parents):
    got = {r.node: r.path for r in plans.QUERIES["o139_id_to_path"](spark, DATA).collect()}
    assert got == plain_paths(parents) and max(got) > 20_000_000_000


def test_path_to_id_and_pending_path_of_every_node(spark, parents):
    want = plain_paths(parents)
    assert {r.id: r.path for r in plans.QUERIES["o138_path_to_id"](spark, DATA).collect()} == want
    assert {r.id: r.path for r in plans.QUERIES["o143_pending_path"](spark, DATA).collect()} == {90000000000 + k: f"{v}/new" for k, v in want.items()}


def test_resolve_batch_of_the_whole_table(spark):
    large = DATA.replace("0.001", "0.01")
    ids = sorted(r.id for r in Store(spark, large).data.select("id").collect())
    batch = [-(p - 1) - 1 if i % 4 == 3 else i for p, i in enumerate(ids)]
    got = {r.pos: r.id for r in plans.QUERIES["o221_resolve_batch"](spark, large).collect()}
    assert got == {p: batch[-i - 1] if i < 0 else i for p, i in enumerate(batch)} and len(got) > 400


def test_numbering_over_ranges(spark):
    keys = [-25, -10, -9, -1, 0, 3, 9, 10, 11, 500]
    got = {r.id: r.pos for r in dedup.numbered(spark.createDataFrame([(k,) for k in keys], "id long"), "id", 10).collect()}
    assert got == {k: p for p, k in enumerate(keys)}


def test_deeper_trees_raise(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "DEPTH", 3)
    columns = "id long, pid long, n string, s long, did long"
    walks = (lambda t: hierarchy.climb(t, t.select(F.col("id").alias("node"))), lambda t: hierarchy.descend(t, t.where("id = 1").select(F.col("id").alias("root"))), hierarchy.roll_up, hierarchy.paths)
    fits, deep = (spark.createDataFrame([(i, i - 1, f"n{i}", 1, i) for i in range(1, n)], columns) for n in (5, 6))
    for walk in walks:
        assert walk(fits).count() >= 4
        with pytest.raises(ValueError):
            walk(deep)


def test_best_fit_against_a_plain_walk(spark):
    import random

    r = random.Random(3)
    holes = [(b, p, 100 * i, r.choice([1, 3, 8, 20, 45])) for b in range(3) for p in range(4) for i in range(5)]
    files = [(b, 1000 * b + i, r.randrange(1, 15)) for b in range(4) for i in range(40)]
    want = set()
    for b in range(3):
        left = sorted((s, i) for x, i, s in files if x == b)
        average = sum(s for s, _ in left) // len(left)
        for _, p, at, room in sorted(h for h in holes if h[0] == b):
            fits = [x for x in left if x[0] <= room]
            chosen = [min(x for x in fits if x[0] == fits[-1][0])] if fits else []
            if room > 2 * average and len(left) > 1:
                total, group = 0, []
                for x in left:
                    if total + x[0] <= room:
                        total += x[0]
                        group.append(x)
                if len(group) > 1 and (total > 0.8 * room or (chosen and total > chosen[0][0])):
                    chosen = group
            for x in chosen:
                want.add((x[1], p, at))
                at += x[0]
                left.remove(x)
    got = packing.best_fit(spark.createDataFrame(holes, "bkt_id long, pi long, start long, size long"), spark.createDataFrame(files, "bkt_id long, id long, size long"))
    assert {tuple(x) for x in got.select("id", "pi", "po").collect()} == want and want


def test_codecs_round_trip(spark):
    texts = ["", "a", "ab" * 5000, "é漢字" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.encode("t", "UTF-8").alias("b"))
    for codec in (payload.ZSTD, payload.GZIP, payload.SNAPPY, payload.BROTLI):
        got = df.select("t", F.decode(payload.decompress(payload.compress(F.col("b"), codec), codec), "UTF-8").alias("back"), payload.process(F.col("b"), codec)["kind"].alias("kind"))
        assert all(r.t == r.back and (r.kind & codec != 0) == (len(r.t) > 100) for r in got.collect())
