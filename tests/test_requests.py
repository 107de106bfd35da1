"""Overlays at every journal row and moves from every tree node, against brute force."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from cairnlake.catalog import Store
from cairnlake.operators import hierarchy, intervals

DATA = "/root/testdata/sf0.001"


def test_overlay_at_every_journal_row(spark):
    journal = Store(spark, DATA).journal
    rows = [(r.seq, r.file_id, r.off, r.len) for r in journal.collect()]
    held = defaultdict(dict)
    for seq, file_id, off, n in sorted(rows):
        held[file_id].update(dict.fromkeys(range(off, off + n), seq))
    want = Counter()
    for seq, file_id, off, _ in rows:
        start = max(0, off - 700)
        want.update((seq, held[file_id].get(p)) for p in range(start, start + 1500))
    reads = journal.select(F.col("seq").alias("read_id"), "file_id", F.greatest(F.lit(0), F.col("off") - 700).alias("off"), F.lit(1500).cast("long").alias("len"))
    got = intervals.overlay(reads, journal, 512).groupBy("read_id", "seq").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("n"))
    assert {(r.read_id, r.seq): r.n for r in got.collect()} == want


def test_moves_of_every_node(spark):
    tree = Store(spark, DATA).tree
    up = {r.id: abs(r.pid) for r in tree.collect()}

    def above(node):
        while node in up:
            yield node
            node = up[node]

    moves = {(x, 10001) for x in up} | {(a, x) for x in up for a in above(x)}
    want = {(x, p): x in above(p) for x, p in moves}
    got = hierarchy.creates_cycle(tree, spark.createDataFrame(sorted(moves), "id long, pid long"))
    assert {(r.id, r.pid): r.cycle for r in got.collect()} == want and set(want.values()) == {True, False}
