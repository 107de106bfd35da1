"""Literal cases: probes, listings, conflicts, scrub, retention, journals, cron."""

import pytest
from pyspark.sql import functions as F

from cairnlake.functions import cron, payload, text
from cairnlake.operators import dedup, hierarchy, integrity, intervals, listing, packing, retention, snapshots, writes

DATA = "id long, os long, h long, x long, s0 long, s1 long, s2 long, s3 long"
PROBE = "pos long, os long, h long, x long, s0 long, s1 long, s2 long, s3 long"
OBJ = "id long, pid long, did long, s long, m long, t int, n string, e string, md long"


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_probe_by_header_and_in_full(spark):
    words = (-2039914840885289964, -7278955230309402332, 2859295262623109964, -6587190536697628587)
    data = spark.createDataFrame([(77, 1, 222, 333, *words)], DATA)
    head = (0, 0, 0, 0, 0)
    probes = [(0, 1, 222, *head), (1, 0, 222, *head), (2, 1, 0, *head), (3, 1, 0, 333, *words), (4, 1, 222, *head), (5, 1, 111, *head), (6, 1, 222, 333, *words), (7, 1, 222, 334, *words)]
    got = dict(values(dedup.probe(data, spark.createDataFrame(probes, PROBE)), "pos", "ref"))
    assert got == {0: 1, 1: 0, 2: 0, 3: 0, 4: 1, 5: 0, 6: 77, 7: 0}


def test_probe_marks_later_equals_of_a_miss(spark):
    data = spark.createDataFrame([(9, 100, 12345, 67890, 11111, 22222, 33333, 44444)], DATA)
    new = (200, 99999, 88888, 77777, 88888, 99999, 10000)
    probes = spark.createDataFrame([(0, *new), (1, *new), (2, 100, 12345, 67890, 11111, 22222, 33333, 44444)], PROBE)
    assert dict(values(dedup.probe(data, probes), "pos", "ref")) == {0: 0, 1: -1, 2: 9}
    ids = spark.createDataFrame([(0, 5), (1, -1)], "pos long, id long")
    assert dict(values(dedup.resolve_batch(ids), "pos", "id")) == {0: 5, 1: 5}


@pytest.fixture(scope="module")
def directory(spark):
    rows = [(1, 7, 0, 0, 101, 1, "test1"), (2, 7, 0, 2, 102, 2, "test2"), (3, 7, 0, 3, 103, 3, "test3"), (4, 7, 0, 3, 103, 4, "test4"), (5, 7, 0, 4, 104, 4, "test5")]
    return spark.createDataFrame([(*r, "", 0) for r in rows], OBJ)


@pytest.mark.parametrize(
    "order, cursor, count, word, ids, last",
    [
        ("id", None, 2, "", [1, 2], "2"),
        ("id", "2", 2, "", [3, 4], "4"),
        ("id", "5", 2, "", [], None),
        ("id", None, 9, "xxx", [], None),
        ("id", None, 9, "test1", [1], "1"),
        ("id", None, 2, "?es*", [1, 2], "2"),
        ("id", None, 9, "TEST1", [], None),
        ("id", None, 9, "TEST1*", [1], "1"),
        ("-id", None, 9, "", [5, 4, 3, 2, 1], "1"),
        ("-name", None, 9, "", [5, 4, 3, 2, 1], "test1"),
        ("+mtime", None, 3, "", [1, 2, 3], "103:3"),
        ("-mtime", None, 2, "", [5, 3], "103:3"),
        ("-mtime", "103:3", 2, "", [4, 2], "102:2"),
        ("-size", None, 2, "", [5, 3], "3:3"),
        ("-type", None, 1, "", [4], "4:4"),
        ("-type", "4:4", 1, "", [5], "4:5"),
        ("id", None, 0, "", [], None),
    ],
)
def test_listing(directory, order, cursor, count, word, ids, last):
    page, total = listing.list_objects(directory, 7, word=word, order=order, cursor=cursor, count=count)
    rows = values(page, "id", "cursor")
    assert [r[0] for r in rows] == ids
    assert not rows or rows[-1][1] == last
    if not word:
        assert total.first()[0] == 5


def test_unknown_order_raises():
    with pytest.raises(ValueError):
        listing.order_field("-owner")


def test_name_conflict_within_a_batch(spark, directory):
    rows = [(21, 7, 0, 0, 1, 2, "test", "", 0, 0), (20, 7, 0, 0, 1, 2, "test", "", 0, 1)]
    obj = directory.unionByName(spark.createDataFrame([(20, 7, 0, 0, 1, 2, "test", "", 0)], OBJ))
    table, answers = writes.replace_into(obj, spark.createDataFrame(rows, OBJ + ", seq long"))
    assert dict(values(answers, "seq", "id")) == {0: 0, 1: 20}
    assert [r for r in values(table, "id", "n") if r[1] == "test"] == [(20, "test")]


def test_scrub_classes(spark):
    data = spark.createDataFrame([(1, 10), (2, 10), (3, 30), (4, 30), (5, 9)], "id long, s long")
    files = [(1, 0, 10), (3, 0, 10), (3, 1, 10), (3, 2, 10), (4, 0, 10), (4, 2, 20), (5, 0, 8), (6, 0, 1)]
    chunk = spark.createDataFrame(files, "data_id long, sn int, size long")
    issues = integrity.scrub(data, chunk)
    assert dict(values(issues, "id", "category")) == {2: "corrupted", 4: "corrupted", 5: "mismatched", 6: "orphaned"}
    assert dict(values(integrity.dirty(data, chunk), "id", "reason")) == {4: "gap", 5: "size"}
    assert dict(values(integrity.prefix_size(chunk), "data_id", "size"))[4] == 10
    ref = spark.createDataFrame([(2, 1), (4, -1)], "did long, pid long")
    assert dict(values(integrity.fix_plan(issues, ref), "id", "action")) == {2: "keep", 4: "delete row", 5: "delete row", 6: "delete files"}
    assert dict(values(integrity.unreferenced(chunk, data, ref), "data_id", "reason"))[4] == "no reference"


def test_retention_keeps_the_newest(spark):
    rows = [(i, 1, i, 100 + i, 1000 + 100 * i, 3, f"v{i}", 0) for i in range(8)]
    version = spark.createDataFrame(rows, "id long, pid long, did long, s long, m long, t int, n string, base long")
    assert not retention.window_rule(version, 10).count()
    gone = retention.max_versions_rule(version, version.where("false").select("id", "pid"), 5, 2)
    assert sorted(values(gone, "id")) == [(0,), (1,), (2,)]
    assert sorted(values(retention.retention(version, 10, 5, 2, 3), "id", "rule")) == [(i, "versions") for i in range(3)]


def test_overlay_and_coverage(spark):
    w = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 5, 10), (1, 3, 20, 5), (1, 4, 7, 1)], "file_id long, seq long, off long, len long")
    r = spark.createDataFrame([(9, 1, 3, 25)], "read_id long, file_id long, off long, len long")
    got = sorted(values(intervals.overlay(r, w, 4), "start", "end", "seq"), key=lambda x: x[0])
    assert got == [(3, 5, 1), (5, 7, 2), (7, 8, 4), (8, 10, 2), (10, 15, 2), (15, 20, None), (20, 25, 3), (25, 28, None)]
    assert sorted(values(intervals.coverage(w), "start", "end")) == [(0, 15), (20, 25)]
    assert values(intervals.modified_bytes(w), "modified") == [(20,)]
    assert sorted(values(intervals.complete_chunks(w, 5), "sn")) == [(0,), (1,), (2,), (4,)]


def test_journal_bytes_round_trip(spark):
    rows = [(1, 1, 0, b"abc"), (1, 2, 5, b"xy"), (1, 3, 1, b"Q")]
    w = spark.createDataFrame(rows, "file_id long, seq long, off long, body binary")
    back = payload.unpack_journals(payload.pack_journals(w))
    assert [(r.off, r.len, bytes(r.body)) for r in back.orderBy("nth").collect()] == [(0, 3, b"abc"), (5, 2, b"xy"), (1, 1, b"Q")]
    base = spark.createDataFrame([(1, b"0123456789")], "file_id long, bytes binary")
    assert bytes(payload.overlay_files(base, w).first().bytes) == b"aQc34xy789"


def test_empty_content_has_fixed_checksums(spark):
    row = spark.createDataFrame([(b"",)], "b binary").select(*payload.checksums(F.col("b"))).first()
    assert tuple(row) == (payload.EMPTY_XXH3, payload.EMPTY_XXH3, -2039914840885289964, -7278955230309402332, 2859295262623109964, -6587190536697628587)


def test_journal_extra(spark):
    df = spark.createDataFrame([(2**60 + 1, -5, 7)], "a long, b long, c long")
    coded = df.select(text.encode_journal_extra(F.col("a"), F.col("b"), F.col("c")).alias("e"))
    assert len(coded.first().e) == 28
    assert tuple(coded.select(text.journal_extra(F.col("e")).alias("x")).first().x) == (2**60 + 1, -5, 7)
    odd = spark.createDataFrame([("",), ("{",), ("AAAA",), (None,)], "e string")
    assert all(r.x is None or r.x.data_id is None for r in odd.select(text.journal_extra(F.col("e")).alias("x")).collect())


def test_cron():
    assert cron.parse("0 1-3 * 1,6 *")[:2] == [[0], [1, 2, 3]]
    assert cron.parse("0 1-3 * 1,1,6 *")[3] == [1, 6]
    for bad in ("* * * *", "60 * * * *", "* * 0 * *", "5-1 * * * *", "x * * * *"):
        with pytest.raises(ValueError):
            cron.parse(bad)


def test_cron_matches_weekday(spark):
    times = spark.createDataFrame([("2024-01-07 02:15:00",), ("2024-01-08 02:15:00",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert [r[0] for r in times.select(cron.matches(F.col("t"), "15 2 * * 0")).collect()] == [True, False]


def test_restore(spark):
    path = spark.createDataFrame([(1, 5, 11, 10, 1, "/a"), (2, 5, 12, 20, 2, "/b")], "id long, pid long, did long, s long, m long, path string")
    rows = spark.createDataFrame([(1, 1, "/a", 10, 9, 0), (1, 3, "/c", 13, 30, 0)], "snapshot_id long, obj_id long, path string, data_id long, size long, mtime long")
    got = {r.path: (r.data_id, r.status) for r in snapshots.restore(path, rows, 1).collect()}
    assert got == {"/a": (10, 0), "/b": (12, 1), "/c": (13, 0)}


def test_packing(spark):
    files = spark.createDataFrame([(1, i, s) for i, s in enumerate([10, 20, 30, 40, 100])], "bkt_id long, id long, size long")
    assert dict(values(packing.next_fit(files, 60), "id", "package")) == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2}
    hole = spark.createDataFrame([(1, 7, 100, 35), (1, 8, 0, 100)], "bkt_id long, pi long, start long, size long")
    assert sorted(values(packing.best_fit(hole, files), "id", "pi", "po")) == [(2, 7, 100), (4, 8, 0)]
    valid = spark.createDataFrame([(1, 7, 10, 5), (2, 7, 20, 5)], "id long, pi long, po long, os long")
    whole = spark.createDataFrame([(7, 40), (8, 9)], "pi long, size long")
    assert sorted(values(packing.holes(valid, whole), "pi", "start", "size")) == [(7, 0, 10), (7, 15, 5), (7, 25, 15), (8, 0, 9)]


def test_cycle_stops(spark):
    tree = spark.createDataFrame([(1, 2, "a", 5, 0), (2, 1, "b", 7, 0)], "id long, pid long, n string, s long, did long")
    assert hierarchy.climb(tree, tree.select(F.col("id").alias("node")), depth=4).count() == 10


def test_glob():
    import re

    for pattern, name, fits in (("*.tmp", "a.tmp", True), ("*.tmp", "a/b.tmp", False), ("a?c", "abc", True), ("[ab]*", "bx", True), ("a.b", "axb", False)):
        assert bool(re.match(listing.glob_regex(pattern), name)) is fits


def test_streams(spark, tmp_path):
    from cairnlake.streaming import jobs

    spark.range(10).selectExpr("id", "id * 10 AS size").write.parquet(str(tmp_path / "in"))
    seen = []
    run = jobs.buffered_writes(jobs.read_table(spark, str(tmp_path / "in")), lambda batch, number: seen.append(batch.count()), "1 second", str(tmp_path / "cp"))
    run.processAllAvailable()
    run.stop()
    assert sum(seen) == 10


def test_pending_deletions(spark, tmp_path):
    from cairnlake.streaming import jobs

    def put(rows):
        made = spark.createDataFrame(rows, "key string, at long, action string, deadline_s long").selectExpr("key", "timestamp_seconds(at) AS ts", "action", "deadline_s")
        made.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put([("a", 100, "delete", 10), ("b", 100, "delete", 10), ("b", 105, "cancel", 0)])
    stream = jobs.read_table(spark, str(tmp_path / "in")).withWatermark("ts", "1 second")
    run = jobs.pending_deletions(stream).writeStream.format("memory").queryName("due").outputMode("append").start()
    run.processAllAvailable()
    put([("y", 2000, "delete", 10)])
    run.processAllAvailable()
    run.stop()
    got = {r.key: r.due for r in spark.table("due").collect()}
    assert got == {"a": 110}


def test_chunk_folder(spark, tmp_path):
    from cairnlake.sources import files

    names = spark.createDataFrame([(5, 0), (5, 1)], "data_id long, sn int")
    for r in files.chunk_names(names).collect():
        f = tmp_path / r.path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x" * 7)
    (tmp_path / "5_2").write_bytes(b"x")
    got = files.chunk_files(spark, str(tmp_path))
    assert sorted(values(got, "data_id", "sn", "valid", "size")) == [(5, 0, True, 7), (5, 1, True, 7), (5, 2, False, 1)]
