"""The operators that SQL can express: on the small tables and on odd rows."""

import duckdb
import pytest

from cairnlake.llm import decontamination, license_scan, mixing, queries, sharding, url_reputation

BENCH = [(0, " ".join(f"w{i}" for i in range(40))), (1, None), (2, ""), (3, "one two"), (4, "one two"), (4, "One, TWO!"), (None, "tab and feed"), (5, " ".join(f"w{i}" for i in range(40)))]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_oracle(name, agree):
    agree(queries.QUERIES[name], queries.SQL[name])


@pytest.fixture(scope="module")
def compare(plain_rows):
    def check(frame, sql, **tables):
        con = duckdb.connect()
        for name, df in tables.items():
            con.register(name, df.toArrow())
        assert plain_rows(frame.toPandas()) == plain_rows(con.execute(sql).df())

    return check


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


def test_odd_rows(odd, bench, compare):
    compare(decontamination.digest(odd, bench), decontamination.SQL, documents=odd, benchmark=bench)
    compare(mixing.digest(odd), mixing.SQL, documents=odd)
    compare(license_scan.digest(odd), license_scan.SQL, documents=odd)
    short = odd.where("doc_id != 8")  # the oracle's checksum goes bit by bit
    compare(sharding.digest(short), sharding.SQL, documents=short)


def test_empty_tables(nothing, bench, spark):
    assert decontamination.digest(nothing, bench).count() == 0
    assert mixing.digest(nothing).count() == 0 and mixing.mix_documents(nothing).count() == 0
    assert license_scan.digest(nothing).count() == 0
    assert sharding.digest(nothing).count() == 0
    pages, labels = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert url_reputation.digest(pages, labels).count() == 0


def test_empty_benchmark(odd, bench):
    assert decontamination.digest(odd, bench.where("false")).where("contaminated OR n_items > 0").count() == 0


def test_repeated_rows(repeated, bench):
    n = repeated.count()
    for frame in (decontamination.digest(repeated, bench), mixing.digest(repeated), license_scan.digest(repeated), sharding.digest(repeated)):
        assert frame.count() == n
    slots = sharding.digest(repeated).groupBy("shard").agg({"slot": "max", "*": "count"}).collect()
    assert all(r["max(slot)"] == r["count(1)"] - 1 for r in slots)


def test_operators_keep_clashing_columns(repeated, bench):
    n = repeated.count()
    cut = decontamination.decontaminate(repeated, bench, mode="spans")
    assert cut.columns == repeated.columns and cut.count() == n
    assert {r.row for r in cut.select("row").collect()} == {"mine row"}
    kept = decontamination.decontaminate(repeated, bench)
    bad = decontamination.contamination(repeated, bench).where("n_hit > 0").count()
    assert kept.columns == repeated.columns and kept.count() == n - bad and bad
    assert mixing.mix_documents(repeated).columns == repeated.columns
    assert sharding.shard_documents(repeated).count() == n


def test_spans_are_cut_and_the_rest_stays(spark):
    text = "Before, this: " + " ".join(f"W{i}" for i in range(5, 25)) + ". After -- it!"
    docs = spark.createDataFrame([(1, text), (2, "clean text")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(f"w{i}" for i in range(40)))], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontamination.decontaminate(docs, bench, mode="spans").collect()}
    assert got == {1: "Before, this. After -- it!", 2: "clean text"}


@pytest.mark.parametrize("mode", ["documents", "spans"])
def test_hits_in_long_documents_go(spark, mode):
    item = " ".join(f"b{i}" for i in range(15))
    text = " ".join(f"x{i}" for i in range(500)) + f" {item} " + " ".join(f"y{i}" for i in range(500))
    docs = spark.createDataFrame([(1, text), (2, "clean text")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    row = decontamination.digest(docs, bench).where("doc_id = 1").first()
    assert (row.n_words, row.n_hit, row.contaminated) == (1015, 15, False)
    got = {r.doc_id: r.text for r in decontamination.decontaminate(docs, bench, mode=mode).collect()}
    assert set(got) == ({2} if mode == "documents" else {1, 2})
    assert all("b3" not in t for t in got.values()) and got.get(1, text).count("x") + got.get(1, text).count("y") == 1000


def test_several_passes_over_the_benchmark(odd, bench, monkeypatch, compare):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 700)
    compare(decontamination.digest(odd, bench), decontamination.SQL, documents=odd, benchmark=bench)


def test_hash_hits_need_equal_words(odd, bench, monkeypatch, compare, spark):
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(1).cast("long"))  # all hashes collide
    compare(decontamination.digest(odd.where("doc_id != 8"), bench), decontamination.SQL, documents=odd.where("doc_id != 8"), benchmark=bench)


def test_very_many_spans(spark):
    docs = spark.createDataFrame([(1, "zz a " * 100_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, "zz")], "item_id long, text string")
    row = decontamination.contamination(docs, bench).first()
    assert row.n_hit == 100_000 and len(row.spans) == 100_000
    assert decontamination.decontaminate(docs, bench, mode="spans").first().text.split() == ["a"] * 100_000


def test_no_broadcast_beyond_the_bound(odd, bench, monkeypatch, compare):
    for module in (decontamination, mixing, sharding):
        monkeypatch.setattr(module, "bounded_broadcast", lambda df, rows=0: df)
    compare(decontamination.digest(odd, bench), decontamination.SQL, documents=odd, benchmark=bench)
    compare(mixing.digest(odd), mixing.SQL, documents=odd)
    short = odd.where("doc_id != 8")  # the oracle's checksum goes bit by bit
    compare(sharding.digest(short), sharding.SQL, documents=short)


def test_jump_hash_is_the_published_one(spark):
    from pyspark.sql import functions as F

    def jump(key, buckets):
        key, b, j = key % 2**64, -1, 0
        while j < buckets:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    keys = [0, 1, -1, 2**63 - 1, -(2**63), 0xDEAD10CC, *range(100, 160)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 7, 24, 100):
        assert [r[0] for r in df.select(sharding.jump_hash(F.col("k"), n)).collect()] == [jump(k, n) for k in keys]


def test_ids_in_steps_and_one_hot_id_fill_many_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F

    seen, real = [], sharding.materialise
    monkeypatch.setattr(sharding, "materialise", lambda df: seen.append(df.count()) or real(df))
    sharding.digest(spark.range(5000).selectExpr("id * 64 AS doc_id", "'x' AS text")).count()
    sharding.digest(spark.range(5000).selectExpr("7L AS doc_id", "cast(id AS string) AS text")).count()
    assert seen[0] > 1000 and seen[1] == 64
    named = sharding.shard_documents(spark.range(500).select(F.concat(F.lit("doc "), "id").alias("doc_id"), F.lit("x").alias("text")))
    assert named.select("shard").distinct().count() == 24


def test_grown_shards_only_gain(spark):
    df = sharding.digest(spark.range(5000).selectExpr("id AS doc_id", "'x' AS text"))
    assert df.where("grown_shard != shard AND grown_shard != 24").count() == 0
    assert 100 < df.where("grown_shard = 24").count() < 320


def test_mix_meets_targets(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 's0' ELSE concat('s', id % 11) END AS source", "repeat('word ', cast(1 + id % 90 AS int)) AS text")
    rows = mixing.digest(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    rows["part"] = (rows["target"] / rows["source_size"]) % 1
    rows["spread"] = rows["size"] ** 2 * rows["part"] * (1 - rows["part"])
    for _, of in rows.groupby("source"):  # one draw a document: four standard deviations
        assert abs(of["taken"].sum() - of["target"].iloc[0]) <= 4 * of["spread"].sum() ** 0.5
    assert mixing.digest(docs).where("taken > 3 * size").count() == 0


def test_another_document_of_no_words_changes_no_draw(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "concat('s', id % 3) AS source", "repeat('word ', cast(1 + id % 90 AS int)) AS text")
    more = docs.unionByName(spark.createDataFrame([(10**6, "s1", "")], "doc_id long, source string, text string"))
    rows = lambda df: {tuple(r) for r in mixing.digest(df).where("doc_id < 500").collect()}
    assert rows(docs) == rows(more)


def test_urls(spark, compare):
    urls = [None, "", "no scheme", "http://", "https://A.Example.ORG/es/x?y#z", "http://example.org", "http://example.org/", "http://x.com/fr/1", "http://x.com/de/", "http://xcom/fr/", "ftp://u@h.net:80/a?b", "http://a//b://c"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(3, None), (None, "http://h.net/")], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0, 1) for i in (3, 10)] + [(10, None, None), (None, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    compare(url_reputation.digest(pages, labels), url_reputation.SQL, pages=pages, labels=labels)
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_reputation.digest(pages.where("page_id > 3"), labels).collect()}
    assert got[4] == ("a.example.org", "/es/x", "example.org/es/")
    assert got[5] == ("example.org", "", None) and got[6] == ("example.org", "/", "org/")
    assert got[7][2] == "com/fr/" and got[8][2] == "com/de/" and got[9][2] is None
    assert got[10] == ("u@h.net:80", "/a", None)


def test_domains_below_long_suffixes_and_addresses(spark, compare):
    hosts = {"a.shop.co.uk": ("co.uk", "shop.co.uk"), "co.uk": ("co.uk", "co.uk"), "www.x.com": ("com", "x.com"), "10.0.0.7:80": ("ip", "10.0.0.7"), "u@[::1]:8": ("ip", "[::1]"), "localhost": ("localhost", "localhost")}
    pages = spark.createDataFrame([(i, f"http://{h}/p") for i, h in enumerate(hosts)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    compare(url_reputation.digest(pages, labels), url_reputation.SQL, pages=pages, labels=labels)
    outcomes = labels.selectExpr("doc_id AS page_id", "1 - quality AS bad")
    known = url_reputation.host_reputation(pages.select("page_id", url_reputation.url_host(pages.url).alias("host")), outcomes)
    assert {r.host: (r.suffix, r.domain) for r in known.collect()} == hosts


def test_judged_pages_keep_clashing_columns(spark):
    names = ["row", "host", "path", "rule", "verdict", "suffix", "domain", "n", "bad", "rho"]
    pages = spark.createDataFrame([(1, "http://x.com/", *names), (None, None, *[None] * len(names))], "page_id long, url string, " + ", ".join(f"{x} string" for x in names))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = url_reputation.judge_pages(pages, labels).select("row.*")
    assert got.columns == pages.columns and {r.host for r in got.collect()} == {"host", None}


def test_licence_paragraphs_with_changed_words(spark, compare):
    rows, want = [], {}
    for t, (label, text, phrase) in enumerate(license_scan.TEMPLATES):
        at = license_scan.phrase_place(text, phrase)
        words = text.split()
        moved = words[:at] + ["stray"] * 2 + words[at:] if at > 3 else words  # words before the phrase displace it
        rows += [(2 * t, " ".join(["lead"] * 9 + words)), (2 * t + 1, "x " + " ".join(moved).upper())]
        want[2 * t] = want[2 * t + 1] = label
    rows.append((999, "the software is provided under a licence of any kind to any person"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = license_scan.digest(docs)
    assert all(want[r.doc_id] in r.labels.split(",") for r in got.collect() if r.doc_id < 999)
    assert got.where("doc_id = 999").first().labels == ""
    compare(got, license_scan.SQL, documents=docs)


def test_bad_hosts_are_blocked(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i < 60 else 'h' + str(i % 9)}.site.net/p") for i in range(300)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i < 60 or i % 20 == 0 else 1, 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    got = url_reputation.digest(pages, labels)
    assert {r.host for r in got.where("verdict = 'block'").collect()} == {"bad.site.net"}
    assert got.where("verdict = 'block'").count() == 60
