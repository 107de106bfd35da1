"""The operators that SQL cannot express, against plain versions; and the pipeline."""

import collections
import hashlib
import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnlake.llm import language, minhash, passage_dedup, quality, suffix_dedup
from cairnlake.llm.components import connected_components

DATA = "/root/testdata/sf0.001"


def words(n, seed, vocabulary=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


# -- quality rules

def plain_statistics(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dups = set(), 0
    for x in lines:
        dups += x in seen
        seen.add(x)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = collections.Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(hit)


def test_rule_statistics(docs, odd_rows):
    texts = [r.text for r in docs.select("text").collect()] + [r[1] for r in odd_rows] + ["a b c a b c a b", "x x x x", "a\n\na\n a\na"]
    for t in texts:
        assert quality.rule_statistics(t)[:5] == plain_statistics(t)


def test_quality_keeps_good_and_drops_bad(docs, labels):
    got = quality.digest(docs, labels).join(labels, "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in got.where("NOT base_failed").groupBy("quality", "kept").count().collect()}
    assert n.get((1, True), 0) >= 0.98 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, False), 0) >= 0.8 * (n.get((0, True), 0) + n.get((0, False), 0))


def test_quality_on_labels_that_the_fit_has_not_seen(docs, labels):
    seen, unseen = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = quality.digest(docs, seen).join(unseen, "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in got.where("NOT base_failed").groupBy("quality", "kept").count().collect()}
    assert n.get((1, True), 0) >= 0.95 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, False), 0) >= 0.7 * (n.get((0, True), 0) + n.get((0, False), 0))


def test_statistics_of_a_very_long_text():
    text = " ".join(words(300_000, 5, 10**9)) + " a b c a b c"
    assert quality.rule_statistics(text)[4] == 6


def test_digest_against_a_walk_of_the_whole_query(docs, labels):
    forest, threshold = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.digest(docs, labels).collect()}
    for r in docs.collect():
        n, _, _, _, repeats = plain_statistics(r.text)
        stats = np.array([quality.rule_statistics(r.text)], np.int64)
        failed = n < 50 or 100 * repeats > 50 * n
        assert got[r.doc_id].base_failed == failed
        assert got[r.doc_id].kept == (not failed and quality.score_forest(forest, quality.features(stats))[0] <= threshold)


def test_quality_of_odd_rows(repeated, nothing, labels):
    assert quality.digest(nothing, labels).count() == 0
    got = quality.digest(repeated, labels.where("false"))
    assert got.count() == repeated.count()
    assert got.where("kept != (NOT base_failed)").count() == 0


def test_forest_scores_match_a_walk():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(300, 4))
    forest = quality.fit_forest(rows, rows.min(axis=0) - 1, rows.max(axis=0) + 1, trees=7, subsample=64)

    def path(t, row):
        node = 0
        while forest["feature"][t, node] >= 0:
            node = 2 * node + 1 + int(row[forest["feature"][t, node]] >= forest["split"][t, node])
        return forest["path"][t, node]

    want = [2 ** (-np.mean([path(t, r) for t in range(7)]) / forest["norm"]) for r in rows[:40]]
    assert np.allclose(quality.score_forest(forest, rows[:40]), want)
    far = quality.score_forest(forest, np.full((1, 4), 99.0))
    assert far[0] > np.quantile(quality.score_forest(forest, rows), 0.9)


def test_threshold():
    scores, good = np.array([0.1, 0.2, 0.3, 0.8, 0.9]), np.array([True, True, True, False, False])
    assert 0.3 < quality.calibrate(scores, good) < 0.8
    assert quality.calibrate(scores, np.ones(5, bool)) == np.inf


def test_fit_uses_every_labelled_row(spark):
    """More rows than the sample that the fit once took, and a threshold that each of them decides."""
    words = F.transform(F.sequence(F.lit(1), (F.col("id") % 17 + 52).cast("int")), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(9000)).cast("string")))
    few = spark.range(22_000).select(F.col("id").alias("doc_id"), F.concat(F.array_join(words, " "), F.repeat(F.lit(" #$%"), (F.col("id") % 11).cast("int"))).alias("text"))
    labels = few.select("doc_id", F.when(F.col("doc_id") % 11 > F.pmod(F.xxhash64("doc_id"), F.lit(14)), 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic"))
    forest, threshold = quality.fit(few, labels)
    rows = few.join(labels, "doc_id").collect()
    stats = np.array([quality.rule_statistics(r.text) for r in rows], np.int64)
    assert len(rows) == 22_000 and (stats[:, 0] >= quality.MIN_WORDS).all()
    scores, good = quality.score_forest(forest, quality.features(stats)), np.array([r.quality == 1 for r in rows])
    assert threshold == quality.calibrate(scores, good)
    assert {r.doc_id: r.kept for r in quality.digest(few, labels).collect()} == {r.doc_id: bool(x <= threshold) for r, x in zip(rows, scores)}


@pytest.mark.parametrize("seed", range(4))
def test_threshold_of_a_table_is_that_of_its_rows(spark, seed):
    rng = np.random.default_rng(seed)
    good = rng.random(600) < 0.7
    scores = np.round(np.clip(rng.normal(np.where(good, 0.45, 0.6), 0.06), 0.01, 1), 3)
    table = spark.createDataFrame([(float(s), bool(g)) for s, g in zip(scores, good)], "score double, good boolean")
    assert quality.calibrate_rows(table) == quality.calibrate(scores, good)
    assert quality.calibrate_rows(table.where("good")) == np.inf


# -- near duplicates

def plain_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        sets.setdefault(i, []).append(frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if w else frozenset())
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_near_duplicates(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.component_id for r in minhash.digest(docs).collect()}
    assert got == plain_components(rows, 3, 85)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got == plain_components(rows, 5, 80)


def variants(n, size, edits, seed):
    """A base text and n - 1 copies of it with so many words changed, at most."""
    r, base = random.Random(seed), words(size, seed)
    out = [base]
    for _ in range(n - 1):
        copy = list(base)
        for at in r.sample(range(size), r.randrange(1, edits)):
            copy[at] = f"x{r.randrange(10**6)}"
        out.append(copy)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("block", [500_000, 900])
def test_large_groups_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    rows = list(enumerate(variants(60, 100, 9, 3) + variants(25, 50, 6, 4) + [" ".join(words(80, 99 + i)) for i in range(30)]))
    random.Random(5).shuffle(rows)
    got = {r.doc_id: r.component_id for r in minhash.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows, 3, 85)


def test_repeated_ids_link_their_texts(spark):
    a, b, c = (" ".join(words(40, i)) for i in (1, 2, 3))
    rows = [(3, a), (5, a), (5, b), (9, b), (11, c), (5, c), (12, " ".join(words(40, 4)))]
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 3, True), (5, 3, False), (9, 3, False), (11, 3, False), (12, 12, True)}


@pytest.mark.parametrize("block", [500_000, 700])
def test_boilerplate_is_not_chained_and_no_link_is_lost(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    r, core, rows = random.Random(12), words(60, 77), []
    for i in range(40):  # half of each text is shared
        rows.append((i, " ".join(core + words(55, 500 + i))))
    for i in range(12):  # near copies of some of them, linked to each other but hardly to a hub
        text = rows[i][1].split()
        for j in range(3):
            text[r.randrange(60, 115)] = f"y{r.randrange(10**6)}"
            rows.append((100 + 3 * i + j, " ".join(text)))
    random.Random(6).shuffle(rows)
    got = {x.doc_id: x.component_id for x in minhash.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows, 3, 85)


def test_near_duplicates_of_odd_rows(repeated, repeated_rows, nothing):
    assert minhash.digest(nothing).count() == 0
    got = minhash.digest(repeated).collect()
    want = plain_components([(r[0], r[1]) for r in repeated_rows if r[0] is not None], 3, 85)
    assert len(got) == len(repeated_rows)
    assert all(r.component_id == (None if r.doc_id is None and r.n_shingles else want.get(r.doc_id)) for r in got)
    assert all(r.kept for r in got if r.doc_id is None)
    kept = minhash.drop_near_duplicates(repeated)
    assert kept.columns == repeated.columns
    assert 3 not in {r.doc_id for r in kept.select("doc_id").collect()}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 100)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- repeated passages

def test_passages(spark):
    shared = words(51, 50)
    rows = [(i, " ".join(words(60 + 7 * i, 60 + i))) for i in range(12)]
    rows += [(100 + i, " ".join(words(40 + i, 80 + i) + shared + words(30, 90 + i))) for i in range(6)]
    got = {r.doc_id: r for r in passage_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {100 + i for i in range(6)}
    assert all(100 in r.first_doc_ids and 24 <= r.n_repeat_words <= 51 for r in got.values())
    assert got[100].n_removed_words == 0 and all(got[100 + i].n_removed_words >= 24 for i in range(1, 6))


def test_recall_of_near_equal_passages(spark):
    r = random.Random(31)
    sizes, pairs, n = {51: 0.12, 55: 0.08, 60: 0.04, 80: 0.01, 100: 0.01}, [], 200
    for size in sizes:
        for _ in range(n):
            a = [f"v{r.getrandbits(40)}" for _ in range(size)]
            b = list(a)
            b[r.randrange(size)] = f"v{r.getrandbits(40)}"
            pairs.append((size, a, b))
    rows = []
    for i, (size, a, b) in enumerate(pairs):
        cut = [[frozenset(tuple(x[p + j : p + j + 5]) for j in range(20)) for p in range(size - 23)] for x in (a, b)]
        assert any(100 * len(x & y) >= 80 * len(x | y) for x in cut[0] for y in cut[1])
        rows += [(2 * i + k, " ".join([f"v{r.getrandbits(40)}" for _ in range(30)] + x + [f"v{r.getrandbits(40)}" for _ in range(30)])) for k, x in enumerate((a, b))]
    got = {x.doc_id for x in passage_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = collections.Counter(size for i, (size, _, _) in enumerate(pairs) if not {2 * i, 2 * i + 1} <= got)
    assert all(missed[size] <= most * n for size, most in sizes.items()), missed


def jaccard(a, b):
    x, y = ({tuple(t[j : j + 5]) for j in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_recall_of_near_equal_lines(spark):
    r, rows, n = random.Random(32), [], 0
    while len(rows) < 800:
        size = r.randrange(20, 201)
        a = [f"v{r.getrandbits(40)}" for _ in range(size)]
        b = list(a)
        for _ in range(r.randrange(1, 1 + max(1, size // 40))):
            b[r.choice([0, size - 1, r.randrange(size)])] = f"v{r.getrandbits(40)}"
        if jaccard(a, b) >= 0.8:
            for x in (a, b):
                rows.append((len(rows), "\n".join(" ".join(y) for y in ([f"v{r.getrandbits(40)}" for _ in range(12)], x, [f"v{r.getrandbits(40)}" for _ in range(30)]))))
    got = {x.doc_id for x in passage_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = sum(not {2 * i, 2 * i + 1} <= got for i in range(400))
    assert missed <= 12, missed


def test_repeated_lines_of_the_tables(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    lines = [(i, x.lower().split()) for i, t in texts.items() for x in (t or "").split("\n") if len(x.split()) >= 20]
    grams, often = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for _, w in lines], collections.defaultdict(list)
    want = set()
    for k, x in enumerate(grams):
        for y in {y for g in x for y in often[g]}:
            if lines[y][0] != lines[k][0] and 100 * len(x & grams[y]) >= 80 * len(x | grams[y]):
                want |= {lines[y][0], lines[k][0]}
        for g in x:
            often[g].append(k)
    every = collections.defaultdict(set)
    for i, t in texts.items():
        w = (t or "").lower().split()
        for j in range(len(w) - 4):
            every[tuple(w[j : j + 5])].add(i)
    shares = collections.Counter(i for of in every.values() if len(of) > 1 for i in of)
    got = {r.doc_id: r for r in passage_dedup.digest(docs).collect()}
    assert want and len(want - set(got)) <= 0.02 * len(want)
    assert all(shares[i] >= 12 for i in got)  # 0.8 of the shingles of a paragraph of 20 words
    assert all(r.n_removed_words <= r.n_repeat_words <= len(texts[i].split()) for i, r in got.items())


def test_paragraph_digests_depend_on_the_words_alone():
    line = " ".join(words(40, 7))
    one, two = passage_dedup.Texts([line]), passage_dedup.Texts([" ".join(words(90, 8)) + "\n" + line + "\nand more", None, "short"])
    of = [{(int(key), int(d)) for keys, start, end, digest in t.paragraphs() for key, a, b, d in zip(keys, start, end, digest) if b - a == 40} for t in (one, two)]
    assert of[0] == of[1] and len(of[0]) == passage_dedup.BANDS
    stretch = [{int(d) for keys, start, end, digest in t.paragraphs() for a, b, d in zip(start, end, digest) if b - a == 24} for t in (one, two)]
    assert stretch[0] and stretch[0] <= stretch[1]


def test_repeats_of_short_texts(spark):
    rows = [(10 * n + k, " ".join(words(n, n))) for n in range(18, 28) for k in range(2)]
    got = {r.doc_id: r.n_removed_words for r in passage_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {10 * n + k: n * k for n in range(20, 28) for k in range(2)}


def test_passages_in_blocks(spark, monkeypatch):
    shared = words(30, 50)
    rows = [(i, " ".join(words(40, 80 + i) + shared[:15] + words(3, i) + shared[15:] + words(30, 190 + i))) for i in range(40)]
    rows += [(100 + i, " ".join(words(40, 280 + i) + shared * 2 + words(40, 380 + i))) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, passage_dedup.digest(df).collect()))
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 60)
    monkeypatch.setattr(passage_dedup, "SEGMENT", 50)
    assert sorted(map(tuple, passage_dedup.digest(df).collect())) == want and want


def test_passages_of_odd_rows(repeated, nothing):
    assert passage_dedup.digest(nothing).count() == 0
    assert {r.doc_id for r in passage_dedup.digest(repeated).collect()} == {1, 2, 3}
    cut = passage_dedup.drop_passages(repeated)
    assert cut.columns == repeated.columns and cut.count() == repeated.count()
    texts = {r.doc_id: r.text for r in cut.where("doc_id IS NOT NULL").collect()}
    assert len(texts[3].split()) < 60 and texts[4] is None


# -- repeated byte strings

def plain_removal(texts):
    n = suffix_dedup.LENGTH
    raws = [(t or "").encode() for t in texts]
    often = collections.Counter(b[i : i + n] for b in raws for i in range(len(b) - n + 1))
    out = []
    for b in raws:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if often[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def removal(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return [tuple(r)[1:] for r in suffix_dedup.digest(df).orderBy("doc_id").collect()]


@pytest.mark.parametrize("group, blocks", [(1000, 16), (2, 16), (2, 2)])
def test_suffixes(spark, monkeypatch, group, blocks):
    for name, value in (("GROUP", group), ("BLOCKS", blocks), ("PIECE", 1500), ("BATCH", 3)):
        monkeypatch.setattr(suffix_dedup, name, value)
    r = random.Random(4)
    shared = " ".join(words(60, 1))
    texts = [" ".join(words(r.randrange(20, 90), 100 + i)) + shared[r.randrange(60) : 260 + r.randrange(60)] + " ".join(words(50, 300 + i)) for i in range(30)]
    texts += ["ab" * 300, "ab" * 99 + "c", "é" * 150 + "ü", None, "", "x" * 199, "x" * 200, "y" * 201, shared * 3, texts[0], texts[0], texts[1][:-1] + "?"]
    assert removal(spark, texts) == plain_removal(texts)


def test_suffixes_of_the_tables(spark, docs):
    texts = [r.text for r in docs.orderBy("doc_id").limit(120).collect()]
    assert removal(spark, texts) == plain_removal(texts)


def test_suffixes_of_odd_rows(repeated, repeated_rows, nothing):
    assert suffix_dedup.digest(nothing).count() == 0
    got = collections.Counter(tuple(r)[1:] for r in suffix_dedup.digest(repeated).collect())
    assert got == collections.Counter(plain_removal([r[1] for r in repeated_rows]))
    kept = suffix_dedup.remove_repeats(repeated)
    assert kept.select("row.*").columns == repeated.columns and kept.count() == repeated.count()


def test_levels_grow_geometrically():
    family = suffix_dedup.SuffixFamily()
    for i in range(40):
        rows = np.array([b"%04d" % (10 * i + j) for j in range(10)], "S4")
        assert not len(family.add(rows, np.arange(10 * i, 10 * i + 10)))
    assert len(family.levels) <= 6 and sum(len(w) for w, _ in family.levels) == 400
    assert sorted(family.add(np.array([b"0007", b"0399"], "S4"), np.array([400, 401])).tolist()) == [7, 399, 400, 401]


# -- language

def test_language_on_held_out_rows(docs):
    got = language.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and sum(r.rejected for r in got) <= 0.02 * len(got)


def test_kneser_ney_is_a_distribution():
    code, n = np.unique(language.grams(["abra cadabra barbarian", "a cab bar"])[0], return_counts=True)
    model = language.KneserNey({"x": (code, n), "y": (code[::2], n[::2])})
    for context in (0, ord("a"), (ord("a") << 12) | ord("b"), ord("z")):
        letters = np.array([0, *map(ord, "abcdnri")], np.int64)
        p = np.exp(model.score((context << 12) | letters).astype(float)).sum(axis=0)
        unseen = np.exp(model.score(np.array([(context << 12) | ord("q")])).astype(float))[0]
        assert np.allclose(p + unseen, 1, atol=1e-3)


def test_scores_against_a_plain_model():
    def codes(text):
        return language.grams([text])[0].tolist()

    learned = {"x": "abra cadabra barbarian rabarber", "y": "ici le chat et la chatte", "z": "der hund und die hunde"}
    model = language.KneserNey({k: np.unique(codes(t), return_counts=True) for k, t in learned.items()})
    mask = lambda k: (1 << (12 * k)) - 1
    of = {k: {4: collections.Counter(codes(t))} for k, t in learned.items()}
    for counts in of.values():
        for k in (3, 2, 1):
            counts[k] = collections.Counter(c & mask(k) for c in counts[k + 1])
    letters = len({c for counts in of.values() for c in counts[1]})

    def p(counts, code, k=4):
        if k == 0:
            return 1 / (1 + letters)
        here = counts[k]
        once, twice = (sum(n == m for n in here.values()) for m in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        same = [n for c, n in here.items() if c >> 12 == code >> 12]
        lower = p(counts, code & mask(k - 1), k - 1)
        return lower if not same else max(here[code] - d, 0) / sum(same) + d * len(same) / sum(same) * lower

    for text in ("abra", "le hund barbar", "qqq zz", "chatte und", "A"):
        want = [sum(np.log(p(of[k], c)) for c in codes(text)) for k in "xyz"]
        sums, n = model.totals([text])
        assert np.allclose(sums[0], want, atol=1e-3) and n[0] == len(codes(text))
        names, *_ = language._identify(model, np.array([[9.0, 0.0]] * 3), [text])
        assert names == ["xyz"[int(np.argmax(np.round(want, 6)))]]


def test_grams_in_plain():
    def plain(t):
        ids = [ord(c) if c.isalpha() else 0 for c in t.lower()]
        ids = [c for i, c in enumerate(ids) if c or i == 0 and False or (i > 0 and ids[i - 1])]
        ids = [0, 0, 0, *ids]
        return [sum(ids[i - k] << (12 * k) for k in range(4)) for i in range(3, len(ids))]

    texts = ["Hello,  World!", "", "...", "é Ü", "a"]
    code, n = language.grams(texts)
    assert code.tolist() == [x for t in texts for x in plain(t)]
    assert n.tolist() == [len(plain(t)) for t in texts]


def test_language_of_odd_rows(repeated, nothing, docs):
    assert language.digest(nothing).count() == 0
    got = language.digest(repeated)
    assert got.count() == repeated.count()
    assert {r.lang_pred for r in got.where("doc_id IN (4, 5, 6, 12)").collect()} == {"und"}
    model, limits = language.fit(docs)
    assert language.identify(repeated, model, limits).where("NOT rejected").select("row.*").columns == repeated.columns
    alien = docs.sparkSession.createDataFrame([(1, "這是一個完全不同的語言 " * 40)], "doc_id long, text string")
    assert language.identify(alien, model, limits).first().rejected


# -- the pipeline

def test_pipeline(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    columns = docs.columns
    assert [n for n, _ in pipeline.STAGES] == ["identify_language", "near_dedup", "decontaminate", "mix", "shard"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    one = pipeline.identify_language(spark, docs, DATA)
    assert one.columns == columns and ids(one) <= ids(docs) and len(ids(one)) >= 0.98 * docs.count()
    two = pipeline.near_dedup(spark, docs, DATA)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert two.columns == columns and ids(two) == set(plain_components(rows, 5, 80).values())
    three = pipeline.decontaminate(spark, docs, DATA)
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    from cairnlake.llm import decontamination, mixing

    bad = decontamination.digest(docs, bench).where("n_hit > 0")
    assert three.columns == columns and ids(three) == ids(docs) - ids(bad)
    four = pipeline.mix(spark, docs, DATA)
    want = {r.doc_id: r.taken // r.size for r in mixing.digest(docs).collect() if r.size}
    got = {r.doc_id: r["count"] for r in four.groupBy("doc_id").count().collect()}
    assert four.columns == columns and got == {k: v for k, v in want.items() if v}
    done = pipeline.run(spark, DATA)
    assert done.columns == [*columns, "text_crc32", "shard", "slot", "grown_shard"]
    per = done.groupBy("shard").agg(F.max("slot").alias("last"), F.count_distinct("slot").alias("n")).collect()
    assert all(r.last == r.n - 1 for r in per) and done.count() > 0
