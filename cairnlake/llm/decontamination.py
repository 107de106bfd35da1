"""Benchmark decontamination (DataFrame functions only).

The benchmark's normalised n-grams become a hash set; every window of every document is looked up in
it by length and 64-bit hash, and a hit is verified on the words themselves: the set carries each
n-gram's words, and the window's words are put together only where the hashes meet.

The set is broadcast in parts of a measured size (``BROADCAST_BYTES``); each part is one pass over the
documents, so no window is ever shuffled however large the benchmark is.  Windows are exploded and
looked up within the scan's stage.  One row per document and one per hit are written; hits are joined
to runs and to item ids keyed by document row, so that a passage which a third of all documents share
stays spread over all tasks.

``decontaminate`` acts on every document with a verified hit.  The share of hit words only decides the
``contaminated`` column of the digest.

Defined cases: null or wordless text has no words and is never contaminated; a benchmark item without
words is ignored, one with fewer than n words is a single shorter window; equal items under several
ids all count, rows that repeat an item id count once, a null id counts as the empty id; rows that
repeat a document are judged each by itself; empty tables give no hits or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bounded_broadcast, content_words, let, materialise, table_bytes

#: Words in a window, and the share of hit words (1 in SHARE) from which a document is contaminated.
N, SHARE = 13, 20

#: A word of the text as it stands, with what precedes it.
_PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _windows(words: Column, length: int) -> Column:
    """(len, pos, h) of all windows of so many words."""
    def one(i: Column) -> Column:
        return F.struct(F.lit(length).alias("len"), i.alias("pos"), F.xxhash64(F.slice(words, i + 1, length)).alias("h"))

    none = F.array().cast("array<struct<len:int,pos:int,h:bigint>>")
    return F.when(F.size(words) >= length, F.transform(F.sequence(F.lit(0), F.size(words) - length), one)).otherwise(none)


def benchmark_grams(bench: DataFrame, n: int = N) -> tuple[DataFrame, DataFrame]:
    """(gid, len, h, gram): the distinct n-grams, their words joined by blanks; and (gid, item): the ids,
    as strings, of the items that hold them."""
    words = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), content_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(n))
    parts = F.transform(F.sequence(F.lit(1), F.size("words") - length + 1), lambda i: F.slice("words", i, length))
    held = words.select("item", F.explode(parts).alias("part")).select("item", F.size("part").alias("len"), F.xxhash64("part").alias("h"), F.array_join("part", " ").alias("gram"))
    held = materialise(held.distinct())
    grams = materialise(held.select("len", "h", "gram").distinct().select(F.monotonically_increasing_id().alias("gid"), "len", "h", "gram"))
    return grams, materialise(held.join(grams, ["len", "h", "gram"]).select("gid", "item"))


def contamination(docs: DataFrame, bench: DataFrame, n: int = N) -> DataFrame:
    """One row per document: doc_id, text_md5, n_words, n_hit, spans (array of start and end word of
    maximal hit runs), items (sorted ids of the items found)."""
    grams, held = benchmark_grams(bench, n)
    lengths = sorted(r["len"] for r in grams.select("len").distinct().collect())  # n values at most
    passes = max(1, -(-table_bytes(grams) // BROADCAST_BYTES))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    rows = materialise(rows) if passes > 1 else rows  # rids must be the same in every pass
    rows = rows.select("rid", "doc_id", F.md5("text").alias("text_md5"), content_words(F.col("text")).alias("words"))
    document = F.struct(F.lit(0).alias("len"), F.size("words").alias("pos"), F.lit(0).cast("long").alias("h"))
    met = []
    for k in range(passes):
        part = grams.where(F.pmod("h", F.lit(passes)) == k).select("gid", F.col("h").alias("gram_h"), "gram")
        looked_up = [_windows(F.col("words"), length) for length in lengths]
        windows = rows.select("*", F.concat(*[F.array(document)] * (k == 0), F.slice(F.array(document), 1, 0), *looked_up).alias("windows"))
        # The outer form, since Spark infers a filter from the plain one, which would evaluate all windows once more.
        windows = windows.select("rid", "doc_id", "text_md5", "words", F.inline_outer("windows"))
        spelled = F.array_join(F.slice("words", F.col("pos") + 1, F.col("len")), " ")
        # Equality, put so that it is no key of the join and is evaluated only where hashes meet.
        same = F.col("gram").startswith(spelled) & (F.octet_length("gram") <= F.octet_length(spelled))
        found = windows.join(F.broadcast(part), (F.col("h") == F.col("gram_h")) & same, "left")
        doc = F.when(F.col("len") == 0, F.struct("doc_id", "text_md5"))
        met.append(materialise(found.where("len = 0 OR gid IS NOT NULL").select("rid", doc.alias("doc"), "len", "pos", "gid")))
    every = met[0]
    for more in met[1:]:
        every = every.unionByName(more)
    hits = every.where("len > 0").select("rid", F.col("pos").alias("start"), (F.col("pos") + F.col("len")).alias("end"), "gid")

    order = Window.partitionBy("rid").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = hits.select("rid", "start", "end", F.when(F.col("start") <= reach, 0).otherwise(1).alias("opens"))
    runs = opened.select("rid", "start", "end", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    runs = runs.groupBy("rid", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = runs.groupBy("rid").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    items = hits.select("rid", "gid").distinct().join(bounded_broadcast(held), "gid").select("rid", "item").distinct().groupBy("rid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    verdicts = materialise(spans.join(items, "rid"))
    out = every.where("len = 0").select("rid", "doc.*", F.col("pos").cast("long").alias("n_words")).join(bounded_broadcast(verdicts), "rid", "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return out.select("doc_id", "text_md5", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def is_contaminated(share: int = SHARE) -> Column:
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = N, mode: str = "documents") -> DataFrame:
    """``documents``: the documents without those that have a verified hit.  ``spans``: all documents, hit
    words cut from them.  Columns stay as they are.  A verdict depends on the text alone, so verdicts
    meet the documents again by the text's MD5 and no document is shuffled unless there are too many
    verdicts to broadcast."""
    verdicts = contamination(docs, bench, n).where("n_hit > 0")
    found = materialise(verdicts.groupBy(F.col("text_md5").alias("found_md5")).agg(F.first("spans").alias("found_spans")))
    held = docs.select(F.struct("*").alias("row"), F.col("text"))
    match = F.md5(F.col("text")) == F.col("found_md5")
    if mode == "documents":
        return held.join(bounded_broadcast(found.select("found_md5")), match, "left_anti").select("row.*")
    met = held.join(bounded_broadcast(found), match, "left")
    pieces = F.regexp_extract_all("text", F.lit(_PIECE), 0)

    def cut(p: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.col("found_spans.end"))
        ends = F.concat(F.col("found_spans.start"), F.array(F.size(p)))
        keep = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(p, a + 1, b - a)))
        tail = F.substring(F.col("text"), F.length(F.array_join(p, "")) + 1, F.length("text"))
        return F.concat(F.array_join(keep, ""), tail)

    text = F.when(F.col("found_spans").isNull(), F.col("text")).otherwise(let(pieces, cut))
    return met.select(F.col("row").withField("text", text).alias("row")).select("row.*")


def digest(docs: DataFrame, bench: DataFrame) -> DataFrame:
    found = contamination(docs.select("doc_id", "text"), bench.select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), {N}) AS k, array_to_string(w[i:i + least(len(w), {N}) - 1], ' ') AS gram
      FROM (SELECT *, unnest(range(1, len(w) - least(len(w), {N}) + 2)) AS i FROM b WHERE len(w) > 0)),
l AS (SELECT DISTINCT k FROM g),
x AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, l WHERE len(w) >= k)),
h AS (SELECT DISTINCT doc_id, i, x.k, item FROM x JOIN g ON x.k = g.k AND x.gram = g.gram),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""
