"""Substring removal by paragraph MinHash banding.

Paragraphs are of two kinds:

* every line (between newlines) of LEAST words or more, and every text of LEAST words or more that is too
  short for a stretch.  BANDS permutations of its shingle hashes give a minimum and a maximum each; the two
  are a band of two rows.  A pair of Jaccard similarity s meets with probability 1 - (1 - s ** 2) ** BANDS:
  0.994 at 0.8, 0.9998 at 0.9, and 0.76 at 0.5, where verification drops it;
* stretches of STRETCH words inside lines and across them, since repeated passages seldom start or end
  with a line.  Among WINDOW shingles in a row the one with the least hash is picked (the MinHash value of
  that stretch), and a stretch starts at every pick; each of PICKS hash functions picks its own, as bands of
  one row.  A passage of WINDOW + SHINGLE + STRETCH - 2 = 51 words or more that stands in two documents has a
  whole stretch in common, wherever it stands; of shorter ones, and of near-equal ones, a part is missed
  (README has the measured shares), unless they are lines of their own.

1. One pass in Arrow batches finds the keys of all paragraphs, and a digest of each text.
2. Equal texts repeat as a whole; one of each group takes part in the rest.  Keys found in one text only
   are dropped by minima and maxima over the rows of a key, which spill where a key has many.
3. The texts that hold other keys are read again; their paragraphs with such keys go on: text, place, digest
   of the words, keys, and the shingles if a key stands for different words (by 32 bits of their digest).
4. Paragraphs with equal words, by a 64-bit digest, are one kind.  Kinds with a key in common are linked where the Jaccard
   similarity of their shingle sets, compared in full, is PERCENT or more: first with the key's least kind,
   then, in keys whose kinds are not one component by that, among each other in blocks of bounded size.
5. Components of the links are the clusters; a cluster in two documents or more is a repeat.  The document
   of least id keeps it, the other documents' places are removed.

Defined cases: null and wordless texts and texts below LEAST words have no paragraphs; rows with a null id
are not looked at; rows that repeat an id and text are one document, rows that repeat an id with another
text are further texts of it, and repeats within one document alone do not count; an empty table gives no
rows; very long texts are read alone and whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, materialise, release, shared_dir, slices, small_batches, text_keys
from .components import connected_components
from .minhash import hash_word, mix, shared_keys, shingles, verified_links

SHINGLE, PERCENT = 5, 80
#: Words of a line, or of a short text, that make it a paragraph, and its bands.
LEAST, BANDS = 20, 5
#: Shingles among which a stretch's start is picked, words of a stretch, hash functions that pick.
WINDOW, STRETCH, PICKS = 24, 24, 2
#: Windows whose minima are worked out at once; places within them take 24 bits.
SEGMENT = 4_000_000

_SPAN = WINDOW + SHINGLE - 1
_TEXT = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_LOW = np.uint64((1 << 24) - 1)
_SEEDS = np.random.default_rng(20240302).integers(0, 2**63, PICKS, np.uint64)
_ODD = np.random.default_rng(20240303).integers(0, 2**63, BANDS, np.uint64) * np.uint64(2) + np.uint64(1)


class Texts:
    """Word hashes ``h`` of several texts in a row, the text ``of`` each word, the hashes ``g`` of all runs of
    SHINGLE words (runs across texts included; callers leave those out), and the starts and ends of lines."""

    def __init__(self, texts: list[str | None]) -> None:
        hashes, ends, n = [], [], []
        for text in texts:
            before = len(hashes)
            for line in (text or "").encode().lower().split(b"\n"):
                hashes += map(hash_word, line.split())
                ends.append(len(hashes))
            n.append(len(hashes) - before)
        self.n = np.array(n, np.int64)
        self.h = np.array(hashes, np.uint64)
        self.of = np.repeat(np.arange(len(texts)), self.n)
        self.first = np.cumsum(self.n) - self.n
        self.g = shingles(self.h, SHINGLE)
        self._prefix = self._inverse = None
        ends_ = np.unique(np.array(ends, np.int64))
        starts = np.concatenate([[0], ends_[:-1]]).astype(np.int64)
        short = (self.n >= LEAST) & (self.n < _SPAN)  # a short text is a paragraph as a whole
        long = ends_ - starts >= LEAST
        both = np.column_stack([np.concatenate([starts[long], self.first[short]]), np.concatenate([ends_[long], (self.first + self.n)[short]])])
        self.lines = np.unique(both, axis=0)

    def paragraphs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Keys, starts, ends and 64-bit digests of the words of all paragraphs, a band at a time."""
        if len(self.lines):
            edges = np.column_stack([self.lines[:, 0], self.lines[:, 1] - SHINGLE + 1]).ravel()
            digest = self._digests(self.lines[:, 0], self.lines[:, 1])
            for band, odd in enumerate(_ODD):
                value = np.append(self.g * odd, np.uint64(0))
                low, high = np.minimum.reduceat(value, edges)[::2], np.maximum.reduceat(value, edges)[::2]
                yield mix(mix(low) * _TEXT + mix(high) + np.uint64(band)), self.lines[:, 0], self.lines[:, 1], digest
        for seed in _SEEDS:
            key, at = self._picks(seed)
            yield key, at, at + STRETCH, self._digests(at, at + STRETCH)

    def _digests(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A polynomial over the words' hashes, from prefix sums."""
        if self._prefix is None:
            powers, self._inverse = (np.append(np.uint64(1), np.cumprod(np.full(len(self.h), x, np.uint64))) for x in (_BASE, _INVERSE))
            self._prefix = np.append(np.uint64(0), np.cumsum(mix(self.h) * powers[:-1]))
        return mix((self._prefix[end] - self._prefix[start]) * self._inverse[start])

    def _picks(self, seed: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """The sliding minimum is built by doubling; of equal hashes the first is picked."""
        of, parts = self.of, [np.zeros(0, np.int64)]
        for start in range(0, max(0, len(of) - _SPAN + 1), SEGMENT):
            value = mix(self.g[start : start + SEGMENT + WINDOW - 1] ^ seed)
            least = (value & ~_LOW) | np.arange(len(value), dtype=np.uint64)
            width = 1
            while 2 * width <= WINDOW:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < WINDOW:
                least = np.minimum(least[: len(least) - (WINDOW - width)], least[WINDOW - width :])
            whole = of[start : start + len(least)] == of[start + _SPAN - 1 : start + _SPAN - 1 + len(least)]
            parts.append((least[whole] & _LOW).astype(np.int64) + start)
        at = np.unique(np.concatenate(parts))
        at = at[at + STRETCH <= len(of)]
        at = at[of[at] == of[at + STRETCH - 1]]
        return mix(self.g[at] ^ seed), at


def _arrays(rows: np.ndarray, values: pa.Array, n: int) -> pa.ListArray:
    """One list for each of n rows, of the values with that row number (ascending)."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), values)


def repeated_paragraphs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k1, k2, n_words): the distinct texts, by their digest, of the documents; and (k1, k2, rep,
    place, end, cluster, first_doc_id): the paragraphs that several documents hold, in the distinct texts,
    each with its document of least id and the least id of the cluster."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", *text_keys(F.col("text")), "text")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            read = Texts(batch.column("text").to_pylist())
            found = [np.column_stack([read.of[at], key.view(np.int64), words.view(np.int64)]) for key, at, _, words in read.paragraphs() if len(at)]
            rows = np.concatenate([np.zeros((0, 3), np.int64), *found])
            rows = rows[np.argsort(rows[:, 0], kind="stable")]
            pairs = pa.StructArray.from_arrays([pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(np.int32))], ["key", "words"])
            held = [batch.column(c) for c in ("doc_id", "k1", "k2")]
            yield pa.RecordBatch.from_arrays([*held, pa.array(read.n), _arrays(rows[:, 0], pairs, len(read.n))], names=["doc_id", "k1", "k2", "n_words", "keys"])

    path = shared_dir(docs.sparkSession)
    found = materialise(texts.mapInArrow(keys, f"doc_id {kind}, k1 long, k2 long, n_words long, keys array<struct<key:long,words:int>>"), path)
    of = materialise(found.select("doc_id", "k1", "k2", "n_words").distinct())
    each = found.select("k1", F.inline("keys"))
    # One shuffle of all keys: the rows that share a key, and not another join, say whether texts or words differ.
    alike = Window.partitionBy("key")
    met = each.select("k1", "key", *[f(c).over(alike).alias(f"{f.__name__}_{c}") for c in ("k1", "words") for f in (F.min, F.max)]).where("min_k1 != max_k1")
    again = met.select("k1", F.struct("key", (F.col("min_words") != F.col("max_words")).alias("mixed")).alias("key"))
    again = materialise(again.groupBy(F.col("k1").alias("a1")).agg(F.collect_set("key").alias("keys")))
    release(docs.sparkSession, path)  # all keys: read for the last time
    reps = of.groupBy(F.col("k1").alias("a1"), F.col("k2").alias("a2")).agg(F.min("doc_id").alias("rep"))
    again = again.join(reps, "a1")
    # Texts meet what is asked of them by a shuffle at every size: what is asked grows with the corpus.
    held = texts.join(again.hint("shuffle_hash"), (F.col("k1") == F.col("a1")) & (F.col("k2") == F.col("a2")) & (F.col("doc_id") == F.col("rep"))).select("rep", "k1", "k2", "text", "keys")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            read = Texts(batch.column("text").to_pylist())
            wanted = batch.column("keys")
            asked = wanted.flatten()
            ask = asked.field("key").to_numpy().view(np.uint64) + np.repeat(np.arange(len(wanted), dtype=np.uint64), np.diff(wanted.offsets.to_numpy())) * _TEXT
            order = np.argsort(ask)
            ask, mixed = ask[order], asked.field("mixed").to_numpy(zero_copy_only=False)[order]
            parts = []
            for key, start, end, words in read.paragraphs():
                of = key + read.of[start].astype(np.uint64) * _TEXT
                at = np.minimum(np.searchsorted(ask, of), len(ask) - 1)
                hit = ask[at] == of
                parts.append(np.column_stack([start[hit], end[hit], key[hit].view(np.int64), mixed[at[hit]], words[hit].view(np.int64)]))
            rows = np.concatenate(parts)
            if len(rows):
                rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
                new = np.append(True, (np.diff(rows[:, :2], axis=0) != 0).any(axis=1))
                first = np.flatnonzero(new)
                spans, at = rows[new, :2], np.append(first, len(rows))
                low, several = read.g.astype(np.uint32).view(np.int32), np.maximum.reduceat(rows[:, 3], first)
                sets = [np.unique(low[x : y - SHINGLE + 1]) if z else None for (x, y), z in zip(spans.tolist(), several.tolist())]
                text = read.of[spans[:, 0]]
                of = [batch.column(c).take(pa.array(text)) for c in ("rep", "k1", "k2")]
                place = (spans - read.first[text, None]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(rows[:, 2])), pa.array(sets, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*of, pa.array(place[:, 0]), pa.array(place[:, 1]), pa.array(rows[new, 4]), *lists], names=["rep", "k1", "k2", "place", "end", "kind", "keys", "shingles"])

    places = materialise(held.mapInArrow(cut, f"rep {kind}, k1 long, k2 long, place int, end int, kind long, keys array<long>, shingles array<int>"))
    sets = places.where("shingles IS NOT NULL").groupBy(F.col("kind").alias("rep")).agg(F.first("shingles").alias("shingles"))
    sets = materialise(sets.select("rep", F.size("shingles").alias("n"), "shingles"))
    met = shared_keys(places.where("shingles IS NOT NULL").select(F.explode("keys").alias("key"), F.col("kind").alias("rep")).distinct())
    roots = materialise(connected_components(verified_links(met, sets, PERCENT)).select(F.col("node").alias("kind"), "root"))
    kinds = places.groupBy("kind").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
    named = materialise(kinds.join(roots, "kind", "left").select("kind", "low", "high", F.coalesce("root", "kind").alias("cluster")))
    clusters = named.groupBy("cluster").agg(F.min("low").alias("first_doc_id"), F.max("high").alias("last")).where("first_doc_id != last").select("cluster", "first_doc_id")
    first = materialise(named.join(clusters, "cluster").select("kind", "cluster", "first_doc_id"))
    return of, places.select("k1", "k2", "rep", "place", "end", "kind").join(first, "kind").drop("kind")


def _runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of words under paragraphs with these starts and ends."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per document and text with repeated passages: doc_id, k1 and k2 (digest of the text), passages
    (maximal runs of words, start and end), removed (those parts that go), first_doc_ids (documents that
    keep them).  Of equal texts of LEAST words the one of least id stays, but for what others keep of it."""
    of, paragraphs = repeated_paragraphs(docs)
    span = F.struct(F.col("place").alias("start"), "end")
    gone = F.collect_set(F.when(F.col("rep") != F.col("first_doc_id"), span))
    per = materialise(paragraphs.groupBy("k1", "k2").agg(F.collect_set(span).alias("places"), gone.alias("gone"), F.collect_set("first_doc_id").alias("firsts")))
    copies = materialise(of.where(F.col("n_words") >= LEAST).groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep != last").select("k1", "k2", "rep"))
    met = of.join(bounded_broadcast(copies), ["k1", "k2"], "left").join(bounded_broadcast(per), ["k1", "k2"], "left").where("rep IS NOT NULL OR places IS NOT NULL")
    every = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    places = F.when(F.col("rep").isNotNull(), every).otherwise(F.col("places"))
    removed = F.when(F.col("rep") != F.col("doc_id"), every).otherwise(F.coalesce("gone", none))
    firsts = F.coalesce("firsts", F.slice(F.array("doc_id"), 1, 0))
    firsts = F.array_sort(F.array_distinct(F.when(F.col("rep").isNotNull(), F.concat(firsts, F.array("rep"))).otherwise(firsts)))
    met = met.select("doc_id", "k1", "k2", places.alias("places"), removed.alias("gone"), firsts.alias("first_doc_ids"))
    run = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = []
            for c in ("places", "gone"):
                rows = batch.column(c).to_pylist()
                cols.append(pa.array([[{"start": a, "end": b} for a, b in _runs([(x["start"], x["end"]) for x in row])] for row in rows], run))
            held = [batch.column(c) for c in ("doc_id", "k1", "k2")]
            yield pa.RecordBatch.from_arrays([*held, *cols, batch.column("first_doc_ids")], names=["doc_id", "k1", "k2", "passages", "removed", "first_doc_ids"])

    runs, kind = "array<struct<start:int,end:int>>", dict(docs.dtypes)["doc_id"]
    return met.mapInArrow(join, f"doc_id {kind}, k1 long, k2 long, passages {runs}, removed {runs}, first_doc_ids array<{kind}>")


def drop_passages(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages cut from all but the first that holds them; other columns
    unchanged.  A cut takes its words and the blanks after them."""
    found = materialise(repeated_passages(docs.select("doc_id", "text")).where(F.size("removed") > 0).select(F.col("doc_id").alias("of"), "k1", "k2", "removed"))
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("of"), F.col("text"), *text_keys(F.col("text")))
    met = keyed.join(bounded_broadcast(found), ["of", "k1", "k2"], "left").select("row", "text", "removed")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist()):
                if runs and text is not None:
                    starts = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)] + [len(text)]
                    edges = [(starts[min(r["start"], len(starts) - 1)], starts[min(r["end"], len(starts) - 1)]) for r in runs]
                    text = "".join(text[a:b] for a, b in zip([0, *(b for _, b in edges)], [*(a for a, _ in edges), len(text)]))
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], names=["row", "kept"])

    done = met.mapInArrow(cut, f"row {dict(met.dtypes)['row']}, kept string")
    return done.select(F.col("row").withField("text", F.col("kept")).alias("row")).select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    def words(runs: str):
        return F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + (r["end"] - r["start"]))

    found = repeated_passages(docs.select("doc_id", "text"))
    return found.select("doc_id", F.size("passages").cast("long").alias("n_passages"), words("passages").alias("n_repeat_words"), words("removed").alias("n_removed_words"), "first_doc_ids")
