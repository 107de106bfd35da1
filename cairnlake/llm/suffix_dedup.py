"""Exact removal of byte strings that repeat, with a logarithmic family of suffix arrays.

A byte goes if a string of LENGTH bytes that covers it starts anywhere else, in the same text or in
another.  Sorting the suffixes of a whole corpus is out of reach; those that cannot match are set
aside first, without losing any:

1. Every window of LENGTH bytes picks the least hash among its runs of GRAM bytes (the first of equal
   ones): its anchor.  The pick depends on the window's bytes alone, so equal windows have equal
   anchors at equal places.  One pass in Arrow batches gives each text's anchors, about 1 in 85 bytes.
2. An anchor hash found in one place only proves that all windows with that anchor are unique.  The
   others' contexts (the bytes under all windows with that anchor) go on, from one text of each group
   of equal texts; equal contexts are counted, with partial aggregation, and meet as one.
3. Different contexts with equal anchor hashes are dealt by that hash to tasks of bounded size.  A task
   takes them in batches: each batch gets its suffix array (its window starts in the order of the
   LENGTH bytes that follow), is scanned against every level of the family for equal strings, and
   joins the family; levels of equal size merge, so there are logarithmically many.
4. An anchor hash with more than GROUP different contexts (a passage that many texts share, each
   followed by something else) is dealt into blocks of about GROUP, and every two blocks meet in a
   task of their own.  Beyond BLOCKS blocks, where pairs of blocks would cost more than they save,
   the windows are dealt by 128-bit fingerprint, which is counted with partial aggregation.
5. Spans return to the texts by the MD5 of the text.  Texts are read twice more, each time through a shuffle:
   nothing that grows with the texts is broadcast.

Texts that repeat as a whole are removed whole if they have LENGTH bytes.

Defined cases: null text is empty; a text below LENGTH bytes keeps everything; equal rows count as
occurrences of each other, also under one id; an empty table gives no rows; very long texts are
anchored in pieces of PIECE bytes that overlap by LENGTH - 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, materialise, slices, small_batches, text_keys

LENGTH, GRAM = 200, 32
PIECE = 1_000_000
#: Different contexts of an anchor hash in a block, and blocks up to which suffix arrays judge them.
GROUP, BLOCKS = 1000, 16
#: Windows that a task judges, about, and contexts in a batch.
TASK_WINDOWS, BATCH = 150_000, 500

_PICKS = LENGTH - GRAM + 1
_TABLE = np.random.default_rng(20240301).integers(0, 2**63, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 24) - 1)


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM (a power of two) bytes from each place, built by doubling."""
    h, width, base = _TABLE[raw], 1, _BASE
    while width < GRAM:
        h = h[:-width] * np.uint64(base) + h[width:]
        width, base = 2 * width, base * base % 2**64
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def anchors(pieces: list[bytes]) -> list[np.ndarray]:
    """For each piece an array of rows (hash, place, first window, last window): the anchors and the
    runs of window starts that pick them."""
    none = np.zeros((0, 4), np.int64)
    sizes = np.array([len(p) for p in pieces], np.int64)
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    if len(raw) < LENGTH:
        return [none] * len(pieces)
    h = _gram_hashes(raw)
    least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= _PICKS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < _PICKS:
        least = np.minimum(least[: len(least) - (_PICKS - width)], least[_PICKS - width :])
    pick = (least & _LOW).astype(np.int64)
    of = np.repeat(np.arange(len(pieces)), sizes)
    starts = np.flatnonzero(of[: len(pick)] == of[LENGTH - 1 :])
    if not len(starts):
        return [none] * len(pieces)
    pick = pick[starts]
    cut = np.flatnonzero((np.diff(pick) != 0) | (np.diff(starts) != 1)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(starts)]]) - 1
    place = pick[first]
    base = (np.cumsum(sizes) - sizes)[of[place]]
    rows = np.column_stack([h[place].view(np.int64), place - base, starts[first] - base, starts[last] - base])
    edges = np.searchsorted(of[place], np.arange(len(pieces) + 1))
    return [rows[a:b] for a, b in zip(edges[:-1], edges[1:])]


def text_anchors(raws: list[bytes]) -> list[np.ndarray]:
    """Anchors of whole texts, worked out in runs of about PIECE bytes."""
    found: list[list[np.ndarray]] = [[] for _ in raws]
    run: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        for (i, at, _), rows in zip(run, anchors([p for _, _, p in run])):
            found[i].append(rows + np.array([0, at, at, at]))
        run.clear()

    size = 0
    for i, raw in enumerate(raws):
        for at in range(0, max(1, len(raw) - LENGTH + 1), PIECE):
            part = raw[at : at + PIECE + LENGTH - 1]
            run.append((i, at, part))
            size += len(part)
            if size >= PIECE:
                flush()
                size = 0
    flush()
    return [np.concatenate(x) if x else np.zeros((0, 4), np.int64) for x in found]


class SuffixFamily:
    """Suffix arrays of batches in levels of geometric sizes: each level has window starts (as ids) in
    the order of their LENGTH bytes."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, windows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Index a batch of windows; returns the ids, of this batch and of earlier ones, that are
        now known to have an equal."""
        order = np.argsort(windows, kind="stable")
        windows, ids = windows[order], ids[order]
        same = windows[1:] == windows[:-1]
        found = [ids[1:][same], ids[:-1][same]]
        for held, held_ids in self.levels:
            left, right = np.searchsorted(held, windows, "left"), np.searchsorted(held, windows, "right")
            met = right > left
            found.append(ids[met])
            marks = np.zeros(len(held) + 1, np.int64)
            np.add.at(marks, left[met], 1)
            np.add.at(marks, right[met], -1)
            found.append(held_ids[np.cumsum(marks[:-1]) > 0])
        self.levels.append((windows, ids))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) > len(self.levels[-2][0]):
            (a, a_ids), (b, b_ids) = self.levels[-2:]
            at = np.searchsorted(a, b, "right")
            self.levels[-2:] = [(np.insert(a, at, b), np.insert(a_ids, at, b_ids))]
        return np.concatenate(found)


def _windows(context: bytes, tag: int) -> np.ndarray:
    """All windows of a context behind a tag, as an array of byte strings of fixed length."""
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(context, np.uint8), LENGTH)
    out = np.empty((len(view), 4 + LENGTH), np.uint8)
    out[:, :4] = np.frombuffer(tag.to_bytes(4, "big"), np.uint8)
    out[:, 4:] = view
    return out.view(f"S{4 + LENGTH}")[:, 0]


def _spans(starts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes under windows with these starts (ascending)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(starts[1:] > starts[:-1] + LENGTH) + 1
    return [(int(p[0]), int(p[-1]) + LENGTH) for p in np.split(starts, cut)]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix arrays over all contexts of a task: (h, c1, c2, spans) of those with windows that repeat.
    A pair of blocks has a tag of its own: a block may meet several others in one task, and must not be
    taken for its own repeat.  Hashes of one block need none, as their windows differ anyway."""
    family, keys, first, total = SuffixFamily(), [], [], 0
    tags: dict[tuple, int] = {}
    repeated = []
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            pairs = zip(*(part.column(c).to_pylist() for c in ("h", "i", "j")))
            contexts = [_windows(x, tags.setdefault(p, len(tags) + 1) if p[1] < p[2] else 0) for x, p in zip(part.column("context").to_pylist(), pairs)]
            keys += zip(*(part.column(c).to_pylist() for c in ("h", "c1", "c2")))
            for c in contexts:
                first.append(total)
                total += len(c)
            windows = np.concatenate(contexts)
            repeated.append(np.unique(family.add(windows, np.arange(total - len(windows), total))))
    if not keys:
        return
    starts = np.unique(np.concatenate(repeated))
    edges = np.searchsorted(starts, np.array([*first, total]))
    out = [(key, _spans(starts[a:b] - f)) for key, f, a, b in zip(keys, first, edges[:-1], edges[1:]) if b > a]
    yield _context_rows([k for k, _ in out], [s for _, s in out])


def _context_rows(keys: list, spans: list) -> pa.RecordBatch:
    cols = [pa.array([k[j] for k in keys], pa.int64()) for j in range(3)]
    return pa.RecordBatch.from_arrays([*cols, pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPANS)], names=["h", "c1", "c2", "spans"])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            contexts = part.column("context").to_pylist()
            n = np.array([len(c) - LENGTH + 1 for c in contexts])
            prints = b"".join(hashlib.blake2b(c[s : s + LENGTH], digest_size=16).digest() for c in contexts for s in range(len(c) - LENGTH + 1))
            f = np.frombuffer(prints, np.int64).reshape(-1, 2)
            keys = [pa.array(np.repeat(part.column(c).to_numpy(), n)) for c in ("h", "c1", "c2")]
            start = np.concatenate([np.arange(k) for k in n]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*keys, pa.array(start), pa.array(f[:, 0]), pa.array(f[:, 1])], names=["h", "c1", "c2", "start", "f1", "f2"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(k1, k2, whole, spans): for each text, by its MD5, whether it repeats as a whole, and spans
    (neither merged nor sorted) of bytes under windows that repeat."""
    small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *text_keys(F.col("text"))).where(F.octet_length("text") >= LENGTH)
    copies = keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = text_anchors([t.encode() for t in batch.column("text").to_pylist()])
            unique = [np.unique(x[:, 0], return_counts=True) for x in found]
            n = [len(u) for u, _ in unique]
            if sum(n):
                cols = [pa.array(np.repeat(batch.column(c).to_numpy(), n)) for c in ("k1", "k2")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate([u for u, _ in unique])), pa.array(np.concatenate([c for _, c in unique]).astype(np.int32))], names=["k1", "k2", "h", "times"])

    found = materialise(keyed.select("k1", "k2", "text").mapInArrow(find, "k1 long, k2 long, h long, times int"))
    twice = materialise(found.groupBy("h").agg(F.min("k1").alias("a"), F.max("k1").alias("b"), F.max("times").alias("times")).where("a != b OR times > 1").select("h"))
    again = found.join(bounded_broadcast(twice), "h").groupBy("k1", "k2").agg(F.collect_set("h").alias("hashes"))
    again = again.join(copies, ["k1", "k2"]).select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), "rep", "hashes")
    # What is asked of a text is as long as the text at worst, so texts meet it by a shuffle at every size.
    held = keyed.join(again.hint("shuffle_hash"), (F.col("k1") == F.col("a1")) & (F.col("k2") == F.col("a2")) & F.col("doc_id").eqNullSafe(F.col("rep")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raws = [t.encode() for t in batch.column("text").to_pylist()]
            keys = list(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist()))
            rows: dict[tuple, list[int]] = {}
            for i, (raw, rows_of, hashes) in enumerate(zip(raws, text_anchors(raws), batch.column("hashes").to_pylist())):
                for h, place, lo, hi in rows_of[np.isin(rows_of[:, 0], np.array(hashes, np.int64))].tolist():
                    rows.setdefault((i, h, place - lo, raw[lo : hi + LENGTH]), []).append(lo)
            if rows:
                digests = np.array([np.frombuffer(hashlib.blake2b(r.to_bytes(4, "little") + c, digest_size=16).digest(), np.int64) for _, _, r, c in rows])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[i][0] for i, *_ in rows]), pa.array([keys[i][1] for i, *_ in rows]), pa.array([h for _, h, _, _ in rows]), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([c for *_, c in rows], pa.binary()), pa.array(list(rows.values()), pa.list_(pa.int32()))],
                    names=["k1", "k2", "h", "c1", "c2", "context", "at"],
                )

    contexts = materialise(held.select("k1", "k2", "hashes", "text").mapInArrow(cut, "k1 long, k2 long, h long, c1 long, c2 long, context binary, at array<int>"))
    kinds = contexts.groupBy("h", "c1", "c2").agg(F.min("k1").alias("a"), F.max("k1").alias("b"), F.max(F.size("at")).alias("times"), F.first("context").alias("context"))
    kinds = materialise(kinds.select("h", "c1", "c2", "context", ((F.col("a") != F.col("b")) | (F.col("times") > 1)).alias("full")))
    groups = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.bool_or(~F.col("full")).alias("open"), F.sum(F.octet_length("context") - (LENGTH - 1)).alias("windows")).where("kinds > 1 AND open")
    groups = materialise(groups.select("h", "windows", F.ceil(F.col("kinds") / GROUP).cast("int").alias("blocks")))
    few, many = groups.where(F.col("blocks") <= BLOCKS), groups.where(F.col("blocks") > BLOCKS)
    windows = few.agg(F.coalesce(F.sum(F.col("windows") * F.greatest(F.col("blocks") - 1, F.lit(1))), F.lit(0))).first()[0]
    dealt = kinds.join(bounded_broadcast(few.select("h", "blocks")), "h").withColumn("block", F.pmod("c1", F.col("blocks")).cast("int"))
    dealt = dealt.select("h", "c1", "c2", "context", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "blocks").where("other != block OR blocks = 1")
    dealt = dealt.select("h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "c1", "c2", "context")
    judged = dealt.repartition(max(1, -(-windows // TASK_WINDOWS)), "h", "i", "j").mapInArrow(_judge, "h long, c1 long, c2 long, spans array<struct<start:int,end:int>>")
    prints = materialise(kinds.join(bounded_broadcast(many.select("h")), "h").select("h", "c1", "c2", "context").mapInArrow(_fingerprints, "h long, c1 long, c2 long, start int, f1 long, f2 long"))
    equal = materialise(prints.groupBy("f1", "f2").agg(F.min("c1").alias("a"), F.max("c1").alias("b")).where("a != b").select("f1", "f2"))
    printed = prints.join(equal, ["f1", "f2"]).groupBy("h", "c1", "c2").agg(F.collect_list("start").alias("starts"))
    printed = printed.select("h", "c1", "c2", F.transform("starts", lambda s: F.struct(s.alias("start"), (s + LENGTH).alias("end"))).alias("spans"))
    full = kinds.where("full").select("h", "c1", "c2", F.array(F.struct(F.lit(0).alias("start"), F.octet_length("context").alias("end"))).alias("spans"))
    open_ = kinds.where("NOT full").select("h", "c1", "c2")
    marked = materialise(full.unionByName(judged.unionByName(printed).join(open_, ["h", "c1", "c2"], "left_semi")))
    met = contexts.select("k1", "k2", "h", "c1", "c2", "at").join(marked, ["h", "c1", "c2"])
    placed = met.select("k1", "k2", F.explode("at").alias("at"), "spans").select("k1", "k2", F.transform("spans", lambda s: F.struct((F.col("at") + s["start"]).alias("start"), (F.col("at") + s["end"]).alias("end"))).alias("spans"))
    spans = placed.groupBy("k1", "k2").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    whole = copies.where("n > 1").select("k1", "k2", F.lit(True).alias("whole"))
    return spans.join(whole, ["k1", "k2"], "full").select("k1", "k2", F.coalesce("whole", F.lit(False)).alias("whole"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, carry: Column | None = None) -> DataFrame:
    """``row`` (struct of all columns, or what ``carry`` gives), removed (maximal runs of bytes, sorted)
    and kept (the other bytes, joined) of each document."""
    spans = materialise(repeated_spans(docs.select("doc_id", "text")))
    keyed = docs.select((F.struct("*") if carry is None else carry).alias("row"), "text", *text_keys(F.col("text")))
    met = keyed.join(spans.hint("shuffle_hash"), ["k1", "k2"], "left").select("row", "text", "whole", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            removed, kept = [], []
            for text, whole, spans in zip(*(batch.column(c).to_pylist() for c in ("text", "whole", "spans"))):
                raw = (text or "").encode()
                runs = [(0, len(raw))] if whole and len(raw) >= LENGTH else merge([(s["start"], s["end"]) for s in spans or []])
                removed.append([{"start": a, "end": b} for a, b in runs])
                kept.append(b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(raw)])))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(removed, _SPANS), pa.array(kept, pa.binary())], names=["row", "removed", "kept"])

    return met.mapInArrow(cut, f"row {dict(met.dtypes)['row']}, removed array<struct<start:int,end:int>>, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    done = remove_repeats(docs.select("doc_id", "text"), F.struct("doc_id"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return done.select("row.doc_id", (F.octet_length("kept") + n_removed).cast("long").alias("n_bytes"), n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
