"""Language identification with interpolated Kneser-Ney character models.

For each learned language a character model of order 4 is kept in sorted arrays of n-gram codes that
all languages share: a row of an array holds the log probability of that n-gram in every language, so
one binary search serves all of them.  N-grams in no array fall back to the weight of their context
and the next lower order.  The language with the lowest cross-entropy per character wins; a document
is rejected if that cross-entropy lies above what calibration documents of the language show.

Characters are lower-cased letters; anything else is one blank, and blanks in a row count once.
Letters below ``DIRECT`` stand for themselves, rarer scripts share 256 codes.

Fitting takes at most ``FIT_DOCS`` documents per language, in expectation, chosen by a hash of the id
(the documented bound), a fifth of them for calibration.  Their n-grams are counted on the executors;
the model is built on the driver from those counts.  Scoring runs over whole texts of all rows in one
pass of Arrow batches without a shuffle; texts beyond ``CHUNK`` characters are scored in pieces of that
length, whose log probabilities are added.

Defined cases: null text, or one without a letter, is ``und`` with score 0 and rejected; rows without
lang or id are never learned from; without any row to learn from, everything is ``und``; rows that
repeat are judged each by itself; equal cross-entropies go to the first language by name; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, materialise, slices, small_batches

#: Documents per language that the models learn from and are calibrated on, in expectation.
FIT_DOCS = 3000
ORDER, BITS = 4, 12
#: Letters below this code point have a code of their own.
DIRECT = 0xF00
#: Characters scored at once.
CHUNK = 500_000
#: Rejection: quantile of calibration cross-entropies, and standard errors allowed beyond it.
QUANTILE, ERRORS = 0.999, 4.0
#: Characters' worth of evidence in a score.
SHARPNESS = 20.0

_MASK = [(1 << (BITS * k)) - 1 for k in range(ORDER + 1)]
_codes: list[np.ndarray] = []


def letter_codes() -> np.ndarray:
    """Code of each code point: 0 for all but letters."""
    if not _codes:
        codes = np.zeros(0x110000, np.int64)
        letters = np.array([c for c in range(0x110000) if chr(c).isalpha()])
        codes[letters] = np.where(letters < DIRECT, letters, DIRECT + letters % 256)
        _codes.append(codes)
    return _codes[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """N-gram codes of order ORDER of all characters of all texts (each text starts after blanks),
    and the number of codes of each text."""
    pad = "\0" * (ORDER - 1)
    low = [t.lower() for t in texts]
    every = np.frombuffer((pad + pad.join(low)).encode("utf-32-le", "surrogatepass"), np.uint32) if low else np.zeros(0, np.uint32)
    ids = letter_codes()[every]
    sizes = np.array([len(t) for t in low], np.int64)
    text_of = np.repeat(np.arange(len(low)), sizes + ORDER - 1)
    starts = np.cumsum(sizes + ORDER - 1) - sizes
    is_pad = np.zeros(len(ids), bool)
    for k in range(1, ORDER):
        is_pad[starts - k] = True
    keep = is_pad | (ids != 0)
    keep[1:] |= (ids[:-1] != 0) & ~is_pad[1:]
    ids, is_pad, text_of = ids[keep], is_pad[keep], text_of[keep]
    code = ids.copy()
    for k in range(1, ORDER):
        code[k:] |= ids[:-k] << (BITS * k)
    code, text_of = code[~is_pad], text_of[~is_pad]
    return code, np.bincount(text_of, minlength=len(low))


def _find(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each key in the sorted array, and whether it is there."""
    if not len(of):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(of, keys), len(of) - 1)
    return at, of[at] == keys


class KneserNey:
    """Models of several languages: for each order k sorted n-gram codes with log probabilities, and
    sorted context codes with log backoff weights, a column per language."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        self.gram: list[np.ndarray] = [np.zeros(0, np.int64)] * (ORDER + 1)
        self.logp: list[np.ndarray] = [np.zeros((0, 0), np.float32)] * (ORDER + 1)
        self.context: list[np.ndarray] = [np.zeros(0, np.int64)] * (ORDER + 1)
        self.weight: list[np.ndarray] = [np.zeros((0, 0), np.float32)] * (ORDER + 1)
        by_order: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER + 1)]
        for name in self.languages:
            code, n = counts[name]
            order = np.argsort(code)
            code, n = code[order], n[order]
            by_order[ORDER].append((code, n))
            for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct longer n-grams that end so
                code, n = np.unique(code & _MASK[k], return_counts=True)
                by_order[k].append((code, n))
        self.blank = math.log(1.0 / (1 + len(np.unique(np.concatenate([x[0] for x in by_order[1]])))))
        for k in range(1, ORDER + 1):
            union = np.unique(np.concatenate([x[0] for x in by_order[k]]))
            contexts = np.unique(union >> BITS)
            lower = np.exp(self.score(union & _MASK[k - 1], k - 1).astype(float))
            p, w = np.zeros((len(union), len(self.languages))), np.ones((len(contexts), len(self.languages)))
            at = np.searchsorted(contexts, union >> BITS)
            for j, (code, n) in enumerate(by_order[k]):
                once, twice = (n == 1).sum(), (n == 2).sum()
                discount = once / (once + 2 * twice) if once and twice else 0.5
                where = np.searchsorted(contexts, code >> BITS)
                total = np.bincount(where, n, len(contexts))
                kinds = np.bincount(where, minlength=len(contexts))
                some = np.maximum(total, 1)
                w[:, j] = np.where(total > 0, discount * kinds / some, 1.0)
                mine = np.searchsorted(union, code)
                p[mine, j] = (n - discount) / some[where]
                p[:, j] += w[at, j] * lower[:, j]
            self.gram[k], self.logp[k] = union, np.log(p).astype(np.float32)
            self.context[k], self.weight[k] = contexts, np.log(w).astype(np.float32)

    def score(self, code: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Log probabilities of n-grams of order k, a column per language."""
        if k == 0:
            return np.full((len(code), len(self.languages)), self.blank, np.float32)
        at, there = _find(code, self.gram[k])
        out = self.logp[k][at]
        if not there.all():
            miss = code[~there]
            rest = self.score(miss & _MASK[k - 1], k - 1)
            at, known = _find(miss >> BITS, self.context[k])
            rest[known] += self.weight[k][at[known]]
            out[~there] = rest
        return out

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text in each language, and the number of characters scored."""
        code, n = grams(texts)
        sums = np.zeros((len(texts), len(self.languages)))
        full = np.flatnonzero(n)
        if len(full):
            ends = np.cumsum(n)
            sums[full] = np.add.reduceat(self.score(code), (ends - n)[full], axis=0, dtype=np.float64)
        return sums, n


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Runs of (row, piece of text) of about CHUNK characters."""
    rows, parts, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text or ""), CHUNK):
            part = text[at : at + CHUNK]
            rows.append(i)
            parts.append(part)
            size += len(part)
            if size >= CHUNK:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def _identify(model: KneserNey | None, limits: np.ndarray, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, cross-entropy and whether rejected, of each text."""
    if not model:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
    sums, n = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
    for rows, parts in _pieces(texts):
        s, k = model.totals(parts)
        np.add.at(sums, rows, s)
        np.add.at(n, rows, k)
    letters = np.array([any(map(str.isalpha, t or "")) for t in texts], bool)
    entropy = -sums / np.maximum(n, 1)[:, None]
    best = entropy.argmin(axis=1)
    least = entropy[np.arange(len(texts)), best]
    sharp = np.exp(-(entropy - least[:, None]) * np.minimum(np.maximum(n, 1), SHARPNESS)[:, None])
    score = np.where(letters, 1 / sharp.sum(axis=1), 0.0)
    limit = limits[best, 0] + ERRORS * limits[best, 1] / np.sqrt(np.maximum(n, 1))
    names = [model.languages[b] if x else "und" for b, x in zip(best, letters)]
    return names, score, np.where(letters, least, 0.0), ~letters | (least > limit)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> tuple[KneserNey | None, np.ndarray]:
    """Models and rejection limits, learned from text and lang of rows that are not held out."""
    small_batches(docs.sparkSession)
    usable = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    per = materialise(usable.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(fit_docs)) / F.count(F.lit(1))).alias("share")).select(F.col("lang").alias("of"), "share"))
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    sample = usable.join(bounded_broadcast(per), F.col("lang") == F.col("of")).where(pick < F.ceil(F.col("share") * 1_000_000)).select("lang", "text", (F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(5)) == 0).alias("calibrate"))
    sample = materialise(sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                for _, parts in _pieces([t for x, t in zip(langs, texts) if x == lang]):
                    code, n = np.unique(grams(parts)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n)], names=["lang", "code", "n"])

    # A language with few documents may have none for calibration; it learns from all of them then.
    spare = {r["lang"] for r in sample.groupBy("lang").agg(F.sum(F.col("calibrate").cast("int")).alias("n"), F.count(F.lit(1)).alias("all")).where("n = all").select("lang").collect()}
    learn = sample.where(~F.col("calibrate") | F.col("lang").isin(*spare) if spare else ~F.col("calibrate"))
    counted = learn.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    if not len(counted):
        return None, np.zeros((0, 2))
    model = KneserNey({lang: (part["code"].to_numpy(np.int64), part["n"].to_numpy(np.int64)) for lang, part in counted.groupby("lang")})

    def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for rows, parts in _pieces(texts):
                sums, n = model.totals(parts)
                own = [-sums[i, model.languages.index(langs[r])] / n[i] if n[i] and langs[r] in model.languages else None for i, r in enumerate(rows)]
                yield pa.RecordBatch.from_arrays([pa.array([langs[r] for r in rows], pa.string()), pa.array(own, pa.float64()), pa.array(n)], names=["lang", "entropy", "n"])

    seen = sample.where("calibrate").select("lang", "text").mapInArrow(entropies, "lang string, entropy double, n long").where("entropy IS NOT NULL").toPandas()
    limits = np.array([[math.inf, 0.0]] * len(model.languages))
    for lang, part in seen.groupby("lang"):
        h, n = np.sort(part["entropy"].to_numpy()), part["n"].to_numpy()
        mean = np.average(part["entropy"], weights=n)
        spread = math.sqrt(np.mean((part["entropy"] - mean) ** 2 * n))
        limits[model.languages.index(lang)] = max(float(np.quantile(h, QUANTILE)), mean), spread
    return model, limits


def identify(docs: DataFrame, model: KneserNey | None, limits: np.ndarray, carry: Column | None = None) -> DataFrame:
    """``row`` (struct of all columns, or what ``carry`` gives), lang_pred, score, cross_entropy, rejected."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model, limits))
    held = docs.select((F.struct("*") if carry is None else carry).alias("row"), "text")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, limits = shared.value
        for batch in slices(parts):
            names, score, entropy, rejected = _identify(model, limits, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(names, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)], names=["row", "lang_pred", "score", "cross_entropy", "rejected"])

    row = dict(held.dtypes)["row"]
    return held.mapInArrow(batches, f"row {row}, lang_pred string, score double, cross_entropy double, rejected boolean")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is not rejected; columns unchanged."""
    model, limits = fit(docs)
    return identify(docs, model, limits).where("NOT rejected").select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    model, limits = fit(docs)
    found = identify(docs.select("doc_id", "text"), model, limits, F.struct("doc_id"))
    return found.select("row.doc_id", "lang_pred", "score", "rejected").withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "rejected")
