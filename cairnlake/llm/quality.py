"""Quality rules with an isolation forest on rule statistics.

Each document's rule statistics (counts of words, symbols, repeated lines, repeated word windows and
so on) become ratios; an isolation forest over the ratios gives an anomaly score from path lengths
over random splits.  Split points are drawn over the box that a node covers within the range of all
labelled rows, not only over the rows in it, so a statistic that is constant on good documents can
still isolate a document that departs from it; a branch without training rows is a leaf of its own.

The forest judges what the base rule lets pass.  So it is fitted on good labelled rows that pass, and
the threshold is calibrated on all labelled rows that pass: the score that best separates good from
bad ones, but never one that drops more than ``LEAST_KEPT`` allows of the good ones.  Ranges and the
threshold come from every labelled row, by aggregations; each tree draws its ``SUBSAMPLE`` rows, which
is the method's own, from all good ones by a hash.

One pass over the documents in Arrow batches computes the statistics, whose small rows are written to
the shared folder; labels meet them by a join, so no text is shuffled or read twice.  The driver holds
the rows that the trees draw, whatever the number of labels.

Defined cases: null or wordless text has zero counts and fails the base rule; null labels and labels
of unknown documents are ignored; without labelled rows of both kinds the forest drops nothing;
repeated rows are judged each by itself; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices, small_batches
from .minhash import hash_word, shingles

TREES, SUBSAMPLE, SEED = 100, 256, 7
#: Share of good labelled rows that the threshold must keep.
LEAST_KEPT = 0.995
#: Ranges of scores that are summed up apart while the threshold is sought.
RANGES = 4096
#: Base rule: fewest words, and percent of words in repeated windows that fails a document.
MIN_WORDS, MAX_REPEAT = 50, 50
SYMBOLS = b"#*$%&|<>"

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "marks")

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_TAIL = np.zeros(256, bool)
_TAIL[0x80:0xC0] = True


def rule_statistics(text: str | None) -> tuple[int, ...]:
    """Counts in the order of STATS over the whole text.  Repeated windows are found by sorting their 64-bit
    hashes, so a very long text takes some tens of bytes a word."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits = int(of[65:91].sum()), int(of[97:123].sum()), int(of[48:58].sum())
    symbols = int(of[list(SYMBOLS)].sum())
    chars = len(raw) - int(of[_BLANK].sum()) - int(of[_TAIL].sum())
    marks = int(of[33:127].sum()) - upper - lower - digits
    seen: set[bytes] = set()
    lines = dups = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dups += 1
            else:
                seen.add(line)
    repeats = 0
    if n > 3:
        grams = shingles(np.fromiter(map(hash_word, words), np.uint64, n), 3)
        order = np.argsort(grams, kind="stable")
        same = grams[order][1:] == grams[order][:-1]
        hit = np.zeros(n, bool)
        for at in (order[1:][same], order[:-1][same]):
            for j in range(3):
                hit[at + j] = True
        repeats = int(hit.sum())
    return n, chars, symbols, dups, repeats, lines, upper, upper + lower, digits, marks


def features(stats: np.ndarray) -> np.ndarray:
    """Ratios in the order of FEATURES from rows of STATS; cube roots spread the small ratios of rare characters."""
    n, chars, symbols, dups, repeats, lines, upper, letters, digits, marks = stats.astype(float).T
    some = np.maximum(n, 1)
    return np.column_stack([np.log1p(n), chars / some, np.cbrt(symbols / some), dups / np.maximum(lines, 1), repeats / some, upper / np.maximum(letters, 1), digits / np.maximum(chars, 1), np.cbrt(marks / some)])


def expected_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows, which a leaf of n rows stands for."""
    n = np.asarray(n, float)
    h = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def fit_forest(rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED, drawn: tuple[np.ndarray, int] | None = None) -> dict[str, np.ndarray]:
    """Arrays (tree, node) of complete binary trees: feature (-1 in leaves), split, path length of leaves.
    Each tree draws from ``rows``; or ``drawn`` has the tree of each row, in order, and of how many rows they are."""
    of, n = drawn or (None, len(rows))
    depth = math.ceil(math.log2(max(2, min(subsample, n))))
    size = 2 ** (depth + 1) - 1
    feature, split, path = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
    rng = np.random.default_rng(seed)
    for t in range(trees):
        pick = rows[rng.permutation(n) if of is None else of == t][:subsample]
        todo = [(0, 0, pick, low.copy(), high.copy())]
        while todo:
            node, d, part, lo, hi = todo.pop()
            open_ = np.flatnonzero(hi > lo)
            if d == depth or len(part) <= 1 or not len(open_):
                path[t, node] = d + float(expected_path(len(part)))
                continue
            f = int(rng.choice(open_))
            s = float(rng.uniform(lo[f], hi[f]))
            feature[t, node], split[t, node] = f, s
            left = part[:, f] < s
            lo2, hi2 = lo.copy(), hi.copy()
            hi2[f], lo2[f] = s, s
            todo += [(2 * node + 1, d + 1, part[left], lo, hi2), (2 * node + 2, d + 1, part[~left], lo2, hi)]
    return {"feature": feature, "split": split, "path": path, "norm": np.array(float(expected_path(min(subsample, max(n, 2)))) or 1.0)}


def score_forest(forest: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Anomaly score 2 ** (-mean path / expected path) of each row; larger is odder."""
    total = np.zeros(len(rows))
    at = np.arange(len(rows))
    for feature, split, path in zip(forest["feature"], forest["split"], forest["path"]):
        node = np.zeros(len(rows), int)
        for _ in range(int(math.log2(len(feature) + 1))):
            f = feature[node]
            inner = f >= 0
            right = rows[at, np.maximum(f, 0)] >= split[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        total += path[node]
    return 2.0 ** (-total / len(forest["path"]) / forest["norm"])


def calibrate(scores: np.ndarray, good: np.ndarray, least_kept: float = LEAST_KEPT) -> float:
    """The score above which documents go: the best sum of good rows kept and bad rows dropped among
    thresholds that keep enough good rows; infinite without rows of both kinds."""
    if not good.any() or good.all():
        return math.inf
    cuts = np.unique(scores)
    kept_good = np.searchsorted(np.sort(scores[good]), cuts, "right") / good.sum()
    kept_bad = np.searchsorted(np.sort(scores[~good]), cuts, "right") / (~good).sum()
    gain = np.where(kept_good >= least_kept, kept_good - kept_bad, -np.inf)
    best = int(np.argmax(gain))
    return float((cuts[best] + cuts[best + 1]) / 2) if best + 1 < len(cuts) else float(cuts[best])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of STATS of every document, materialised."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(parts):
            stats = np.array([rule_statistics(x.as_py()) for x in batch.column("text")], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, stats.T)], names=["doc_id", *STATS])

    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return materialise(docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, " + ", ".join(f"{x} long" for x in STATS)))


def _with(df: DataFrame, names: dict[str, str], values) -> DataFrame:
    """``df`` with columns of these names and types, which ``values`` works out from arrays of each batch."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, values(part))], names=[*part.schema.names, *names])

    return df.mapInArrow(batches, ", ".join(f"{a} {b}" for a, b in [*df.dtypes, *names.items()]))


def _matrix(batch: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    return np.column_stack([batch.column(x).to_numpy(zero_copy_only=False) for x in names])


def calibrate_rows(scored: DataFrame, least_kept: float = LEAST_KEPT) -> float:
    """What ``calibrate`` gives for the rows (score, good) of a table, without collecting them: counts by
    distinct score, summed up within ranges of scores to which the counts of lower ranges are added."""
    counts = scored.groupBy("score").agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
    counts = materialise(counts.withColumn("range", F.floor(F.col("score") * RANGES)))
    ranges = counts.groupBy("range").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("range").collect()  # RANGES rows at most
    n_good, n_bad = sum(r["good"] for r in ranges), sum(r["bad"] for r in ranges)
    if not n_good or not n_bad:
        return math.inf
    below, good, bad = [], 0, 0
    for r in ranges:
        below.append((r["range"], good, bad))
        good, bad = good + r["good"], bad + r["bad"]
    below = counts.sparkSession.createDataFrame(below, "range long, good_below long, bad_below long")
    upward = Window.partitionBy("range").orderBy("score")
    cuts = counts.join(F.broadcast(below), "range").select("score", (F.col("good_below") + F.sum("good").over(upward)).alias("g"), (F.col("bad_below") + F.sum("bad").over(upward)).alias("b"))
    cuts = cuts.select("score", (F.col("g") / n_good).alias("kept_good"), (F.col("b") / n_bad).alias("kept_bad")).where(F.col("kept_good") >= least_kept)
    best = cuts.orderBy((F.col("kept_good") - F.col("kept_bad")).desc(), "score").first()["score"]
    after = counts.where(F.col("score") > best).agg(F.min("score")).first()[0]
    return best if after is None else (best + after) / 2


def fit_statistics(stats: DataFrame, labels: DataFrame) -> tuple[dict[str, np.ndarray] | None, float]:
    """Forest and threshold from the statistics of all labelled rows."""
    said = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg((F.min("quality") == 1).alias("good"))
    labelled = stats.where(~base_failed()).join(said, F.col("doc_id") == F.col("id")).select("good", F.xxhash64("doc_id", *STATS).alias("h"), *STATS)
    rows = materialise(_with(labelled, dict.fromkeys(FEATURES, "double"), lambda batch: features(_matrix(batch, STATS)).T).select("good", "h", *FEATURES))
    bounds = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("n_good"), *[f(x).alias(f"{f.__name__}_{x}") for f in (F.min, F.max) for x in FEATURES]).first()
    n, n_good = bounds["n"], bounds["n_good"]
    if not n:
        return None, math.inf
    low, high = (np.array([bounds[f"{f}_{x}"] for x in FEATURES]) for f in ("min", "max"))
    n_from = n_good or n
    source, most = rows.where("good") if n_good else rows, 2 * SUBSAMPLE
    if n_from <= most:
        forest = fit_forest(source.select(*FEATURES).toPandas().sort_values([*FEATURES]).to_numpy(), low, high)
    else:  # a tree draws the rows of least hash; twice as many as it needs come, in expectation
        least = F.lit(-(2**63) + int(most / n_from * 2**64))
        draws = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64("h", t, F.lit(SEED)).alias("draw")))
        drawn = source.select(F.inline(F.filter(draws, lambda x: x["draw"] < least)), *FEATURES).toPandas()
        drawn = drawn.sort_values(["tree", "draw", *FEATURES])  # rows come in any order: the fit must not depend on it
        forest = fit_forest(drawn[list(FEATURES)].to_numpy(), low, high, drawn=(drawn["tree"].to_numpy(), n_from))
    scored = _with(rows.select("good", *FEATURES), {"score": "double"}, lambda batch: [score_forest(forest, _matrix(batch, FEATURES))])
    return forest, calibrate_rows(scored.select("score", "good"))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, np.ndarray] | None, float]:
    """Forest and threshold from all labelled documents."""
    return fit_statistics(statistics(docs), labels)


def score_statistics(stats: DataFrame, forest: dict[str, np.ndarray] | None) -> DataFrame:
    """The rows of ``statistics`` with their score."""
    return _with(stats, {"score": "double"}, lambda batch: [score_forest(forest, features(_matrix(batch, STATS))) if forest else np.zeros(batch.num_rows)])


def score_documents(docs: DataFrame, forest: dict[str, np.ndarray] | None) -> DataFrame:
    """doc_id, the counts of STATS, score."""
    return score_statistics(statistics(docs), forest)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = statistics(docs)
    forest, threshold = fit_statistics(stats, labels)
    scored = score_statistics(stats, forest).withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & (F.col("score") <= F.lit(float(threshold)))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "score")
