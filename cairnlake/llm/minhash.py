"""MinHash near-duplicate removal with min-max hashing.

Each permutation of the shingle hashes gives two values of a signature, its minimum and its maximum,
so a signature of 192 values takes 96 hash evaluations.  Bands of ROWS values collide for a pair of
similarity s with probability s ** ROWS each; with 32 bands of 6 a pair at 0.85 is missed with
probability below 1e-6, one at 0.8 below 1e-4, and a component is lost only with all its paths.

1. One pass in Arrow batches: size of the shingle set, its 128-bit digest, and the bands.
2. Documents with equal sets are one class (a group by digest with partial aggregation: a third of
   all rows may be one class).
3. Band keys meet by aggregation: the least class of a key is its hub, and every other class of the
   key is a candidate for a link to the hub, unless the sizes of the sets rule it out.  No pairs within
   a bucket are made.
4. The sets of classes with candidates are written once.  Links to hubs are verified on full sets, first
   one hub for each class, then the hubs that are not yet in the class's component.  Components are those
   of verified links only, so texts that share boilerplate are not chained together.
5. A key whose classes other than the hub still lie in several components may hide links among them.
   The sets of such a key come together, in blocks of at most BLOCK_SHINGLES: a larger bucket is dealt
   into blocks, and every pair of blocks is a task of bounded size.  Within a task, intersections come
   from an inverted list, and only sets outside the largest component need a row of intersections, since
   links within a component change nothing.
6. Documents that share an id link their classes.  Components of all links give every class its document
   of least id.

The work in step 5 grows with the square of a bucket's blocks; it is needed for buckets whose texts
collide and yet are no near copies of the bucket's hub.

Defined cases: null or wordless text has an empty set and is linked with nothing; a text with fewer
words than a shingle is one shingle; equal texts under several ids are one class; rows that repeat
an id count as one document, linked by all their texts; a row with a null id is neither linked nor
dropped (component null, kept); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, materialise, slices, small_batches
from .components import connected_components

SHINGLE, PERCENT = 5, 80
PERMUTATIONS, ROWS = 96, 6
BANDS = 2 * PERMUTATIONS // ROWS
#: Shingles of sets that one task holds at most from each of two blocks.
BLOCK_SHINGLES = 500_000
#: Words whose hashes a worker remembers, and shingles hashed at once.
REMEMBER, AT_ONCE = 200_000, 200_000

_ODD = np.random.default_rng(20240229).integers(0, 2**63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()
hash_word = _words.__getitem__


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words between ASCII blanks, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    return np.fromiter(map(hash_word, words), np.uint64, len(words))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, in order; a shorter sequence is one."""
    n = min(k, len(h))
    if not n:
        return h
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = mix(out * _M3 + h[j : len(h) - n + 1 + j] + np.uint64(n))
    return out


def shingle_set(text: str | None, k: int) -> np.ndarray:
    return np.unique(shingles(word_hashes(text), k))


def band_values(sets: list[np.ndarray]) -> np.ndarray:
    """Band hashes (set, band) of non-empty sets."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    every = np.concatenate(sets)
    signature = np.empty((len(sets), 2 * PERMUTATIONS), np.uint64)
    for p, odd in enumerate(_ODD):
        value = every * odd
        signature[:, 2 * p] = np.minimum.reduceat(value, starts)
        signature[:, 2 * p + 1] = np.maximum.reduceat(value, starts)
    bands = np.zeros((len(sets), BANDS), np.uint64)
    for j in range(ROWS):
        bands = mix(bands * _M3 + signature[:, j::ROWS])
    return bands.view(np.int64)


def set_digest(s: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set), bands (null for the empty set)."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(parts):
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column("text")]
            bands: list[list[int] | None] = [None] * len(sets)
            run: list[int] = []
            size = 0
            for i, s in enumerate([*sets, None]):
                if s is None or size >= AT_ONCE:
                    if run:
                        for r, row in zip(run, band_values([sets[r] for r in run])):
                            bands[r] = row
                    run, size = [], 0
                if s is not None and len(s):
                    run.append(i)
                    size += len(s)
            digests = np.array([set_digest(s) for s in sets]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "d1", "d2", "bands"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, n_shingles long, d1 long, d2 long, bands array<long>")


def link_sets(sets: list[np.ndarray], names: list, percent: int) -> list[int]:
    """Component (index of one of its members) of each set: sets are linked if they share a name or
    100 * intersection >= percent * union."""
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first: dict = {}
    for i, name in enumerate(names):
        parent[i] = find(first.setdefault(name, i))
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    _, item = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(item, kind="stable")]
    per = np.bincount(item)
    begin = np.cumsum(per) - per

    def compare(x: int) -> None:
        items = item[starts[x] : starts[x + 1]]
        n = per[items]
        shared = np.bincount(owner[np.repeat(begin[items] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))
        for y in np.flatnonzero((shared > 0) & (100 * shared >= percent * (sizes[x] + sizes - shared))):
            parent[find(int(y))] = find(x)

    overlap = np.add.reduceat(per[item], starts[:-1])
    compare(int(np.argmax(overlap)))
    roots = [find(i) for i in range(len(sets))]
    largest = max(set(roots), key=roots.count)
    for x in range(len(sets)):
        if roots[x] != largest:
            compare(x)
    return [find(i) for i in range(len(sets))]


def _link_block(table: pa.Table, percent: int) -> pa.Table:
    names = table.column("rep").to_pylist()
    held = table.column("shingles").combine_chunks()
    flat, ends = held.flatten().to_numpy(), held.offsets.to_numpy()
    sets = [flat[x - ends[0] : y - ends[0]] for x, y in zip(ends[:-1], ends[1:])]
    a, b = [], []
    for i, root in enumerate(link_sets(sets, names, percent)):
        if names[i] != names[root]:
            a.append(names[i])
            b.append(names[root])
    kind = table.schema.field("rep").type
    return pa.table({"a": pa.array(a, kind), "b": pa.array(b, kind)})


def _sets(docs: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """(rep, n, shingles): the shingle sets of the classes (rep, d1, d2), made anew from the text of rep."""
    kind = dict(docs.dtypes)["doc_id"]
    members = bounded_broadcast(materialise(members))
    held = docs.select("doc_id", "text").join(members, F.col("doc_id") == F.col("rep")).select("rep", "d1", "d2", "text")

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(parts):
            found = [shingle_set(t.as_py(), shingle) for t in batch.column("text")]
            digests = np.array([set_digest(s) for s in found]).reshape(-1, 2)
            same = (digests[:, 0] == batch.column("d1").to_numpy()) & (digests[:, 1] == batch.column("d2").to_numpy())
            sets = pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in ("rep", "d1", "d2")] + [sets], names=["rep", "d1", "d2", "shingles"]).filter(pa.array(same))

    made = held.mapInArrow(read, f"rep {kind}, d1 long, d2 long, shingles array<long>")
    return made.groupBy("rep", "d1", "d2").agg(F.first("shingles").alias("shingles")).select("rep", F.size("shingles").alias("n"), "shingles")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets satisfy 100 * intersection >= percent * union.  b's set goes to a's, so a
    hub with very many candidates is a skewed join that adaptive execution splits."""
    one, two = [sets.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("shingles").alias(f"s_{x}")) for x in "ab"]
    met = pairs.join(two, "b").join(one, "a")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return materialise(met.where(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b").distinct())


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends do not lie in one component."""
    of = [roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab"]
    met = pairs.join(of[0], "a", "left").join(of[1], "b", "left")
    return met.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _shared_ids(usable: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that repeat an id with other texts."""
    ids = usable.groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("low"), F.max(F.struct("d1", "d2")).alias("high")).where("low != high").select("doc_id")
    of = usable.join(bounded_broadcast(materialise(ids)), "doc_id").join(classes, ["d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    return of.where("a != b").distinct()


def _hidden(met: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the reps of keys that still hold several components besides the hub.  Keys with
    the same reps count once."""
    kind = dict(met.dtypes)["rep"]
    of = roots.select(F.col("node").alias("rep"), "root")
    inside = materialise(met.join(of, "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root")))
    name = F.xxhash64("rep")
    open_ = inside.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.bit_xor(name).alias("x"), F.sum(F.shiftright(name, 32)).alias("y"), F.count(F.lit(1)).alias("z"))
    open_ = materialise(open_.where("low != high").groupBy("x", "y", "z").agg(F.min("key").alias("key")).select("key"))
    held = inside.join(bounded_broadcast(open_), "key")
    blocks = held.join(sets.select("rep", "n"), "rep").groupBy("key").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    held = held.join(bounded_broadcast(materialise(blocks)), "key").join(sets.select("rep", "shingles"), "rep")
    dealt = held.withColumn("block", F.pmod(name, F.col("blocks")).cast("int"))
    dealt = dealt.select("key", "root", "shingles", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "blocks").where("other != block OR blocks = 1")
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("root").alias("rep"), "shingles")
    return dealt.groupBy("key", "i", "j").applyInArrow(lambda t: _link_block(t, percent), f"a {kind}, b {kind}")


def shared_keys(keys: DataFrame) -> DataFrame:
    """From distinct (key, rep): (key, hub, rep) of all but the least rep of each key that several share; hub
    is that least."""
    hubs = materialise(keys.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).where("hub != top").select("key", "hub"))
    return materialise(keys.join(bounded_broadcast(hubs), "key").where("rep != hub").select("key", "hub", "rep"))


def verified_links(met: DataFrame, sets: DataFrame, percent: int, known: DataFrame | None = None) -> DataFrame:
    """Links (a, b), verified on the full sets (rep, n, shingles), whose components are those of all pairs
    that share a key and satisfy 100 * intersection >= percent * union; ``known`` has further links."""
    pairs = met.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    for x in "ab":
        pairs = pairs.join(sets.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}")), x)
    sized = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    candidates = materialise(pairs.where(sized).select("a", "b").distinct())
    first = materialise(candidates.groupBy("b").agg(F.min("a").alias("a")))
    links = _verified(first, sets, percent)
    roots = materialise(connected_components(links))
    rest = candidates.join(first.select("b", F.col("a").alias("done")), "b").where("a != done").select("a", "b")
    links = links.unionByName(_verified(_apart(rest, roots), sets, percent))
    links = materialise(links.unionByName(known) if known else links)
    roots = materialise(connected_components(links))
    return links.unionByName(_hidden(met, roots, sets, percent))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    signed = materialise(signatures(docs, shingle))
    usable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialise(usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    keys = classes.select("rep", F.posexplode("bands").alias("band", "value")).select("rep", F.xxhash64("band", "value").alias("key"))
    met = shared_keys(keys)
    wanted = met.select(F.explode(F.array("rep", "hub")).alias("rep")).distinct()
    sets = materialise(_sets(docs, classes.join(wanted, "rep").select("rep", "d1", "d2"), shingle))
    joined = materialise(connected_components(verified_links(met, sets, percent, _shared_ids(usable, classes))))

    named = classes.select("d1", "d2", "rep").join(joined.select(F.col("node").alias("rep"), "root"), "rep", "left")
    named = materialise(named.select("d1", "d2", F.coalesce("root", "rep").alias("component_id")))
    out = signed.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each group of near duplicates, with its columns unchanged.  Where rows repeat
    an id, all rows of a kept id stay."""
    gone = materialise(near_duplicates(docs.select("doc_id", "text"), shingle, percent).where("NOT kept").select(F.col("doc_id").alias("gone")).distinct())
    held = docs.select(F.struct("*").alias("row"))
    return held.join(bounded_broadcast(gone), F.col("row.doc_id") == F.col("gone"), "left_anti").select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text"), shingle=3, percent=85)
