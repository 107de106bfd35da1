"""Mixing sources to target weights (DataFrame functions only).

Words are summed per source, targets follow by sharing the whole size by weight under a cap
(a multiple of each source's own size), and every document is emitted floor(rate) times plus one
hash-seeded Bernoulli copy with probability equal to the fraction of the rate.

Two passes over the texts, no shuffle of documents: an aggregation by source (partial sums first, so
a source with a third of all rows sends one row per task) and a join with the table of sources, which
is broadcast only when its size has been checked.

There is one draw for each document, which depends on its id alone: reruns and other partitionings
agree, and another document changes a copy only through the rate.  The words taken from a source miss
its target by about sqrt(sum of size^2 * part * (1 - part)), a share that falls with the square root of
the number of documents.

Defined cases: null text has size 0; a null source is a source of its own and the last in order; an
empty table gives no rows; a source without words has target 0 and takes nothing; rows that repeat
an id share a draw; a null id draws by its text.  Columns of the documents are carried in a struct,
so names that clash with those made here stay intact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blank_word_count, bounded_broadcast, materialise

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "0:"


def draw(doc_id: Column, text: Column) -> Column:
    """A number from 0 to 2**32-1, decided by the document's id (by its text if that is null)."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(text)), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED), key)), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """From (source, source_size): adds weight and target.

    Weights repeat in the order of the sources by code point, null last.  Sharing a total by weight
    under caps is water-filling: in order of cap / weight, a source is capped as long as the level
    that the rest would get reaches its cap; the others share what is left by weight.  The windows
    run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1).cast("long"))
    ranked = ranked.withColumn("cap", (F.col("source_size") * cap).cast("long"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = ranked.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        F.sum("weight").over(every).alias("weights"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    )
    capped = (F.col("total") - F.col("cap_before")).cast("double") * F.col("weight") >= F.col("cap").cast("double") * (F.col("weights") - F.col("weight_before"))
    ranked = ranked.withColumn("capped", capped)
    left = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every)
    left_weight = F.col("weights") - F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0)).over(every)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * left.cast("double") / F.nullif(left_weight, F.lit(0)))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def mixing_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per document: ``row`` (struct of all its columns), size, source_size, target,
    copies (how often the mix takes it)."""
    sized = docs.select(F.struct("*").alias("row"), F.col("source"), blank_word_count(F.col("text")).alias("size"))
    sizes = docs.select("source", blank_word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = materialise(targets.select(F.col("source").alias("to_source"), "source_size", "target", F.floor(rate).cast("long").alias("whole"), ((rate - F.floor(rate)) * 4294967296.0).alias("part")))
    joined = sized.join(bounded_broadcast(rates), F.col("source").eqNullSafe(F.col("to_source")))
    copies = F.col("whole") + F.when(draw(F.col("row.doc_id"), F.col("row.text")) < F.col("part"), 1).otherwise(0)
    return joined.select("row", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mixed corpus: each document's row as often as the mix takes it, columns unchanged."""
    plan = mixing_plan(docs, weights, cap).where("copies > 0")
    return plan.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    plan = mixing_plan(docs.select("doc_id", "text", "source"))
    return plan.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  coalesce(doc_id::VARCHAR, 'text ' || md5(text), '') AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight, {CAP} * source_size AS cap FROM s),
q AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS weights,
             coalesce(sum(cap) OVER b, 0)::BIGINT AS cap_before, coalesce(sum(weight) OVER b, 0)::BIGINT AS weight_before FROM r
      WINDOW b AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (total - cap_before)::DOUBLE * weight >= cap::DOUBLE * (weights - weight_before) AS capped FROM q),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE weight * (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::DOUBLE
             / nullif(weights - sum(CASE WHEN capped THEN weight ELSE 0 END) OVER (), 0)::DOUBLE END AS target FROM c),
p AS (SELECT *, floor(coalesce(target / nullif(source_size, 0), 0))::BIGINT AS whole FROM t),
w AS (SELECT *, (coalesce(target / nullif(source_size, 0), 0) - whole) * 4294967296.0::DOUBLE AS part FROM p),
j AS (SELECT d.*, w.source_size, w.target, w.whole, w.part, ('0x' || substr(md5('{SEED}' || k), 1, 8))::BIGINT AS u FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN u < part THEN 1 ELSE 0 END))::BIGINT AS taken FROM j
"""
