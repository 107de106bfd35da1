"""Helpers that the corpus operators share: tables, shared storage, bounded broadcasts, words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from ..sources.shared import BATCH_BYTES, TEXTS, materialise, release, shared_dir, small_batches

#: Bytes up to which a measured side of a join is broadcast (a hint is given only after measuring), and
#: bytes that a row costs besides its values.
BROADCAST_BYTES, ROW_OVERHEAD = 32 << 20, 40

#: Characters of texts that a Python worker reads at once.
CHARACTERS = 10_000_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII characters that no content word holds: everything but digits and letters.
NOT_WORD = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: ASCII blanks: space, and tab to carriage return.
BLANKS = "".join(map(chr, [0x20, *range(0x09, 0x0E)]))
BLANK_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def value_bytes(value: Column, kind: DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, (StringType, BinaryType)):
        return 8 + F.coalesce(F.octet_length(value), F.lit(0)).cast("long")
    if isinstance(kind, StructType):
        return sum((value_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("long"))
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, StructType, ArrayType)):
            inner = F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + value_bytes(x, kind.elementType))
        else:
            inner = 8 * F.greatest(F.size(value), F.lit(0)).cast("long")
        return 24 + F.coalesce(inner, F.lit(0).cast("long"))
    return F.lit(8).cast("long")


def table_bytes(df: DataFrame) -> int:
    """About how many bytes the rows take in a broadcast."""
    row = sum((value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(ROW_OVERHEAD).cast("long"))
    return df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def bounded_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` if its measured size is at most ``most`` bytes, else leave the join to Spark
    (shuffled, with adaptive splitting of skewed partitions).  Give a materialised table."""
    return F.broadcast(df) if table_bytes(df) <= most else df


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most TEXTS rows and, but for single rows, CHARACTERS of text."""
    for batch in batches:
        size = np.array(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64)
        at = 0
        while at < batch.num_rows:
            n = min(TEXTS, max(1, int(np.searchsorted(np.cumsum(size[at : at + TEXTS]), CHARACTERS, "right"))), batch.num_rows - at)
            yield batch.slice(at, n)
            at += n


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body`` (also inside lambdas, where
    a plain column expression would be evaluated again for each element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def content_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; null has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + NOT_WORD, UPPER.lower() + " " * len(NOT_WORD))
    return F.array_remove(F.split(plain, " "), "")


def blank_word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(BLANK_WORD)), F.lit(0)).cast("long")


def text_keys(text: Column) -> list[Column]:
    """The MD5 of a text in two numbers."""
    digest = F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
    return [F.conv(F.substring(digest, 1 + 16 * j, 16), 16, -10).cast("long").alias(f"k{j + 1}") for j in range(2)]
