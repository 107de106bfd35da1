"""Payload functions: codecs, checksums, journals in bytes (O-156 to O-163, O-173, O-180, O-188, O-189)."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import small_batches

#: Flags of block kinds.
NORMAL, AES256, SM4 = 1, 2, 4
SNAPPY, ZSTD, GZIP, BROTLI = 16, 32, 64, 128
SPARSE = 65536
CODEC_NAMES = {AES256: "AES256", SM4: "SM4", SNAPPY: "SNAPPY", ZSTD: "ZSTD", GZIP: "GZIP", BROTLI: "BR"}
#: Fixed value: bytes that the header checksum covers.
HEADER = 102400
#: Checksums of empty content.
EMPTY_XXH3 = 3244421341483603138


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@F.pandas_udf(T.LongType())
def xxh3(content: pd.Series) -> pd.Series:
    """64-bit XXH3 as a signed number."""
    return content.map(lambda b: None if b is None else _signed(xxhash.xxh3_64_intdigest(b))).astype("Int64")


def checksums(content: Column) -> list[Column]:
    """h (first HEADER bytes), x, and the four signed words of SHA-256."""
    sha = F.sha2(content, 256)
    words = [F.conv(F.substring(sha, 1 + 16 * i, 16), 16, -10).cast("long").alias(f"s{i}") for i in range(4)]
    return [xxh3(F.substring(content, 1, HEADER)).alias("h"), xxh3(content).alias("x"), *words]


def _snappy_size(block: bytes) -> int:
    """The size of the content, which a Snappy block starts with (seven bits a byte, the lowest first)."""
    size = 0
    for i, byte in enumerate(block[:5]):
        size |= (byte & 127) << (7 * i)
        if byte < 128:
            break
    return size


def _packer(codec: int, level: int) -> Callable[[bytes], bytes]:
    return {
        ZSTD: zstandard.ZstdCompressor(level=level).compress,
        GZIP: lambda b: gzip.compress(b, level, mtime=0),
        SNAPPY: lambda b: pa.compress(b, codec="snappy", asbytes=True),
        BROTLI: lambda b: pa.Codec("brotli", compression_level=level).compress(b, asbytes=True),
    }[codec]


def _unpacker(codec: int) -> Callable[[bytes], bytes]:
    return {
        ZSTD: zstandard.ZstdDecompressor().decompress,
        GZIP: gzip.decompress,
        SNAPPY: lambda b: pa.decompress(b, _snappy_size(b), codec="snappy", asbytes=True),
        BROTLI: lambda b: pa.CompressedInputStream(pa.BufferReader(b), "brotli").read(),
    }[codec]


def compress(content: Column, codec: int, level: int = 3) -> Column:
    """zstd, gzip or brotli frames, or Snappy blocks, of byte columns."""
    small_batches(SparkSession.active())

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        pack = _packer(codec, level)
        return values.map(lambda b: None if b is None else pack(bytes(b)))

    return run(content)


def decompress(content: Column, codec: int) -> Column:
    small_batches(SparkSession.active())

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        unpack = _unpacker(codec)
        return values.map(lambda b: None if b is None else unpack(bytes(b)))

    return run(content)


def process(content: Column, codec: int, key: bytes | None = None) -> Column:
    """Struct (bytes, kind): compressed unless that is not smaller, then encrypted if there is a key."""
    packed = compress(content, codec)
    smaller = F.octet_length(packed) < F.octet_length(content)
    body = F.when(smaller, packed).otherwise(content)
    kind = F.when(smaller, NORMAL | codec).otherwise(NORMAL)
    if key:
        body, kind = F.aes_encrypt(body, F.lit(key)), kind.bitwiseOR(AES256)
    return F.struct(body.alias("bytes"), kind.alias("kind"))


def unprocess(content: Column, kind: Column, codec: int, key: bytes | None = None) -> Column:
    body = F.when(kind.bitwiseAND(AES256) != 0, F.aes_decrypt(content, F.lit(key))).otherwise(content) if key else content
    return F.when(kind.bitwiseAND(codec) != 0, decompress(F.when(kind.bitwiseAND(codec) != 0, body), codec)).otherwise(body)


def unprocess_any(content: Column, kind: Column, codecs: Sequence[int], key: bytes | None = None) -> Column:
    """Decrypt and decompress as the block's kind says, whichever of the codecs it names."""
    body = F.when(kind.bitwiseAND(AES256) != 0, F.aes_decrypt(content, F.lit(key))).otherwise(content) if key else content
    small_batches(SparkSession.active())

    @F.pandas_udf("binary")
    def run(values: pd.Series, kinds: pd.Series) -> pd.Series:
        unpack = {codec: _unpacker(codec) for codec in codecs}
        return pd.Series([None if b is None else next(unpack[c] for c in codecs if int(k) & c)(bytes(b)) for b, k in zip(values, kinds)], dtype=object)

    named = kind.bitwiseAND(sum(set(codecs)))
    return F.coalesce(run(F.when(named != 0, body), F.coalesce(named, F.lit(0))), body)


def assemble(chunks: DataFrame) -> DataFrame:
    """(data_id, bytes) of blocks from their chunks (data_id, sn, bytes) in order.  A block is one row, as
    large as the block; keep large blocks in chunks."""
    parts = F.array_sort(F.collect_list(F.struct("sn", "bytes")))
    joined = F.aggregate(parts, F.unhex(F.lit("")), lambda a, p: F.concat(a, p["bytes"]))
    return chunks.groupBy("data_id").agg(joined.alias("bytes"))


def zero_filled(blocks: DataFrame, chunks: DataFrame, chunk: int) -> DataFrame:
    """(data_id, sn, bytes) of all chunks of sparse blocks (id, s): missing ones and short ends are zeros."""
    want = blocks.where("s > 0").select(F.col("id").alias("data_id"), "s", F.explode(F.sequence(F.lit(0), F.ceil(F.col("s") / chunk).cast("int") - 1)).alias("sn"))
    size = F.least(F.lit(chunk), F.col("s") - F.col("sn") * chunk).cast("int")
    zero = F.unhex(F.lit("00"))
    met = want.join(chunks, ["data_id", "sn"], "left")
    return met.select("data_id", "sn", F.rpad(F.coalesce("bytes", F.unhex(F.lit(""))), size, zero).alias("bytes"))


def apply_writes(base: bytes, writes: list[tuple[int, bytes]]) -> bytes:
    """The base with the writes laid over it in order, grown by zeros where a write starts beyond its end."""
    out = bytearray(base)
    for at, body in writes:
        if at > len(out):
            out += bytes(at - len(out))
        out[at : at + len(body)] = body
    return bytes(out)


def overlay_files(base: DataFrame, writes: DataFrame) -> DataFrame:
    """(file_id, bytes) of base files (file_id, bytes) after their writes (file_id, seq, off, body); one
    file, or one chunk of it, is one group."""
    def run(key: tuple, b: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        body = bytes(b["bytes"].iloc[0]) if len(b) else b""
        w = w.sort_values("seq")
        return pd.DataFrame({"file_id": [key[0]], "bytes": [apply_writes(body, [(int(o), bytes(x)) for o, x in zip(w["off"], w["body"])])]})

    return base.groupBy("file_id").cogroup(writes.groupBy("file_id")).applyInPandas(run, "file_id long, bytes binary")


def pack_journal(entries: list[tuple[int, bytes]], size: int) -> bytes:
    """Count and file size, then offset, length and bytes of each entry; numbers are 8 bytes, little-endian."""
    return struct.pack("<qq", len(entries), size) + b"".join(struct.pack("<qq", o, len(b)) + b for o, b in entries)


def unpack_journal(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    count, _ = struct.unpack_from("<qq", raw)
    at = 16
    for _ in range(count):
        off, length = struct.unpack_from("<qq", raw, at)
        yield off, length, raw[at + 16 : at + 16 + length]
        at += 16 + length


def pack_journals(writes: DataFrame) -> DataFrame:
    """(file_id, raw) from writes (file_id, seq, off, body)."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        entries = [(int(o), bytes(b)) for o, b in zip(part["off"], part["body"])]
        return pd.DataFrame({"file_id": [part["file_id"].iloc[0]], "raw": [pack_journal(entries, max(o + len(b) for o, b in entries))]})

    return writes.select("file_id", "seq", "off", "body").groupBy("file_id").applyInPandas(run, "file_id long, raw binary")


def unpack_journals(raws: DataFrame) -> DataFrame:
    """(file_id, nth, off, len, body) of packed journals (file_id, raw)."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(f, i, o, n, b) for f, raw in zip(part["file_id"], part["raw"]) for i, (o, n, b) in enumerate(unpack_journal(bytes(raw)))]
            yield pd.DataFrame(rows, columns=["file_id", "nth", "off", "len", "body"])

    return raws.select("file_id", "raw").mapInPandas(run, "file_id long, nth long, off long, len long, body binary")
