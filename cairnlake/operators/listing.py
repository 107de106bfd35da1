"""Filters, name matching, keyset paging and listings (O-62 to O-86, O-136)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Public order names and their columns.
ORDER_FIELDS = {"id": "id", "name": "n", "mtime": "m", "type": "t", "size": "s"}
UNIQUE = ("id", "n")


def order_field(name: str) -> tuple[str, bool]:
    """Column and whether descending, of ``[+-]name``; unknown names raise."""
    field = name.lstrip("+-")
    if field not in ORDER_FIELDS:
        raise ValueError(f"unknown order field: {field}")
    return ORDER_FIELDS[field], name.startswith("-")


def like_pattern(word: str) -> str:
    """``*`` and ``?`` become LIKE wildcards; LIKE's own characters are taken literally."""
    return word.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")


def name_matches(name: Column, word: str) -> Column:
    """Exact and case-sensitive without wildcards; with them, case-insensitive."""
    if not word:
        return F.lit(True)
    return name.ilike(like_pattern(word)) if "*" in word or "?" in word else name == word


def after_cursor(order: str, cursor: str | None) -> Column:
    """Rows after a cursor.  Non-unique fields continue with larger ids within the cursor's value,
    in both directions."""
    field, down = order_field(order)
    if not cursor:
        return F.lit(True)
    col = F.col(field)
    if field in UNIQUE:
        value = cursor if field == "n" else int(cursor)
        return col < value if down else col > value
    value, last = map(int, cursor.split(":"))
    return (col < value if down else col > value) | ((col == value) & (F.col("id") > last))


def cursor_of(order: str) -> Column:
    field, _ = order_field(order)
    return F.col(field).cast("string") if field in UNIQUE else F.concat_ws(":", F.col(field).cast("string"), F.col("id").cast("string"))


def keyset_page(df: DataFrame, order: str = "id", cursor: str | None = None, count: int = 1000) -> DataFrame:
    """The next ``count`` rows after the cursor, each with the cursor that continues after it."""
    field, down = order_field(order)
    keys = [F.desc(field) if down else F.asc(field)] + ([] if field == "id" else [F.asc("id")])
    return df.where(after_cursor(order, cursor)).orderBy(*keys).limit(count).withColumn("cursor", cursor_of(order))


def list_objects(obj: DataFrame, pid: int, word: str = "", kind: int | None = None, order: str = "id", cursor: str | None = None, count: int = 1000) -> tuple[DataFrame, DataFrame]:
    """A page of a directory's live entries, and the total, which the cursor does not change."""
    rows = obj.where((F.col("pid") == pid) & name_matches(F.col("n"), word))
    rows = rows.where(F.col("t") == kind) if kind else rows
    return keyset_page(rows, order, cursor, count), rows.agg(F.count(F.lit(1)).alias("total"))


def list_recycled(obj: DataFrame, word: str = "", order: str = "mtime", cursor: str | None = None, count: int = 1000) -> DataFrame:
    return keyset_page(obj.where((F.col("pid") < 0) & name_matches(F.col("n"), word)), order, cursor, count)


def deleted_before(obj: DataFrame, time: int, limit: int) -> DataFrame:
    return obj.where((F.col("pid") < 0) & (F.col("m") <= time)).orderBy("m", "id").limit(limit)


def small_unpackaged(data: DataFrame, most: int) -> DataFrame:
    return data.where((F.col("pi") == 0) & (F.col("os") > 0) & (F.col("os") < most))


def brief(obj: DataFrame, level: int) -> DataFrame:
    """1 leaves out extra, parent and data id; 2 leaves the id alone."""
    return obj.select("id") if level == 2 else obj.drop("e", "pid", "did") if level == 1 else obj


def glob_regex(pattern: str) -> str:
    """A file glob (``*``, ``?``, classes) as an anchored regular expression; ``/`` is never matched."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            out += "[" + pattern[i + 1 : end].replace("\\", "\\\\") + "]"
            i = end
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or ("\\" + c if not c.isalnum() and c not in "_ " else c)
        i += 1
    return f"^{out}$"


def ignored(name: Column, patterns: str) -> Column:
    """Whether a name fits one of several globs between semicolons."""
    fits = F.lit(False)
    for pattern in filter(None, patterns.split(";")):
        fits = fits | name.rlike(glob_regex(pattern))
    return fits


def s3_list(keys: DataFrame, prefix: str = "", delimiter: str = "", marker: str = "", max_keys: int = 1000) -> DataFrame:
    """Entries (key, kind) of a listing: contents, and common prefixes up to the delimiter, in order of
    key after the marker, with a flag on every row if there are more."""
    rest = F.substring(F.col("key"), F.lit(len(prefix) + 1), F.length("key"))
    rows = keys.where(F.col("key").startswith(prefix)) if prefix else keys
    if delimiter:
        folded = rest.contains(delimiter)
        entry = F.when(folded, F.concat(F.lit(prefix), F.substring_index(rest, delimiter, 1), F.lit(delimiter))).otherwise(F.col("key"))
        rows = rows.select(entry.alias("key"), F.when(folded, "prefix").otherwise("content").alias("kind")).distinct()
    else:
        rows = rows.select("key", F.lit("content").alias("kind"))
    rows = rows.where(F.col("key") > marker) if marker else rows
    page = rows.orderBy("key").limit(max_keys + 1)
    n = F.row_number().over(Window.orderBy("key"))  # at most max_keys + 1 rows
    counted = page.select("key", "kind", n.alias("nth"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    return counted.where(F.col("nth") <= max_keys).select("key", "kind", (F.col("n") > max_keys).alias("truncated"))


def list_uploads(uploads: DataFrame, prefix: str, key_marker: str, most: int = 1000) -> DataFrame:
    rows = uploads.where(F.col("key").startswith(prefix) & (F.col("key") > key_marker))
    return rows.orderBy("key", "initiated").limit(most)


def list_parts(parts: DataFrame, marker: int, most: int) -> DataFrame:
    """Parts after a marker, with the truncated flag and the next marker."""
    page = parts.where(F.col("part") > marker).orderBy("part").limit(most + 1)
    every = Window.partitionBy()  # at most most + 1 rows
    counted = page.withColumn("nth", F.row_number().over(Window.orderBy("part"))).withColumn("n", F.count(F.lit(1)).over(every))
    kept = counted.where(F.col("nth") <= most)
    return kept.select("part", "etag", (F.col("n") > most).alias("truncated"), F.max("part").over(every).alias("next_marker"))


def cleanup_snapshots(snap: DataFrame, now: int, retention_days: int, most: int) -> DataFrame:
    """Snapshots too old, or beyond the newest ones of their bucket: each once, with the reason."""
    rank = F.row_number().over(Window.partitionBy("bucket_id").orderBy(F.desc("created_at"), F.desc("id")))
    old = F.col("created_at") < now - retention_days * 86400
    rows = snap.withColumn("rank", rank).withColumn("reason", F.when(old, "expired").when(F.col("rank") > most, "excess"))
    return rows.where("reason IS NOT NULL").select("id", "bucket_id", "reason")


def compressible(name: Column, head: Column) -> Column:
    """Not an archive or media file by extension, nor by its first bytes; empty content is not."""
    by_name = ~F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1)).isin(*CLOSED_EXTENSIONS)
    magic = F.lower(F.hex(F.substring(head, 1, 8)))
    by_bytes = F.lit(True)
    for m in CLOSED_MAGIC:
        by_bytes = by_bytes & ~magic.startswith(m)
    return (F.octet_length(head) > 0) & by_name & by_bytes


#: Extensions and first bytes (hex) of formats that are compressed already.
CLOSED_EXTENSIONS = ("7z", "avi", "br", "bz2", "flac", "gif", "gz", "jpeg", "jpg", "mkv", "mov", "mp3", "mp4", "ogg", "png", "rar", "webm", "webp", "xz", "zip", "zst")
CLOSED_MAGIC = ("1f8b", "28b52ffd", "377abcaf271c", "425a68", "474946", "494433", "4f676753", "504b0304", "52617221", "664c6143", "89504e47", "fd377a585a00", "ffd8ff")


def fragmented(ru: Column, lu: Column, threshold: int) -> Column:
    """Whether the share of used bytes that no live object needs reaches the threshold in percent."""
    if threshold == 0:
        return F.lit(True)
    return (ru > 0) & (ru > lu) & ((ru - lu).cast("double") * 100.0 / F.nullif(ru, F.lit(0)) >= threshold)
