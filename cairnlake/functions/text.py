"""Paths, headers, flags and times as column expressions (O-146 to O-155, O-174)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_path(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def base_name(path: Column) -> Column:
    """Last segment; ``.`` of the empty path, ``/`` of slashes alone."""
    return F.when(path == "", ".").when(path.rlike("^/+$"), "/").otherwise(F.regexp_extract(path, r"([^/]*)/*$", 1))


def dir_name(path: Column) -> Column:
    """What precedes the last segment, without slashes at its end; ``.`` if there is none."""
    trimmed = F.regexp_replace(path, "/+$", "")
    front = F.regexp_replace(trimmed, "[^/]*$", "")
    cut = F.regexp_replace(front, "/+$", "")
    return F.when(path == "", ".").when(trimmed == "", "/").when(front == "", ".").when(cut == "", "/").otherwise(cut)


def trim_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substring(text, F.lit(len(prefix) + 1), F.length(text))).otherwise(text)


def etag(data_id: Column) -> Column:
    return F.concat(F.lit('"'), F.lower(F.hex(data_id)), F.lit('"'))


def http_date(seconds: Column) -> Column:
    """RFC 1123 date in GMT; the session's time zone must be UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def content_range(start: Column, end: Column, total: Column) -> Column:
    return F.concat(F.lit("bytes "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("/"), total.cast("string"))


def parse_range(header: Column, size: Column) -> Column:
    """Struct (start, end) of a ``bytes=`` header: ``a-b``, ``a-`` or ``-n``; null if it cannot be met."""
    form = r"^bytes=(\d*)-(\d*)$"
    a, b = (F.nullif(F.regexp_extract(header, form, i), F.lit("")).try_cast("long") for i in (1, 2))
    start = F.when(a.isNotNull(), a).otherwise(F.greatest(F.lit(0), size - b))
    end = F.when(a.isNotNull() & b.isNotNull(), F.least(b, size - 1)).otherwise(size - 1)
    valid = header.rlike(form) & (a.isNotNull() | (b.isNotNull() & (b > 0))) & (start < size) & ~F.coalesce(a.isNotNull() & b.isNotNull() & (a > b), F.lit(False))
    return F.when(valid, F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))


def has_flags(value: Column, mask: int) -> Column:
    return value.bitwiseAND(mask) != 0


def set_flags(value: Column, mask: int) -> Column:
    return value.bitwiseOR(mask)


def clear_flags(value: Column, mask: int) -> Column:
    return value.bitwiseAND(~mask)


def little_endian(raw: Column, at: int, width: int) -> Column:
    """The unsigned (signed for 8 bytes) little-endian number of ``width`` bytes from place ``at``."""
    digits = F.concat(*[F.hex(F.substring(raw, at + 1 + i, 1)) for i in reversed(range(width))])
    return F.conv(digits, 16, -10 if width == 8 else 10).cast("long")


def journal_extra(extra: Column) -> Column:
    """Struct (data_id, base_id, entries) of a journal's extra text: JSON, or base64 of a format byte and
    little-endian numbers of 8, 8 and 4 bytes.  Numbers of JSON are exact; null if it cannot be read."""
    is_json = extra.startswith("{")
    raw = F.when(~is_json, F.try_to_binary(extra, F.lit("base64")))
    from_json = F.struct(
        F.get_json_object(extra, "$.journalDataID").try_cast("long").alias("data_id"), F.get_json_object(extra, "$.baseVersionID").try_cast("long").alias("base_id"), F.get_json_object(extra, "$.entryCount").try_cast("long").alias("entries")
    )
    packed = F.struct(little_endian(raw, 1, 8).alias("data_id"), little_endian(raw, 9, 8).alias("base_id"), little_endian(raw, 17, 4).alias("entries"))
    return F.when(is_json, from_json).when(F.octet_length(raw) == 21, packed)


def encode_journal_extra(data_id: Column, base_id: Column, entries: Column) -> Column:
    def bytes_of(value: Column, width: int) -> Column:
        digits = F.lpad(F.hex(value), 2 * width, "0")
        return F.unhex(F.concat(*[F.substring(digits, 2 * (width - i) - 1, 2) for i in range(width)]))

    return F.base64(F.concat(F.unhex(F.lit("01")), bytes_of(data_id.cast("long"), 8), bytes_of(base_id.cast("long"), 8), bytes_of(entries.cast("long"), 4)))
