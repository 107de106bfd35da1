"""Packages: holes, offsets, fitting and packing (O-66, O-119, O-128, O-130, O-131, O-197 to O-200, O-235)."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid_blocks(data: DataFrame, obj: DataFrame) -> DataFrame:
    """Packaged blocks that a live object refers to."""
    return data.where("pi > 0").join(obj.where("pid >= 0").select(F.col("did").alias("id")), "id", "left_semi")


def holes(valid: DataFrame, files: DataFrame) -> DataFrame:
    """(pi, start, size) of the gaps before and between a package's valid blocks and up to its file's
    size; ``files`` has (pi, size)."""
    order = Window.partitionBy("pi").orderBy("po", "id")
    reach = F.coalesce(F.max(F.col("po") + F.col("os")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gaps = valid.select("pi", reach.alias("start"), (F.col("po") - reach).alias("size"))
    ends = valid.groupBy("pi").agg(F.max(F.col("po") + F.col("os")).alias("end"))
    tails = files.join(ends, "pi", "left").select("pi", F.coalesce("end", F.lit(0)).alias("start"), (F.col("size") - F.coalesce("end", F.lit(0))).alias("size"))
    return gaps.unionByName(tails).where("size > 0").select("pi", F.col("start").cast("long").alias("start"), F.col("size").cast("long").alias("size"))


def offsets(blocks: DataFrame, group: str, order: str = "id", size: str = "os") -> DataFrame:
    """Adds ``new_po``: the sum of the sizes before, within the group."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("new_po", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))


def next_fit(files: DataFrame, limit: int) -> DataFrame:
    """Pack each bucket's files (bkt_id, id, size) in order of (size, id): a file that does not fit
    starts the next package.  The running carry decides, so a bucket is one sequential group; what is
    packed is each bucket's small unpackaged remainder, which the caller bounds."""
    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "id"])
        group, total, out = 0, 0, []
        for size in part["size"]:
            if total and total + size > limit:
                group, total = group + 1, 0
            total += size
            out.append(group)
        return part.assign(package=out)[["bkt_id", "id", "size", "package"]]

    return files.select("bkt_id", "id", "size").groupBy("bkt_id").applyInPandas(pack, "bkt_id long, id long, size long, package long")


def push_packages(files: DataFrame, limit: int, threshold: int) -> DataFrame:
    """The upload packager: a file that overfills the buffer, or comes when it holds ``threshold``
    files, flushes it and is written alone (package null)."""
    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "id"])
        group, total, n, out, places = 0, 0, 0, [], []
        for size in part["size"]:
            if total + size > limit or n >= threshold or size >= limit:
                group, total, n = group + (n > 0), 0, 0
                out.append(None)
                places.append(None)
            else:
                out.append(group)
                places.append(total)
                total, n = total + size, n + 1
        return part.assign(package=pd.array(out, "Int64"), offset=pd.array(places, "Int64"))[["bkt_id", "id", "size", "package", "offset"]]

    return files.select("bkt_id", "id", "size").groupBy("bkt_id").applyInPandas(pack, "bkt_id long, id long, size long, package long, offset long")


def best_fit(hole: DataFrame, files: DataFrame) -> DataFrame:
    """Fill holes (bkt_id, pi, start, size) with files (bkt_id, id, size), greedily by (pi, start): the
    largest single file that fits; in holes of more than twice the average file, a combination in
    order of size if it fills over 80 % or more than the single file.  Returns (id, pi, po)."""
    def fit(key: tuple, holes_of: pd.DataFrame, files_of: pd.DataFrame) -> pd.DataFrame:
        ordered = files_of.sort_values(["size", "id"])
        ids, sizes = ordered["id"].tolist(), ordered["size"].tolist()
        average = sum(sizes) // len(sizes) if sizes else 0
        out = []
        for pi, start, room in holes_of.sort_values(["pi", "start"])[["pi", "start", "size"]].itertuples(index=False, name=None):
            fits = bisect_right(sizes, room)  # files before this place fit
            first, last = (bisect_left(sizes, sizes[fits - 1]), 1) if fits else (0, 0)
            if room > 2 * average > 0 and len(sizes) > 1:
                total = many = 0
                while many < len(sizes) and total + sizes[many] <= room:
                    total, many = total + sizes[many], many + 1
                if many > 1 and (total > 0.8 * room or (last and total > sizes[first])):
                    first, last = 0, many
            at = start
            for x in range(first, first + last):
                out.append((key[0], ids[x], pi, at))
                at += sizes[x]
            del ids[first : first + last], sizes[first : first + last]
        return pd.DataFrame(out, columns=["bkt_id", "id", "pi", "po"]).astype("int64")

    return hole.groupBy("bkt_id").cogroup(files.groupBy("bkt_id")).applyInPandas(fit, "bkt_id long, id long, pi long, po long")
