"""What became of each entry: identical, modified, new or removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import match
from ..sources.snapshots import Snapshot


def status(si: Column, eff: Column, t_size: Column, same: Column) -> Column:
    """identical, modified or new, given the usable source size ``eff`` and whether the checksums agree."""
    equal = si.isNotNull() & (eff == t_size) & ((eff == 0) | same)
    return F.when(equal, "identical").when(eff == 0, "new").otherwise("modified")


def forward(target: DataFrame, source: DataFrame) -> DataFrame:
    """(ti, path, si, behind, status) for exact matches and a reader that only moves forward."""
    found = match.with_cursor(match.exact(target, source))
    eff = F.when(F.col("s_idx").isNull() | F.col("behind"), 0).otherwise(F.col("s_size"))
    same = F.coalesce(F.col("t_crc") == F.col("s_crc"), F.lit(False))
    return found.select(F.col("t_idx").alias("ti"), "path", F.col("s_idx").alias("si"), "behind", status(F.col("s_idx"), eff, F.col("t_size"), same).alias("status"))


def plan(target: Snapshot, source: Snapshot, mode: str = "best", every: bool = False) -> DataFrame:
    """The delta plan, one row a target entry, without patches:
    (ti, path, kind, status, si, s_path, s_sha, src_off, src_size, t_size, t_sha).

    ``best`` matches by path and shape and calls entries identical by size and SHA-256. ``compat`` follows the
    forward reader and its size and CRC-32, but an entry behind the cursor is never identical: it is stored
    whole, as a reader could not reach it. With ``every``, ``best`` has a row for each source entry of an entry's path.
    """
    t, s = target.entries, source.entries
    matched = match.best(t, s, every) if mode == "best" else match.compat(t, s)
    src = s.select(F.col("idx").alias("si"), F.col("path").alias("s_path"), F.col("off").alias("src_off"), F.col("size").alias("s_size"), F.col("crc").alias("s_crc"), F.col("sha").alias("s_sha"))
    tgt = t.select(F.col("idx").alias("ti"), F.col("size").alias("t_size"), F.col("crc").alias("t_crc"), F.col("sha").alias("t_sha"))
    rows = matched.join(tgt, "ti").join(src, "si", "left")
    if mode == "best":
        behind, same = F.lit(False), F.col("t_sha") == F.col("s_sha")
    else:
        behind, same = F.col("behind"), F.col("t_crc") == F.col("s_crc")
    usable = F.col("si").isNotNull() & ~behind
    eff = F.when(usable, F.col("s_size")).otherwise(0)
    state = status(F.when(usable, F.col("si")), eff, F.col("t_size"), F.coalesce(same, F.lit(False)))
    done = rows.withColumn("status", state).withColumn("_usable", usable & (F.col("status") != "new"))
    return done.select(
        "ti", "path", "kind", "status", F.when(F.col("_usable"), F.col("si")).alias("si"), F.when(F.col("_usable"), F.col("s_path")).alias("s_path"), F.when(F.col("_usable"), F.col("s_sha")).alias("s_sha"),
        F.when(F.col("_usable"), F.col("src_off")).alias("src_off"), F.when(F.col("_usable"), F.col("s_size")).otherwise(0).alias("src_size"), "t_size", "t_sha",
    )


def new_entries(target: DataFrame, source: DataFrame) -> DataFrame:
    return target.join(source.select("path"), "path", "left_anti").select("idx", "path", "size")


def removed_entries(planned: DataFrame, source: DataFrame) -> DataFrame:
    """Source entries that no row of ``planned`` refers to by ``si``: with exact matches, those whose path is gone; with
    a whole plan, those that no delta needs. Of source entries with one path, all but the last are removed."""
    return source.join(planned.where("si is not null").select(F.col("si").alias("idx")), "idx", "left_anti").select("idx", "path", "size")


def sets(target: DataFrame, source: DataFrame) -> DataFrame:
    """(kind, path): common, new and removed paths, by set operations."""
    t, s = target.select("path"), source.select("path")
    parts = {"common": t.intersect(s), "new": t.exceptAll(s.distinct()).distinct(), "removed": s.distinct().exceptAll(t.distinct())}
    named = [df.select(F.lit(k).alias("kind"), "path") for k, df in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


def summary(planned: DataFrame, patch_size: Column | None = None) -> DataFrame:
    """(status, entries, target_bytes, record_bytes) by status; a record takes 8 bytes for an identical entry and
    24 and its patch otherwise. Without ``patch_size`` patches count as 0."""
    size = F.coalesce(patch_size, F.lit(0)) if patch_size is not None else F.lit(0)
    record = F.when(F.col("status") == "identical", 8).otherwise(24 + size)
    return planned.groupBy("status").agg(F.count("*").alias("entries"), F.sum("t_size").alias("target_bytes"), F.sum(record).cast("bigint").alias("record_bytes"))


def summary_rollup(planned: DataFrame) -> DataFrame:
    """(directory, status, entries, target_bytes), with totals by directory and of all."""
    first = F.element_at(F.split("path", "/"), 1)
    return planned.withColumn("directory", first).rollup("directory", "status").agg(F.count("*").alias("entries"), F.sum("t_size").alias("target_bytes"))
