"""Snapshots: a manifest of metadata and, apart from it, the payload."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ordered import index_by
from ..plans.scratch import Scratch
from .pseudo import read_pseudo


@dataclass(frozen=True)
class Snapshot:
    """entries: (idx, path, size, off, crc, sha), one row an entry; payload: (path, sha, content).

    A path may be there more than once. A path and a checksum name a content, so payload rows that agree in both are
    equal, and ``contents`` joins them as one. Plans that match touch ``entries`` only; contents are joined for the
    entries that need them.
    """

    entries: DataFrame
    payload: DataFrame


def _payload(rows: DataFrame) -> DataFrame:
    return rows.select("path", F.sha2("content", 256).alias("sha"), "content")


def of_table(rows: DataFrame, path: str = "path", content: str = "content", order: str | None = None) -> Snapshot:
    """A snapshot of a table of paths and contents, in the order of the paths; contents may be text.

    A null content is empty. Rows with a null path are no entries. Rows of one path are entries of their own, in the
    order of the column ``order``, or else of their checksums.
    """
    body = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    more = [F.col(order).alias("_order")] if order else []
    kept = rows.where(F.col(path).isNotNull()).select(F.col(path).alias("path"), body.alias("content"), *more)
    metadata = kept.select("path", F.octet_length("content").cast("bigint").alias("size"), F.crc32("content").alias("crc"), F.sha2("content", 256).alias("sha"), *["_order"] * bool(order))
    scratch = Scratch(rows.sparkSession, "hashed")
    hashed = scratch.keep(metadata)  # else the sample that finds the ranges would read and hash every content once more
    entries = index_by(hashed, ["path", "_order" if order else "sha"], "idx", {"off": "size"})
    scratch.drop(hashed)
    return Snapshot(entries.select("idx", "path", "size", "off", "crc", "sha"), _payload(kept))


def of_pseudo(spark: SparkSession, path: str) -> Snapshot:
    """A snapshot of a pseudo-file, in its own order. Its metadata are kept, so that plans don't read the payload for them."""
    rows = read_pseudo(spark, path)
    entries = rows.select("idx", "path", "size", "off", F.crc32("content").alias("crc"), F.sha2("content", 256).alias("sha"))
    return Snapshot(Scratch(spark, "pseudo").keep(entries), _payload(rows))


def contents(wanted: DataFrame, payload: DataFrame, key: str, path: str = "path", sha: str = "sha", content: str = "content", how: str = "inner") -> DataFrame:
    """``wanted``, in which ``key`` is different in every row, with the ``content`` that its path and checksum name.

    Equal payload rows become one before the join, so that copies don't multiply. A row without a path meets no content; such
    rows are dealt by their key, as one task would get them all by their nulls.
    """
    named = payload.select(F.col("path").alias("_path"), F.col("sha").alias("_sha"), F.col("content").alias(content))
    once = named.repartition("_path", "_sha").dropDuplicates(["_path", "_sha"])  # dealt as the join needs it, and once
    dealt = wanted.select("*", F.coalesce(path, F.col(key).cast("string")).alias("_at"), F.when(F.col(path).isNotNull(), F.col(sha)).alias("_named"))
    return dealt.join(once, (F.col("_at") == F.col("_path")) & (F.col("_named") == F.col("_sha")), how).select(*wanted.columns, content)


def of_parquet(spark: SparkSession, path: str) -> Snapshot:
    """A snapshot that ``save`` wrote."""
    return Snapshot(spark.read.parquet(f"{path}/entries"), spark.read.parquet(f"{path}/payload"))


def save(snapshot: Snapshot, path: str) -> None:
    snapshot.entries.write.mode("overwrite").parquet(f"{path}/entries")
    snapshot.payload.write.mode("overwrite").parquet(f"{path}/payload")


def open_snapshot(spark: SparkSession, path: str) -> Snapshot:
    """A folder that ``save`` wrote (by its entries), or else a pseudo-file."""
    try:
        return of_parquet(spark, path)
    except Exception as e:  # the path is no such folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return of_pseudo(spark, path)


def fixture_pair(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two versions of a collection derived from ``documents``: (path, content) of source and target."""

    def name(version):
        return F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc-"), F.col("doc_id").cast("string"), version, F.lit(".txt"))

    source = documents.where("doc_id % 7 <> 3").select(name(F.lit(".v1")).alias("path"), F.col("text").alias("content"))
    bumped = F.when(F.col("doc_id") % 5 == 0, ".v2").otherwise(".v1")
    edited = F.when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit(" patched"))).otherwise(F.col("text"))
    return source, documents.where("doc_id % 11 <> 5").select(name(bumped).alias("path"), edited.alias("content"))


def pages_pair(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same idea over ``pages``, with the URL as the path."""
    source = pages.where("page_id % 7 <> 3").select(F.col("url").alias("path"), F.col("html").alias("content"), "page_id")
    edited = F.when(F.col("page_id") % 4 == 1, F.concat("html", F.lit(" patched"))).otherwise(F.col("html"))
    return source, pages.where("page_id % 11 <> 5").select(F.col("url").alias("path"), edited.alias("content"), "page_id")
