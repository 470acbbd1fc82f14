"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import Scratch as Scratch

#: The white space of the word definition: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the synthetic tables, read by Spark only (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row.

    Catalyst may inline a column into every place that uses it, also inside lambdas, where it would run once
    an element; a lambda variable can't be inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all other characters untouched."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_keys(docs: DataFrame, text: str, doc_id: str) -> tuple[Column, Column]:
    """What names a row: its id (NO_ID for null), and XXH64 of its text, as ids may repeat."""
    return F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(NO_ID)), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def row_names(docs: DataFrame, text: str, doc_id: str) -> tuple[Column, Column]:
    """The same with 128 bits (MD5) of the text, for where rows of one id, as of none, may be very many."""
    return row_keys(docs, text, doc_id)[0], F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")))
