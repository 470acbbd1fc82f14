"""A block codec of DataFrame operations only: aligned blocks that the source has are copied, others inserted.

Blocks of a pair meet by an equi-join on pair and content, so entries of any size are encoded by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 64


def split(content: Column, size: int = SIZE) -> Column:
    """The blocks of a binary column, in order; the last may be short, and empty content has none."""
    n = F.ceil(F.octet_length(content) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(content, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<binary>"))


def operations(pairs: DataFrame, size: int = SIZE) -> DataFrame:
    """(ti, pos, copy, literal) of each target block of ``pairs`` (ti, source, target): ``copy`` is the first
    source block with its content, or null, and then ``literal`` holds the block."""
    ours = pairs.select("ti", F.posexplode(split(F.col("target"), size)).alias("pos", "block"))
    theirs = pairs.select("ti", F.posexplode(split(F.col("source"), size)).alias("n", "block")).groupBy("ti", "block").agg(F.min("n").alias("copy"))
    joined = ours.join(theirs, ["ti", "block"], "left")
    return joined.select("ti", "pos", "copy", F.when(F.col("copy").isNull(), F.col("block")).alias("literal"))


def encode(pairs: DataFrame, size: int = SIZE) -> DataFrame:
    """(ti, ops): the operations of each entry in order; an entry without blocks has none."""
    found = operations(pairs, size).groupBy("ti").agg(F.sort_array(F.collect_list(F.struct("pos", "copy", "literal"))).alias("ops"))
    return pairs.select("ti").join(found, "ti", "left").select("ti", F.coalesce("ops", F.array().cast("array<struct<pos:int,copy:int,literal:binary>>")).alias("ops"))


def decode(source: Column, ops: Column, size: int = SIZE) -> Column:
    """The target that the operations make of the source."""
    parts = F.transform(ops, lambda o: F.hex(F.coalesce(o["literal"], F.substring(source, o["copy"] * size + 1, F.lit(size)))))
    return F.unhex(F.array_join(parts, ""))


def summary(pairs: DataFrame, size: int = SIZE) -> DataFrame:
    """(ti, blocks, copied, inserted_bytes) of each entry that has blocks."""
    ops = operations(pairs, size)
    return ops.groupBy("ti").agg(F.count("*").alias("blocks"), F.count("copy").alias("copied"), F.coalesce(F.sum(F.octet_length("literal")), F.lit(0)).cast("bigint").alias("inserted_bytes"))
