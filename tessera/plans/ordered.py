"""Global order without a global task: dense indices and running values in two levels.

A window without PARTITION BY sends every row to one task. Here rows are windowed within ranges or buckets,
and only one summary row a range or bucket meets in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Rows of an index that are windowed in one partition.
BUCKET = 1 << 16


def index_by(df: DataFrame, order: str | list[str], index: str = "idx", running: dict[str, str] | None = None) -> DataFrame:
    """``df`` with a dense ``index`` (bigint, from 0) in the order of the column or columns ``order``.

    ``running`` maps new columns to numeric columns: the sum of the rows before, 0 for the first. Ties are
    numbered in an arbitrary order that is then fixed, as the ranges are written once.
    """
    running = running or {}
    by = [order] if isinstance(order, str) else order
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    kept = Scratch(df.sparkSession, "ordered").keep(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")))
    sums = kept.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{name}") for name, c in running.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_s0_{n}") for n in running])
    inside = Window.partitionBy("_part").orderBy("_row")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = kept.select("*", (F.row_number().over(inside) - 1).alias("_i"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_r_{n}") for n, c in running.items()])
    joined = out.join(F.broadcast(base), "_part")  # as many rows as ranges
    return joined.select(*df.columns, (F.col("_n0") + F.col("_i")).cast("bigint").alias(index), *[(F.col(f"_s0_{n}") + F.col(f"_r_{n}")).cast("bigint").alias(n) for n in running])


def running(df: DataFrame, index: str, values: dict[str, tuple[str, Column]], within: list[str] | None = None, bucket: int = BUCKET) -> DataFrame:
    """``df`` with columns of values over all rows with a lesser ``index``, null where there is none.

    ``values`` maps a name to ("max", column) or ("last", column), which pass over nulls. ``index`` is dense, so
    a bucket of it has a bounded number of rows; ``within`` names columns that separate independent orders.
    """
    keys = list(within or [])
    last = lambda c: F.max(F.when(c.isNotNull(), F.struct(F.col(index).alias("at"), c.alias("v"))))
    marked = df.withColumn("_bucket", F.floor(F.col(index) / bucket))
    sums = marked.groupBy(*keys, "_bucket").agg(*[(F.max(c) if kind == "max" else last(c)).alias(f"_b_{name}") for name, (kind, c) in values.items()])
    over = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, "_bucket", *[F.max(f"_b_{n}").over(over).alias(f"_p_{n}") for n in values])
    here = Window.partitionBy(*keys, "_bucket").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    out = marked.select("*", *[(F.max(c) if kind == "max" else F.last(c, ignorenulls=True)).over(here).alias(f"_h_{name}") for name, (kind, c) in values.items()])
    joined = out.join(base, [*keys, "_bucket"])
    new = []
    for name, (kind, _) in values.items():
        p, h = F.col(f"_p_{name}"), F.col(f"_h_{name}")
        new.append((F.greatest(p, h) if kind == "max" else F.coalesce(h, p["v"])).alias(name))
    return joined.select(*df.columns, *new)
