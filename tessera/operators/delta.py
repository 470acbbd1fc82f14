"""Generate, apply and verify deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classify
from .codec import DEFAULT, codec
from ..plans.scratch import Scratch
from ..session import ship
from ..sources.snapshots import Snapshot, contents

COLUMNS = ["ti", "path", "kind", "status", "si", "s_path", "s_sha", "src_off", "src_size", "t_size", "t_sha", "codec", "patch", "patch_size"]


# Plain functions of rows, not of pandas batches: a worker then holds the rows of a pickled batch (100 by default) and not
# the contents of 10,000, and needs neither pandas nor Arrow.


def _encoder(name: str):
    ship(SparkSession.active())
    encode = codec(name).encode
    return F.udf(lambda source, target: encode(bytes(source), bytes(target)), "binary", useArrow=False)


def _decoder(name: str):
    ship(SparkSession.active())
    decode = codec(name).decode
    # a null source is an entry that needs no decoder
    return F.udf(lambda source, patch: None if source is None else decode(bytes(source), bytes(patch)), "binary", useArrow=False)


def generate(source: Snapshot, target: Snapshot, name: str = DEFAULT, mode: str = "best") -> DataFrame:
    """The delta table, one row a target entry (COLUMNS). Only entries that changed meet their contents, and
    only these reach the encoder."""
    # metadata only; written once, as both branches and whoever reads the delta would match anew
    planned = Scratch(source.entries.sparkSession, "plan").keep(classify.plan(target, source, mode).withColumn("codec", F.lit(name)))
    empty = F.lit(None)
    same = planned.where("status = 'identical'").select(*planned.columns, empty.cast("binary").alias("patch"), empty.cast("bigint").alias("patch_size"))
    changed = planned.where("status <> 'identical'")
    after = contents(changed, target.payload, "ti", "path", "t_sha", "_t")
    met = contents(after, source.payload, "ti", "s_path", "s_sha", "_s", "left")
    patch = _encoder(name)(F.coalesce("_s", F.lit(b"")), F.col("_t"))
    patched = met.select(*planned.columns, patch.alias("patch")).withColumn("patch_size", F.octet_length("patch").cast("bigint"))
    return same.unionByName(patched).select(COLUMNS)


def apply(delta: DataFrame, source: Snapshot, name: str = DEFAULT) -> DataFrame:
    """(idx, path, content) of the target, one row a delta row. A source entry that is missing, or whose content is
    another than the delta was made of, is an error, not a gap."""
    met = contents(delta, source.payload, "ti", "s_path", "s_sha", "_s", "left")
    missing = F.col("s_path").isNotNull() & F.col("_s").isNull()
    base = F.when(missing, F.raise_error(F.concat(F.lit("no source entry "), F.col("s_path"))).cast("binary")).otherwise(F.coalesce("_s", F.lit(b"")))
    # in one pass: two branches would each join the whole delta to the contents
    same = F.col("status") == "identical"
    content = F.when(same, base).otherwise(_decoder(name)(F.when(~same, base), F.when(~same, F.col("patch"))))
    return met.select(F.col("ti").alias("idx"), "path", content.alias("content"))


def verify(rebuilt: DataFrame, target: DataFrame) -> DataFrame:
    """(idx, path, problem) of what differs between rebuilt entries (idx, path, content) and the target's (idx, path,
    size, sha): missing, extra, repeated, size or content. Empty if all is well."""
    some = rebuilt.select("idx", "path", F.octet_length("content").alias("size"), F.sha2("content", 256).alias("sha"))
    r = some.groupBy("idx", "path").agg(F.count("*").alias("n"), F.min("size").alias("r_size"), F.min("sha").alias("r_sha"))
    t = target.groupBy("idx", "path").agg(F.min("size").alias("t_size"), F.min("sha").alias("t_sha"))
    problem = (
        F.when(F.col("n").isNull(), "missing")
        .when(F.col("t_sha").isNull(), "extra")
        .when(F.col("n") > 1, "repeated")
        .when(F.col("r_size") != F.col("t_size"), "size")
        .when(F.col("r_sha") != F.col("t_sha"), "content")
    )
    return r.join(t, ["idx", "path"], "full_outer").select("idx", "path", problem.alias("problem")).where("problem is not null")
