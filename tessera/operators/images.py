"""Deltas between whole images: one patch an image, behind the header that says how to rebuild it.

Images are rows (name, content), so a collection of them is encoded in parallel; one image must fit a task and is
refused beyond whole.LIMIT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import rebuild_arguments
from ..functions.paths import basename
from ..sources import headers
from .codec import DEFAULT, codec
from .delta import _decoder, _encoder
from .whole import LIMIT

#: What to do with an image that can't be rebuilt from a header: refuse it, or store a patch without a header.
ON_UNSUPPORTED = ("error", "plain")


def read_images(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """(name, content) of the images under ``path``; the file's name unless one is given, as for a single pair."""
    files = spark.read.format("binaryFile").load(path)
    return files.select((F.lit(name) if name else basename(F.col("path"))).alias("name"), "content")


def _refuse(name: Column, why: Column, otherwise: Column, kind: str) -> Column:
    return F.when(why.isNotNull(), F.raise_error(F.concat(name, F.lit(": "), why)).cast(kind)).otherwise(otherwise)


def generate(source: DataFrame, target: DataFrame, codec_name: str = DEFAULT, on_unsupported: str = "error") -> DataFrame:
    """(name, kind, delta) of every target image: kind is container (header and patch) or plain (patch only).

    An image that the source lacks is encoded against nothing. Bad superblocks are errors; images with compressor
    options are, too, unless ``on_unsupported`` is plain.
    """
    if on_unsupported not in ON_UNSUPPORTED:
        raise ValueError(f"on_unsupported is one of {', '.join(ON_UNSUPPORTED)}")
    chosen = codec(codec_name)
    met = target.join(source.select("name", F.col("content").alias("_s")), "name", "left")
    block = headers.decode(F.substring("content", 1, headers.HEADER_SIZE), headers.SUPERBLOCK)
    why = F.when(F.greatest(F.octet_length("content"), F.octet_length("_s")) > LIMIT, "too large for one patch").otherwise(headers.superblock_error(block))
    plain = F.coalesce(why == "compressor options", F.lit(False)) if on_unsupported == "plain" else F.lit(False)
    checked = met.select("name", "_s", _refuse(F.col("name"), F.when(~plain, why), F.col("content"), "binary").alias("_t"), plain.alias("_plain"), block.alias("_b"))
    patched = checked.select("name", "_plain", "_b", _encoder(codec_name)(F.coalesce("_s", F.lit(b"")), F.col("_t")).alias("_patch"))
    b = F.col("_b")
    head = headers.header_bytes(F.lit(chosen.tool), b["mtime"], b["comp"], b["flags"])
    kind = F.when(F.col("_plain"), "plain").otherwise("container")
    return patched.select("name", kind.alias("kind"), F.when(F.col("_plain"), F.col("_patch")).otherwise(F.concat(head, F.col("_patch"))).alias("delta"))


def apply(deltas: DataFrame, source: DataFrame, codec_name: str = DEFAULT) -> DataFrame:
    """(name, content, arguments) of the target images; arguments rebuild the image, null for a plain delta.

    What a delta is, its column ``kind`` says, or its magic where there is no such column. A header that isn't valid, or
    that names another tool than the codec's, is an error, as is an unknown magic.
    """
    chosen = codec(codec_name)
    if "kind" not in deltas.columns:
        known = headers.delta_kind(F.col("delta"))
        deltas = deltas.withColumn("kind", _refuse(F.col("name"), F.when(F.coalesce(known, F.lit("unknown")) == "unknown", "wrong magic"), known, "string"))
    delta, contained = F.col("delta"), F.col("kind") == "container"
    h = headers.decode(F.substring(delta, 1, headers.HEADER_SIZE), headers.HEADER)
    why = F.when(contained, F.coalesce(headers.header_error(delta), F.when(h["tool"] != chosen.tool, "another codec made this delta")))
    met = deltas.join(source.select("name", F.col("content").alias("_s")), "name", "left")
    patch = _refuse(F.col("name"), why, F.when(contained, headers.body(delta)).otherwise(delta), "binary")
    made = met.select("name", F.coalesce("_s", F.lit(b"")).alias("_s"), patch.alias("_p"), F.when(contained, rebuild_arguments(h)).alias("arguments"))
    return made.select("name", _decoder(codec_name)(F.col("_s"), F.col("_p")).alias("content"), "arguments")
