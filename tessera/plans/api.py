"""The application interface: generate, apply and verify by path, and export and import of containers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import FORMS
from ..operators import classify, codec, delta, images, match, stretches, whole
from ..session import ship
from ..sources import container, headers, snapshots, streams
from ..sources.parts import folder_for, join
from ..sources.pseudo import payload_start, read_pseudo
from .scratch import Scratch, forget, remove, shared_dir

GRANULARITIES = ("entry", "whole")


def generate(spark: SparkSession, source: str, target: str, out: str, codec_name: str = codec.DEFAULT, mode: str = "best", granularity: str = "entry") -> DataFrame:
    """Writes the delta from the snapshot at ``source`` to the one at ``target`` to the folder ``out`` and returns
    its summary by status. Snapshots are pseudo-files or saved folders. The header goes first and comes last, and without
    it nothing is a delta, so a failed write leaves none, not the parts of two."""
    ship(spark)
    if granularity not in GRANULARITIES:
        raise ValueError(f"unknown granularity {granularity!r}")
    chosen = codec.codec(codec_name)
    s, t = snapshots.open_snapshot(spark, source), snapshots.open_snapshot(spark, target)
    remove(spark, f"{out}/header")
    meta = spark.createDataFrame([(chosen.name, chosen.tool, granularity, mode)], "codec string, tool int, granularity string, mode string")
    if granularity == "whole":
        patch = whole.generate(s, t, codec_name)
        spark.createDataFrame([(bytearray(patch),)], "patch binary").write.mode("overwrite").parquet(f"{out}/records")
        meta.write.mode("overwrite").parquet(f"{out}/header")
        return spark.createDataFrame([("whole", 1, len(patch))], "status string, entries bigint, record_bytes bigint")
    if mode == "compat":
        _disjoint(s)
    delta.generate(s, t, codec_name, mode).write.mode("overwrite").parquet(f"{out}/records")
    t.entries.select("idx", "path", "size", "sha").write.mode("overwrite").parquet(f"{out}/target")
    meta.write.mode("overwrite").parquet(f"{out}/header")
    return classify.summary(spark.read.parquet(f"{out}/records"), F.col("patch_size"))


def _disjoint(source: snapshots.Snapshot) -> None:
    bad = match.overlaps(source.entries).limit(3).collect()
    if bad:
        raise ValueError("source segments overlap: " + ", ".join(r["path"] for r in bad))


def apply(spark: SparkSession, source: str, delta_path: str, out: str | None = None) -> DataFrame:
    """The target entries (idx, path, content) that a delta makes of ``source``; written as a pseudo-file if ``out``
    is given. A per-entry delta is checked against the target's checksums, and a difference is an error."""
    ship(spark)
    meta = spark.read.parquet(f"{delta_path}/header").first()
    name = codec.by_tool(meta["tool"]).name
    s = snapshots.open_snapshot(spark, source)
    records = spark.read.parquet(f"{delta_path}/records")
    if meta["granularity"] == "whole":
        rebuilt = whole.apply(s, bytes(records.first()["patch"]), name)
    else:
        rebuilt = Scratch(spark, "apply").keep(delta.apply(records, s, name))  # decoded once, read by the check and the writer
        wrong = delta.verify(rebuilt, spark.read.parquet(f"{delta_path}/target")).limit(5).collect()
        if wrong:
            raise ValueError("the rebuilt target differs: " + ", ".join(f"{r['path']} ({r['problem']})" for r in wrong))
    if out:
        from ..sources.pseudo import write_pseudo

        write_pseudo(rebuilt, out)
    return rebuilt


def generate_images(spark: SparkSession, source: str, target: str, out: str, codec_name: str = codec.DEFAULT, on_unsupported: str = "error", name: str | None = None) -> None:
    """Writes the deltas of the images under ``target`` against those under ``source`` of the same file name; for a
    single pair under different names, ``name`` names both. A failed write leaves no delta."""
    ship(spark)
    s, t = images.read_images(spark, source, name), images.read_images(spark, target, name)
    made = images.generate(s, t, codec_name, on_unsupported)
    made.select("*", F.lit(codec_name).alias("codec")).write.mode("overwrite").parquet(out)


def apply_images(spark: SparkSession, source: str, delta_path: str, name: str | None = None) -> DataFrame:
    """(name, content, arguments) of the images that ``generate_images`` stored; see images.apply."""
    ship(spark)
    deltas = spark.read.parquet(delta_path)
    first = deltas.select("codec").first()
    return images.apply(deltas, images.read_images(spark, source, name), first["codec"] if first else codec.DEFAULT)


def neutral_header(spark: SparkSession, tool: int, ts: int = 0, comp: int = 6, flags: int = 0x00C0) -> bytes:
    """The header of a delta whose target is no image."""
    return bytes(spark.range(1).select(headers.header_bytes(F.lit(tool), F.lit(ts), F.lit(comp), F.lit(flags)).alias("h")).first()["h"])


def export_container(spark: SparkSession, source: str, target: str, out: str, codec_name: str = codec.DEFAULT, head: bytes | None = None) -> int:
    """Writes the delta as one container, by the compatible matcher, and returns its bytes.

    Source offsets count from the start of the source stream: the length of its manifest is added, as in the
    records' definition. Both snapshots are pseudo-files; ``head`` is the delta's header (``headers.header_for``), a neutral
    one if none is given. Source segments that overlap are an error, as a reader that only moves forward can't take them.
    """
    ship(spark)
    chosen = codec.codec(codec_name)
    if FORMS.get(chosen.tool) != "entries":
        raise ValueError(f"codec {chosen.name!r} makes one patch of whole files (files.generate_file)")
    manifests = [stretches.Place(path, 0, payload_start(path)) for path in (source, target)]
    s, t = snapshots.of_pseudo(spark, source), snapshots.of_pseudo(spark, target)
    _disjoint(s)
    table = delta.generate(s, t, codec_name, "compat")
    # a new entry has no source: its offset only says that a patch follows
    placed = table.withColumn("src_off", F.coalesce("src_off", F.lit(0)) + manifests[0].size)
    with folder_for(out) as folder:
        patch = stretches.encode(spark, codec_name, *manifests, folder)
        return container.write_container(head or neutral_header(spark, chosen.tool), patch, manifests[0].size, placed, out)


def import_container(spark: SparkSession, source: str, path: str) -> DataFrame:
    """(idx, path, content) of the target that a container makes of the pseudo-file ``source``.

    Records meet source entries by index or by offset; the manifest's patch names the target entries. A record
    without its source or an entry of the wrong size is an error.
    """
    ship(spark)
    with streams.open_input(path) as f:
        head = f.read(32)
        f.seek(0)
        _, _, _, size, at = next(container.walk(f, f.size()))
    checked = spark.createDataFrame([(bytearray(head),)], "h binary")
    error, tool = checked.select(headers.header_error(F.col("h")), headers.decode(F.col("h"), headers.HEADER)["tool"]).first()
    if error:
        raise ValueError(error)
    chosen = codec.by_tool(tool)
    start = payload_start(source)
    # the target's manifest as a file of its own, which the plan reads: the driver holds no entry
    names = f"{shared_dir(spark).rstrip('/')}/tessera-names-{uuid.uuid4().hex}"
    with folder_for(names) as folder:
        join(spark, stretches.decode(spark, chosen.name, stretches.Place(source, 0, start), stretches.Place(path, at, size), folder), folder, names)
    forget(spark, names)
    target = read_pseudo(spark, names, payload=False).select(F.col("idx").alias("ti"), "path", F.col("size").alias("t_size"))
    s = snapshots.of_pseudo(spark, source)
    records = container.read_container(spark, path).where("ti >= 0")
    by_index = s.entries.select(F.col("idx").alias("_i"), F.col("path").alias("_p"), F.col("sha").alias("_ps"))
    by_off = s.entries.where("size > 0").select((F.col("off") + start).alias("_o"), F.col("path").alias("_q"), F.col("sha").alias("_qs"))
    met = records.join(by_index, F.col("si") == F.col("_i"), "left").join(by_off, (F.col("src_off") == F.col("_o")) & (F.col("src_size") > 0), "left")
    lost = (F.col("si").isNotNull() & F.col("_p").isNull()) | ((F.col("src_size") > 0) & F.col("_q").isNull())
    named = met.withColumn("s_path", F.when(lost, F.raise_error(F.lit("a record refers to no source entry")).cast("string")).otherwise(F.coalesce("_p", "_q"))).withColumn("s_sha", F.coalesce("_ps", "_qs"))
    table = named.join(target, "ti", "full_outer").withColumn("status", F.when(F.col("kind") == "identical", "identical").otherwise("modified"))
    rebuilt = delta.apply(table.select("ti", "path", "status", "s_path", "s_sha", "patch"), s, chosen.name)
    right = rebuilt.join(target.select(F.col("ti").alias("idx"), "t_size"), "idx")
    body = F.when(F.octet_length("content") == F.col("t_size"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("wrong size: "), F.col("path"))).cast("binary"))
    return right.select("idx", "path", body.alias("content"))
