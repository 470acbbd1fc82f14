"""Superblocks of images and headers of deltas: decode, validate, encode."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.binary import le_bytes, le_uint
from ..functions.codes import COMPRESSION, DELTA_MAGIC, FORMAT_VERSION, HEADER_SIZE, OWN_TOOLS, SUPERBLOCK_MAGIC, TOOLS, TOOLS_VERSION, XDELTA3_MAGIC, unsupported
from ..session import ship
from . import streams

#: field -> (offset, width)
SUPERBLOCK = {"magic": (0, 4), "inode_count": (4, 4), "mtime": (8, 4), "block_size": (12, 4), "fragment_count": (16, 4), "comp": (20, 2), "block_log": (22, 2), "flags": (24, 2), "id_count": (26, 2), "major": (28, 2), "minor": (30, 2)}
HEADER = {"magic": (0, 4), "format_v": (4, 1), "tools_v": (5, 1), "tool": (6, 2), "ts": (8, 4), "comp": (12, 2), "flags": (14, 2)}


def decode(content: Column, layout: dict[str, tuple[int, int]]) -> Column:
    return F.struct(*[le_uint(content, o, w).alias(name) for name, (o, w) in layout.items()])


def superblock_error(block: Column) -> Column:
    """Why a superblock isn't usable, or null."""
    return (
        F.when(block["minor"].isNull(), "too short")
        .when(block["magic"] != SUPERBLOCK_MAGIC, "wrong magic")
        .when((block["major"] != 4) | (block["minor"] != 0), "unsupported version")
        .when(~block["comp"].isin(list(COMPRESSION)), "unknown compression")
        .otherwise(unsupported(block["flags"]))
    )


def delta_kind(content: Column) -> Column:
    """What a delta file is by its magic: container, plain or unknown; null under 4 bytes."""
    magic = le_uint(content, 0, 4)
    return F.when(magic == DELTA_MAGIC, "container").when(magic == XDELTA3_MAGIC, "plain").when(magic.isNotNull(), "unknown")


def header_error(content: Column) -> Column:
    """Why a delta's header isn't usable, or null."""
    h, kind = decode(content, HEADER), delta_kind(content)
    return (
        F.when(kind.isNull() | ((kind == "container") & (F.octet_length(content) < HEADER_SIZE)), "too short")
        .when(kind == "unknown", "wrong magic")
        .when(kind == "plain", None)
        .when((h["format_v"] != FORMAT_VERSION) | (h["tools_v"] != TOOLS_VERSION), "unsupported version")
        .when(~h["tool"].isin([*TOOLS, *OWN_TOOLS]), "unknown tool")
    )


def header_bytes(tool: Column, ts: Column, comp: Column, flags: Column) -> Column:
    """The 32 bytes of a delta header."""
    fields = [(F.lit(DELTA_MAGIC), 4), (F.lit(FORMAT_VERSION), 1), (F.lit(TOOLS_VERSION), 1), (tool, 2), (ts, 4), (comp, 2), (flags, 2), (F.lit(0), 8), (F.lit(0), 8)]
    return F.concat(*[le_bytes(value, width) for value, width in fields])


def header_of(block: Column, tool: int) -> Column:
    """The delta header that a target's superblock gives, as a struct."""
    return F.struct(F.lit(DELTA_MAGIC).alias("magic"), F.lit(FORMAT_VERSION).alias("format_v"), F.lit(TOOLS_VERSION).alias("tools_v"), F.lit(tool).alias("tool"), block["mtime"].alias("ts"), block["comp"].alias("comp"), block["flags"].alias("flags"))


def header_for(spark: SparkSession, head: bytes, tool: int) -> tuple[str | None, bytes]:
    """Why an image that starts with these bytes can't be rebuilt, or None, and the header of its delta."""
    row = spark.createDataFrame([(bytearray(head[:HEADER_SIZE]),)], "head binary").select(decode(F.col("head"), SUPERBLOCK).alias("b"))
    h = header_of(F.col("b"), tool)
    error, made = row.select(superblock_error(F.col("b")), header_bytes(h["tool"], h["ts"], h["comp"], h["flags"])).first()
    return error, bytes(made or b"")


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class Heads(DataSource):
    """``spark.read.format("heads").load(path)``: (path, head), the first HEADER_SIZE bytes of a file or of every file in a
    folder. Nothing else of the files is read, however large they are."""

    @classmethod
    def name(cls) -> str:
        return "heads"

    def schema(self) -> str:
        return "path string, head binary"

    def reader(self, schema) -> DataSourceReader:
        return _HeadReader(self.options["path"])


class _HeadReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        found = streams.files(self.path)
        return [_Files(found[i : i + 64]) for i in range(0, len(found), 64)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            with streams.open_input(path) as f:
                yield path, f.read(HEADER_SIZE)


def read_superblocks(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(path, the fields, error) of every image under ``path``. ``strict`` raises at the first unusable one."""
    ship(spark).dataSource.register(Heads)
    found = spark.read.format("heads").load(path).select("path", decode(F.col("head"), SUPERBLOCK).alias("b"))
    error = superblock_error(F.col("b"))
    if strict:
        error = F.when(error.isNotNull(), F.raise_error(F.concat(F.col("path"), F.lit(": "), error)).cast("string"))
    return found.select("path", "b.*", error.alias("error"))


def body(content: Column) -> Column:
    """What follows a delta's header."""
    return F.substring(content, F.lit(HEADER_SIZE + 1), F.octet_length(content))
