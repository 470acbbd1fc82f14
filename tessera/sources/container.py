"""Delta containers: a 32-byte header, a record for the manifest, and one record for each target entry.

A record starts with a signed 64-bit control word. Zero or less: the entry equals source entry ``-control``.
More: it is the source offset, the source manifest's length included, and the size of the source, the length
of the patch and the patch follow. The manifest's record always has offset 0 and comes first. A parquet delta
table is the parallel form; this is the form to exchange.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.binary import le_bytes
from ..functions.codes import HEADER_SIZE
from . import parts, streams

SCHEMA = "container string, ti bigint, kind string, si bigint, src_off bigint, src_size bigint, patch_size bigint, patch binary"
_ARROW = pa.schema([("container", pa.string()), ("ti", pa.int64()), ("kind", pa.string()), *[(c, pa.int64()) for c in ("si", "src_off", "src_size", "patch_size")], ("patch", pa.binary())])
TASK_BYTES = 64 << 20
_WORD, _REST = struct.Struct("<q"), struct.Struct("<qq")


def record_kind(control):
    """identical or patch, by the sign of the control word (a column)."""
    return F.when(control <= 0, "identical").otherwise("patch")


def record_bytes(identical, si, src_off, src_size, patch):
    """A record as a binary column."""
    same = le_bytes(-si, 8)
    full = F.concat(le_bytes(src_off, 8), le_bytes(src_size, 8), le_bytes(F.octet_length(patch), 8), patch)
    return F.when(identical, same).otherwise(full)


def walk(f, size: int, at: int = HEADER_SIZE, n: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """(number, control, source size, patch length, where the patch starts) of each record; patches are skipped.

    Number 0 is the manifest's. A record that the file ends in is an error. ``at``, ``n`` and ``end`` take a stretch of
    the records: from the place of record ``n`` to another's.
    """
    while at < (size if end is None else end):
        f.seek(at)
        head = f.read(24)
        if len(head) < 8:
            raise ValueError(f"record {n} is cut off")
        (control,) = _WORD.unpack_from(head)
        if n and control <= 0:
            yield n, control, 0, 0, at + 8
            at += 8
        else:
            if len(head) < 24:
                raise ValueError(f"record {n} is cut off")
            src, patch = _REST.unpack_from(head, 8)
            if n == 0 and control != 0 or src < 0 or patch < 0 or at + 24 + patch > size:
                raise ValueError(f"record {n} is malformed")
            yield n, control, src, patch, at + 24
            at += 24 + patch
        n += 1


class _Part(InputPartition):
    """The records of a container from ``low``, where number ``first`` starts, to ``high``."""

    def __init__(self, path: str, first: int = 0, low: int = 0, high: int = 0):
        super().__init__(path)
        self.path, self.first, self.low, self.high = path, first, low, high


class DeltaContainer(DataSource):
    """``spark.read.format("delta_container").load(path)``: the records of a container.

    Record boundaries depend on the lengths before, so planning hops from record to record, reading 24 bytes
    of each and holding none; the patches are read by tasks of about TASK_BYTES. ti is -1 for the manifest's record.
    """

    @classmethod
    def name(cls) -> str:
        return "delta_container"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in streams.files(self.path):
            with streams.open_input(path) as f:
                first, low, n, high = 0, HEADER_SIZE, -1, HEADER_SIZE
                for n, _, _, size, at in walk(f, f.size()):
                    high = at + size
                    if high - low + 64 * (n - first) >= TASK_BYTES:
                        out.append(_Part(path, first, low, high))
                        first, low = n + 1, high
                if high > low:
                    out.append(_Part(path, first, low, high))
        return out or [_Part("")]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        return streams.batches(self._rows(partition), _ARROW)

    def _rows(self, partition: _Part) -> Iterator[tuple[tuple, int]]:
        if not partition.high:
            return
        with streams.open_input(partition.path) as f:
            for n, control, src, size, at in walk(f, f.size(), partition.low, partition.first, partition.high):
                if n and control <= 0:
                    yield (partition.path, n - 1, "identical", -control, None, None, None, None), 0
                else:
                    f.seek(at)
                    yield (partition.path, n - 1, "patch", None, control, src, size, f.read(size)), size


def read_container(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(DeltaContainer)
    return spark.read.format("delta_container").load(path)


def _write_records(rows: Iterator, name: str) -> tuple[parts.Part]:
    return (parts.Part(name, streams.write_chunks(name, (bytes(r["record"]) for r in rows))),)


def write_container(header: bytes, manifest_patch: bytes | list[bytes | parts.Part], manifest_size: int, delta: DataFrame, path: str) -> int:
    """Writes a delta table (ti, status, si, src_off, src_size, patch) with ti dense as one container.

    Records follow each other in one file: tasks write stretches of them as parts, and one task joins them (``parts``). The
    manifest's patch may be in parts already. The file appears under its name when it is whole.
    """
    record = record_bytes(F.col("status") == "identical", F.col("si"), F.col("src_off"), F.col("src_size"), F.coalesce("patch", F.lit(b"")))
    patch = [manifest_patch] if isinstance(manifest_patch, bytes) else manifest_patch
    size = sum(len(p) if isinstance(p, bytes) else p.size for p in patch)
    with parts.folder_for(path) as folder:
        made = parts.write_rows(delta.select("ti", record.alias("record")), "ti", _write_records, folder)
        return parts.join(delta.sparkSession, [header + struct.pack("<qqq", 0, manifest_size, size), *patch, *(p for (p,) in made)], folder, path)
