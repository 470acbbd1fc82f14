r"""Pseudo-files: a text manifest, a marker, and the payload of the regular files behind it.

A manifest line is ``path type time mode uid gid size offset``; a space or backslash in a path has a backslash
before it. After the marker line, the next line that starts with # ends the text, and offsets count from
there. Blank lines, comments and lines of fewer than three fields are passed over; a regular file (type R)
with fewer than eight fields or a number that isn't one is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import unescape
from . import parts, streams

MARKER = "# START OF DATA - DO NOT MODIFY"
SCHEMA = "snapshot string, idx bigint, path string, type string, size bigint, off bigint, content binary"
_ARROW = pa.schema([("snapshot", pa.string()), ("idx", pa.int64()), ("path", pa.string()), ("type", pa.string()), ("size", pa.int64()), ("off", pa.int64()), ("content", pa.binary())])
_NAME = r"^((?:\\.|[^ \\])+) "
#: Payload of a read task, roughly.
TASK_BYTES = 64 << 20


@dataclass(frozen=True)
class Entry:
    path: str
    size: int
    off: int


def parse_line(line: str) -> Entry | None:
    """The entry of a regular file; None for a line that holds none."""
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    m = re.match(_NAME, line)
    if not m:
        return None
    rest = line[m.end() :].split()
    if len(rest) < 2 or rest[0] != "R":
        return None
    if len(rest) < 7:
        raise ValueError(f"too few fields: {line!r}")
    return Entry(re.sub(r"\\([ \\])", r"\1", m[1]), int(rest[5]), int(rest[6]))


def _lines(f) -> Iterator[tuple[int, bytes]]:
    """The lines from where ``f`` stands, each with its number of bytes; also a last one without a line feed."""
    pending = b""
    while more := f.read(1 << 16):
        *whole, pending = (pending + more).split(b"\n")
        for line in whole:
            yield len(line) + 1, line
    if pending:
        yield len(pending) + 1, pending


def walk_manifest(f) -> Iterator[tuple[int, int, Entry | None]]:
    """Where the line of each entry starts and ends, and the entry; at last, without an entry, where the payload starts.

    Nothing is held. A stream without a marker has no payload.
    """
    at, marked = 0, False
    for n, line in _lines(f):
        at += n
        text = line.decode("utf-8", "surrogateescape")
        if marked:
            if text.startswith("#"):
                break
        elif text.strip() == MARKER:
            marked = True
        elif entry := parse_line(text):
            yield at - n, at, entry
    yield at, at, None


def read_manifest(f) -> tuple[list[Entry], int]:
    """The entries in order, and where the payload starts."""
    entries, at = [], 0
    for _, at, entry in walk_manifest(f):
        if entry:
            entries.append(entry)
    return entries, at


def payload_start(path: str) -> int:
    """Where the payload of a pseudo-file starts, which is the length of its manifest."""
    at, marked = 0, False
    with streams.open_input(path) as f:
        for n, line in _lines(f):
            at += n
            if marked:
                if line.startswith(b"#"):
                    break
            elif line.startswith(b"#") or MARKER.encode() in line:
                marked = line.decode("utf-8", "surrogateescape").strip() == MARKER
    return at


def parse_lines(lines: DataFrame, line: str = "line", order: str = "line_no") -> DataFrame:
    """(idx, path, type, size, off) of the regular files among the lines of one manifest, by built-in functions.

    For manifests that are tables of lines already; ``order`` numbers them. A malformed regular file raises.
    """
    text = F.trim(F.col(line))
    name = F.regexp_extract(text, _NAME, 1)
    fields = F.split(F.trim(F.substring(text, F.length(name) + 1, F.length(text))), r"\s+")
    rows = lines.where(~text.startswith("#") & (name != "") & (F.size(fields) >= 2) & (F.get(fields, F.lit(0)) == "R"))
    full = F.when(F.size(fields) < 7, F.raise_error(F.concat(F.lit("too few fields: "), text)).cast("array<string>")).otherwise(fields)
    parsed = rows.select(F.col(order).alias("line_no"), unescape(name).alias("path"), F.lit("R").alias("type"), F.get(full, F.lit(5)).cast("bigint").alias("size"), F.get(full, F.lit(6)).cast("bigint").alias("off"))
    from ..plans.ordered import index_by

    return index_by(parsed, "line_no", "idx").select("idx", "path", "type", "size", "off")


def manifest_text(path: Column, size: Column, off: Column) -> Column:
    """A manifest line for a regular file with neutral time, mode and owner."""
    from ..functions.paths import escape

    return F.concat_ws(" ", escape(path), F.lit("R 0 644 0 0"), size.cast("string"), off.cast("string"))


class _Part(InputPartition):
    """The lines of a manifest from ``low`` to ``high``, the first of which is entry number ``first``."""

    def __init__(self, path: str, start: int = 0, first: int = 0, low: int = 0, high: int = 0):
        super().__init__(path)
        self.path, self.start, self.first, self.low, self.high = path, start, first, low, high


class PseudoFile(DataSource):
    """``spark.read.format("pseudo").load(path)``: the regular files of a pseudo-file, or of every one in a folder.

    Planning reads the manifests only, and holds no entry of them: tasks get a stretch of lines for about TASK_BYTES of
    payload and seek to both, so one image is read in parallel; a payload that ends early is an error. The option ``payload=false``
    leaves content null and reads no payload.
    """

    @classmethod
    def name(cls) -> str:
        return "pseudo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in streams.files(self.path):
            some, low, first, n, held, start = [], 0, 0, 0, 0, 0
            with streams.open_input(path) as f:
                for _, high, e in walk_manifest(f):
                    if e is None:
                        start = high
                        if n > first:
                            some.append((first, low, high))
                        continue
                    n += 1
                    held += 64 + e.size
                    if held >= TASK_BYTES:
                        some.append((first, low, high))
                        first, low, held = n, high, 0
            out += [_Part(path, start, *p) for p in some]
        return out or [_Part("")]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        return streams.batches(self._rows(partition), _ARROW)

    def _rows(self, partition: _Part) -> Iterator[tuple[tuple, int]]:
        if not partition.high:
            return
        with streams.open_input(partition.path) as f:
            f.seek(partition.low)
            found = (parse_line(x.decode("utf-8", "surrogateescape")) for x in f.read(partition.high - partition.low).split(b"\n"))
            for i, e in enumerate(filter(None, found), partition.first):
                content = None
                if self.payload:
                    f.seek(partition.start + e.off)
                    content = f.read(e.size) if e.size else b""
                    if len(content) != e.size:
                        raise ValueError(f"{partition.path}: payload of {e.path!r} ends early")
                yield (partition.path, i, e.path, "R", e.size, e.off, content), len(content or b"")


def read_pseudo(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(PseudoFile)
    return spark.read.format("pseudo").option("payload", str(payload).lower()).load(path)


def _write_entries(rows: Iterator, name: str) -> tuple[parts.Part, parts.Part]:
    """Writes contents, and apart from them their lines, with offsets that count from the first of these contents."""
    lines, off = [], 0

    def contents() -> Iterator[bytes]:
        nonlocal off
        for r in rows:
            if "\n" in r["path"]:
                raise ValueError(f"a manifest can't hold a path with a line feed: {r['path']!r}")
            path, content = re.sub(r"([ \\])", r"\\\1", r["path"]), bytes(r["content"])
            lines.append(f"{path} R 0 644 0 0 {len(content)} {off}\n".encode("utf-8", "surrogateescape"))
            off += len(content)
            yield content

    n = streams.write_chunks(name, contents())
    return parts.Part(f"{name}-lines", streams.write_chunks(f"{name}-lines", lines)), parts.Part(name, n)


def write_pseudo(entries: DataFrame, path: str) -> int:
    """Writes (idx, path, content), with idx dense, as one pseudo-file in the order of idx and returns its bytes.

    Tasks write stretches of it as parts, and one task joins them (``parts``); the driver sees their sizes only. The
    file appears under its name when it is whole.
    """
    with parts.folder_for(path) as folder:
        made = parts.write_rows(entries.select("idx", "path", "content"), "idx", _write_entries, folder)
        before = accumulate((body.size for _, body in made), initial=0)
        heads = [replace(lines, add=add) for (lines, _), add in zip(made, before)]
        return parts.join(entries.sparkSession, [*heads, f"#\n{MARKER}\n#\n".encode(), *(body for _, body in made)], folder, path)
