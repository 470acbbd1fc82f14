"""A patch between two files of any size: the target's stretches, each encoded by a task against the source around its place.

A small pair has one patch of the codec, as ever. For others the patch is MAGIC and then, for each stretch of the target
in order, where its part of the source starts, the lengths of that part, of the stretch and of its patch, and the patch.
Codecs whose patches only their own tools read are left whole, with whole.LIMIT.
"""

from __future__ import annotations

import struct
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .codec import codec
from .whole import LIMIT
from ..session import ship
from ..sources import parts, streams

MAGIC = b"\x93tessera"
#: Bytes of the target in a stretch, and of the source on both sides of its place.
STRETCH = REACH = 8 << 20
_HEAD, _HEAD_SIZE = "<qqqq", struct.calcsize("<qqqq")
#: Codecs whose patches this engine alone reads.
OWN = ("zstd", "zstd-stream", "store", "store-stream")


@dataclass(frozen=True)
class Place:
    """``size`` bytes of a file from ``at`` on."""

    path: str
    at: int
    size: int

    def read(self, at: int = 0, size: int | None = None) -> bytes:
        with streams.open_input(self.path) as f:
            f.seek(self.at + at)
            content = f.read(self.size - at if size is None else size)
        if len(content) != (self.size - at if size is None else size):
            raise ValueError(f"{self.path} ends early")
        return content


def whole_file(path: str, at: int = 0) -> Place:
    with streams.open_input(path) as f:
        return Place(path, at, f.size() - at)


def _one(*places: Place) -> None:
    for p in places:
        if p.size > LIMIT:
            raise ValueError(f"{p.path}: {p.size} bytes are too many for one patch of an external tool; use a codec of entries")


def cut(source: int, target: int) -> list[tuple[int, int, int, int]]:
    """(start, length) of each stretch of the target and of its part of the source, which is around the same place
    in proportion to the lengths: between versions of an ordered collection, contents drift little from there."""
    out = []
    for at in range(0, target, STRETCH):
        n = min(STRETCH, target - at)
        low = max(0, at * source // target - REACH)
        out.append((at, n, low, min(source, (at + n) * source // target + REACH) - low))
    return out


def encode(spark: SparkSession, name: str, source: Place, target: Place, folder: str) -> list[bytes | parts.Part]:
    """The pieces of the patch, which tasks write into ``folder``."""
    ship(spark)
    chosen = codec(name)
    if chosen.name not in OWN:
        _one(source, target)
        return [chosen.encode(source.read(), target.read())]
    if max(source.size, target.size) <= STRETCH:
        patch = chosen.encode(source.read(), target.read())
        if not patch.startswith(MAGIC):
            return [patch]
    run_one = chosen.encode

    def run(stretch):
        at, n, low, length = stretch
        patch = run_one(source.read(low, length), target.read(at, n))
        made = f"{folder}/stretch-{uuid.uuid4().hex}"
        return parts.Part(made, streams.write_chunks(made, (struct.pack(_HEAD, low, length, n, len(patch)), patch)))

    return [MAGIC, *_in_tasks(spark, cut(source.size, target.size), run)]


def decode(spark: SparkSession, name: str, source: Place, patch: Place, folder: str) -> list[bytes | parts.Part]:
    """The pieces of the target, which tasks write into ``folder``. A patch that is cut off, or that refers to more than
    the source has, is an error."""
    ship(spark)
    chosen = codec(name)
    if chosen.name not in OWN or patch.size < len(MAGIC) or patch.read(0, len(MAGIC)) != MAGIC:
        _one(source, patch)
        return [chosen.decode(source.read(), patch.read())]
    found, at = [], len(MAGIC)
    with streams.open_input(patch.path) as f:
        while at < patch.size:
            f.seek(patch.at + at)
            head = f.read(min(_HEAD_SIZE, patch.size - at))
            low, length, n, size = struct.unpack(_HEAD, head) if len(head) == _HEAD_SIZE else (-1, 0, 0, 0)
            at += _HEAD_SIZE
            if min(low, length, n, size) < 0 or low + length > source.size or at + size > patch.size:
                raise ValueError(f"{patch.path}: stretch {len(found)} is malformed")
            found.append((low, length, n, at, size))
            at += size
    run_one = chosen.decode

    def run(stretch):
        low, length, n, at, size = stretch
        content = run_one(source.read(low, length), patch.read(at, size))
        if len(content) != n:
            raise ValueError(f"{patch.path}: a stretch gives {len(content)} bytes, not {n}")
        made = f"{folder}/stretch-{uuid.uuid4().hex}"
        return parts.Part(made, streams.write_chunks(made, (content,)))

    return _in_tasks(spark, found, run)


def _in_tasks(spark: SparkSession, given: list, run) -> list[parts.Part]:
    return spark.sparkContext.parallelize(given, len(given)).map(run).collect() if given else []
