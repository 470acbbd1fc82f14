"""Whole mode: one patch for a whole snapshot, for parity with tools that diff two complete streams.

It needs both streams in one place, so it refuses snapshots beyond a documented size; per-entry deltas have no
such bound and are what to use at scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codec import DEFAULT, codec
from ..sources.snapshots import Snapshot, contents

#: The largest stream, in bytes.
LIMIT = 512 << 20


def stream(snapshot: Snapshot) -> bytes:
    """The snapshot as one stream: lines of path and size, an empty line, and the contents in order."""
    total = snapshot.entries.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    if total > LIMIT:
        raise ValueError(f"{total} bytes are too many for one patch; use a per-entry delta")
    rows = contents(snapshot.entries.select("idx", "path", "sha"), snapshot.payload, "idx").select("idx", "path", "content").orderBy("idx").toLocalIterator()
    lines, parts = [], []
    for r in rows:
        lines.append(f"{len(r['content'])} {r['path']}\n".encode("utf-8", "surrogateescape"))
        parts.append(bytes(r["content"]))
    return b"".join(lines) + b"\n" + b"".join(parts)


def entries_of(flat: bytes) -> list[tuple[int, str, bytes]]:
    """What ``stream`` was made of: (idx, path, content)."""
    sizes, at = [], 0
    while flat[at : at + 1] != b"\n":
        end = flat.index(b"\n", at)
        size, path = flat[at:end].decode("utf-8", "surrogateescape").split(" ", 1)
        sizes.append((int(size), path))
        at = end + 1
    at += 1
    out = []
    for i, (size, path) in enumerate(sizes):
        out.append((i, path, flat[at : at + size]))
        at += size
    if at != len(flat):
        raise ValueError("the stream's length doesn't fit its entries")
    return out


def generate(source: Snapshot, target: Snapshot, name: str = DEFAULT) -> bytes:
    return codec(name).encode(stream(source), stream(target))


def apply(source: Snapshot, patch: bytes, name: str = DEFAULT) -> DataFrame:
    """(idx, path, content) of the target."""
    rows = entries_of(codec(name).decode(stream(source), patch))
    return source.entries.sparkSession.createDataFrame(rows, "idx bigint, path string, content binary")
