"""Files that many tasks write: each writes parts beside the file, and one task joins them under its name.

No content passes through the driver, which holds the names and sizes of the parts only. The folder of a file must be one
that driver and executors share, as for reading.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import streams

#: Entries of one part.
ROWS = 1 << 12
_CHUNK = 8 << 20


@dataclass(frozen=True)
class Part:
    """A file, or stretch of one. With ``add`` it holds lines whose last field is a number that ``add`` is added to."""

    path: str
    size: int
    add: int | None = None


@contextmanager
def folder_for(path: str) -> Iterator[str]:
    """A new folder beside ``path``, which is removed at the end."""
    folder = f"{path}.{uuid.uuid4().hex}.parts"
    streams.make_folder(folder)
    try:
        yield folder
    finally:
        streams.remove_folder(folder)


def _chunks(pieces: Iterable[bytes | Part]) -> Iterator[bytes]:
    for p in pieces:
        if isinstance(p, bytes):
            yield p
            continue
        with streams.open_input(p.path) as f:
            if p.add is None:
                while chunk := f.read(_CHUNK):
                    yield chunk
            else:
                heads = (line.rsplit(b" ", 1) for line in f.read().split(b"\n")[:-1])  # of at most ROWS entries
                yield b"".join(b"%b %d\n" % (head, int(off) + p.add) for head, off in heads)


def join(spark: SparkSession, pieces: list[bytes | Part], folder: str, path: str) -> int:
    """Writes the pieces, one after the other, as the file ``path`` and returns its bytes. One file is one writer: a task
    streams them into ``folder``, and the file appears under its name when it is whole."""
    ship(spark)

    def run(given):
        name = f"{folder}/whole-{uuid.uuid4().hex}"
        return name, streams.write_chunks(name, _chunks(given))

    name, n = spark.sparkContext.parallelize([pieces], 1).map(run).first()
    streams.rename(name, path)
    return n


def write_rows(rows: DataFrame, index: str, write: Callable[[Iterator, str], tuple], folder: str) -> list[tuple]:
    """What ``write`` returns for each stretch of ROWS values of ``index``, in order. It gets the rows of the stretch, in
    order, and a file name of its own. Rows are dealt by their index, so nothing is sampled and ``rows`` is computed once."""
    ship(rows.sparkSession)
    dealt = rows.withColumn("_stretch", F.floor(F.col(index) / ROWS)).repartition("_stretch").sortWithinPartitions("_stretch", index)

    def run(given):
        given, held = iter(given), []

        def stretch(first):
            yield first
            for r in given:
                if r["_stretch"] != first["_stretch"]:
                    held.append(r)
                    return
                yield r

        first = next(given, None)
        while first is not None:
            yield first["_stretch"], write(stretch(first), f"{folder}/part-{uuid.uuid4().hex}")
            first = held.pop() if held else None

    return [made for _, made in sorted(dealt.rdd.mapPartitions(run).collect())]
