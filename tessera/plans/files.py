"""Deltas as single files: with a header and records or one patch behind it, or plain.

What follows a header is what its tool's id stands for (``codes.FORMS``): a record for each entry (``container``), or one
patch of the two whole pseudo-files (``stretches``: of any size for the engine's own codecs). A plain delta is a patch of two
files as they are, without a header. Applying reads the magic first, then the tool. Patches of external tools need both
files in one place and have whole.LIMIT.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.codes import FORMS, HEADER_SIZE, SUPERBLOCK_MAGIC, rebuild_arguments
from ..operators import codec, stretches
from ..operators.images import ON_UNSUPPORTED
from ..operators.whole import LIMIT
from ..session import ship
from ..sources import headers, image_tools, pseudo, streams
from ..sources.parts import folder_for, join
from . import api
from .scratch import shared_dir


def _head(path: str) -> bytes:
    with streams.open_input(path) as f:
        return f.read(HEADER_SIZE)


def _whole(path: str) -> bytes:
    with streams.open_input(path) as f:
        if f.size() > LIMIT:
            raise ValueError(f"{path}: {f.size()} bytes are too many for one patch; use a codec of entries")
        return f.read()


def is_image(path: str) -> bool:
    return int.from_bytes(_head(path)[:4], "little") == SUPERBLOCK_MAGIC


def _write(path: str, *chunks: bytes) -> int:
    temporary = path + ".tmp"
    try:
        n = streams.write_chunks(temporary, chunks)
        streams.rename(temporary, path)
    except BaseException:
        streams.remove(temporary)
        raise
    return n


def _temporary(spark: SparkSession) -> tempfile.TemporaryDirectory:
    """A folder for unpacked images, which tasks read and write, too: in the shared one, where that is a local path."""
    place = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    return tempfile.TemporaryDirectory(dir=place if Path(place).is_dir() else None)


@contextmanager
def _pseudo(spark: SparkSession, path: str, purpose: str) -> Iterator[str]:
    """The path of a pseudo-file, which an image is unpacked to."""
    if not is_image(path):
        yield path
        return
    with _temporary(spark) as folder:
        made = str(Path(folder, "pseudo"))
        image_tools.unpack(path, made, purpose)
        yield made


def generate_file(spark: SparkSession, source: str, target: str, out: str, codec_name: str = codec.DEFAULT, on_unsupported: str = "error", like: str | None = None) -> int:
    """Writes the delta from ``source`` to ``target``, images or pseudo-files, to the file ``out`` and returns its bytes.

    The header says how to rebuild the target: it comes from the target's superblock, or, where that is a pseudo-file, from
    the image ``like`` (without one, neutral fields). An image with compressor options is an error, or, with ``on_unsupported``
    plain, gets a plain delta. A failed write leaves no delta.
    """
    ship(spark)
    if on_unsupported not in ON_UNSUPPORTED:
        raise ValueError(f"on_unsupported is one of {', '.join(ON_UNSUPPORTED)}")
    chosen = codec.codec(codec_name)
    head, image = None, target if is_image(target) else like
    if chosen.tool and image:
        error, head = headers.header_for(spark, _head(image), chosen.tool)
        if error == "compressor options" and on_unsupported == "plain" and is_image(target):
            chosen = codec.codec(codec.PLAIN)
        elif error:
            raise ValueError(f"{image}: {error}")
    if not chosen.tool:
        return _write(out, chosen.encode(_whole(source), _whole(target)))
    with _pseudo(spark, source, "generate") as before, _pseudo(spark, target, "generate") as after:
        if FORMS[chosen.tool] == "entries":
            return api.export_container(spark, before, after, out, codec_name=codec_name, head=head)
        if head is None:
            head = api.neutral_header(spark, chosen.tool)
        with folder_for(out) as folder:
            return join(spark, [head, *stretches.encode(spark, codec_name, stretches.whole_file(before), stretches.whole_file(after), folder)], folder, out)


def apply_file(spark: SparkSession, source: str, delta: str, out: str) -> list[str] | None:
    """Writes to ``out`` what the delta file makes of ``source``, and returns the arguments that rebuild an image (None
    for a plain delta). A source image gives an image, a pseudo-file a pseudo-file. Unknown magics, versions, tools,
    compressions and flags are errors."""
    ship(spark)
    head = _head(delta)
    row = spark.createDataFrame([(bytearray(head),)], "h binary")
    kind, error, tool = row.select(headers.delta_kind(F.col("h")), headers.header_error(F.col("h")), headers.decode(F.col("h"), headers.HEADER)["tool"]).first()
    if error:
        raise ValueError(f"{delta}: {error}")
    if kind == "plain":
        _write(out, codec.codec(codec.PLAIN).decode(_whole(source), _whole(delta)))
        return None
    arguments = row.select(rebuild_arguments(headers.decode(F.col("h"), headers.HEADER)).alias("a")).first()["a"]
    chosen, image = codec.by_tool(tool), is_image(source)
    with _temporary(spark) as folder, _pseudo(spark, source, "apply") as before:
        made = str(Path(folder, "made")) if image else out
        if FORMS[tool] == "entries":
            pseudo.write_pseudo(api.import_container(spark, before, delta), made)
        else:
            with folder_for(made) as parts:
                join(spark, stretches.decode(spark, chosen.name, stretches.whole_file(before), stretches.whole_file(delta, HEADER_SIZE), parts), parts, made)
        if image:
            image_tools.build(made, out, arguments)
    return arguments
