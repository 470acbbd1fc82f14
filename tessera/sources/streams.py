"""Random access to files in any store that Arrow or the local system reaches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs


def _resolve(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def batches(rows: Iterable[tuple[tuple, int]], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows, each with its bytes, as Arrow batches of about ``most`` bytes."""
    some: list[tuple] = []
    held = 0
    for row, n in rows:
        some.append(row)
        held += n + 64
        if held >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
            some, held = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def open_input(path: str) -> BinaryIO:
    place, name = _resolve(path)
    return place.open_input_file(name)


def write_chunks(path: str, chunks) -> int:
    """Writes chunks as a new file and returns its bytes."""
    place, name = _resolve(path)
    n = 0
    with place.open_output_stream(name) as out:
        for chunk in chunks:
            out.write(chunk)
            n += len(chunk)
    return n


def make_folder(path: str) -> None:
    place, name = _resolve(path)
    place.create_dir(name, recursive=True)


def rename(old: str, new: str) -> None:
    place, name = _resolve(old)
    place.move(name, _resolve(new)[1])


def remove(path: str) -> None:
    place, name = _resolve(path)
    if place.get_file_info(name).type != fs.FileType.NotFound:
        place.delete_file(name)


def remove_folder(path: str) -> None:
    place, name = _resolve(path)
    if place.get_file_info(name).type != fs.FileType.NotFound:
        place.delete_dir(name)


def files(path: str, suffix: str = "") -> list[str]:
    """The file at ``path``, or the files in the folder, in order."""
    place, name = _resolve(path)
    info = place.get_file_info(name)
    prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
    if info.type == fs.FileType.Directory:
        found = sorted(x.path for x in place.get_file_info(fs.FileSelector(name)) if x.type == fs.FileType.File and x.path.endswith(suffix))
        return [prefix + x for x in found]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [path]
