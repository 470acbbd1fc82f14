"""Codecs: how a changed entry is stored as a patch against its source entry."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

import zstandard

#: A raw-content dictionary needs at least so many bytes.
_LEAST_DICTIONARY = 8


@dataclass(frozen=True)
class Codec:
    """encode(source, target) -> patch, and decode(source, patch) -> target. ``tool`` is its id in headers, 0 for a patch
    that stands without one. ``at_level`` makes the codec with another compression level, where it has one."""

    name: str
    tool: int
    encode: Callable[[bytes, bytes], bytes]
    decode: Callable[[bytes, bytes], bytes]
    available: Callable[[], bool] = lambda: True
    at_level: Callable[[int], Codec] | None = None


def _dictionary(source: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(source, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(source) >= _LEAST_DICTIONARY else None


def _window(n: int) -> int:
    """The log of a window that spans source and target, within what decoders accept."""
    return min(27, max(10, (n - 1).bit_length()))


def zstd_encode(source: bytes, target: bytes, level: int = 19) -> bytes:
    params = zstandard.ZstdCompressionParameters.from_level(level, window_log=_window(len(source) + len(target) + 1), enable_ldm=len(source) > 1 << 20)
    return zstandard.ZstdCompressor(dict_data=_dictionary(source), compression_params=params).compress(target)


def zstd_decode(source: bytes, patch: bytes) -> bytes:
    return zstandard.ZstdDecompressor(dict_data=_dictionary(source), max_window_size=1 << 27).decompress(patch)


def _external(encode: list[str], decode: list[str], level: int):
    """A codec pair that runs tools on files; {source}, {target} and {patch} stand for their names, {level} for a number."""

    def run(command: list[str], given: dict[str, bytes], made: str) -> bytes:
        with tempfile.TemporaryDirectory() as folder:
            names = {k: str(Path(folder, k)) for k in ("source", "target", "patch")}
            for k, content in given.items():
                Path(names[k]).write_bytes(content)
            subprocess.run([found(command[0]) or command[0], *(part.format(**names, level=level) for part in command[1:])], check=True, capture_output=True)
            return Path(names[made]).read_bytes()

    return (lambda s, t: run(encode, {"source": s, "target": t}, "patch"), lambda s, p: run(decode, {"source": s, "patch": p}, "target"))


# The tools define these options and arguments.
#: The option with which a tool only says what it is; one without an option isn't started to see whether it works.
PROBE = {"xdelta3": "config", "hdiffz": "-v", "hpatchz": "-v", "mksquashfs": "-version", "unsquashfs": "-help"}
_XDELTA3 = ["xdelta3", "-e", "-f", "-{level}", "-A", "-s", "{source}", "{target}", "{patch}"]
_XDELTA3_PLAIN = ["xdelta3", "-e", "-f", "-{level}", "-s", "{source}", "{target}", "{patch}"]
_XDELTA3_BACK = ["xdelta3", "-d", "-f", "-s", "{source}", "{patch}", "{target}"]
_HDIFFZ = ["hdiffz", "-f", "-m-6", "-SD", "-c-zstd-{level}-24", "-d", "{source}", "{target}", "{patch}"]
_HPATCHZ = ["hpatchz", "-f", "-s-8m", "{source}", "{patch}", "{target}"]
_BSDIFF, _BSPATCH = ["bsdiff", "{source}", "{target}", "{patch}"], ["bspatch", "{source}", "{target}", "{patch}"]
# End of the fixed values.

#: A variable that names folders, as PATH does, in which tools are looked for before the PATH.
FOLDERS = "TESSERA_TOOLS"


def found(tool: str) -> str | None:
    """Where a tool is: in a folder of FOLDERS, or else on the PATH."""
    return shutil.which(tool, path=os.environ.get(FOLDERS, "")) or shutil.which(tool)


def works(tool: str) -> bool:
    """Whether a tool is installed and, where PROBE names an option, runs."""
    place, option = found(tool), PROBE.get(Path(tool).name)
    return place is not None and (option is None or subprocess.run([place, option], capture_output=True).returncode == 0)


def external(name: str, tool: int, encode: list[str], decode: list[str], level: int | None = None) -> Codec:
    again = (lambda n: external(name, tool, encode, decode, n)) if level is not None else None
    return Codec(name, tool, *_external(encode, decode, level or 0), lambda: all(works(c[0]) for c in (encode, decode)), again)


def _zstd(name: str, tool: int, level: int = 19) -> Codec:
    return Codec(name, tool, lambda s, t: zstd_encode(s, t, level), zstd_decode, at_level=lambda n: _zstd(name, tool, n))


CODECS = {
    c.name: c
    for c in (
        _zstd("zstd", 0x101),
        _zstd("zstd-stream", 0x111),
        Codec("store", 0x103, lambda s, t: t, lambda s, p: p),
        Codec("store-stream", 0x113, lambda s, t: t, lambda s, p: p),
        external("xdelta3", 0x1, _XDELTA3, _XDELTA3_BACK, 7),
        external("xdelta3-plain", 0, _XDELTA3_PLAIN, _XDELTA3_BACK, 3),
        external("hdiffz", 0x2, _HDIFFZ, _HPATCHZ, 21),
        external("hdiffz-whole", 0x13, _HDIFFZ, _HPATCHZ, 21),
        external("bsdiff", 0x12, _BSDIFF, _BSPATCH),
    )
}
DEFAULT = "zstd"
PLAIN = "xdelta3-plain"


def codec(name: str) -> Codec:
    """The codec of that name, or of "name:level"; an error if it is unknown, has no levels, or its tools are missing."""
    base, _, level = name.partition(":")
    one = CODECS.get(base)
    if one is None:
        raise ValueError(f"unknown codec {base!r}; there are {', '.join(CODECS)}")
    if level:
        if not one.at_level or not level.isdigit():
            raise ValueError(f"codec {base!r} has no level {level!r}")
        one = one.at_level(int(level))
    if not one.available():
        raise ValueError(f"the tools of codec {base!r} aren't installed")
    return one


def by_tool(tool: int) -> Codec:
    for c in CODECS.values():
        if tool and c.tool == tool:
            return codec(c.name)
    raise ValueError(f"unknown tool id {tool:#x}")
