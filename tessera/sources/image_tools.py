"""Images to pseudo-files and back, by the tools that make and read them, where they are installed."""

from __future__ import annotations

import subprocess

from ..operators.codec import found, works

# Arguments of the tools. Making a delta has memory; applying one may not.
_UNPACK = {"generate": ["-da", "128", "-fr", "128"], "apply": ["-mem-percent", "3"]}
_BUILD = ["-mem-percent", "3"]
# End of the fixed values.


def _tool(name: str) -> str:
    if not works(name):
        raise ValueError(f"the tool {name} isn't installed or doesn't run")
    return found(name) or name


def unpack(image: str, pseudo: str, purpose: str = "generate") -> None:
    """Writes the pseudo-file of an image."""
    subprocess.run([_tool("unsquashfs"), *_UNPACK[purpose], "-no-progress", "-pf", pseudo, image], check=True, capture_output=True)


def build(pseudo: str, image: str, arguments: list[str]) -> None:
    """Makes the image of a pseudo-file; ``arguments`` are those of a delta's header."""
    with open(pseudo, "rb") as stream:
        subprocess.run([_tool("mksquashfs"), "-", image, "-pf", "-", "-noappend", "-quiet", *arguments, *_BUILD], check=True, capture_output=True, stdin=stream)
