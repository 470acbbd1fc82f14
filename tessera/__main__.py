"""python -m tessera generate|apply --source FILE --target FILE --delta FOLDER"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .operators.codec import CODECS, DEFAULT
from .plans import api, files
from .session import local_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description="Deltas between two versions of a collection of entries.")
    p.add_argument("operation", choices=("generate", "apply"))
    p.add_argument("-s", "--source", required=True)
    p.add_argument("-t", "--target", required=True)
    p.add_argument("-d", "--delta", required=True)
    p.add_argument("--codec", help=f"how changed entries are stored, {', '.join(sorted(CODECS))}, with :LEVEL where there are levels; {DEFAULT} if none is named")
    p.add_argument("--file", action="store_true", help="one delta file, for images or pseudo-files; apply takes files by themselves")
    p.add_argument("--plain-unsupported", action="store_true", help="a plain delta for an image with compressor options")
    for tool in ("xdelta3", "hdiffz", "bsdiff"):
        p.add_argument(f"--{tool}", action="store_true", help=f"the same as --codec {tool}")
    p.add_argument("--whole", action="store_true", help="one patch for the whole collection")
    p.add_argument("--mode", choices=("best", "compat"), default="best")
    return p


def main(args: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(args)
    named = [t for t in ("xdelta3", "hdiffz", "bsdiff") if getattr(a, t)] + [a.codec] * bool(a.codec)
    if len(named) > 1:
        p.error("name one codec only")
    if a.operation == "apply" and named:
        p.error("apply takes its codec from the delta")
    spark = local_session("*")
    try:
        if a.operation == "generate" and a.file:
            files.generate_file(spark, a.source, a.target, a.delta, named[0] if named else DEFAULT, "plain" if a.plain_unsupported else "error")
        elif a.operation == "apply" and Path(a.delta).is_file():
            files.apply_file(spark, a.source, a.delta, a.target)
        elif a.operation == "generate":
            api.generate(spark, a.source, a.target, a.delta, named[0] if named else DEFAULT, a.mode, "whole" if a.whole else "entry").show()
        else:
            api.apply(spark, a.source, a.delta, a.target)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
