"""python -m quillwork FILE.pdf -f md: convert a PDF file."""

from __future__ import annotations

import argparse
import pathlib
import sys

from quillwork import __version__
from quillwork.api import MODES, convert
from quillwork.plans.emit import format_name

SUFFIX = {"typst": "typ", "latex": "tex"}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("quillwork", description="Convert PDF files.")
    p.add_argument("input")
    p.add_argument("-f", "--format", default="docx")
    p.add_argument("-o", "--output")
    p.add_argument("-m", "--mode", default="flow", choices=MODES)
    p.add_argument("-p", "--password", default="")
    p.add_argument("--version", action="version", version=__version__)
    a = p.parse_args(argv)
    try:
        name = format_name(a.format)
        target = a.output or str(pathlib.Path(a.input).with_suffix("." + SUFFIX.get(name, name)))
        convert(a.input, name, target, a.mode, a.password)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(target)
    return 0


if __name__ == "__main__":
    sys.exit(main())
