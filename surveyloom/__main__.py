"""``python -m surveyloom FILE...``: what survey files hold and what is odd about them, without Spark and without their data."""

from __future__ import annotations

import argparse
import sys
from collections import Counter
from typing import TextIO

from surveyloom.functions.layout import LINE_CATEGORIES, SurveyFile
from surveyloom.sources import catalog


def describe(path: str, out: TextIO) -> None:
    """Header, channels, lines, cells, diagnostics and departures of one file."""
    s = SurveyFile(path)
    print(path, file=out)
    if s.is_survey:
        print("  " + ", ".join(f"{k} {v}" for k, v in s.header.items()), file=out)
        print(f"  {len(s.blocks)} blocks, {len(s.live)} cells", file=out)
        for c in s.channels:
            print(f"  channel {c.slot} {c.var_name}: type {c.dtype}" + f", {c.width} wide" * (c.width > 1), file=out)
        for category, n in sorted(Counter(x.category for x in s.lines).items()):
            print(f"  {n} lines of category {LINE_CATEGORIES[category]}", file=out)
    for code, line, channel, offset, message in catalog._diagnostics(s, True):
        where = ", ".join(f"{k} {v}" for k, v in (("line", line), ("channel", channel), ("offset", offset)) if v is not None)
        print(f"  {code}: {message}" + f" ({where})" * bool(where), file=out)
    if s.is_survey:
        for record, slot, field, value in catalog._conformance(s):
            print(f"  unlike others: {record} {slot}, {field} is {value}", file=out)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="python -m surveyloom", description=__doc__)
    parser.add_argument("files", nargs="+")
    for path in parser.parse_args(argv).files:
        describe(path, sys.stdout)
    return 0


if __name__ == "__main__":
    sys.exit(main())
