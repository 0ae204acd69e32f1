"""python -m quernlight.cli [-e SQL]... FILE...: files as tables, then statements, or a prompt where none is given."""

from __future__ import annotations

import argparse
import sys

from .engine import Engine, Result
from .plans.syntax import DialectError


def table(result: Result, most: int = 200) -> str:
    if not result.columns:
        return "OK"
    cells = [["NULL" if v is None else str(v) for v in row.values()] for row in result.rows[:most]]
    if len(result.columns) == 1 and cells and "\n" in cells[0][0]:
        return cells[0][0]
    widths = [max(len(x) for x in column) for column in zip(result.columns, *cells)]
    lines = [" | ".join(x.ljust(w) for x, w in zip(row, widths)).rstrip() for row in (result.columns, ["-" * w for w in widths], *cells)]
    return "\n".join([*lines, f"({len(result.rows)} rows{f', {most} shown' if len(result.rows) > most else ''})"])


def main(args: list[str] | None = None, engine: Engine | None = None, lines=None) -> int:
    parser = argparse.ArgumentParser(prog="quernlight")
    parser.add_argument("files", nargs="*")
    parser.add_argument("-e", "--execute", action="append", default=[])
    given = parser.parse_args(args)
    engine, failed = engine or Engine(), 0
    for path in given.files:
        print(f"loaded {engine.load(path)}")
    prompt = not given.execute and lines is None and sys.stdin.isatty()
    pending = ""
    for line in given.execute or lines or (iter(lambda: input("> "), None) if prompt else sys.stdin):
        if line.strip() in (".exit", ".quit"):
            break
        if line.strip() == ".tables":
            print("\n".join(engine.catalog.names()))
            continue
        pending = f"{pending}\n{line}".strip() if not given.execute else line
        if not pending or (not given.execute and not pending.endswith(";")):
            continue
        try:
            print(table(engine.run(pending)))
        except DialectError as error:
            failed = 1
            print(f"error: {error}", file=sys.stderr)
        pending = ""
    return failed


if __name__ == "__main__":
    sys.exit(main())
