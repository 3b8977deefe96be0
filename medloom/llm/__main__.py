"""Command line: python -m medloom.llm NAME FOLDER [--out PATH] runs a query of this subpackage; without a name it lists them."""

from __future__ import annotations

import argparse
import sys

from medloom.llm import plans
from medloom.runtime import session


def main(argv: list[str] | None = None) -> int:
    made = argparse.ArgumentParser(prog="medloom.llm")
    made.add_argument("--master", default="local[*]")
    made.add_argument("name", nargs="?", choices=sorted(plans.QUERIES))
    made.add_argument("folder", nargs="?")
    made.add_argument("--out", help="Parquet folder; else the first rows are shown")
    args = made.parse_args(argv)
    if args.name is None or args.folder is None:
        print("\n".join(sorted(plans.QUERIES)))
        return 0
    df = plans.QUERIES[args.name](session(args.master), args.folder)
    df.write.mode("overwrite").parquet(args.out) if args.out else df.show(truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main())
