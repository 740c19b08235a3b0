"""``python -m quillon FOLDER COMMAND [ARGUMENT ...] [--out FOLDER] [--format json|csv|parquet|text]``"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame

from quillon.session import session
from quillon.store import COMMANDS, Store, run


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("quillon", description=__doc__)
    parser.add_argument("folder")
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("arguments", nargs="*")
    parser.add_argument("--out", help="where to write the result; without it, twenty rows are shown")
    parser.add_argument("--format", default="json", choices=["json", "csv", "parquet", "text"])
    parser.add_argument("--master")
    a = parser.parse_args(argv)
    found = run(Store(session("quillon", a.master), a.folder), a.command, *a.arguments)
    if not isinstance(found, DataFrame):
        print(found)
    elif a.out:
        found.write.mode("overwrite").format(a.format).save(a.out)
    else:
        found.show(20, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
