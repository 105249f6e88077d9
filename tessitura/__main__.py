"""python -m tessitura QUERY --data FOLDER [--out PATH]: run a query of the library and show or write its result; --list names them."""

from __future__ import annotations

import argparse
from collections.abc import Sequence


def main(arguments: Sequence[str] | None = None) -> int:
    from tessitura.plans import catalogue
    from tessitura.session import get_spark

    parser = argparse.ArgumentParser(prog="tessitura")
    parser.add_argument("query", nargs="?")
    parser.add_argument("--data")
    parser.add_argument("--out")
    parser.add_argument("--master", default="local[*]")
    parser.add_argument("--list", action="store_true")
    given = parser.parse_args(arguments)
    if given.list:
        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    if given.query not in catalogue.QUERIES or not given.data:
        parser.error("name a query and its --data; --list names all queries")
    found = catalogue.QUERIES[given.query](get_spark(given.master), given.data)
    if given.out:
        found.write.mode("overwrite").parquet(given.out)
    else:
        found.show(20, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
