"""python -m quillspan QUERY SF_DIR [ROWS]: show a registered query's first rows."""

from __future__ import annotations

import sys


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    from quillspan.plans.registry import QUERIES

    if len(argv) < 2 or argv[0] not in QUERIES:
        print(__doc__, "Queries: " + ", ".join(sorted(QUERIES)), sep="\n", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName(argv[0]).getOrCreate()
    QUERIES[argv[0]](spark, argv[1]).show(int(argv[2]) if len(argv) > 2 else 20, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
