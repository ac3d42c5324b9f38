"""Batch scoring as a job: ``spark-submit chronolith/plans/batch.py --artifacts A --input I --output O``.

Exit codes: 0 scored, 2 bad arguments, 3 artifacts can't be loaded, 4 input can't be read or scored.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from chronolith.plans.training import Trained
from chronolith.sources.tables import append_scores, read, write


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--artifacts", required=True)
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True, help="a .parquet or .csv path, or a jdbc: url")
    parser.add_argument("--table", default="scores")
    parser.add_argument("--model-version", default="1")
    try:
        args = parser.parse_args(argv)
    except SystemExit as stop:
        return 0 if stop.code == 0 else 2
    spark = SparkSession.builder.getOrCreate()
    try:
        trained = Trained.load(spark, args.artifacts)
    except Exception as error:
        print(f"can't load {args.artifacts}: {error}", file=sys.stderr)
        return 3
    try:
        scores = trained.score(read(spark, args.input), args.model_version)
        append_scores(scores, args.output, args.table) if args.output.startswith("jdbc:") else write(scores, args.output)
    except Exception as error:
        print(f"can't score {args.input}: {error}", file=sys.stderr)
        return 4
    return 0


if __name__ == "__main__":
    sys.exit(main())
