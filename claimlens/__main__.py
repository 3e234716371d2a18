"""Command line: ``python -m claimlens prepare RAW_CSV OUT``, then ``relate OUT`` and ``diagnose OUT``."""

import argparse

from claimlens.plans import jobs
from claimlens.session import build_session


def main() -> None:
    parser = argparse.ArgumentParser(prog="claimlens")
    stages = parser.add_subparsers(dest="stage", required=True)
    prepare = stages.add_parser("prepare")
    prepare.add_argument("raw_csv")
    for stage in (prepare, stages.add_parser("relate"), stages.add_parser("diagnose")):
        stage.add_argument("out")
    args = parser.parse_args()
    spark = build_session()
    if args.stage == "prepare":
        jobs.prepare(spark, args.raw_csv, args.out)
    else:
        getattr(jobs, args.stage)(spark, args.out)
    spark.stop()


if __name__ == "__main__":
    main()
