"""python -m lodeworks report PATH | ingest PATH --index DIR | search QUESTION --index DIR | characterize MODULE [--out DIR]"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodeworks", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("report").add_argument("path")
    p = sub.add_parser("ingest")
    p.add_argument("path")
    p.add_argument("--index", required=True)
    p = sub.add_parser("search")
    p.add_argument("question")
    p.add_argument("--index", required=True)
    p.add_argument("-k", type=int, default=6)
    p.add_argument("--floor", type=float, default=0.52)
    p = sub.add_parser("characterize")
    p.add_argument("module")
    p.add_argument("--type")
    p.add_argument("--out")
    a = parser.parse_args(args)
    if a.command == "characterize":
        from lodeworks.operators import characterize

        print(characterize.report(a.module, a.type, a.out))
        return 0
    spark = SparkSession.builder.appName("lodeworks").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "report":
        from lodeworks.plans.assess import assess
        from lodeworks.plans.report import render

        with assess(spark, a.path) as found:
            print(render(found))
    elif a.command == "ingest":
        from lodeworks.plans.ingest import ingest

        print(ingest(spark, a.path, a.index))
    else:
        from lodeworks.plans.answer import citations, find
        from lodeworks.sources.snapshots import Index

        index = Index(spark, a.index)
        text = index.text()
        for c in citations(find(index.table("chunks"), a.question, k=a.k, floor=a.floor, index=(text.postings(), text.stats()) if text else None)):
            print(c)
    return 0


if __name__ == "__main__":
    sys.exit(main())
