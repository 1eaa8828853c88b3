"""Command line: list the queries, run one, explain its plan, or print its SQL twin.

    python -m kelpie list
    python -m kelpie run cohort_percentile --data DIR [--out DIR --format parquet|csv|json] [--rows N]
    python -m kelpie explain cohort_percentile --data DIR
    python -m kelpie sql cohort_percentile
    python -m kelpie scan|headers|hashes|undecodable|documents ROOT [--out DIR]
    python -m kelpie audit TRACKS [--out DIR]      findings over a Parquet table of tracks; the exit code is 1 if one is an error
    python -m kelpie sections NAME...              which sections of a digest these names mean
    python -m kelpie check QUERY... --data DIR     runs queries and says how many rows each has
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from kelpie.operators import headline, quality
from kelpie.plans import registry
from kelpie.sources import documents, media

FOLDER_COMMANDS = {
    "scan": lambda spark, root: media.channel_levels(media.read_blocks(spark, root)),
    "headers": media.headers,
    "hashes": media.hashes,
    "undecodable": media.undecodable,
    "documents": documents.find_documents,
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="kelpie", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    for name in ("run", "explain", "sql"):
        p = commands.add_parser(name)
        p.add_argument("query", choices=sorted(registry.QUERIES))
        if name != "sql":
            p.add_argument("--data", required=True)
        if name == "run":
            p.add_argument("--out")
            p.add_argument("--format", default="parquet", choices=("parquet", "csv", "json"))
            p.add_argument("--rows", type=int, default=20)
    for name in FOLDER_COMMANDS:
        p = commands.add_parser(name)
        p.add_argument("root")
        p.add_argument("--out")
    p = commands.add_parser("audit")
    p.add_argument("root")
    p.add_argument("--out")
    p = commands.add_parser("sections")
    p.add_argument("names", nargs="+")
    p = commands.add_parser("check")
    p.add_argument("queries", nargs="+", choices=sorted(registry.QUERIES))
    p.add_argument("--data", required=True)
    args = parser.parse_args(argv)
    if args.command == "list":
        for name, f in sorted(registry.QUERIES.items()):
            print(name, "-", (f.__doc__ or "").strip().split("\n")[0])
        return 0
    if args.command == "sql":
        print(registry.ORACLE_SQL.get(args.query, "no SQL says this"))
        return 0
    if args.command == "sections":
        print("\n".join(headline.chosen_sections(args.names)))
        return 0
    spark = SparkSession.builder.appName("kelpie").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    code = 0
    if args.command == "check":
        for name in args.queries:
            print(name, registry.QUERIES[name](spark, args.data).count())
        return 0
    if args.command in FOLDER_COMMANDS:
        out = FOLDER_COMMANDS[args.command](spark, args.root)
    elif args.command == "audit":
        out = quality.audit(spark.read.parquet(args.root))
        code = quality.exit_code(out)
    else:
        out = registry.QUERIES[args.query](spark, args.data)
    if args.command == "explain":
        out.explain("formatted")
    elif args.out:
        out.write.mode("errorifexists").format(getattr(args, "format", "parquet")).save(args.out)
    else:
        out.show(getattr(args, "rows", 20), truncate=False)
    return code


if __name__ == "__main__":
    raise SystemExit(main())
