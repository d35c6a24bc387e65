"""The command line: ``python -m jobquarry search --keywords ... --table folder`` and the other tools, as JSON lines."""

from __future__ import annotations

import argparse
import datetime
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from jobquarry.plans import tools
from jobquarry.plans.search import SearchQuery
from jobquarry.sources import board_feeds, feeds, more_feeds, resolver  # noqa: F401  (rules are added by import)
from jobquarry.sources.documents import read_resumes
from jobquarry.sources.store import wire


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="jobquarry")
    p.add_argument("--version", action="version", version="jobquarry 0.2")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("search", "match-resume", "sponsor-jobs", "companies"):
        s = sub.add_parser(name)
        s.add_argument("--table", required=True, help="Parquet folder of stored rows")
        s.add_argument("--today", default=datetime.date.today().isoformat())
        s.add_argument("--limit", type=int, default=20)
        for field in ("keywords", "location", "country", "city", "level", "sector", "employment_type"):
            s.add_argument(f"--{field.replace('_', '-')}")
        s.add_argument("--salary-min", type=float)
        s.add_argument("--remote", action="store_true", default=None)
        if name == "match-resume":
            s.add_argument("--resume", required=True, help="text or Markdown file")
        if name == "sponsor-jobs":
            s.add_argument("--sponsors", required=True, help="Parquet folder of sponsor records")
    r = sub.add_parser("resolve")
    r.add_argument("url")
    sub.add_parser("sources")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    a = parser().parse_args(argv)
    if a.command == "sources":
        out.write("\n".join(sorted(feeds.RULES)) + "\n")
        return 0
    spark = spark or SparkSession.builder.appName("jobquarry").getOrCreate()
    if a.command == "resolve":
        found = spark.range(1).select(resolver.resolve(F.lit(a.url)).alias("b")).first().b
        out.write(f"{found.source} {found.token}\n" if found else "unknown\n")
        return 0 if found else 1
    names = ("keywords", "location", "country", "city", "level", "sector", "employment_type", "salary_min", "remote", "limit")
    q = SearchQuery(**{n: getattr(a, n) for n in names if getattr(a, n) is not None})
    jobs = spark.read.parquet(a.table)
    if a.command == "search":
        rows = tools.search_jobs(jobs, q, a.today)
    elif a.command == "match-resume":
        rows = tools.match_resume(jobs, read_resumes(spark, a.resume).first().text, q, a.today)
    elif a.command == "sponsor-jobs":
        rows = tools.sponsor_jobs(jobs, spark.read.parquet(a.sponsors), q, a.today)
    else:
        rows = tools.list_companies(jobs, a.keywords, a.limit)
    for row in wire(rows).collect():
        out.write(row.json + "\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
