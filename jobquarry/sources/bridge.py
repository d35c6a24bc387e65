"""The star tables as postings, so that the engine's operators have rows at any scale.

``jobs`` reads orders with their customers and places as stored rows; ``JOBS_SQL`` is the same view in SQL for the
oracle. Nulls of all kinds occur."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day that ages count from.
TODAY = "2001-08-15"

TITLES = (
    "Senior Data Engineer", "Staff Accountant", "Engineering Manager", "Product Manager", "Software Engineer II", "Data Analyst I/II", "Sales Development Representative", "Head of Research",
    "Research Associate Scientist", "Principal Engineer", "Warehouse Associate", "Junior Data Engineer",
)
DEPARTMENTS = ("Engineering", "Sales and Research", "Data Platform", "Finance")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(key: str, values: tuple[str, ...], modulo: int) -> str:
    return f"CASE {key} % {modulo} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


def _columns(day) -> dict[str, str]:
    """SQL of the columns, the same for both engines but for the text of a date (``day``)."""
    k = "o_orderkey"
    return {
        "ord": k,
        "id": f"substr(sha1('orders:' || CAST({k} AS STRING)), 1, 16)",
        "content_hash": f"substr(sha1(o_orderpriority || '|' || CAST({k} % 50 AS STRING)), 1, 16)",
        "enrich_hash": f"substr(sha1(o_orderstatus || '|' || CAST({k} % 90 AS STRING)), 1, 16)",
        "company_key": "replace(lower(c_name), '#', ' ')",
        "source": _case(k, ("greenhouse", "lever", "remoteok", "elsewhere"), 4),
        "company": "c_name",
        "company_domain": f"CASE WHEN {k} % 6 <> 0 THEN replace(lower(c_name), '#', '') || '.example.com' END",
        "title": _case(k, TITLES, len(TITLES)),
        "department": _case(k, DEPARTMENTS, 5),
        "sector": f"CASE WHEN {k} % 11 <> 0 THEN c_mktsegment END",
        "location": "n_name || ', ' || r_name",
        "city": "n_name",
        "country": "r_name",
        "remote": _case(k, ("remote", "hybrid", "onsite", "unknown", "unknown", "unknown", "onsite"), 7),
        "level": "CASE o_orderpriority WHEN '1-URGENT' THEN 'senior' WHEN '2-HIGH' THEN 'mid' WHEN '3-MEDIUM' THEN 'junior' WHEN '5-LOW' THEN 'entry' ELSE 'unknown' END",
        "employment_type": "CASE o_orderstatus WHEN 'O' THEN 'full_time' WHEN 'F' THEN 'contract' ELSE 'unknown' END",
        "salary_min": f"CASE WHEN {k} % 3 <> 0 THEN o_totalprice END",
        "salary_max": f"CASE WHEN {k} % 4 <> 0 THEN o_totalprice * 1.25E0 END",
        "salary_currency": _case(k, ("USD", "EUR"), 3),
        "years_min": f"CASE WHEN {k} % 4 <> 0 THEN CAST({k} % 10 AS INT) END",
        "years_max": f"CASE WHEN {k} % 6 <> 0 THEN CAST({k} % 10 + {k} % 3 AS INT) END",
        "degree_min": _case(k, ("highschool", "bachelor", "master", "phd_md"), 6),
        "visa_sponsor": f"CASE WHEN {k} % 9 = 0 THEN TRUE END",
        "sponsorship_offered": f"CASE {k} % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END",
        "apply_url": f"'https://' || CASE {k} % 3 WHEN 0 THEN 'boards' WHEN 1 THEN 'jobs.careers' ELSE 'www' END || '.acme' || CAST({k} % 40 AS STRING) || CASE {k} % 2 WHEN 0 THEN '.co.uk' ELSE '.com' END || '/j/' || CAST({k} AS STRING)",
        "board_token": f"CASE WHEN {k} % 3 <> 0 THEN 'b' || CAST({k} % 200 AS STRING) END",
        "posted_at": f"CASE WHEN {k} % 13 <> 0 THEN {day('o_orderdate', 0)} END",
        "updated_at": f"CASE WHEN {k} % 8 = 0 THEN {day('o_orderdate', 30)} END",
        "status": f"CASE WHEN {k} % 10 = 9 THEN 'expired' ELSE 'active' END",
        "first_seen": day("o_orderdate", 0),
        "last_seen": day("o_orderdate", 60),
        "expired_at": f"CASE WHEN {k} % 10 = 9 THEN {day('o_orderdate', 90)} END",
        "expiry_reason": f"CASE WHEN {k} % 10 = 9 THEN 'departed_board' END",
        "build_id": "'b1'",
        "snippet": f"CASE WHEN {k} % 7 <> 3 THEN o_orderpriority || ' research in ' || c_mktsegment END",
    }


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored rows."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.selectExpr(*[f"{sql} AS {name}" for name, sql in _columns(lambda c, d: f"date_format({c} + INTERVAL {d} DAYS, 'yyyy-MM-dd')").items()])


JOBS_SQL = (
    "SELECT "
    + ", ".join(f"{sql} AS {name}" for name, sql in _columns(lambda c, d: f"strftime({c} + INTERVAL {d} DAY, '%Y-%m-%d')").items())
    + " FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
)


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two builds: the first without every seventh row; the second without others, with new pay for some rows and a new build id
    for all."""
    j = jobs(spark, sf_dir)
    previous = j.where("ord % 7 <> 1")
    current = j.where("ord % 7 <> 2").withColumns(
        {"salary_min": F.expr("CASE WHEN ord % 5 = 0 THEN coalesce(salary_min, 0) + 1000 ELSE salary_min END"), "build_id": F.lit("b2"), "first_seen": F.lit(TODAY)}
    )
    return previous, current


SNAPSHOTS_SQL = f"""j AS ({JOBS_SQL}), p AS (SELECT * FROM j WHERE ord % 7 <> 1),
c AS (SELECT * REPLACE (CASE WHEN ord % 5 = 0 THEN coalesce(salary_min, 0) + 1000 ELSE salary_min END AS salary_min, 'b2' AS build_id, '{TODAY}' AS first_seen) FROM j WHERE ord % 7 <> 2)"""
