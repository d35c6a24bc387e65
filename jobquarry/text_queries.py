"""Queries over prose and payloads: texts and records made from the rows of the standard tables, so that whole tables are read and
the answers, which SQL works out from the same keys, differ by row."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobquarry.functions import degrees, experience, extract, pay, places
from jobquarry.queries import query
from jobquarry.sources import board_feeds, feeds, fixtures, more_feeds  # noqa: F401  (rules are added by import)
from jobquarry.sources.bridge import table

#: The number in a text, and which of some texts a row has.
N = "(o_orderkey % 30 + 1)"


def _sql(value) -> str:
    if value is None:
        return "NULL"
    return ("TRUE" if value else "FALSE") if isinstance(value, bool) else "'" + str(value).replace("'", "''") + "'"


def _pick(values, kind: str, key: str = "o_orderkey // 30") -> str:
    return f"CASE ({key}) % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + f" END::{kind}"


def _texts(spark: SparkSession, sf_dir: str, templates) -> DataFrame:
    """Orders with ``text`` and ``language`` of one of the templates each."""
    n = (F.col("o_orderkey") % 30 + 1).cast("string")
    which = F.floor(F.col("o_orderkey") / 30) % len(templates)
    body, language = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (lang, text, *_) in enumerate(templates):
        body = F.when(which == k, F.replace(F.lit(text), F.lit("{n}"), n)).otherwise(body)
        language = F.when(which == k, F.lit(lang)).otherwise(language)
    return table(spark, sf_dir, "orders").select("o_orderkey", body.alias("text"), language.alias("language"))


def _of_n(sql) -> str:
    return "NULL" if sql is None else str(sql).replace("{n}", N)


@query(f"SELECT o_orderkey, {_pick([_of_n(t[2]) for t in fixtures.YEARS_OF_N], 'INT')} AS low, {_pick([_of_n(t[3]) for t in fixtures.YEARS_OF_N], 'INT')} AS high FROM orders")
def text_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir, fixtures.YEARS_OF_N).withColumn("y", experience.years(F.col("text"), F.lit(None).cast("string"), F.col("language")))
    return rows.select("o_orderkey", "y.low", "y.high")


@query(f"SELECT o_orderkey, {_pick([_sql(t[2]) for t in fixtures.DEGREES_OF_N], 'VARCHAR')} AS level, {_pick([_sql(t[3]) for t in fixtures.DEGREES_OF_N], 'BOOLEAN')} AS required FROM orders")
def text_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, fixtures.DEGREES_OF_N).withColumn("d", degrees.degree(F.col("text"), F.col("language"))).select("o_orderkey", "d.level", "d.required")


def _pay_sql(k: int, kind: str) -> str:
    cells = [f"CASE WHEN {_of_n(t[6])} THEN {_of_n(t[k]) if k < 4 else _sql(t[k])} END" for t in fixtures.PAY_OF_N]
    return _pick(cells, kind)


@query(f"SELECT o_orderkey, {_pay_sql(2, 'DOUBLE')} AS min_amount, {_pay_sql(3, 'DOUBLE')} AS max_amount, {_pay_sql(4, 'VARCHAR')} AS currency, {_pay_sql(5, 'VARCHAR')} AS interval FROM orders")
def text_salaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir, fixtures.PAY_OF_N).withColumn("s", pay.salary(F.col("text"), F.lit(None).cast("string"), F.col("language")))
    return rows.select("o_orderkey", "s.min_amount", "s.max_amount", "s.currency", "s.interval")


PLACES = {t: v for t, v in fixtures.LOCATIONS.items() if t != "Any City"}


@query("SELECT c_custkey, " + ", ".join(f"{_pick([_sql(v[k]) for v in PLACES.values()], 'VARCHAR', 'c_custkey')} AS {name}" for k, name in enumerate(("city", "region", "country"))) + " FROM customer")
def text_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw: Column = F.lit(None).cast("string")
    for k, text in enumerate(PLACES):
        raw = F.when(F.col("c_custkey") % len(PLACES) == k, F.lit(text)).otherwise(raw)
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "customer").withColumn("p", places.reader(fixtures.CITIES)(none, none, none, raw, F.lit(False)))
    return rows.select("c_custkey", "p.city", "p.region", "p.country")


@query(f"SELECT c_custkey, {_pick([_sql(s) for _, s in fixtures.COMPANIES], 'VARCHAR', 'c_custkey')} AS sector FROM customer")
def text_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    name: Column = F.lit(None).cast("string")
    for k, (company, _) in enumerate(fixtures.COMPANIES):
        name = F.when(F.col("c_custkey") % len(fixtures.COMPANIES) == k, F.lit(company)).otherwise(name)
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(extract.sector_from_brand(name), extract.sector_from_name(name)).alias("sector"))


def _register_feeds() -> None:
    """Suppliers as payloads of each source: whole ones with the supplier's key in the title, others without a title, and broken ones,
    which give no row."""
    for source, (payload, want) in fixtures.PAYLOADS.items():
        body = json.dumps(payload)

        def run(spark: SparkSession, sf_dir: str, source=source, body=body, want=want) -> DataFrame:
            key = F.col("s_suppkey")
            titled = F.replace(F.lit(body), F.lit('Dev"'), F.concat(F.lit("Dev "), key.cast("string"), F.lit('"')))
            untitled = F.replace(F.lit(body), F.lit('Dev"'), F.lit('"'))
            payload = F.when(key % 7 == 5, F.lit(body[: len(body) // 2])).when(key % 7 == 3, untitled).otherwise(titled)
            rows = table(spark, sf_dir, "supplier").select(key.cast("long").alias("ord"), payload.alias("payload"), F.lit("Board").alias("company"))
            found = feeds.normalize(rows, source)
            shown = [F.col(c).cast("string").alias(c) for c in want if c != "title"]
            return found.select("ord", F.coalesce(F.trim("title"), F.lit("")).alias("title"), *shown)

        run.__name__ = f"feed_{source}"
        # Titles stand in front of these two where they say "Remote".
        title = "CASE WHEN s_suppkey % 7 = 3 THEN " + _sql("Remote" if source == "teamtailor" else "") + " ELSE " + _sql("Remote Dev " if source == "teamtailor" else "Dev ") + " || s_suppkey END"
        columns = [f"{_sql('true' if v is True else v)}::VARCHAR AS {c}" for c, v in want.items() if c != "title"]
        query("SELECT s_suppkey::BIGINT AS ord, " + ", ".join([f"{title} AS title", *columns]) + " FROM supplier WHERE s_suppkey % 7 <> 5")(run)


_register_feeds()
