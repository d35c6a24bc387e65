"""Reading captured documents: feeds in XML, pages, tables of files, résumés, JSON lines; and writing exports beside the store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobquarry.functions import text

XML_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&amp;": "&"}


def xml_text(value: Column) -> Column:
    """The text of an element: CDATA as it is, entities read, white space around it gone."""
    inner = F.regexp_replace(value, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for entity, char in XML_ENTITIES.items():
        inner = F.replace(inner, F.lit(entity), F.lit(char))
    return F.nullif(F.trim(F.regexp_replace(inner, r"^\s+|\s+$", "")), F.lit(""))


def element(xml: Column, name: str) -> Column:
    """The raw content of the first element of a name (with any prefix), null without one."""
    return F.nullif(F.regexp_extract(xml, rf"(?s)<(?:\w+:)?{name}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{name}\s*>", 1), F.lit(""))


def xml_records(feeds: DataFrame, item: str, fields: dict[str, str], xml: str = "xml") -> DataFrame:
    """A row for each ``item`` element of feeds (``<item>`` of RSS, ``<entry>`` of Atom, ``<position>``), with ``payload``: JSON of
    the named fields. Elements that don't close are left out; feeds without items give no rows."""
    items = F.regexp_extract_all(F.col(xml), F.lit(rf"(?s)<{item}(?:\s[^>]*)?>(.*?)</{item}\s*>"), F.lit(1))
    rest = [c for c in feeds.columns if c != xml]
    each = feeds.select(*rest, F.explode(items).alias("__i"))
    made = F.struct(*[xml_text(element(F.col("__i"), name)).alias(field) for field, name in fields.items()])
    return each.select(*rest, F.to_json(made).alias("payload"))


def html_rows(pages: DataFrame, row: str, fields: dict[str, str], html: str = "html") -> DataFrame:
    """A row for each match of the pattern ``row`` in pages, with ``payload``: JSON of fields, each the first group of a pattern
    within the match, without tags."""
    rows = F.regexp_extract_all(F.col(html), F.lit(row), F.lit(0))
    rest = [c for c in pages.columns if c != html]
    each = pages.select(*rest, F.explode(rows).alias("__r"))
    clean = lambda p: F.nullif(text.unescape_basic(text.strip_tags(F.regexp_extract("__r", p, 1))), F.lit(""))
    return each.select(*rest, F.to_json(F.struct(*[clean(p).alias(f) for f, p in fields.items()])).alias("payload"))


def embedded_json(pages: DataFrame, script_id: str, html: str = "html") -> DataFrame:
    """The JSON that a page carries in the script of an id, as ``payload``; pages without valid JSON give no row."""
    body = F.regexp_extract(F.col(html), rf"(?is)<script[^>]*id=[\"']{script_id}[\"'][^>]*>(.*?)</script>", 1)
    found = pages.withColumn("payload", F.trim(body)).where(F.try_parse_json(F.trim(body)).isNotNull() & (F.trim(body) != ""))
    return found.select(*[c for c in pages.columns if c != html], "payload")


def key_range(table: DataFrame, key: str, low: str, high: str, host: str | None = None, host_col: str = "host") -> DataFrame:
    """Rows of a table sorted by ``key`` within [low, high), of one exact host; both reach the scan, so row groups are skipped."""
    found = table.where((F.col(key) >= low) & (F.col(key) < high))
    return found if host is None else found.where(F.col(host_col) == host)


def surt(domain: str) -> tuple[str, str]:
    """Bounds of a domain's pages and those of its subdomains in reversed-host order: ``jobs.acme.com`` sorts as ``com,acme,jobs``."""
    name = ",".join(reversed(domain.lower().strip(".").split(".")))
    return name, name + "-"


def filings(rows: DataFrame, employer: str = "employer", status: str = "status", decided: str = "decided") -> DataFrame:
    """Filings tables in their several forms as ``employer``, ``status``, ``decided`` (ISO date); rows without an employer go.
    Dates may be ISO, month first, or numbers of days since 1899-12-30."""
    d = F.col(decided).cast("string")
    serial = F.when(F.regexp_like(d, F.lit(r"^\d{4,6}(\.0+)?$")), F.date_add(F.lit("1899-12-30").cast("date"), d.cast("double").cast("int")))
    date = F.coalesce(F.try_to_timestamp(F.substring(d, 1, 10), F.lit("yyyy-MM-dd")).cast("date"), F.try_to_timestamp(d, F.lit("M/d/yyyy")).cast("date"), serial)
    out = rows.select(F.trim(employer).alias("employer"), F.trim(status).alias("status"), date.cast("string").alias("decided"))
    return out.where("employer IS NOT NULL AND employer <> ''")


def read_resumes(spark: SparkSession, path: str) -> DataFrame:
    """Résumés in text and Markdown files as ``path`` and ``text``; other kinds need a reader of their own."""
    files = spark.read.option("pathGlobFilter", "*.{txt,md}").option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("text")).where("text <> ''")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a schema; lines that are none are left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema + ", __bad string", {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"}).alias("r"))
    return parsed.where("r.__bad IS NULL").select("r.*").drop("__bad")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def append_history(spark: SparkSession, path: str, summary: dict) -> None:
    """One more build in the history: a small file of its own, so that builds never write over each other."""
    spark.createDataFrame([summary]).write.mode("append").json(path)


def last_published(history: DataFrame, value: str, order: str = "seq") -> DataFrame:
    """The value of the last published build that has one, as one row."""
    good = history.where(F.col("published") & F.col(value).isNotNull())
    return good.agg(F.max_by(value, order).alias(value))


def sidecar(spark: SparkSession, path: str, departed: DataFrame, deltas: DataFrame, stats: DataFrame) -> None:
    """What a sweep found, as three tables under one folder."""
    for name, rows in (("expired", departed), ("deltas", deltas), ("stats", stats)):
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def export(rows: DataFrame, limit: int) -> pd.DataFrame:
    """At most ``limit`` rows as a pandas table, for callers that want them in memory."""
    return rows.limit(limit).toPandas()


def records(rows: DataFrame, limit: int) -> list[dict]:
    """At most ``limit`` rows as dictionaries."""
    return [r.asDict(recursive=True) for r in rows.limit(limit).collect()]


def work(items: DataFrame, function, column: str, attempts: int = 1) -> DataFrame:
    """Items with the ``result`` of a function of one column, or the ``error`` it ended in: one bad item never ends the others.
    Tasks are the workers; results come in no order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            results, errors = [], []
            for value in rows[column]:
                result, error = None, None
                for _ in range(attempts):
                    try:
                        result, error = function(value), None
                        break
                    except Exception as e:  # noqa: BLE001  (any failure of an item is a row)
                        error = f"{type(e).__name__}: {e}"
                results.append(None if result is None else str(result))
                errors.append(error)
            yield rows.assign(result=results, error=errors)

    schema = T.StructType([*items.schema.fields, T.StructField("result", T.StringType()), T.StructField("error", T.StringType())])
    return items.mapInPandas(run, schema)
