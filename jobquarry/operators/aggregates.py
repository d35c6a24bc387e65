"""Rollups, coverage, gates, regressions and evaluation measures."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobquarry.functions import keys
from jobquarry.schemas import SCHEMA_VERSION

# Tolerances of builds and fields.
ROW_FLOOR = 0.75
ACTIVE_DROP, SOURCE_DROP, POINT_DROP = 5.0, 30.0, 3.0
ALARM_RATE, ALARM_LEAST = 0.5, 5
TOP_SOURCES = 15


def first_known(value: str, order: str) -> Column:
    """The value of the first row in ``order`` that has one (an empty text is none)."""
    v = F.col(value)
    return F.min_by(v, F.when(v.isNotNull() & (v.cast("string") != ""), F.col(order)))


def company_rollup(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Companies with their postings counted; name and source of the first posting, domain and sector of the first that
    has one. Rows whose company has no key are left out."""
    own = rows.withColumn("company_key", keys.company_key(F.col("company"))).where("company_key <> ''")
    return own.groupBy("company_key").agg(
        F.min_by("company", order).alias("display_name"), first_known("company_domain", order).alias("domain"), F.min_by("source", order).alias("primary_ats"),
        first_known("sector", order).alias("sector"), F.count(F.lit(1)).alias("open_roles"),
    )


def count_by(rows: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Active rows by value, most frequent first; null and empty values don't count."""
    c = F.col(column)
    out = rows.where((F.col("status") == "active") & c.isNotNull() & (c.cast("string") != "")).groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("jobs")).orderBy(F.desc("jobs"), "value")
    return out if limit is None else out.limit(limit)


def coverage(rows: DataFrame) -> DataFrame:
    """One row of counts, from one pass."""
    active = F.col("status") == "active"
    count = lambda c: F.count_if(F.coalesce(active & c, F.lit(False)))
    return rows.agg(
        F.count(F.lit(1)).alias("total_jobs"), F.count_if(active).alias("active_jobs"), F.count_if(~active).alias("expired_jobs"),
        count(F.coalesce("salary_min", "salary_max").isNotNull()).alias("with_salary"), count(F.trim("snippet") != "").alias("with_jd"),
        count(F.col("visa_sponsor")).alias("visa_sponsors"), count(F.col("sponsorship_offered")).alias("sponsorship_offered"), count(F.col("sector") != "").alias("with_sector"),
    )


def duplicate_ids(rows: DataFrame) -> DataFrame:
    return rows.agg((F.count(F.lit(1)) - F.count_distinct("id")).alias("duplicates"))


def orphans(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """Rows whose company is not in the rollup."""
    return rows.where(F.col("company_key").isNotNull()).join(companies.select("company_key"), "company_key", "left_anti")


@dataclass(frozen=True)
class Gate:
    name: str
    passed: bool
    detail: str


def evaluate_gates(rows: DataFrame, companies: DataFrame, schema_version: int, previous: int | None = None, last_known: int | None = None, cold_start: bool = False) -> list[Gate]:
    """Whether a build may be published. The row floor counts from the previous build or, if that is missing, from the last
    published one; a cold start only needs rows."""
    n, dup = rows.agg(F.count(F.lit(1)), F.count(F.lit(1)) - F.count_distinct("id")).first()
    lost = orphans(rows, companies).count()
    basis = previous or last_known
    floor = int(basis * ROW_FLOOR) if basis and not cold_start else 1
    return [
        Gate("schema_version", schema_version == SCHEMA_VERSION, str(schema_version)),
        Gate("row_floor", n >= floor, f"{n} rows, floor {floor}"),
        Gate("no_duplicate_ids", dup == 0, f"{dup} duplicates"),
        Gate("company_fk_intact", lost == 0, f"{lost} orphan rows"),
    ]


def metrics(rows: DataFrame) -> DataFrame:
    """The block that builds are compared by: active rows and the shares of them that have a body, pay, a sector."""
    pct = lambda c: F.when(F.col("active_jobs") > 0, F.round(F.col(c) / F.col("active_jobs") * 100, 2)).otherwise(0.0)
    return coverage(rows).select("active_jobs", "with_jd", pct("with_jd").alias("jd_pct"), "with_salary", pct("with_salary").alias("salary_pct"), pct("with_sector").alias("sector_pct"))


def regressions(current: DataFrame, previous: DataFrame) -> DataFrame:
    """What fell too far since the previous build: ``metric``, ``prev``, ``curr``, ``delta``, ``threshold``. Both sides have
    ``metric`` and ``value``; metrics named ``source:*`` and ``active_jobs`` count in percent, others in points. A
    source that is gone counts as 0."""
    c = current.select("metric", F.col("value").cast("double").alias("curr"))
    p = previous.select("metric", F.col("value").cast("double").alias("prev"))
    source, active = F.startswith("metric", F.lit("source:")), F.col("metric") == "active_jobs"
    both = p.join(c, "metric", "left").withColumn("curr", F.when(source, F.coalesce("curr", F.lit(0.0))).otherwise(F.col("curr")))
    change = F.when(source | active, F.try_divide(F.col("curr") - F.col("prev"), F.when(F.col("prev") > 0, F.col("prev"))) * 100.0).otherwise(F.col("curr") - F.col("prev"))
    limit = F.when(active, -ACTIVE_DROP).when(source, -SOURCE_DROP).otherwise(-POINT_DROP)
    return both.select("metric", "prev", "curr", F.round(change, 2).alias("delta"), limit.alias("threshold"), change.alias("__d")).where("__d < threshold").drop("__d")


def expiry_alarms(stats: DataFrame) -> DataFrame:
    """Sources of which more than half of what was checked expired, and at least five; parts are added up first."""
    s = stats.groupBy("source").agg(F.sum("candidates").alias("candidates"), F.sum("expired").alias("expired"))
    rate = F.coalesce(F.try_divide("expired", "candidates"), F.lit(0.0))
    return s.withColumn("rate", rate).where((F.col("rate") > ALARM_RATE) & (F.col("expired") >= ALARM_LEAST))


def field_coverage(rows: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """For each group the share of rows in which each field has a value."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(f).isNotNull().cast("int")).alias(f) for f in fields])


def classification(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of each class."""
    labels = rows.select(F.col(gold).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), (F.col(gold) == F.col(predicted)).cast("int").alias("t")).unionAll(
        rows.select(F.col(predicted).alias("label"), F.lit(0), F.lit(1), F.lit(0))
    )
    s = labels.groupBy("label").agg(F.sum("t").alias("tp"), (F.sum("p") - F.sum("t")).alias("fp"), (F.sum("g") - F.sum("t")).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    s = s.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return s.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_f1(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Accuracy and the mean F1 over all classes that occur on either side."""
    acc = rows.agg(F.avg((F.col(gold) == F.col(predicted)).cast("int")).alias("accuracy"))
    return acc.crossJoin(classification(rows, gold, predicted).agg(F.avg("f1").alias("macro_f1")))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of ``k`` successes in ``n`` trials; (0, 0) without trials."""
    p = k / n
    center, width = p + z * z / (2 * n), z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    denominator = 1 + z * z / n
    safe = lambda c: F.when(n > 0, c).otherwise(0.0)
    return safe(F.greatest(F.lit(0.0), (center - width) / denominator)), safe(F.least(F.lit(1.0), (center + width) / denominator))


def field_scores(rows: DataFrame, gold: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Accuracy where gold states a value, precision where the prediction does, coverage, and the interval of accuracy.
    Null and "unknown" state nothing."""
    stated = lambda c: F.coalesce(F.col(c).cast("string") != "unknown", F.lit(False))
    right = stated(gold) & stated(predicted) & F.coalesce(F.col(gold) == F.col(predicted), F.lit(False))
    g = rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.count_if(stated(gold)).alias("covered"), F.count_if(stated(predicted)).alias("asserted"), F.count_if(right).alias("correct"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    lo, hi = wilson(F.col("correct"), F.col("covered"))
    return g.select(*(by or []), "n", ratio("correct", "covered").alias("accuracy"), ratio("correct", "asserted").alias("precision"), ratio("covered", "n").alias("coverage"), lo.alias("lo"), hi.alias("hi"))


def majority(votes: list[Column]) -> tuple[Column, Column]:
    """(the value that two of three votes share, else null; whether all three differ). Null is a vote of its own."""
    a, b, c = votes
    value = F.when(a.eqNullSafe(b) | a.eqNullSafe(c), a).when(b.eqNullSafe(c), b)
    return value, ~(a.eqNullSafe(b) | a.eqNullSafe(c) | b.eqNullSafe(c))


def sponsor_filings(filings: DataFrame) -> DataFrame:
    """Certified filings by employer: how many, and the latest date. ``filings``: status, employer, decision_date (ISO or
    month/day/year)."""
    key = keys.company_key(F.col("employer"))
    date = F.coalesce(F.try_to_date("decision_date", "yyyy-MM-dd"), F.try_to_date("decision_date", "M/d/yyyy"), F.try_to_date("decision_date", "dd-MMM-yyyy")).cast("string")
    good = filings.where(F.startswith(F.lower(F.trim("status")), F.lit("certified")) & (F.trim("employer") != "")).select(key.alias("name"), date.alias("d")).where("name <> ''")
    return good.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("last"))


def stratified_total(sample: DataFrame, population: DataFrame, stratum: str, value: str) -> DataFrame:
    """An estimate of a total: the mean of each sampled stratum times its population (``n``), added up."""
    m = sample.groupBy(stratum).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("sampled"))
    return m.join(population, stratum).agg(F.sum(F.col("mean") * F.col("n")).alias("estimate"), F.sum("sampled").alias("sampled"))


def risk_coverage(rows: DataFrame, confidence: str, correct: str, thresholds: list[float]) -> DataFrame:
    """For each threshold the share of rows at or above it and the accuracy there; one aggregate, no global sort."""
    at = rows.select(F.col(confidence).alias("c"), F.col(correct).cast("int").alias("k"), F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    total = F.count(F.lit(1))
    kept = F.col("c") >= F.col("threshold")
    return at.groupBy("threshold").agg((F.count_if(kept) / total).alias("coverage"), F.avg(F.when(kept, F.col("k"))).alias("accuracy"))


def health(results: DataFrame, order: str | None = None) -> DataFrame:
    """Outcomes by source: boards, failures, rows, and the first three different errors, by ``order`` (else by text)."""
    first = results.where("error IS NOT NULL").groupBy("source", "error").agg((F.min(order) if order else F.lit(0)).alias("__at"))
    errors = first.groupBy(F.col("source").alias("__s")).agg(F.array_sort(F.collect_list(F.struct("__at", "error"))).alias("__e"))
    counts = results.groupBy("source").agg(F.count(F.lit(1)).alias("boards"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.sum("rows").alias("rows"))
    said = F.array_join(F.transform(F.slice("__e", 1, 3), lambda x: x["error"]), "; ")
    return counts.join(errors, F.col("source") == F.col("__s"), "left").select("source", "boards", "failed", "rows", F.coalesce(said, F.lit("")).alias("errors"))


def numeric_errors(rows: DataFrame, gold: str, predicted: str, tolerance: float) -> DataFrame:
    """Of rows with both numbers: how many, the mean absolute error, and the share within a relative tolerance of the gold one."""
    both = rows.where(F.col(gold).isNotNull() & F.col(predicted).isNotNull())
    off = F.abs(F.col(predicted) - F.col(gold))
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg(off).alias("mae"), F.avg((off <= tolerance * F.abs(F.col(gold))).cast("int")).alias("within"))


def source_accuracy(candidates: DataFrame, curated: DataFrame) -> DataFrame:
    """Of each sector source (``origin``, ``key``, ``sector``) how many keys are curated too, and how often both agree."""
    both = candidates.join(curated.select("key", F.col("sector").alias("__gold")), "key")
    return both.groupBy("origin").agg(F.count(F.lit(1)).alias("overlap"), F.avg((F.col("sector") == F.col("__gold")).cast("int")).alias("accuracy"))


def shard_stats(parts: list[DataFrame], by: str = "source") -> DataFrame:
    """Statistics of several shards as one: counts of one source are added up."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(by).agg(*[F.sum(c).alias(c) for c in parts[0].columns if c != by])


def status_markdown(coverage_row: dict, top: list[tuple[str, int]]) -> str:
    """The coverage of a build as a page for people."""
    lines = ["# Index status", "", *(f"- {name.replace('_', ' ')}: {value:,}" for name, value in coverage_row.items()), "", "| Company | Open roles |", "| --- | ---: |"]
    return "\n".join([*lines, *(f"| {name} | {n:,} |" for name, n in top)]) + "\n"


def count_sane(current: Column, baseline: Column, ratio: float = 0.5) -> Column:
    """Whether a count has not fallen below a share of its baseline; without a baseline any count will do."""
    return F.coalesce(current >= baseline * ratio, F.lit(True))


def failure_streak(outcomes: DataFrame, key: str, order: str, ok: str) -> DataFrame:
    """For each key the run of equal outcomes that its history ends with: ``ok`` and ``streak``."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    last = F.first(ok).over(w)
    other = F.sum((F.col(ok) != last).cast("int")).over(w)
    return outcomes.withColumn("__o", other).withColumn("__l", last).where("__o = 0").groupBy(key).agg(F.first("__l").alias("ok"), F.count(F.lit(1)).alias("streak"))


def wilson_value(k: int, n: int, z: float = 1.96) -> tuple[float, float]:
    """The same interval for two numbers."""
    if not n:
        return 0.0, 0.0
    p, d = k / n, 1 + z * z / n
    m = z * math.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return max(0.0, (p + z * z / (2 * n) - m) / d), min(1.0, (p + z * z / (2 * n) + m) / d)
