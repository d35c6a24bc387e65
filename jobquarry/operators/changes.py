"""Snapshots and their changes: stored rows, carry-forward, deltas, purges, expiries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobquarry.functions import keys, text
from jobquarry.functions.extract import level_from_years
from jobquarry.plans.search import days_before, latest_activity
from jobquarry.schemas import JOBS, SLIM_NULL, VOLATILE

PURGE_YEARS = 5


def to_rows(postings: DataFrame, build_id: str, today: str) -> DataFrame:
    """Postings as stored rows: only the first location, a snippet of the body, dates of this build."""
    loc, pay = F.get("locations", 0), F.col("salary")
    where = F.when(loc.isNotNull(), keys.location_text(loc))
    content = keys.content_hash(F.col("company"), F.col("title"), F.col("level"), where, pay)
    body = text.normalized_body(F.col("description_text"), F.col("description_html"))
    made = {
        "id": keys.posting_id(F.col("source"), F.col("source_job_id")),
        "content_hash": content,
        "enrich_hash": keys.enrich_hash(content, body),
        "company_key": keys.company_key(F.col("company")),
        "role_family": keys.role_family(F.col("title")),
        "location": where,
        "city": loc["city"],
        "country": loc["country"],
        "salary_min": pay["min_amount"],
        "salary_max": pay["max_amount"],
        "salary_currency": pay["currency"],
        "salary_interval": pay["interval"],
        "years_min": F.col("years_experience_min"),
        "years_max": F.col("years_experience_max"),
        "visa_sponsor": F.when(F.col("visa_sponsor"), True),
        "listing_url": F.col("apply_url"),
        "status": F.lit("active"),
        "first_seen": F.lit(today),
        "last_seen": F.lit(today),
        "fetched_at": F.lit(today),
        "build_id": F.lit(build_id),
        "snippet": text.snippet(F.col("description_text"), F.col("description_html")),
    }
    given = set(postings.columns)
    cols = [made[f.name] if f.name in made else F.col(f.name) if f.name in given else F.lit(None) for f in JOBS.fields]
    return postings.select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(cols, JOBS.fields, strict=True)])


def from_rows(rows: DataFrame) -> DataFrame:
    """Stored rows as postings again; the source's own id and the region are not stored, so the row's id stands in."""
    pay = F.when(F.coalesce("salary_min", "salary_max").isNotNull(), F.struct(F.col("salary_min").alias("min_amount"), F.col("salary_max").alias("max_amount"), F.col("salary_currency").alias("currency"), F.col("salary_interval").alias("interval")))
    place = F.struct("city", F.lit(None).cast("string").alias("region"), "country", F.col("location").alias("raw"), (F.col("remote") == "remote").alias("is_remote"))
    some = F.coalesce(F.nullif("location", F.lit("")), F.nullif("city", F.lit("")), F.nullif("country", F.lit(""))).isNotNull()
    return rows.select(
        "id", "source", F.col("id").alias("source_job_id"), "company", "company_domain", "title", F.col("snippet").alias("description_text"), "department", "sector",
        F.when(some, F.array(place)).otherwise(F.array().cast("array<struct<city:string,region:string,country:string,raw:string,is_remote:boolean>>")).alias("locations"),
        "remote", "level", "employment_type", pay.alias("salary"), F.col("years_min").alias("years_experience_min"), F.col("years_max").alias("years_experience_max"),
        "degree_min", "degree_required", "apply_url", "posted_at", "updated_at", F.when(F.col("visa_sponsor"), True).alias("visa_sponsor"), "visa_last_filed", "sponsorship_offered",
    )


def append_new(stored: DataFrame, batch: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Rows of a batch whose ids are new, one for each id (the first in ``order``)."""
    fresh = batch.join(stored.select("id"), "id", "left_anti")
    nth = F.row_number().over(Window.partitionBy("id").orderBy(*(order or [F.xxhash64(*batch.columns)])))
    return fresh.withColumn("__n", nth).where("__n = 1").drop("__n").select(*batch.columns)


def carry_forward(fresh: DataFrame, previous: DataFrame, crawled: DataFrame, key: str = "company_key") -> DataFrame:
    """Fresh rows and, of companies that were not crawled, the previous ones (rows without a company too). Fresh rows win
    on ids. A fresh row whose company and content are as before keeps the earliest date it was first seen.
    ``crawled`` has the companies' keys."""
    before = previous.groupBy(key, "content_hash").agg(F.min("first_seen").alias("__first"))
    restored = fresh.join(before, [key, "content_hash"], "left").withColumn("first_seen", F.coalesce("__first", "first_seen")).drop("__first")
    kept = previous.join(crawled.select(key).distinct(), key, "left_anti").join(fresh.select("id"), "id", "left_anti")
    return restored.select(*fresh.columns).unionByName(kept.select(*[c for c in fresh.columns if c in previous.columns]), allowMissingColumns=True)


def changed_companies(previous: DataFrame, fresh: DataFrame, key: str = "company_key") -> DataFrame:
    """Companies of ``fresh`` whose set of contents is not what it was: what came, and what went."""
    a, b = fresh.select(key, "content_hash"), previous.select(key, "content_hash")
    gone = b.join(a.select(key).distinct(), key, "left_semi").subtract(a)
    return a.subtract(b).select(key).union(gone.select(key)).where(F.coalesce(key, F.lit("")) != "").distinct()


def content_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c not in VOLATILE]


def delta(previous: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ``current`` that are new or changed, ids that are gone). Columns that change with every build don't count, nor
    do columns that only one side has; nulls are values."""
    same = [c for c in content_columns(current.columns) if c in previous.columns]
    p = previous.select(*[F.col(c).alias(f"__{c}") for c in same])
    equal = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in same if c != "id"])
    upserts = current.join(p, (F.col("id") == F.col("__id")) & equal, "left_anti")
    return upserts, previous.join(current.select("id"), "id", "left_anti").select("id")


class BuildMismatch(ValueError):
    """A delta belongs to another base than the one it is applied to."""


def apply_delta(base: DataFrame, upserts: DataFrame, deletes: DataFrame, base_build: str, from_build: str) -> DataFrame:
    """``base`` moved on by a delta, which must start at the base's own build."""
    if base_build != from_build:
        raise BuildMismatch(f"delta starts at {from_build!r}, base is {base_build!r}")
    gone = deletes.select("id").unionByName(upserts.select("id")).distinct()
    return base.join(gone, "id", "left_anti").select(*base.columns).unionByName(upserts.select(*base.columns))


def delta_chain(links: list[tuple[str, str, int]], have: str, want: str, full_size: int) -> list[tuple[str, str, int]] | None:
    """The deltas from one build to another, following links; None if the chain breaks or is no smaller than the whole."""
    step = {a: (a, b, n) for a, b, n in links}
    out, at = [], have
    while at != want:
        if at not in step or len(out) > len(links):
            return None
        out.append(step[at])
        at = step[at][1]
    return out if sum(n for *_, n in out) < full_size else None


def relevel(rows: DataFrame) -> DataFrame:
    """Rows of unknown level get one from stored years of experience."""
    found = level_from_years(F.col("years_min"), F.col("years_max"))
    return rows.withColumn("level", F.when((F.col("level") == "unknown") & (found != "unknown"), found).otherwise(F.col("level")))


def purge(rows: DataFrame, today: str, years: int = PURGE_YEARS) -> DataFrame:
    """Rows whose latest date is not older than ``years`` (of 365 days); undated ones stay."""
    fresh = latest_activity()
    return rows.where((fresh == "") | (fresh >= days_before(today, 365 * years)))


def children_of(children: DataFrame, rows: DataFrame, key: str = "job_id") -> DataFrame:
    """Child rows whose posting is still there."""
    return children.join(rows.select(F.col("id").alias(key)), key, "left_semi")


def apply_expiries(rows: DataFrame, expired: DataFrame) -> DataFrame:
    """Active rows in ``expired`` (id, expired_at, reason) become expired; nothing is deleted."""
    e = expired.groupBy("id").agg(F.min(F.struct("expired_at", "reason")).alias("__e"))
    hit = F.col("__e").isNotNull() & (F.col("status") == "active")
    out = rows.join(e, "id", "left")
    return out.select(
        *[
            F.when(hit, "expired").otherwise(F.col("status")).alias(c)
            if c == "status"
            else F.when(hit, F.col("__e.expired_at")).otherwise(F.col(c)).alias(c)
            if c == "expired_at"
            else F.when(hit, F.coalesce("__e.reason", F.lit("departed_board"))).otherwise(F.col(c)).alias(c)
            if c == "expiry_reason"
            else F.col(c)
            for c in rows.columns
        ]
    )


def slim(rows: DataFrame) -> DataFrame:
    """The same rows without the heavy columns, which become null."""
    return rows.select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) if c in SLIM_NULL else F.col(c) for c in rows.columns])


def prefer_latest(parts: DataFrame, key: list[str], at: str) -> DataFrame:
    """Of the rows of a key the one with the latest ``at``, null last; a hash of the row breaks ties."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(at).desc_nulls_last(), F.xxhash64(*parts.columns)))
    return parts.withColumn("__n", nth).where("__n = 1").drop("__n")


def reuse_enrichment(fresh: DataFrame, previous: DataFrame, columns: list[str]) -> DataFrame:
    """Fresh rows with enriched columns copied from a previous row of the same id whose input hash is the same;
    ``reused`` tells which need no enrichment."""
    old = previous.select("id", "enrich_hash", *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    out = fresh.join(old, ["id", "enrich_hash"], "left")
    return out.select(*[F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in fresh.columns], F.coalesce("__hit", F.lit(False)).alias("reused"))


def unseen(batch: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose (id, source) was not seen before."""
    return batch.join(seen.select("id", "source").distinct(), ["id", "source"], "left_anti").select(*batch.columns)
