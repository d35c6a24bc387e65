"""Feeds as postings: one projection for each source over captured payloads.

A payload is one posting as JSON text. ``normalize`` parses it once to a variant and reads the paths that the source's
rule names; what is missing or has another type is null, and a payload that is no JSON gives no row. Fetching is outside.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobquarry.functions import text
from jobquarry.functions.extract import level_from_stated
from jobquarry.schemas import POSTING

# Words of sources for workplaces, contracts and pay intervals.
WORKPLACE = {"remote": "remote", "hybrid": "hybrid", "on-site": "onsite", "onsite": "onsite"}
CONTRACTS = {
    "full-time": "full_time", "full time": "full_time", "fulltime": "full_time", "full_time": "full_time", "permanent": "full_time", "regular": "full_time", "vollzeit": "full_time",
    "part-time": "part_time", "part time": "part_time", "parttime": "part_time", "part_time": "part_time", "teilzeit": "part_time", "contract": "contract", "contractor": "contract",
    "freelance": "contract", "temporary": "temporary", "temp": "temporary", "internship": "internship", "intern": "internship", "praktikum": "internship", "trainee": "internship", "other": "other",
}
LEVER_INTERVALS = {"per-year-salary": "year", "per-month-salary": "month", "per-week-salary": "week", "per-day-wage": "day", "per-hour-wage": "hour"}
ASHBY_INTERVALS = {"1 year": "year", "1 month": "month", "1 week": "week", "1 day": "day", "1 hour": "hour"}
PERIODS = {x: x for x in ("year", "month", "week", "day", "hour")}


class Payload:
    """Paths of a payload as columns."""

    def __init__(self, v: Column):
        self.v = v

    def get(self, path: str, kind: str = "string") -> Column:
        return F.try_variant_get(self.v, f"$.{path}", kind)

    def words(self, path: str) -> Column:
        """A text without white space around it; null if nothing is left."""
        return F.nullif(F.trim(self.get(path)), F.lit(""))

    def flag(self, path: str) -> Column:
        return F.coalesce(self.get(path, "boolean"), F.lit(False))

    def amount(self, path: str) -> Column:
        """A positive number, also where it is written as text."""
        x = F.coalesce(self.get(path, "double"), self.get(path).try_cast("double"))
        return F.when(x > 0, x)

    def items(self, path: str, kind: str) -> Column:
        return F.coalesce(self.get(path, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def mapped(value: Column, table: dict[str, str], other: Column | None = None) -> Column:
    found = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.lower(F.trim(value)))
    return F.coalesce(found, other) if other is not None else found


def contract(value: Column, other: str = "unknown") -> Column:
    """The canonical contract; ``other`` for words that are not known, unknown for none."""
    return F.coalesce(mapped(value, CONTRACTS, F.when(F.coalesce(F.trim(value), F.lit("")) != "", other)), F.lit("unknown"))


def place(raw: Column, remote: Column, city: Column | None = None, region: Column | None = None, country: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    parts = [none if c is None else c for c in (city, region, country)]
    return F.struct(parts[0].alias("city"), parts[1].alias("region"), parts[2].alias("country"), raw.alias("raw"), F.coalesce(remote, F.lit(False)).alias("is_remote"))


def places(*found: Column) -> Column:
    return F.array(*found)


def pay(low: Column, high: Column, currency: Column, interval: Column) -> Column:
    made = F.struct(low.alias("min_amount"), high.alias("max_amount"), currency.alias("currency"), interval.alias("interval"))
    return F.when(F.coalesce(low, high).isNotNull(), made)


def instant(value: Column) -> Column:
    """A timestamp text as ISO text in UTC; null if it is none."""
    at = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(value, " UTC$", "Z"), r"^(\d{4}-\d{2}-\d{2}) ", "$1T"))
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def epoch(seconds: Column) -> Column:
    at = F.timestamp_seconds(seconds)
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def is_remote_text(x: Column) -> Column:
    return F.contains(F.lower(x), F.lit("remote"))


def greenhouse(p: Payload) -> dict[str, Column]:
    offices = F.filter(F.transform(p.items("offices", "struct<name:string,location:string>"), lambda o: F.trim(F.coalesce(F.nullif(o["name"], F.lit("")), o["location"]))), lambda n: F.coalesce(n, F.lit("")) != "")
    names = F.when(F.size(offices) > 0, offices).otherwise(F.array_compact(F.array(p.words("location.name"))))
    locations = F.transform(names, lambda n: place(n, is_remote_text(n)))
    stated = F.get(F.filter(p.items("metadata", "struct<name:string,value:string>"), lambda m: F.lower(F.trim(m["name"])) == "workplace type"), 0)["value"]
    html = text.unescape_basic(p.get("content"))
    return {
        "source_job_id": p.get("id"), "company": p.get("company_name"), "title": p.get("title"), "apply_url": p.get("absolute_url"), "locations": locations,
        "remote": F.coalesce(mapped(stated, {**WORKPLACE, "in office": "onsite"}), F.when(F.exists(locations, lambda x: x["is_remote"]), "remote"), F.lit("unknown")),
        "department": p.get("departments[0].name"), "posted_at": instant(p.get("first_published")), "updated_at": instant(p.get("updated_at")),
        "description_html": html, "description_text": F.nullif(text.unescape_basic(text.strip_tags(html)), F.lit("")),
    }


def lever(p: Payload) -> dict[str, Column]:
    everywhere = p.items("categories.allLocations", "string")
    names = F.filter(F.when(F.size(everywhere) > 0, everywhere).otherwise(F.array(p.get("categories.location"))), lambda x: F.coalesce(x, F.lit("")) != "")
    work = F.lower(p.words("workplaceType"))
    country = p.words("country")
    return {
        "source_job_id": p.get("id"), "title": p.get("text"), "apply_url": F.coalesce(p.get("applyUrl"), p.get("hostedUrl")),
        "locations": F.transform(names, lambda n: place(n, F.coalesce(work == "remote", F.lit(False)) | is_remote_text(n), country=country)),
        "remote": F.coalesce(mapped(work, WORKPLACE), F.lit("unknown")), "employment_type": contract(p.get("categories.commitment"), "other"),
        "department": F.coalesce(p.get("categories.department"), p.get("categories.team")),
        "salary": pay(p.get("salaryRange.min", "double"), p.get("salaryRange.max", "double"), p.get("salaryRange.currency"), mapped(p.get("salaryRange.interval"), LEVER_INTERVALS)),
        "posted_at": epoch(p.get("createdAt", "double") / 1000), "description_html": p.get("description"), "description_text": p.get("descriptionPlain"),
    }


def ashby(p: Payload) -> dict[str, Column]:
    remote, at = p.get("isRemote", "boolean"), "address.postalAddress"
    parts = [p.get(f"{at}.addressLocality"), p.get(f"{at}.addressRegion"), p.get(f"{at}.addressCountry")]
    somewhere = F.coalesce(*[F.nullif(x, F.lit("")) for x in (*parts, p.get("location"))]).isNotNull()
    kind = "array<struct<compensationType:string,minValue:double,maxValue:double,currencyCode:string,interval:string>>"
    pays = F.filter(F.coalesce(p.get("compensation.summaryComponents", kind), F.array().cast(kind)), lambda c: (c["compensationType"] == "Salary") & F.coalesce(c["minValue"], c["maxValue"]).isNotNull())
    first = F.get(pays, 0)
    return {
        "source_job_id": p.get("id"), "title": F.trim(p.get("title")), "apply_url": F.coalesce(p.get("applyUrl"), p.get("jobUrl")),
        "locations": F.when(somewhere, places(place(p.get("location"), remote, *parts))), "remote": F.when(remote, "remote").when(~remote, "onsite").otherwise("unknown"),
        "employment_type": contract(F.regexp_replace(p.get("employmentType"), " ", ""), "other"), "department": p.get("department"),
        "salary": pay(first["minValue"], first["maxValue"], first["currencyCode"], mapped(first["interval"], ASHBY_INTERVALS)), "posted_at": instant(p.get("publishedAt")),
        "description_html": p.get("descriptionHtml"), "description_text": p.get("descriptionPlain"),
    }


def smartrecruiters(p: Payload) -> dict[str, Column]:
    city, region, country = (F.nullif(p.get(f"location.{x}"), F.lit("")) for x in ("city", "region", "country"))
    raw = F.coalesce(F.nullif(p.get("location.fullLocation"), F.lit("")), F.nullif(F.concat_ws(", ", city, region, country), F.lit("")))
    remote = p.flag("location.remote")
    known = {k: v for k, v in CONTRACTS.items() if v != "other"}
    return {
        "source_job_id": p.get("id"), "company": p.get("company.name"), "title": p.get("name"), "apply_url": F.concat(F.lit("https://jobs.smartrecruiters.com/"), p.get("company.identifier"), F.lit("/"), p.get("id")),
        "locations": F.when(raw.isNotNull() | remote, places(place(raw, remote, city, region, F.upper(country)))),
        "remote": F.when(remote, "remote").when(p.flag("location.hybrid"), "hybrid").when(raw.isNotNull(), "onsite").otherwise("unknown"),
        "employment_type": F.coalesce(mapped(p.get("typeOfEmployment.id"), known), mapped(p.get("typeOfEmployment.label"), known), F.lit("unknown")),
        "department": p.get("department.label"), "level": level_from_stated(p.get("experienceLevel.label")), "posted_at": instant(p.get("releasedDate")),
    }


def recruitee(p: Payload) -> dict[str, Column]:
    city, region, country, raw = (p.words(x) for x in ("city", "state_name", "country", "location"))
    remote = p.flag("remote") | (~F.coalesce(p.get("on_site", "boolean"), F.lit(True)) & city.isNull() & raw.isNull())
    prefix = F.split_part(F.lower(F.trim(p.get("employment_type_code"))), F.lit("_"), F.lit(1))
    html = F.nullif(p.get("description"), F.lit(""))
    return {
        "source_job_id": p.get("id"), "company": p.get("company_name"), "title": p.get("title"), "apply_url": F.coalesce(p.get("careers_apply_url"), p.get("careers_url")),
        "locations": F.when(F.coalesce(city, region, country, raw).isNotNull() | remote, places(place(raw, remote, city, region, country))),
        "remote": F.when(p.flag("remote"), "remote").when(p.flag("hybrid"), "hybrid").when(p.flag("on_site"), "onsite").when(remote, "remote").otherwise("unknown"),
        "employment_type": contract(prefix), "department": F.nullif(p.get("department"), F.lit("")),
        "salary": pay(p.amount("salary.min"), p.amount("salary.max"), p.words("salary.currency"), mapped(p.get("salary.period"), PERIODS)),
        "posted_at": instant(F.coalesce(p.get("published_at"), p.get("created_at"))), "updated_at": instant(p.get("updated_at")),
        "description_html": html, "description_text": F.nullif(text.unescape_basic(text.strip_tags(html)), F.lit("")),
    }


def remotive(p: Payload) -> dict[str, Column]:
    return {
        "source_job_id": p.get("id"), "company": p.get("company_name"), "title": F.trim(p.get("title")), "description_html": p.get("description"), "apply_url": p.get("url"),
        "locations": places(place(p.words("candidate_required_location"), F.lit(True))), "remote": F.lit("remote"), "employment_type": contract(p.get("job_type"), "other"),
        "department": F.nullif(p.get("category"), F.lit("")), "posted_at": instant(p.get("publication_date")),
    }


def arbeitnow(p: Payload) -> dict[str, Column]:
    remote = p.flag("remote")
    return {
        "source_job_id": p.get("slug"), "company": p.get("company_name"), "title": F.trim(p.get("title")), "description_html": p.get("description"), "apply_url": p.get("url"),
        "locations": places(place(p.words("location"), remote)), "remote": F.when(remote, "remote").otherwise("onsite"), "employment_type": contract(p.get("job_types[0]"), "other"),
        "posted_at": epoch(p.get("created_at", "double")),
    }


def remoteok(p: Payload) -> dict[str, Column]:
    return {
        "source_job_id": p.get("id"), "company": p.get("company"), "title": F.trim(p.get("position")), "description_html": p.get("description"), "apply_url": F.coalesce(p.get("apply_url"), p.get("url")),
        "locations": places(place(p.words("location"), F.lit(True))), "remote": F.lit("remote"), "salary": pay(p.amount("salary_min"), p.amount("salary_max"), F.lit("USD"), F.lit(None).cast("string")),
        "posted_at": instant(p.get("date")),
    }


def jobicy(p: Payload) -> dict[str, Column]:
    first = lambda x: F.coalesce(p.words(f"{x}[0]"), p.words(x))
    low, high = (F.coalesce(p.amount(f"annualSalary{x}"), p.amount(f"salary{x}")) for x in ("Min", "Max"))
    return {
        "source_job_id": p.get("id"), "company": p.get("companyName"), "title": F.trim(p.get("jobTitle")), "description_html": p.get("jobExcerpt"), "apply_url": p.get("url"),
        "locations": places(place(p.words("jobGeo"), F.lit(True))), "remote": F.lit("remote"), "employment_type": F.coalesce(mapped(first("jobType"), CONTRACTS), F.lit("unknown")),
        "salary": pay(low, high, F.coalesce(p.words("salaryCurrency"), p.words("currency")), F.lit("year")), "level": level_from_stated(first("jobLevel")), "sector": first("jobIndustry"),
        "posted_at": instant(p.get("pubDate")),
    }


def himalayas(p: Payload) -> dict[str, Column]:
    return {
        "source_job_id": F.coalesce(p.words("guid"), p.words("applicationLink"), p.words("title")), "company": p.get("companyName"), "title": F.trim(p.get("title")),
        "description_html": p.get("description"), "apply_url": F.coalesce(p.words("applicationLink"), p.get("guid")), "locations": places(place(p.words("locationRestrictions[0]"), F.lit(True))),
        "remote": F.lit("remote"), "employment_type": F.coalesce(mapped(p.get("employmentType"), CONTRACTS), F.lit("unknown")), "level": level_from_stated(p.get("seniority[0]")),
        "department": F.coalesce(p.get("categories[0].name"), p.get("categories[0]")), "salary": pay(p.amount("minSalary"), p.amount("maxSalary"), F.coalesce(p.words("currency"), F.lit("USD")), F.lit("year")),
        "posted_at": epoch(p.get("pubDate", "double")),
    }


RULES: dict[str, Callable[[Payload], dict[str, Column]]] = {
    "greenhouse": greenhouse, "lever": lever, "ashby": ashby, "smartrecruiters": smartrecruiters, "recruitee": recruitee, "remotive": remotive, "arbeitnow": arbeitnow, "remoteok": remoteok,
    "jobicy": jobicy, "himalayas": himalayas,
}


def register(source: str, rule: Callable[[Payload], dict[str, Column]]) -> None:
    """Adds a source, or replaces its rule."""
    RULES[source] = rule


def normalize(payloads: DataFrame, source: str) -> DataFrame:
    """Postings of one source. ``payloads``: ``ord``, ``payload`` (JSON text), and ``company`` and ``board_token`` of the board, which
    stand in where the payload names no company."""
    parsed = payloads.withColumn("__v", F.try_parse_json("payload")).where(F.col("__v").isNotNull())
    p = Payload(F.col("__v"))
    made = RULES[source](p) | {"source": F.lit(source)}
    own = [c for c in ("company", "board_token") if c in payloads.columns]
    made |= {c: F.coalesce(F.nullif(made[c], F.lit("")), F.col(c)) if c in made else F.col(c) for c in own}
    empty = {"remote": F.lit("unknown"), "employment_type": F.lit("unknown"), "level": F.lit("unknown"), "locations": F.array(), "provenance": F.array()}
    out = []
    for f in POSTING.fields:
        value = F.col("ord") if f.name == "ord" else made.get(f.name)
        if value is not None and f.name in empty:
            value = F.coalesce(value.cast(f.dataType), empty[f.name].cast(f.dataType))
        out.append((value if value is not None else empty.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name))
    return parsed.select(*out)


def jsonld_postings(pages: DataFrame, html: str = "html") -> DataFrame:
    """Job postings embedded in pages as JSON-LD: ``payload`` for each, with the page's columns."""
    scripts = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    one = pages.withColumn("__s", F.explode(scripts)).withColumn("__v", F.try_parse_json(F.trim("__s")))
    listed = F.coalesce(F.try_variant_get("__v", "$['@graph']", "array<variant>"), F.try_variant_get("__v", "$", "array<variant>"), F.array("__v"))
    items = one.withColumn("__i", F.explode(listed))
    kind = F.coalesce(F.try_variant_get("__i", "$['@type']", "string"), F.try_variant_get("__i", "$['@type'][0]", "string"))
    return items.where(kind == "JobPosting").select(*pages.columns, F.to_json("__i").alias("payload"))


