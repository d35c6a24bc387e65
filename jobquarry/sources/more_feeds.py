"""Rules of further sources; importing this module adds them to ``feeds.RULES``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobquarry.functions import text
from jobquarry.functions.extract import level_from_stated
from jobquarry.functions.degrees import degree_from_stated
from jobquarry.sources.feeds import CONTRACTS, WORKPLACE, Payload, epoch, instant, is_remote_text, mapped, pay, place, places, register

# Words of these sources.
KNOWN = {k: v for k, v in CONTRACTS.items() if v != "other"} | {"seasonal": "temporary"}
PINPOINT = {
    "full_time": "full_time", "part_time": "part_time", "contract": "contract", "contract_to_hire": "contract", "freelance": "contract", "internship": "internship", "intern": "internship",
    "temporary": "temporary", "apprentice": "other", "apprenticeship": "other",
}
FREQUENCIES = {
    "year": "year", "yearly": "year", "annual": "year", "month": "month", "monthly": "month", "week": "week", "weekly": "week", "day": "day", "daily": "day", "hour": "hour", "hourly": "hour",
}
PAY_FRAMES = {"per year": "year", "per month": "month", "per week": "week", "per day": "day", "per hour": "hour"}
RATE_CODES = {"pa": "year", "fy": "year", "pm": "month", "bw": "week", "pw": "week", "pd": "day", "ph": "hour"}
SCHEDULES = {"full-time": "full_time", "part-time": "part_time", "intermittent": "temporary", "seasonal": "temporary", "multiple schedules": "other"}
ORACLE_PLACES = {"ora_onsite": "onsite", "ora_on_site": "onsite", "ora_remote": "remote", "ora_hybrid": "hybrid"}
PHENOM_TYPES = (
    ("intern", "internship"), ("co-op", "internship"), ("apprentice", "internship"), ("part-time", "part_time"), ("part time", "part_time"), ("contract", "contract"), ("fixed term", "temporary"),
    ("temporary", "temporary"), ("seasonal", "temporary"), ("full-time", "full_time"), ("full time", "full_time"),
)
CURRENCIES = {
    "gb": "GBP", "us": "USD", "at": "EUR", "au": "AUD", "be": "EUR", "br": "BRL", "ca": "CAD", "ch": "CHF", "de": "EUR", "es": "EUR", "fr": "EUR", "in": "INR", "it": "EUR", "mx": "MXN", "nl": "EUR",
    "nz": "NZD", "pl": "PLN", "sg": "SGD", "za": "ZAR",
}


def unknown(c: Column) -> Column:
    return F.coalesce(c, F.lit("unknown"))


def remote_if(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), "remote").otherwise("unknown")


def plain_of(html: Column) -> Column:
    return F.nullif(text.unescape_basic(text.strip_tags(html)), F.lit(""))


def joined(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(", ", *[F.nullif(p, F.lit("")) for p in parts]), F.lit(""))


def at_one(raw: Column, remote: Column | None = None, **parts: Column) -> Column:
    """One place, if anything is known of it."""
    flag = F.coalesce(remote, F.lit(False)) if remote is not None else F.lit(False)
    known = F.coalesce(raw, *parts.values()).isNotNull() | flag
    return F.when(known, places(place(raw, flag, parts.get("city"), parts.get("region"), parts.get("country"))))


def any_remote(locations: Column) -> Column:
    return F.exists(F.coalesce(locations, F.array()), lambda x: x["is_remote"])


def themuse(p: Payload) -> dict[str, Column]:
    names = F.filter(F.transform(p.items("locations", "struct<name:string>"), lambda x: x["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    far = lambda n: is_remote_text(n) | F.contains(F.lower(n), F.lit("flexible"))
    locations = F.transform(names, lambda n: place(n, far(n)))
    return {
        "source_job_id": p.get("id"), "company": p.get("company.name"), "title": F.trim(p.get("name")), "description_html": p.get("contents"), "apply_url": p.get("refs.landing_page"),
        "locations": locations, "remote": remote_if(any_remote(locations)), "employment_type": unknown(mapped(p.get("type"), KNOWN)), "department": p.get("categories[0].name"),
        "level": level_from_stated(p.get("levels[0].name")), "posted_at": instant(p.get("publication_date")),
    }


def breezy(p: Payload) -> dict[str, Column]:
    raw, city = p.words("location.name"), p.words("location.city")
    region = F.coalesce(p.words("location.state.name"), p.words("location.state"))
    country = F.coalesce(p.words("location.country.name"), p.words("location.country"))
    remote = p.flag("location.is_remote") | F.coalesce(is_remote_text(raw), F.lit(False))
    html = F.nullif(p.get("description"), F.lit(""))
    return {
        "source_job_id": F.coalesce(p.get("id"), p.get("_id")), "company": p.get("company.name"), "title": p.get("name"), "apply_url": p.get("url"),
        "locations": at_one(raw, remote, city=city, region=region, country=country), "remote": remote_if(remote),
        "employment_type": unknown(mapped(F.coalesce(p.get("type.name"), p.get("type")), KNOWN)), "department": F.coalesce(p.words("category.name"), p.words("department")),
        "posted_at": instant(F.coalesce(p.get("published_date"), p.get("creation_date"))), "description_html": html, "description_text": plain_of(html),
    }


def bamboohr(p: Payload) -> dict[str, Column]:
    new = [p.words("atsLocation.city"), F.coalesce(p.words("atsLocation.state"), p.words("atsLocation.province")), p.words("atsLocation.country")]
    none = F.coalesce(*new).isNull()
    city, region = F.when(none, p.words("location.city")).otherwise(new[0]), F.when(none, p.words("location.state")).otherwise(new[1])
    remote = p.flag("isRemote")
    return {
        "source_job_id": p.get("id"), "title": p.get("jobOpeningName"), "apply_url": p.get("url"), "locations": at_one(joined(city, region, new[2]), remote, city=city, region=region, country=new[2]),
        "remote": remote_if(remote), "employment_type": unknown(mapped(F.regexp_replace(F.lower(p.get("employmentStatusLabel")), "[^a-z]", ""), KNOWN)), "department": p.words("departmentLabel"),
    }


def pinpoint(p: Payload) -> dict[str, Column]:
    html = F.nullif(p.get("description"), F.lit(""))
    seen = p.flag("compensation_visible")
    low, high = (F.when(seen, p.get(f"compensation_{x}", "double")) for x in ("minimum", "maximum"))
    return {
        "source_job_id": p.get("id"), "title": p.get("title"), "apply_url": F.nullif(p.get("url"), F.lit("")),
        "locations": at_one(p.words("location.name"), city=p.words("location.city"), region=p.words("location.province")), "remote": unknown(mapped(p.get("workplace_type"), WORKPLACE)),
        "employment_type": unknown(mapped(p.get("employment_type"), PINPOINT)), "department": p.words("job.department.name"),
        "salary": pay(low, high, p.words("compensation_currency"), mapped(p.get("compensation_frequency"), FREQUENCIES)), "description_html": html, "description_text": plain_of(html),
    }


def teamtailor(p: Payload) -> dict[str, Column]:
    kind = "struct<address:struct<addressLocality:string,addressRegion:string,addressCountry:string>>"
    listed = F.coalesce(p.get("_jobposting.jobLocation", f"array<{kind}>"), F.array_compact(F.array(p.get("_jobposting.jobLocation", kind))), F.array().cast(f"array<{kind}>"))
    trim = lambda c: F.nullif(F.trim(c), F.lit(""))
    parts = F.transform(listed, lambda x: F.struct(trim(x["address"]["addressLocality"]).alias("c"), trim(x["address"]["addressRegion"]).alias("r"), trim(x["address"]["addressCountry"]).alias("n")))
    known = F.filter(parts, lambda x: F.coalesce(x["c"], x["r"], x["n"]).isNotNull())
    locations = F.transform(known, lambda x: place(joined(x["c"], x["r"], x["n"]), F.lit(False), x["c"], x["r"], x["n"]))
    title = F.trim(F.coalesce(F.nullif(p.get("title"), F.lit("")), p.get("_jobposting.title"), F.lit("")))
    html = F.coalesce(F.nullif(p.get("content_html"), F.lit("")), F.nullif(p.get("_jobposting.description"), F.lit("")))
    one = F.coalesce(p.amount("_jobposting.baseSalary.value.value"), p.amount("_jobposting.baseSalary.value"))
    low, high = p.amount("_jobposting.baseSalary.value.minValue"), p.amount("_jobposting.baseSalary.value.maxValue")
    neither = F.coalesce(low, high).isNull()
    haystack = F.concat_ws(" ", title, F.transform(locations, lambda x: x["raw"]))
    return {
        "source_job_id": p.get("id"), "title": title, "apply_url": F.nullif(p.get("url"), F.lit("")), "locations": locations,
        "remote": remote_if((F.upper(F.trim(p.get("_jobposting.jobLocationType"))) == "TELECOMMUTE") | is_remote_text(haystack)),
        "employment_type": unknown(mapped(F.replace(p.get("_jobposting.employmentType"), F.lit("-"), F.lit("_")), CONTRACTS)),
        "posted_at": instant(F.coalesce(p.get("date_published"), p.get("_jobposting.datePosted"))), "description_html": html, "description_text": plain_of(html),
        "salary": pay(F.when(neither, one).otherwise(low), F.when(neither, one).otherwise(high), p.words("_jobposting.baseSalary.currency"), mapped(p.get("_jobposting.baseSalary.value.unitText"), FREQUENCIES)),
    }


def rippling(p: Payload) -> dict[str, Column]:
    label = F.nullif(p.get("workLocation.label"), F.lit(""))
    parts = F.transform(F.split(label, ","), lambda x: F.trim(x))
    two = ~F.regexp_like(label, F.lit("[()]")) & (F.size(parts) == 2) & F.forall(parts, lambda x: x != "")
    far = is_remote_text(label)
    return {
        "source_job_id": F.coalesce(p.get("uuid"), p.get("id")), "title": p.get("name"), "apply_url": p.get("url"), "department": p.get("department.label"), "remote": remote_if(far),
        "locations": F.when(label.isNotNull(), places(place(label, far, city=F.when(two, F.get(parts, 0)), country=F.when(two, F.get(parts, 1))))),
    }


def paylocity(p: Payload) -> dict[str, Column]:
    def first(*names: str) -> Column:
        """The first of some names, in either of the feed's two spellings."""
        return F.coalesce(*[F.nullif(p.get(x), F.lit("")) for n in names for x in (n, n[0].upper() + n[1:])])

    city, region, country = first("city"), first("state"), first("country")
    raw = F.coalesce(first("locationName"), F.nullif(p.get("location"), F.lit("")), joined(city, region, country))
    far = p.flag("isRemote") | F.coalesce(is_remote_text(raw), F.lit(False))
    return {
        "source_job_id": F.coalesce(first("jobId"), first("id")), "title": first("title", "jobTitle"), "apply_url": first("applyUrl", "url"), "remote": remote_if(far),
        "locations": at_one(raw, far, city=city, region=region, country=country), "employment_type": unknown(mapped(first("employmentType", "jobType", "type"), KNOWN)),
        "department": first("department", "category"), "posted_at": instant(first("publishedDate", "datePosted", "postedDate")), "description_html": first("description", "jobDescription"),
    }


def applicantpro(p: Payload) -> dict[str, Column]:
    city, region, country = p.words("city"), F.coalesce(p.words("state"), p.words("stateAbbreviation")), F.coalesce(p.words("iso3"), p.words("countryAbbreviation"))
    interval = F.coalesce(mapped(p.get("payTypeFrame"), PAY_FRAMES), mapped(p.get("payType"), {"salary": "year", "hourly": "hour"}))
    return {
        "source_job_id": p.get("id"), "title": F.trim(p.get("title")), "apply_url": p.get("jobUrl"), "locations": at_one(city, city=city, region=region, country=country),
        "employment_type": unknown(mapped(F.coalesce(p.words("classification"), p.words("employmentType")), KNOWN)), "department": p.words("orgTitle"),
        "salary": pay(p.amount("minSalary"), p.amount("maxSalary"), F.lit("USD"), interval),
    }


def usajobs(p: Payload) -> dict[str, Column]:
    listed = p.items("PositionLocation", "struct<CityName:string,CountryCode:string,LocationName:string>")
    none = lambda c: F.nullif(c, F.lit(""))
    number = lambda x: p.get(f"PositionRemuneration[0].{x}").try_cast("double")
    code = mapped(p.get("PositionRemuneration[0].RateIntervalCode"), RATE_CODES)
    interval = F.coalesce(code, mapped(p.get("PositionRemuneration[0].Description"), PAY_FRAMES), mapped(p.get("PositionRemuneration[0].RateIntervalCode"), PAY_FRAMES))
    return {
        "source_job_id": p.get("PositionID"), "company": p.get("OrganizationName"), "title": F.trim(p.get("PositionTitle")), "description_text": none(p.get("UserArea.Details.JobSummary")),
        "locations": F.transform(listed, lambda x: place(none(x["LocationName"]), F.lit(False), none(x["CityName"]), None, none(x["CountryCode"]))),
        "remote": remote_if(p.flag("UserArea.Details.RemoteIndicator")), "employment_type": unknown(mapped(p.get("PositionSchedule[0].Name"), SCHEDULES)), "department": none(p.get("DepartmentName")),
        "salary": pay(number("MinimumRange"), number("MaximumRange"), F.lit("USD"), interval), "apply_url": p.get("PositionURI"),
        "posted_at": instant(F.regexp_replace(p.get("PublicationStartDate"), r"(\.\d{6})\d+", "$1")),
    }


def adzuna(p: Payload) -> dict[str, Column]:
    raw, country = p.words("location.display_name"), p.words("location.area[0]")
    kind = F.coalesce(mapped(p.get("contract_time"), {"full_time": "full_time", "part_time": "part_time"}), mapped(p.get("contract_type"), {"permanent": "full_time", "contract": "contract"}))
    return {
        "source_job_id": p.get("id"), "company": p.get("company.display_name"), "title": F.trim(p.get("title")), "description_html": p.get("description"), "locations": at_one(raw, country=country),
        "employment_type": unknown(kind), "department": F.nullif(p.get("category.label"), F.lit("")), "apply_url": p.get("redirect_url"), "posted_at": instant(p.get("created")),
        "salary": pay(p.get("salary_min", "double"), p.get("salary_max", "double"), mapped(F.coalesce(p.get("_country"), F.lit("us")), CURRENCIES), F.lit("year")),
    }


def dejobs(p: Payload) -> dict[str, Column]:
    raw = p.words("location_exact")
    return {
        "source_job_id": F.coalesce(p.get("guid"), p.get("id")), "company": p.get("company_exact"), "title": p.get("title_exact"), "apply_url": p.get("url"), "locations": at_one(raw, is_remote_text(raw)),
        "remote": remote_if(is_remote_text(raw)), "posted_at": instant(p.get("date_added")), "description_html": p.words("description"),
    }


def tesla(p: Payload) -> dict[str, Column]:
    raw = p.words("location")
    return {
        "source_job_id": p.get("id"), "title": p.get("title"), "apply_url": F.concat(F.lit("https://www.tesla.com/careers/search/job/"), p.get("id")), "locations": at_one(raw, is_remote_text(raw)),
        "remote": remote_if(is_remote_text(raw)), "employment_type": unknown(mapped(p.get("type"), KNOWN)), "department": p.get("department"),
    }


def ukg(p: Payload) -> dict[str, Column]:
    at = "Locations[0].Address"
    city, region, country = p.words(f"{at}.City"), F.coalesce(p.words(f"{at}.State.Name"), p.words(f"{at}.State.Code")), F.coalesce(p.words(f"{at}.Country.Name"), p.words(f"{at}.Country.Code"))
    raw = F.coalesce(p.words("Locations[0].LocalizedName"), joined(city, region, country))
    far = is_remote_text(raw)
    return {
        "source_job_id": p.get("Id"), "title": p.get("Title"), "apply_url": p.get("Url"), "locations": at_one(raw, far, city=city, region=region, country=country), "remote": remote_if(far),
        "employment_type": F.when(p.flag("FullTime"), "full_time").otherwise("unknown"), "department": F.nullif(p.get("JobCategoryName"), F.lit("")), "posted_at": instant(p.get("PostedDate")),
        "description_html": p.words("BriefDescription"),
    }


def adp(p: Payload) -> dict[str, Column]:
    at = "requisitionLocations[0].address"
    city, region = p.words(f"{at}.cityName"), p.words(f"{at}.countrySubdivisionLevel1.codeValue")
    raw = F.coalesce(p.words("requisitionLocations[0].nameCode.shortName"), joined(city, region))
    short = F.lower(p.get("workLevelCode.shortName"))
    fields = p.items("customFieldGroup.stringFields", "struct<nameCode:struct<codeValue:string>,stringValue:string>")
    return {
        "source_job_id": p.get("itemID"), "title": p.get("requisitionTitle"), "apply_url": p.get("url"), "locations": at_one(raw, is_remote_text(raw), city=city, region=region),
        "remote": remote_if(is_remote_text(raw)), "employment_type": F.when(F.contains(short, F.lit("full")), "full_time").when(F.contains(short, F.lit("part")), "part_time").otherwise("unknown"),
        "department": F.get(F.filter(fields, lambda x: x["nameCode"]["codeValue"] == "HomeDepartment"), 0)["stringValue"], "posted_at": instant(p.get("postDate")),
    }


def oracle(p: Payload) -> dict[str, Column]:
    raw = p.words("PrimaryLocation")
    stated = mapped(F.coalesce(p.words("WorkplaceTypeCode"), p.words("WorkplaceType")), ORACLE_PLACES)
    return {
        "source_job_id": p.get("Id"), "title": p.get("Title"), "apply_url": p.get("url"), "locations": at_one(raw, is_remote_text(raw)),
        "remote": F.coalesce(stated, remote_if(is_remote_text(raw))), "department": p.words("Department"), "posted_at": instant(F.substring(p.get("PostedDate"), 1, 10)),
        "description_html": p.words("ShortDescriptionStr"),
    }


def phenom(p: Payload) -> dict[str, Column]:
    city, region, country = p.words("city"), p.words("state"), p.words("country")
    raw = F.coalesce(p.words("cityStateCountry"), p.words("location"), joined(city, region, country))
    kind, words = F.lit("unknown"), F.lower(F.coalesce(p.words("type"), F.lit("")))
    for word, value in reversed(PHENOM_TYPES):
        kind = F.when(F.contains(words, F.lit(word)), value).otherwise(kind)
    return {
        "source_job_id": F.coalesce(p.words("jobSeqNo"), p.words("jobId")), "title": p.words("title"), "apply_url": p.words("applyUrl"),
        "locations": at_one(raw, is_remote_text(raw), city=city, region=region, country=country), "remote": F.coalesce(mapped(p.words("checkRemote"), WORKPLACE), remote_if(is_remote_text(raw))),
        "employment_type": kind, "department": F.coalesce(p.words("category"), p.words("multi_category[0]")), "posted_at": instant(p.get("postedDate")), "description_text": p.words("descriptionTeaser"),
    }


def coveo(p: Payload) -> dict[str, Column]:
    first = lambda x: F.coalesce(p.words(f"{x}[0]"), p.words(x))
    raw = joined(*[F.when(F.lower(c) != "multi-location", c) for c in (first("city"), first("country"))])
    label = F.coalesce(raw, first("city"))
    at = F.coalesce(epoch(p.get("date", "double") / 1000), instant(p.get("date")))
    return {
        "source_job_id": F.coalesce(first("jobid"), first("uniqueId")), "title": F.coalesce(F.nullif(p.get("_title"), F.lit("")), p.get("title")), "apply_url": p.get("clickUri"),
        "locations": at_one(label, is_remote_text(label)), "remote": remote_if(is_remote_text(label)), "department": F.coalesce(first("category"), first("obu")), "posted_at": at,
        "description_html": F.coalesce(first("description"), first("data")),
    }


def eightfold(p: Payload) -> dict[str, Column]:
    clean = lambda path: F.filter(F.transform(p.items(path, "string"), lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    standard, named = clean("standardizedLocations"), clean("locations")
    parts = lambda label: F.filter(F.transform(F.split(label, ","), lambda x: F.trim(x)), lambda x: x != "")
    piece = lambda label, k, least: F.when(F.size(parts(label)) >= least, F.element_at(parts(label), k))
    structured = F.transform(standard, lambda n: place(n, is_remote_text(n), piece(n, 1, 2), piece(n, 2, 3), piece(n, -1, 2)))
    plain = F.transform(F.when(F.size(named) > 0, named).otherwise(F.array_compact(F.array(p.words("location")))), lambda n: place(n, is_remote_text(n)))
    locations = F.when(F.size(standard) > 0, structured).otherwise(plain)
    option = mapped(F.replace(p.get("work_location_option"), F.lit("_"), F.lit("-")), WORKPLACE)
    return {
        "source_job_id": p.get("id"), "title": F.coalesce(p.words("name"), p.words("posting_name")), "apply_url": p.get("canonicalPositionUrl"), "locations": locations,
        "remote": F.coalesce(option, remote_if(any_remote(locations))), "employment_type": unknown(mapped(p.get("type"), KNOWN)), "department": p.words("department"),
        "posted_at": epoch(p.get("t_create", "double")), "updated_at": epoch(p.get("t_update", "double")),
    }


def workable(p: Payload) -> dict[str, Column]:
    far = p.flag("telecommuting")
    none = lambda c: F.nullif(c, F.lit(""))
    listed = p.items("locations", "struct<city:string,region:string,country:string>")
    structured = F.transform(listed, lambda x: place(joined(x["city"], x["region"], x["country"]), far, none(x["city"]), none(x["region"]), none(x["country"])))
    city, region, country = p.words("city"), p.words("state"), p.words("country")
    locations = F.when(F.size(listed) > 0, structured).otherwise(at_one(joined(city, region, country), far, city=city, region=region, country=country))
    html = F.nullif(F.concat_ws("\n", *[none(p.get(x)) for x in ("description", "requirements", "benefits")]), F.lit(""))
    degree = degree_from_stated(p.get("education"))
    kind = F.coalesce(mapped(p.get("employment_type"), KNOWN), F.when(p.words("employment_type").isNotNull(), "other"))
    return {
        "source_job_id": p.get("shortcode"), "title": p.get("title"), "apply_url": F.coalesce(none(p.get("url")), none(p.get("application_url")), none(p.get("shortlink"))), "locations": locations,
        "remote": F.when(far, "remote").when(F.size(locations) > 0, "onsite").otherwise("unknown"), "employment_type": unknown(kind), "department": none(p.get("department")),
        "level": level_from_stated(p.get("experience")), "degree_min": degree, "degree_required": F.when(degree.isNotNull(), True), "posted_at": instant(p.get("published_on")), "description_html": html,
        "description_text": plain_of(html),
    }


for _rule in (themuse, breezy, bamboohr, pinpoint, teamtailor, rippling, paylocity, applicantpro, usajobs, adzuna, dejobs, tesla, ukg, adp, oracle, phenom, coveo, eightfold, workable):
    register(_rule.__name__, _rule)
