"""Rules of employers' own boards and of generic sources; importing this module adds them to ``feeds.RULES``.

Pages and feeds that aren't JSON reach these rules as the records that a reader took from them (``sources.documents``), with the
names below. ``url`` is the record's own address; ``id`` its identifier where the source has no better one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobquarry.functions import text
from jobquarry.functions.extract import level_from_stated
from jobquarry.sources.feeds import WORKPLACE, Payload, instant, is_remote_text, mapped, pay, place, places, register
from jobquarry.sources.more_feeds import FREQUENCIES, any_remote, at_one, joined, plain_of, remote_if, unknown

# Words of these sources.
PERSONIO = {
    "permanent": "full_time", "full-time": "full_time", "fulltime": "full_time", "part-time": "part_time", "parttime": "part_time", "intern": "internship", "internship": "internship",
    "trainee": "internship", "working_student": "part_time", "temporary": "temporary", "contractor": "contract", "freelance": "contract",
}
JOIN = {
    "employee": "full_time", "working student": "part_time", "intern": "internship", "internship": "internship", "apprenticeship": "internship", "trainee": "internship", "freelancer": "contract",
    "freelance": "contract", "temporary": "temporary",
}
JOIN_FREQUENCIES = {"per_year": "year", "per_month": "month", "per_week": "week", "per_day": "day", "per_hour": "hour"}
WITHOUT_CENTS = ("BIF", "CLP", "DJF", "GNF", "JPY", "KMF", "KRW", "MGA", "PYG", "RWF", "UGX", "VND", "VUV", "XAF", "XOF", "XPF")
NETWORK = {"full-time": "full_time", "part-time": "part_time", "contract": "contract", "temporary": "temporary", "internship": "internship"}
SCHEMA_ORG = {
    "full_time": "full_time", "fulltime": "full_time", "part_time": "part_time", "parttime": "part_time", "contract": "contract", "contractor": "contract", "intern": "internship",
    "internship": "internship", "temporary": "temporary", "temp": "temporary", "per_diem": "other", "other": "other",
}
CAPTURED = {"full_time": "full_time", "full-time": "full_time", "part_time": "part_time", "part-time": "part_time", "contract": "contract", "intern": "internship", "internship": "internship", "temporary": "temporary"}
JAZZ = {
    "full time": "full_time", "part time": "part_time", "contract": "contract", "contractor": "contract", "temporary": "temporary", "internship": "internship", "intern": "internship",
    "freelance": "contract", "commission": "other",
}
PAYCOM = {
    "full time": "full_time", "full-time": "full_time", "fulltime": "full_time", "part time": "part_time", "part-time": "part_time", "parttime": "part_time", "contract": "contract",
    "temporary": "temporary", "seasonal": "temporary", "intern": "internship", "internship": "internship",
}
#: The first of these that a text holds decides.
PAGEUP = (
    ("full time", "full_time"), ("full-time", "full_time"), ("part time", "part_time"), ("part-time", "part_time"), ("casual", "temporary"), ("temporary", "temporary"), ("fixed term", "temporary"),
    ("contract", "contract"), ("intern", "internship"),
)
TALEO_BUSINESS = (
    (r"\bfull[\s-]?time\b", "full_time"), (r"\bpart[\s-]?time\b", "part_time"), (r"\bcontract(or)?\b", "contract"), (r"\btemp(orary)?\b", "temporary"), (r"\bseasonal\b", "temporary"),
    (r"\bintern(ship)?\b", "internship"), (r"\bcasual\b", "other"), (r"\bregular\b", "full_time"),
)
TALEO_WORD = r"(?:full[\s-]?time|part[\s-]?time|contract(?:or)?|temp(?:orary)?|seasonal|intern(?:ship)?|casual|regular)"
TALEO_DATES = ("MMM d, yyyy", "MMMM d, yyyy", "M/d/yyyy", "yyyy-MM-dd")
BRASSRING_PLACES = ("location", "city", "state", "region", "country", "formtext8", "formtext10")


def day(value: Column, *formats: str) -> Column:
    """A date in one of some forms as ISO text."""
    at = F.coalesce(*[F.try_to_timestamp(F.trim(value), F.lit(f)) for f in formats])
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def one_place(raw: Column) -> Column:
    return at_one(raw, is_remote_text(raw))


def labelled(raw: Column, **more: Column) -> dict[str, Column]:
    """A place by its label, and whether it is a remote one."""
    return {"locations": one_place(raw), "remote": remote_if(is_remote_text(raw))} | more


def jsonld_places(p: Payload, path: str = "jobLocation", keep_empty: bool = False) -> Column:
    """Addresses of a JSON-LD posting, one or several, as places; remote if their label says so."""
    kind = "struct<address:struct<addressLocality:string,addressRegion:string,addressCountry:string>>"
    listed = F.coalesce(p.get(path, f"array<{kind}>"), F.array_compact(F.array(p.get(path, kind))), F.array().cast(f"array<{kind}>"))
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    with_address = F.filter(listed, lambda x: x["address"].isNotNull())
    parts = F.transform(with_address, lambda x: F.struct(*[clean(x["address"][f"address{n}"]).alias(n) for n in ("Locality", "Region", "Country")]))
    if not keep_empty:
        parts = F.filter(parts, lambda x: F.coalesce(x["Locality"], x["Region"], x["Country"]).isNotNull())

    def made(x: Column) -> Column:
        label = joined(x["Locality"], x["Region"], x["Country"])
        return place(label, is_remote_text(label), x["Locality"], x["Region"], x["Country"])

    return F.transform(parts, made)


def jsonld_pay(p: Payload) -> Column:
    def positive(path: str) -> Column:
        return F.when(F.replace(p.get(path), F.lit(","), F.lit("")).try_cast("double") > 0, F.replace(p.get(path), F.lit(","), F.lit("")).try_cast("double"))

    low, high = positive("baseSalary.value.minValue"), positive("baseSalary.value.maxValue")
    single = F.coalesce(positive("baseSalary.value.value"), positive("baseSalary.value"))
    neither = F.coalesce(p.get("baseSalary.value.minValue"), p.get("baseSalary.value.maxValue")).isNull()
    currency = F.coalesce(p.words("baseSalary.currency"), p.words("salaryCurrency"))
    return pay(F.when(neither, single).otherwise(low), F.when(neither, single).otherwise(high), currency, F.lit(None).cast("string"))


def schema_contract(p: Payload) -> Column:
    stated = F.coalesce(p.get("employmentType[0]"), p.get("employmentType"))
    return unknown(mapped(F.regexp_replace(stated, "[- ]", "_"), SCHEMA_ORG))


def schemaorg(p: Payload) -> dict[str, Column]:
    locations = jsonld_places(p, keep_empty=True)
    return {
        "source_job_id": F.coalesce(p.words("identifier.value"), p.words("identifier"), p.words("id"), p.words("url")), "company": p.words("hiringOrganization.name"), "title": p.words("title"),
        "apply_url": p.words("url"), "locations": locations, "remote": remote_if(any_remote(locations)), "employment_type": schema_contract(p), "department": p.words("occupationalCategory"),
        "salary": jsonld_pay(p), "posted_at": instant(p.words("datePosted")), "description_html": p.words("description"),
    }


def icims(p: Payload) -> dict[str, Column]:
    """Records of the newer interface, or of classic pages, which are JSON-LD (``_gen`` is "classic")."""
    classic = F.coalesce(p.get("_gen") == "classic", F.lit(False))
    city, region, country = p.words("city"), p.words("state"), p.words("country")
    raw = F.coalesce(p.words("location_name"), p.words("full_location"), joined(city, region, country))
    new = at_one(raw, is_remote_text(raw), city=city, region=region, country=country)
    locations = F.when(classic, jsonld_places(p, keep_empty=True)).otherwise(new)
    low, high = p.amount("salary_min_value"), p.amount("salary_max_value")
    none = F.lit(None).cast("string")
    return {
        "source_job_id": F.coalesce(p.words("req_id"), p.words("id")), "title": p.words("title"), "apply_url": F.coalesce(p.words("url"), p.words("apply_url")), "locations": locations,
        "remote": remote_if(any_remote(locations)),
        "employment_type": F.when(classic, schema_contract(p)).otherwise(unknown(mapped(F.regexp_replace(p.words("employment_type"), "[- ]", "_"), SCHEMA_ORG))),
        "department": F.when(~classic, F.coalesce(p.words("department"), p.words("categories[0].name"))), "salary": F.when(classic, jsonld_pay(p)).otherwise(pay(low, high, none, none)),
        "posted_at": instant(F.when(classic, p.words("datePosted")).otherwise(p.words("posted_date"))), "updated_at": F.when(~classic, instant(p.words("update_date"))), "description_html": p.words("description"),
    }


def workday(p: Payload) -> dict[str, Column]:
    raw, title, said = F.nullif(p.get("locationsText"), F.lit("")), p.get("title"), F.lower(F.trim(p.get("postedOn")))
    days = F.when(F.contains(said, F.lit("today")), 0).when(F.contains(said, F.lit("yesterday")), 1).otherwise(F.nullif(F.regexp_extract(said, r"(\d+)\s*\+?\s*days?\s+ago", 1), F.lit("")).cast("int"))
    at = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()) - F.make_dt_interval(days)
    return {
        "source_job_id": F.coalesce(p.words("bulletFields[0]"), p.words("id"), p.words("externalPath")), "title": title, "apply_url": F.coalesce(p.words("url"), p.words("externalUrl")),
        "locations": F.when(raw.isNotNull(), places(place(raw, F.lit(False)))), "remote": remote_if(is_remote_text(F.concat_ws(" ", raw, title))),
        "posted_at": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
    }


def workable_network(p: Payload) -> dict[str, Column]:
    work, city, country = F.lower(p.get("workplace")), p.words("location.city"), F.nullif(p.get("location.countryName"), F.lit(""))
    remote = F.coalesce(work == "remote", F.lit(False))
    known = F.coalesce(F.nullif(p.get("location.city"), F.lit("")), country).isNotNull()
    own = place(joined(city, country), remote, city, F.nullif(p.get("location.subregion"), F.lit("")), country)
    nowhere = place(F.lit(None).cast("string"), remote)
    host = F.regexp_replace(F.lower(F.split_part(F.element_at(F.split(p.words("company.website"), "//"), -1), F.lit("/"), F.lit(1))), r"^www\.", "")
    return {
        "source_job_id": p.get("id"), "company": F.coalesce(p.get("company.title"), p.get("company.name")), "company_domain": F.nullif(host, F.lit("")), "title": F.trim(p.get("title")),
        "description_html": p.get("description"), "locations": F.when(known, places(own)).when(remote, places(nowhere)), "remote": unknown(mapped(work, {**WORKPLACE, "on_site": "onsite"})),
        "employment_type": unknown(mapped(p.get("employmentType"), NETWORK)), "apply_url": F.coalesce(F.nullif(p.get("url"), F.lit("")), p.get("linkoutUrl")), "posted_at": instant(p.get("created")),
    }


def personio(p: Payload) -> dict[str, Column]:
    offices = F.filter(F.concat(F.array(p.get("office")), p.items("additionalOffices", "string")), lambda o: F.coalesce(o, F.lit("")) != "")
    locations = F.transform(offices, lambda o: place(o, is_remote_text(o)))
    sections = F.transform(
        p.items("jobDescriptions", "struct<name:string,value:string>"),
        lambda s: F.concat_ws("\n", F.when(F.coalesce(s["name"], F.lit("")) != "", F.concat(F.lit("<h3>"), s["name"], F.lit("</h3>"))), F.nullif(s["value"], F.lit(""))),
    )
    html = F.nullif(F.array_join(F.filter(sections, lambda s: s != ""), "\n"), F.lit(""))
    said = F.lower(p.words("yearsOfExperience"))
    numbers = F.regexp_extract_all(said, F.lit(r"\d+"), F.lit(0))
    first, second = F.get(numbers, 0).cast("int"), F.get(numbers, 1).cast("int")
    under, over = F.startswith(said, F.lit("lt")), F.startswith(said, F.lit("gt"))
    return {
        "source_job_id": p.get("id"), "title": p.get("name"), "locations": locations, "remote": remote_if(any_remote(locations)), "employment_type": unknown(mapped(p.get("employmentType"), PERSONIO)),
        "apply_url": F.when(p.words("id").isNotNull(), F.concat(F.lit("https://"), F.coalesce(p.words("token"), p.words("company")), F.lit(".jobs.personio.de/job/"), p.words("id"))),
        "department": F.nullif(p.get("department"), F.lit("")), "level": level_from_stated(p.get("seniority")),
        "years_experience_min": F.when(under, 0).otherwise(first), "years_experience_max": F.when(under, 1).when(over, F.lit(None)).otherwise(F.coalesce(second, first)),
        "salary": pay(p.amount("salaryInformation.min"), p.amount("salaryInformation.max"), F.upper(p.words("salaryInformation.currencyCode")), mapped(p.get("salaryInformation.type"), FREQUENCIES)),
        "posted_at": instant(p.get("createdAt")), "description_html": html, "description_text": plain_of(html),
    }


def join(p: Payload) -> dict[str, Column]:
    city, country, iso = p.words("city.cityName"), p.words("city.countryName"), p.words("country.iso3166")

    def major(path: str) -> Column:
        """An amount that is given in cents, where the currency has some."""
        return p.amount(f"{path}.amount") / F.when(F.upper(p.words(f"{path}.currency")).isin(*WITHOUT_CENTS), 1.0).otherwise(100.0)

    currency = F.coalesce(F.nullif(p.get("salaryAmountFrom.currency"), F.lit("")), F.nullif(p.get("salaryAmountTo.currency"), F.lit("")))
    known = F.coalesce(city, country, iso).isNotNull()
    return {
        "source_job_id": F.coalesce(p.words("idParam"), p.words("id")), "title": p.get("title"), "apply_url": p.words("url"),
        "locations": F.when(known, places(place(joined(city, country), F.lit(False), city, country=F.coalesce(country, iso)))), "remote": unknown(mapped(p.get("workplaceType"), {**WORKPLACE, "on_site": "onsite"})),
        "employment_type": unknown(mapped(p.get("employmentType.name"), JOIN)), "department": F.nullif(p.get("category.name"), F.lit("")),
        "salary": pay(major("salaryAmountFrom"), major("salaryAmountTo"), currency, mapped(p.get("salaryFrequency"), JOIN_FREQUENCIES)), "posted_at": instant(p.get("createdAt")),
    }


def listed(p: Payload) -> dict[str, Column]:
    """Rows of a rendered list of jobs: title, place and address are all there is."""
    return {"source_job_id": p.words("id"), "title": p.get("title"), "apply_url": p.words("url")} | labelled(p.words("location"))


def taleo(p: Payload) -> dict[str, Column]:
    """Rows of the newer lists are arrays of columns, whose numbers the row tells; older ones (``_ftl``) have names."""
    older, cells = F.coalesce(p.get("_ftl", "boolean"), F.lit(False)), p.items("column", "string")
    cell = lambda k: F.when(k >= 0, F.get(cells, k))
    coded = F.trim(cell(p.get("locationsColumns[0]", "int")))
    parsed = F.try_variant_get(F.try_parse_json(coded), "$", "array<string>")
    label = F.coalesce(F.array_join(F.filter(F.transform(parsed, lambda x: F.trim(x)), lambda x: x != ""), ", "), F.try_variant_get(F.try_parse_json(coded), "$", "string"), coded)
    raw = F.nullif(F.when(older, p.get("location")).otherwise(label), F.lit(""))
    posted = F.when(older, p.get("posted")).otherwise(F.try_element_at(cells, F.lit(-1)))
    title = F.when(older, p.get("title")).otherwise(F.trim(cell(p.get("linkedColumn", "int"))))
    return {"source_job_id": F.coalesce(p.words("jobId"), p.words("contestNo"), p.words("id")), "title": title, "apply_url": p.words("url"), "posted_at": day(posted, *TALEO_DATES)} | labelled(raw)


def taleobe(p: Payload) -> dict[str, Column]:
    said = F.lower(p.words("employment_type"))
    kind = F.lit(None).cast("string")
    for pattern, value in reversed(TALEO_BUSINESS):
        kind = F.when(F.regexp_like(said, F.lit(pattern)), value).otherwise(kind)
    whole = F.regexp_like(said, F.lit(rf"^{TALEO_WORD}(?:[\s/,&-]+{TALEO_WORD})*$"))
    return listed(p) | {"employment_type": unknown(F.when(whole, kind)), "department": F.nullif(p.get("department"), F.lit(""))}


def jazzhr(p: Payload) -> dict[str, Column]:
    city, region, country, title = (p.words(x) for x in ("city", "state", "country", "title"))
    raw = joined(city, region, country)
    far = is_remote_text(F.concat_ws(" ", raw, title))
    stamp = F.nullif(F.regexp_extract(p.get("id"), r"(?i)job_(\d{14})_", 1), F.lit(""))
    return {
        "source_job_id": p.get("id"), "title": title, "apply_url": p.words("url"), "locations": F.when(raw.isNotNull(), places(place(raw, far, city, region, country))), "remote": remote_if(far),
        "employment_type": unknown(mapped(p.get("type"), JAZZ)), "department": p.words("department"), "level": level_from_stated(p.get("experience")), "posted_at": day(stamp, "yyyyMMddHHmmss"),
        "description_html": p.words("description"),
    }


def dug(p: Payload, path: Column) -> Column:
    """The text at a dotted path that the payload itself names; numbers count into lists."""
    steps = F.concat(F.lit("$"), F.regexp_replace(F.concat(F.lit("."), path), r"\.(\d+)(?=\.|$)", "[$1]"))
    return F.call_function("get_json_object", F.to_json(p.v), steps)


def brassring(p: Payload) -> dict[str, Column]:
    named = lambda path, other: F.coalesce(F.nullif(F.trim(dug(p, F.lower(p.words(path)))), F.lit("")), *[p.words(o) for o in other])
    title_field = F.coalesce(F.lower(p.words("_fields.JobTitle")), F.lit("jobtitle"))
    extra = F.transform(F.filter(p.items("_fields.Position3", "string"), lambda n: ~F.lower(n).isin("department", "reqid", "autoreq", "jobtitle") & (F.lower(n) != title_field)), lambda n: F.lower(n))
    own = F.transform(extra, lambda n: F.nullif(F.trim(F.call_function("get_json_object", F.to_json(p.v), F.concat(F.lit("$."), n))), F.lit("")))
    label = F.nullif(F.array_join(F.array_distinct(F.array_compact(F.concat(own, F.array(*[p.words(n) for n in BRASSRING_PLACES])))), ", "), F.lit(""))
    return {
        "source_job_id": F.coalesce(p.words("reqid"), p.words("id")), "title": named("_fields.JobTitle", ["jobtitle"]), "apply_url": p.words("url"), "department": p.words("department"),
        "updated_at": day(F.substring(p.words("lastupdated"), 1, 11), "d-MMM-yyyy"), "description_html": named("_fields.Summary", ["jobdescription", "formtext3"]),
    } | labelled(label)


def apicapture(p: Payload) -> dict[str, Column]:
    """Records of captured interfaces; ``_spec`` in the record says where its fields are, as dotted paths."""
    at = lambda name, default=None: F.nullif(F.trim(dug(p, F.coalesce(p.words(f"_spec.{name}"), F.lit(default)))), F.lit(""))
    found = at("location")
    inner = F.try_parse_json(found)
    first = F.coalesce(F.try_variant_get(inner, "$[0]", "variant"), inner)
    names = [F.try_variant_get(first, f"$.{n}", "string") for k in ("city", "name", "state", "country") for n in (f"{k}.name", k, f"{k.title()}.name", k.title())]
    plain = lambda c: F.when(~F.startswith(c, F.lit("{")), F.nullif(F.trim(c), F.lit("")))
    composed = F.coalesce(F.try_variant_get(first, "$.en_name", "string"), F.nullif(F.array_join(F.array_distinct(F.array_compact(F.array(*[plain(n) for n in names]))), ", "), F.lit("")))
    raw = F.when(F.regexp_like(found, F.lit(r"^[\[{]")), F.coalesce(composed, F.try_variant_get(inner, "$[0]", "string"))).otherwise(found)
    title = F.regexp_replace(text.unescape_basic(at("title", "title")), r"(?i)^(?:```+\s*\w*|plaintext|markdown|text)\s*[\r\n]+", "")
    return {
        "source_job_id": F.coalesce(at("id", "id"), p.words("id")), "title": F.trim(F.btrim(title, F.lit("`"))), "apply_url": F.coalesce(at("url", "url"), p.words("url")), "department": at("department"),
        "employment_type": unknown(mapped(F.replace(at("employment_type"), F.lit(" "), F.lit("_")), CAPTURED)), "posted_at": day(F.substring(at("posted_at"), 1, 10), "yyyy-MM-dd"),
        "description_html": at("description"),
    } | labelled(raw)


def peopleadmin(p: Payload) -> dict[str, Column]:
    return {"source_job_id": p.words("id"), "title": p.get("title"), "apply_url": p.words("url"), "department": p.words("department"), "posted_at": instant(p.words("published")), "description_html": p.words("description")}


def peopleclick(p: Payload) -> dict[str, Column]:
    title = F.coalesce(p.words("FLD_JP_POSTING_TITLE"), p.words("JPM_TITLE"))
    return {"source_job_id": F.coalesce(p.words("JPM_ID"), p.words("id")), "title": title, "apply_url": p.words("url"), "department": p.words("FLD_JP_DEPARTMENT")} | labelled(p.words("JPM_LOCATION"))


def jobdiva(p: Payload) -> dict[str, Column]:
    names = F.array_distinct(F.filter(F.transform(F.concat(F.array(p.get("location")), p.items("otherLocations", "string")), lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != ""))
    said = F.lower(F.coalesce(p.get("workingRemote"), F.lit("")))
    has = lambda *words: F.regexp_like(said, F.lit("|".join(words)))
    far = has("remote") | said.isin("yes", "y", "true", "1")
    return {
        "source_job_id": p.words("id"), "title": p.get("title"), "apply_url": p.words("url"), "locations": F.transform(names, lambda n: place(n, is_remote_text(n))),
        "remote": F.when(has("hybrid"), "hybrid").when(far, "remote").when(has("onsite", "on-site") | said.isin("no", "n", "false", "0"), "onsite").otherwise("unknown"),
        "posted_at": instant(p.words("postDate")), "description_html": p.words("jobDescription"),
    }


def zwayam(p: Payload) -> dict[str, Column]:
    raw = F.coalesce(p.words("location"), p.words("locationSeparatedbySlash"))
    far = raw.isNotNull() & is_remote_text(F.concat_ws(" ", raw, p.get("workMode")))
    return {
        "source_job_id": F.coalesce(p.words("jobId"), p.words("id")), "title": F.coalesce(p.words("jobTitle"), p.words("designation")), "apply_url": p.words("url"), "locations": at_one(raw, far),
        "remote": remote_if(far), "department": F.coalesce(p.words("departmentName"), p.words("jobFunction")),
    }


def ceipal(p: Payload) -> dict[str, Column]:
    raw = joined(*[p.words(x) for x in ("city", "state", "country")])
    far = F.coalesce(p.get("remote_opportunities") == "1", F.lit(False)) | F.coalesce(is_remote_text(raw), F.lit(False))
    return {
        "source_job_id": F.coalesce(p.words("job_code"), p.words("id")), "title": F.coalesce(p.words("position_title"), p.words("public_job_title")), "apply_url": p.words("url"),
        "locations": F.when(raw.isNotNull(), places(place(raw, far))), "remote": remote_if(far), "department": p.words("job_code"),
    }


def radancy(p: Payload) -> dict[str, Column]:
    return listed(p) | {"department": F.nullif(p.get("category"), F.lit(""))}


def pageup(p: Payload) -> dict[str, Column]:
    parts = F.filter(F.transform(F.split(p.words("location"), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    said = F.lower(F.coalesce(p.get("work_type"), F.lit("")))
    kind = F.lit("unknown")
    for word, value in reversed(PAGEUP):
        kind = F.when(F.contains(said, F.lit(word)), value).otherwise(kind)
    feed_date = lambda path: F.coalesce(instant(p.words(path)), day(F.regexp_replace(p.words(path), "^[A-Za-z]{3}, ", ""), "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z"))
    return {
        "source_job_id": p.words("id"), "title": p.get("title"), "apply_url": p.words("url"), "employment_type": kind, "posted_at": F.coalesce(feed_date("updated"), feed_date("pub_date")),
        "department": F.coalesce(F.nullif(p.get("department"), F.lit("")), F.nullif(p.get("category"), F.lit(""))), "description_html": p.get("description_html"),
        "description_text": p.get("description_text"),
    } | labelled(F.nullif(F.array_join(parts, ", "), F.lit("")))


def peoplesoft(p: Payload) -> dict[str, Column]:
    return listed(p) | {"department": F.nullif(p.get("department"), F.lit("")), "posted_at": day(p.words("posted"), "M/d/yyyy", "yyyy-MM-dd", "d-MMM-yyyy", "MMM d, yyyy")}


def dayforce(p: Payload) -> dict[str, Column]:
    city, region = p.words("postingLocations[0].cityName"), p.words("postingLocations[0].stateCode")
    raw = F.coalesce(p.words("postingLocations[0].formattedAddress"), joined(city, region))
    return {
        "source_job_id": F.coalesce(p.words("jobPostingId"), p.words("id")), "title": p.get("jobTitle"), "apply_url": p.words("url"), "remote": remote_if(p.get("hasVirtualLocation", "boolean")),
        "locations": F.when(raw.isNotNull(), places(place(raw, F.lit(False), city, region))), "posted_at": instant(p.words("postingStartTimestampUTC")), "description_html": F.when(p.words("jobDescription").isNotNull(), p.get("jobDescription")),
    }


def paycom(p: Payload) -> dict[str, Column]:
    raw, said = p.words("locations"), F.lower(F.coalesce(p.get("remoteType"), F.lit("")))
    far = F.coalesce(is_remote_text(raw), F.lit(False)) | F.contains(said, F.lit("remote"))
    two = F.contains(raw, F.lit(","))
    head, last = F.regexp_replace(raw, ",[^,]*$", ""), F.trim(F.element_at(F.split(raw, ","), -1))
    city = F.when(two, F.nullif(F.trim(F.element_at(F.split(head, "-"), -1)), F.lit("")))
    region = F.when(two, F.nullif(F.split_part(last, F.lit(" "), F.lit(1)), F.lit("")))
    return {
        "source_job_id": F.coalesce(p.words("jobId"), p.words("id")), "title": F.trim(p.get("jobTitle")), "apply_url": p.words("url"),
        "locations": F.when(raw.isNotNull(), places(place(raw, far, city, region))), "remote": F.when(far, "remote").when(F.contains(said, F.lit("hybrid")), "hybrid").otherwise("unknown"),
        "employment_type": unknown(mapped(p.get("positionType"), PAYCOM)), "description_html": F.when(p.words("description").isNotNull(), p.get("description")),
    }


for _rule in (
    schemaorg, icims, workday, workable_network, personio, join, taleo, taleobe, jazzhr, brassring, apicapture, peopleadmin, peopleclick, jobdiva, zwayam, ceipal, radancy, pageup, peoplesoft, dayforce, paycom,
):
    register(_rule.__name__, _rule)
for _name in ("successfactors", "avature", "jobvite", "ripplehire"):
    register(_name, listed)
