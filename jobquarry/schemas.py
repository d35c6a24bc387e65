"""Types of postings: the canonical nested form that sources normalise to, and the stored flat row."""

from pyspark.sql import types as T

# Domains of the enumerated columns.
REMOTE = ("onsite", "hybrid", "remote", "unknown")
EMPLOYMENT = ("full_time", "part_time", "contract", "internship", "temporary", "other", "unknown")
INTERVALS = ("year", "month", "week", "day", "hour")
LEVELS = ("intern", "entry", "junior", "mid", "senior", "staff", "principal", "lead", "manager", "director", "executive", "unknown")
#: In rising order.
DEGREES = ("highschool", "associate", "bachelor", "master", "phd_md")


_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType()}


def struct_of(spec: str) -> T.StructType:
    """A struct from "name type" pairs; unlike Spark's own parser this needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in spec.split(","))])


LOCATION = struct_of("city string, region string, country string, raw string, is_remote boolean")
SALARY = struct_of("min_amount double, max_amount double, currency string, interval string")
PROVENANCE = struct_of("source string, source_job_id string, apply_url string, fetched_at string")

POSTING = (
    struct_of("ord long, source string, source_job_id string, company string, company_domain string, title string, description_text string, description_html string")
    .add("locations", T.ArrayType(LOCATION))
    .add("remote", "string")
    .add("employment_type", "string")
    .add("level", "string")
    .add("department", "string")
    .add("sector", "string")
    .add("salary", SALARY)
    .add("years_experience_min", "integer")
    .add("years_experience_max", "integer")
    .add("degree_min", "string")
    .add("degree_required", "boolean")
    .add("visa_sponsor", "boolean")
    .add("visa_last_filed", "string")
    .add("sponsorship_offered", "boolean")
    .add("apply_url", "string")
    .add("board_token", "string")
    .add("posted_at", "string")
    .add("updated_at", "string")
    .add("provenance", T.ArrayType(PROVENANCE))
)

#: The stored table, in column order. Dates are ISO text in UTC and compare as text.
JOBS = struct_of(
    "id string, content_hash string, enrich_hash string, company_key string, source string, company string, company_domain string, title string, department string,"
    " role_family string, location string, city string, country string, remote string, level string, employment_type string, sector string, salary_min double,"
    " salary_max double, salary_currency string, salary_interval string, salary_annual double, years_min int, years_max int, degree_min string, degree_required boolean,"
    " visa_sponsor boolean, visa_last_filed string, sponsorship_offered boolean, apply_url string, listing_url string, board_token string, posted_at string,"
    " updated_at string, closes_at string, status string, first_seen string, last_seen string, expired_at string, expiry_reason string, fetched_at string,"
    " build_id string, snippet string"
)
SCHEMA_VERSION = 3

# Columns that the slim table leaves empty, and those that change with every build.
SLIM_NULL = (
    "snippet", "department", "role_family", "company_domain", "listing_url", "board_token", "salary_annual", "years_min", "years_max", "visa_last_filed",
    "updated_at", "closes_at", "expired_at", "expiry_reason",
)
VOLATILE = ("build_id", "fetched_at", "last_seen")
