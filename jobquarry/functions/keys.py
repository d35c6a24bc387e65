"""Derived keys and fingerprints as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that don't tell companies apart, and words of titles that speak of grade, not of role.
COMPANY_STOPWORDS = (
    "inc", "incorporated", "llc", "ltd", "limited", "gmbh", "corp", "corporation", "co", "company", "plc", "ag", "sa", "sas", "bv", "srl", "oy", "ab", "pty", "holdings", "the",
)
TITLE_STOPWORDS = ("senior", "sr", "snr", "junior", "jr", "jnr", "lead", "principal", "staff", "mid", "entry", "level", "i", "ii", "iii", "iv", "the", "a", "an")


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9; ``&`` reads as the word "and"."""
    spaced = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("&"), F.lit(" and "))
    return F.filter(F.split(F.regexp_replace(spaced, "[^a-z0-9]+", " "), " "), lambda t: t != "")


def _without(text: Column, stop: tuple[str, ...]) -> Column:
    own = tokens(text)
    kept = F.filter(own, lambda t: ~t.isin(*stop))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(own), " ")


def company_key(company: Column) -> Column:
    """A company's name without legal forms; if nothing else is left, with them."""
    return _without(company, COMPANY_STOPWORDS)


def company_key_of(company: str) -> str:
    """The same of a known name."""
    own = re.findall("[a-z0-9]+", company.lower().replace("&", " and "))
    return " ".join([t for t in own if t not in COMPANY_STOPWORDS] or own)


def role_family(title: Column) -> Column:
    """A title without words of seniority; if nothing else is left, with them."""
    return _without(title, TITLE_STOPWORDS)


def posting_id(source: Column, source_job_id: Column) -> Column:
    return F.substring(F.sha1(F.concat(source, F.lit(":"), source_job_id)), 1, 16)


def python_float(x: Column) -> Column:
    """A double as Python prints it (``120000.0``, ``1e+16``, ``None``), for hashes that have such text inside."""
    whole = F.abs(x) < 1e16
    digits = F.when((x == F.floor(x)) & whole, F.concat(F.format_string("%.0f", x), F.lit(".0")))
    # Shortest digits come from the cast; scientific notation is rewritten where Python would not use it.
    text = x.cast("string")
    mantissa, exponent = F.split_part(text, F.lit("E"), F.lit(1)), F.split_part(text, F.lit("E"), F.lit(2))
    e = F.try_to_number(exponent, F.lit("S999")).cast("int")
    sign = F.when(x < 0, "-").otherwise("")
    all_digits = F.regexp_replace(mantissa, "[-.]", "")
    plain_large = F.concat(sign, F.substr(all_digits, F.lit(1), e + 1), F.lit("."), F.substr(F.rpad(all_digits, 40, "0"), e + 2, F.greatest(F.length(all_digits) - e - 1, F.lit(1))))
    plain_small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -e - 1), F.regexp_replace(all_digits, "0$", ""))
    science = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.when(e < 0, "e-").otherwise("e+"), F.when(F.abs(e) < 10, F.concat(F.lit("0"), F.abs(e).cast("string"))).otherwise(F.abs(e).cast("string")))
    made = F.when(~F.contains(text, F.lit("E")), text).when(e.between(0, 15), plain_large).when(e.between(-4, -1), plain_small).otherwise(science)
    return F.coalesce(digits, made, F.lit("None"))


def location_text(location: Column) -> Column:
    """City, region and country that are there, joined by commas; else the raw text."""
    parts = F.filter(F.array(location["city"], location["region"], location["country"]), lambda p: p.isNotNull() & (p != ""))
    return F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise(F.coalesce(location["raw"], F.lit("")))


def content_hash(company: Column, title: Column, level: Column, location: Column, salary: Column) -> Column:
    """What makes a posting the same opening: company, role, level, first location, pay. ``location`` is text."""
    money = F.concat_ws("|", python_float(salary["min_amount"]), python_float(salary["max_amount"]), F.coalesce(salary["currency"], F.lit("None")))
    basis = F.concat_ws("|", company_key(company), role_family(title), level, F.lower(F.coalesce(location, F.lit(""))), F.when(salary.isNotNull(), money).otherwise(""))
    return F.substring(F.sha1(basis), 1, 16)


def enrich_hash(content: Column, body: Column) -> Column:
    """``content`` with the normalised body: whether enrichment would read the same."""
    return F.substring(F.sha1(F.concat_ws("|", content, body)), 1, 16)


def vector_signature(content: Column, description: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", content, F.coalesce(description, F.lit("")))), 1, 16)


def detail_signature(content: Column, title: Column, level: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(F.nullif(content, F.lit("")), F.concat_ws("|", F.coalesce(title, F.lit("")), F.coalesce(level, F.lit("")))), 256), 1, 16)


def idset_hash(ids: Column) -> Column:
    """A fingerprint of a set of ids, whatever their order; each id ends with NUL."""
    return F.sha1(F.array_join(F.transform(F.array_sort(F.array_distinct(ids)), lambda i: F.concat(i, F.lit("\0"))), ""))


def sector_slug(sector: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(sector, F.lit(""))), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(slug == "", "unknown").otherwise(slug)


def sha1_mod(text: Column, n: int) -> Column:
    """The SHA-1 of a text, as the 160-bit number that it is, modulo ``n`` (less than 2**31). The digest is taken once and read by
    eight digits: an expression inside a lambda is evaluated at each of its uses."""
    eight = lambda digest, i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    number = lambda digest: reduce(lambda a, i: (a * 2**32 + eight(digest, i)) % n, range(5), F.lit(0).cast("long"))
    return F.transform(F.array(F.sha1(text)), number)[0]
