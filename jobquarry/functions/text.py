"""Text expressions: plain text from markup, cue windows, hosts, texts to embed."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{A0}]+"
SNIPPET = 300

# Public suffixes of two labels.
TWO_LEVEL = (
    "co.uk", "org.uk", "ac.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "co.in", "com.br", "com.mx", "com.sg", "com.hk", "co.za", "com.tr", "co.il", "com.cn",
)

# What marks a passage as worth reading for pay and experience.
CUE = (
    r"(?i)\$|£|€|\bUSD\b|\bEUR\b|\bGBP\b|\bCAD\b|\bAUD\b|\bsalary\b|\bcompensation\b|\bpay\b|\bOTE\b|\bbase\b|\bexperience\b|\bexperienced\b"
    r"|\b(?:\d{1,2}|one|two|three|four|five|six|seven|eight|nine|ten)\s*\+?\s*(?:years?|yrs?)\b"
)


# Letters with marks and the plain ones beneath, by rule: all up to U+024F that decompose to one letter.
_MARKED = {chr(c): d[0] for c in range(0xC0, 0x250) if len(d := "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) == 1 and d.isascii()}


def fold(text: Column) -> Column:
    """Without accents: marked letters become plain, loose marks go."""
    return F.regexp_replace(F.translate(text, "".join(_MARKED), "".join(_MARKED.values())), r"\p{M}", "")


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, SPACE, " "), "^ | $", "")


def strip_tags(html: Column) -> Column:
    """Markup without its tags, white space collapsed; case stays."""
    return collapse(F.regexp_replace(html, "<[^>]+>", " "))


def unescape_basic(text: Column) -> Column:
    """The five named references and the space; ``&amp;`` last, so nothing is decoded twice."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def snippet_source(text: Column, html: Column) -> Column:
    """The text of a posting's body: as given, else from its markup, else empty."""
    return F.coalesce(F.nullif(text, F.lit("")), strip_tags(html), F.lit(""))


def snippet(text: Column, html: Column) -> Column:
    return F.nullif(F.substring(snippet_source(text, html), 1, SNIPPET), F.lit(""))


def normalized_body(text: Column, html: Column) -> Column:
    """The body as hashes see it: collapsed and in lower case."""
    return F.lower(collapse(snippet_source(text, html)))


def host_of(url: Column) -> Column:
    """The host of a URL, without user and port, in lower case."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def registrable_domain(host: Column, per_tenant: tuple[str, ...] = ()) -> Column:
    """The part of a host under which its subdomains share a rate limit; hosts under ``per_tenant`` stay whole."""
    h = F.lower(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":.*$", ""))
    parts = F.split(h, r"\.")
    last = lambda k: F.array_join(F.slice(parts, -k, k), ".")
    short = F.when(F.size(parts) <= 2, h).when(last(2).isin(*TWO_LEVEL), last(3)).otherwise(last(2))
    kept = F.lit(False)
    for t in per_tenant:
        kept = kept | (h == t) | F.endswith(h, F.lit("." + t))
    return F.when(kept, h).otherwise(short)


def domain_candidates(host: Column) -> Column:
    """A host and its parent domains, longest first, down to two labels."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    up = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, k, n), "."))
    return F.array_distinct(F.concat(F.array(host), up))


def cue_windows(text: Column, radius: int = 250, most: int = 2000) -> Column:
    """Passages around cues, ``radius`` characters to both sides, merged where they overlap, joined by " … " and cut at
    ``most``; the head of the text if there is no cue; short texts as they are."""
    found = F.regexp_extract_all(text, F.lit(CUE), F.lit(0))
    pieces = F.slice(F.split(text, CUE, -1), F.lit(1), F.size(found))
    n = F.length(text)
    state = lambda at, spans: F.struct(at.alias("at"), spans.alias("spans"))
    none = F.array().cast("array<struct<s:int,e:int>>")

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["p"])
        end = begin + F.length(x["m"])
        s, e = F.greatest(begin - radius, F.lit(0)), F.least(end + radius, n)
        last = F.element_at(acc["spans"], -1)
        joins = (F.size(acc["spans"]) > 0) & (s <= F.get(acc["spans"], F.size(acc["spans"]) - 1)["e"])
        grown = F.concat(F.slice(acc["spans"], F.lit(1), F.size(acc["spans"]) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], e).alias("e"))))
        return state(end, F.when(joins, grown).otherwise(F.concat(acc["spans"], F.array(F.struct(s.alias("s"), e.alias("e"))))))

    spans = F.aggregate(F.arrays_zip(pieces.alias("p"), found.alias("m")), state(F.lit(0), none), add, lambda a: a["spans"])
    joined = F.array_join(F.transform(spans, lambda w: F.substr(text, w["s"] + 1, w["e"] - w["s"])), " … ")
    long = F.when(F.size(found) > 0, F.substring(joined, 1, most)).otherwise(F.substring(text, 1, radius))
    return F.when(n <= 2 * radius, text).otherwise(long)


def text_to_embed(title: Column, department: Column, body: Column, most: int = 600) -> Column:
    """Title, department and the head of the body, those that are there, joined by dashes."""
    return F.concat_ws(" — ", F.nullif(title, F.lit("")), F.nullif(department, F.lit("")), F.nullif(F.substring(body, 1, most), F.lit("")))


def salary_text(salary: Column) -> Column:
    """A salary for people: currency, one amount or an en-dash range, interval; empty without amounts."""
    lo, hi = salary["min_amount"], salary["max_amount"]
    amount = lambda x: F.format_number(F.bround(x, 0), 0)
    body = F.when(lo != hi, F.concat(amount(lo), F.lit("–"), amount(hi))).otherwise(amount(F.coalesce(lo, hi)))
    prefix = F.when(F.coalesce(salary["currency"], F.lit("")) != "", F.concat(salary["currency"], F.lit(" "))).otherwise("")
    suffix = F.when(salary["interval"].isNotNull(), F.concat(F.lit("/"), salary["interval"])).otherwise("")
    return F.when(F.coalesce(lo, hi).isNull(), "").otherwise(F.concat(prefix, body, suffix))
