"""The typed query: filters that compile to one predicate over stored rows, and the orders of results."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobquarry.functions import keys, stem
from jobquarry.schemas import DEGREES

# Names of one city, and other names of countries.
CITY_GROUPS = (
    ("new york", "new york city", "nyc", "manhattan", "brooklyn", "queens", "the bronx", "bronx", "staten island"),
    ("san francisco", "sf"),
    ("washington", "washington dc", "washington d.c.", "dc"),
    ("los angeles", "l.a."),
)
COUNTRY_ALIASES = {
    "us": "united states", "usa": "united states", "u.s.": "united states", "u.s.a.": "united states", "united states of america": "united states",
    "uk": "united kingdom", "u.k.": "united kingdom", "england": "united kingdom", "scotland": "united kingdom", "uae": "united arab emirates",
}
#: Words between the first and the last term of a proximity match, at most.
NEAR = 10
FTS_COLUMNS = ("title", "company", "department", "snippet")


@dataclass(frozen=True)
class SearchQuery:
    """Filters; ``None`` means no filter. Fields named ``include_unknown_*`` decide about rows without a value."""

    keywords: str | None = None
    location: str | None = None
    remote: bool | None = None
    employment_type: str | None = None
    level: str | None = None
    include_unknown_level: bool = False
    sector: str | None = None
    include_unknown_sector: bool = False
    visa_sponsor: bool | None = None
    sponsorship_offered: bool | None = None
    include_unknown_sponsorship: bool = True
    country: str | None = None
    city: str | None = None
    salary_min: float | None = None
    salary_max: float | None = None
    salary_currency: str | None = None
    include_unknown_salary: bool = True
    min_years: int | None = None
    max_years: int | None = None
    include_unknown_years: bool = True
    max_degree: str | None = None
    include_unknown_degree: bool = True
    posted_after: str | None = None
    max_age_days: int | None = None
    include_undated: bool = False
    max_last_seen_age_days: int | None = None
    limit: int | None = None

    def where(self, today: str) -> Column:
        """One predicate over active stored rows. ``today`` is the date that ages count from, as ISO text."""
        return reduce(lambda a, b: a & b, [F.col("status") == "active", *self._filters(today)])

    def _filters(self, today: str):
        c = F.col
        if self.remote is True:
            yield c("remote").isin("remote", "hybrid") | F.contains(F.lower("location"), F.lit("remote"))
        if self.employment_type:
            yield c("employment_type").isin(self.employment_type, "unknown")
        if self.level:
            yield c("level").isin(*({self.level, "unknown"} if self.include_unknown_level else {self.level}))
        if self.sector:
            own = F.contains(F.lower("sector"), F.lit(self.sector.lower()))
            yield own | c("sector").isNull() if self.include_unknown_sector else own
        if self.country:
            term = country_term(self.country)
            yield (F.lower("country") == term) | F.contains(F.lower("location"), F.lit(term))
        if self.city:
            yield F.trim(F.lower("city")).isin(*city_terms(self.city))
        if self.location:
            yield F.contains(F.lower("location"), F.lit(self.location.lower()))
        if self.visa_sponsor is True:
            yield c("visa_sponsor") == F.lit(True)
        if self.sponsorship_offered is not None:
            own = c("sponsorship_offered") == F.lit(self.sponsorship_offered)
            yield own | c("sponsorship_offered").isNull() if self.include_unknown_sponsorship else own
        yield from _overlap("salary_min", "salary_max", self.salary_min, self.salary_max, self.include_unknown_salary)
        if self.salary_currency and (self.salary_min is not None or self.salary_max is not None):
            yield c("salary_currency").isNull() | (F.upper("salary_currency") == self.salary_currency.upper())
        yield from _overlap("years_min", "years_max", self.min_years, self.max_years, self.include_unknown_years)
        if self.max_degree:
            own = c("degree_min").isin(*DEGREES[: DEGREES.index(self.max_degree) + 1])
            yield own | c("degree_min").isNull() if self.include_unknown_degree else own
        if self.posted_after:
            yield c("posted_at").isNull() | (c("posted_at") >= self.posted_after)
        if self.max_age_days is not None:
            fresh = latest_activity()
            own = fresh >= days_before(today, self.max_age_days)
            yield own | (fresh == "") if self.include_undated else own
        if self.max_last_seen_age_days is not None:
            yield c("last_seen") >= days_before(today, self.max_last_seen_age_days)


def latest_activity() -> Column:
    """The later of the two dates of a posting, as text; empty if it has none."""
    return F.greatest(F.coalesce("posted_at", F.lit("")), F.coalesce("updated_at", F.lit("")))


def days_before(today: str, days: int) -> Column:
    return F.date_sub(F.lit(today).cast("date"), days).cast("string")


def _overlap(low: str, high: str, at_least, at_most, unknown: bool):
    """A range of the row meets the wanted one; a missing bound is the other one."""
    none = F.col(low).isNull() & F.col(high).isNull()
    for bound, own in ((at_least, lambda: F.coalesce(high, low) >= F.lit(at_least)), (at_most, lambda: F.coalesce(low, high) <= F.lit(at_most))):
        if bound is not None:
            yield none | own() if unknown else own()


def city_terms(city: str) -> tuple[str, ...]:
    own = city.lower().strip()
    return next((g for g in CITY_GROUPS if own in g), (own,))


def country_term(country: str) -> str:
    own = country.strip().lower()
    return COUNTRY_ALIASES.get(own, own)


def query_terms(keywords: str | None) -> list[str]:
    return re.findall(r"[a-z0-9]+", (keywords or "").lower())


def keyword_predicate(terms: list[str], columns: dict[str, Column]) -> Column | None:
    """Retrieval by keywords over token arrays. One or two terms: each occurs in some column. Three and more: all in
    order next to each other in one column, or all within ``NEAR`` words there; from five on, any term is enough (the
    order of results then decides). No terms: no filter."""
    if not terms:
        return None
    some = lambda t: reduce(lambda a, b: a | b, [F.array_contains(c, t) for c in columns.values()])
    if len(terms) <= 2:
        return reduce(lambda a, b: a & b, [some(t) for t in terms])
    found = reduce(lambda a, b: a | b, [_phrase(c, terms) | _near(c, terms) for c in columns.values()])
    return found | reduce(lambda a, b: a | b, [some(t) for t in terms]) if len(terms) >= 5 else found


def _phrase(tokens: Column, terms: list[str]) -> Column:
    wanted = F.array(*[F.lit(t) for t in terms])
    return (F.size(tokens) >= len(terms)) & F.exists(F.sequence(F.lit(1), F.greatest(F.size(tokens) - len(terms) + 1, F.lit(1))), lambda i: F.slice(tokens, i, len(terms)) == wanted)


def _near(tokens: Column, terms: list[str]) -> Column:
    """Whether all terms occur with at most ``NEAR`` other words between the first and the last of them. Some best
    window starts at an occurrence of a term, so windows that start there are tried."""
    need = F.array_distinct(F.array(*[F.lit(t) for t in terms]))
    size = len(terms) + NEAR
    window = lambda i: F.size(F.array_intersect(F.slice(tokens, i, size), need)) == F.size(need)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1))), lambda i: F.array_contains(need, F.get(tokens, i - 1)))
    return (F.size(F.array_intersect(tokens, need)) == F.size(need)) & F.exists(starts, window)


def matching(jobs: DataFrame, q: SearchQuery, today: str, stemmed: bool = False) -> DataFrame:
    """All rows that match, in no order. Keywords are looked for in token arrays of the rows that pass the cheap filters;
    ``stemmed``: words match by their stems, whatever their accents."""
    found = jobs.where(q.where(today))
    terms = query_terms(q.keywords)
    if not terms:
        return found
    if not stemmed:
        # Rows without the terms as pieces of their text can't hold them as words; that is cheap to see, and most rows go.
        text = F.lower(F.concat_ws(" ", *FTS_COLUMNS))
        pieces = [F.contains(text, F.lit(t)) for t in terms if t != "and"]
        if pieces:
            found = found.where(reduce(lambda a, b: a | b if len(terms) >= 5 else a & b, pieces))
        return found.where(keyword_predicate(terms, {c: keys.tokens(F.col(c)) for c in FTS_COLUMNS}))
    held = found.withColumns({f"__{c}": stem.stems(F.col(c)) for c in FTS_COLUMNS})
    match = keyword_predicate([stem.stem(t) for t in terms], {c: F.col(f"__{c}") for c in FTS_COLUMNS})
    return held.where(match).select(*jobs.columns)


def search(jobs: DataFrame, q: SearchQuery, today: str, stemmed: bool = False) -> DataFrame:
    """Rows that match: with keywords the best ones first, else newest first, undated last; ids break ties; 1000 if there
    is no limit or it is 0."""
    found = matching(jobs, q, today, stemmed)
    if query_terms(q.keywords):
        return best_first(found, jobs, q.keywords, stemmed).limit(q.limit or 1000)
    return found.orderBy(F.col("posted_at").desc_nulls_last(), "id").limit(q.limit or 1000)


#: What an occurrence counts by column, and the constants of the rank function.
RANK_WEIGHTS = {"title": 10.0, "company": 3.0, "department": 3.0, "snippet": 1.0}
RANK_K1, RANK_B = 1.2, 0.75


def best_first(found: DataFrame, jobs: DataFrame, keywords: str, stemmed: bool = False) -> DataFrame:
    """``found`` in the order of the index's rank function, scores to nine digits: BM25 over the words of a whole row, where
    an occurrence counts by its column. Statistics are those of all rows of ``jobs``, active or not: one row, so it is
    broadcast. Terms that most rows hold count next to nothing, but not less."""
    terms = list(dict.fromkeys(query_terms(keywords)))
    wanted = [stem.stem(t) for t in terms] if stemmed else terms
    read = stem.stems if stemmed else keys.tokens

    def with_tokens(rows: DataFrame) -> DataFrame:
        held = rows.withColumns({f"__{c}": read(F.col(c)) for c in RANK_WEIGHTS})
        return held.withColumn("__n", reduce(lambda a, b: a + b, [F.size(f"__{c}") for c in RANK_WEIGHTS]))

    def held_in_some(t: str) -> Column:
        return reduce(lambda a, b: a | b, [F.array_contains(f"__{c}", t) for c in RANK_WEIGHTS])

    stats = with_tokens(jobs.select(*RANK_WEIGHTS)).agg(F.count(F.lit(1)).alias("__rows"), F.avg("__n").alias("__mean"), *[F.count_if(held_in_some(t)).alias(f"__df{k}") for k, t in enumerate(wanted)])
    rows = with_tokens(found).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for k, t in enumerate(wanted):
        df = F.col(f"__df{k}")
        idf = F.greatest(F.log((F.col("__rows") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        tf = reduce(lambda a, b: a + b, [w * F.size(F.filter(f"__{c}", _equals(t))) for c, w in RANK_WEIGHTS.items()])
        score = score + idf * (tf * (RANK_K1 + 1)) / (tf + RANK_K1 * (1 - RANK_B + RANK_B * F.col("__n") / F.col("__mean")))
    ranked = rows.withColumn("__score", F.round(score, 9)).orderBy(F.desc("__score"), "id")
    return ranked.select(*found.columns)


def _equals(term: str):
    return lambda x: x == term


def whats_new(jobs: DataFrame, q: SearchQuery, since: str, today: str, include_changed: bool = False) -> DataFrame:
    """Matching rows first seen (or changed) since a date, newest first; 100 if there is no limit."""
    new = F.col("first_seen") >= since
    if include_changed:
        new = new | F.coalesce(F.col("updated_at") >= since, F.lit(False))
    return matching(jobs, q, today).where(new).orderBy(F.col("first_seen").desc_nulls_last(), F.col("posted_at").desc_nulls_last(), "id").limit(q.limit or 100)


def public_defaults(q: SearchQuery) -> SearchQuery:
    """What public surfaces add: rows not confirmed for three weeks are hidden."""
    return q if q.max_last_seen_age_days is not None else replace(q, max_last_seen_age_days=21)
