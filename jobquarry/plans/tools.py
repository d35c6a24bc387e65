"""The functions behind the query surfaces: search, what is new, résumé match, fit, sponsors, companies, sources; a cache of
results; and the handler of requests. They return small results to a caller; frames stay frames until then."""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import asdict, fields, replace
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobquarry.functions import extract, vectors
from jobquarry.operators import aggregates, joins
from jobquarry.plans import ranking
from jobquarry.plans.search import SearchQuery, matching, public_defaults, search

#: Rows that are fetched for a reranking: so many times the limit, and so many at least.
POOLS = {"semantic": (10, 200), "resume": (8, 120), "sponsor": (6, 100)}
#: Limits of the request handler.
LIMIT_DEFAULT, LIMIT_MOST = 20, 200
#: Days for which a sponsor's last filing counts as active.
ACTIVE_DAYS = 730


class Backend(Protocol):
    """Where postings come from: anything with a table of stored rows."""

    def jobs(self) -> DataFrame: ...


def pool_size(kind: str, limit: int) -> int:
    times, least = POOLS[kind]
    return max(times * limit, least)


def search_jobs(jobs: DataFrame, q: SearchQuery, today: str) -> DataFrame:
    """A public search: rows not confirmed for three weeks are hidden, ``LIMIT_DEFAULT`` rows unless the query says."""
    q = public_defaults(q)
    return search(jobs, q if q.limit is not None else replace(q, limit=LIMIT_DEFAULT), today)


def match_resume(jobs: DataFrame, resume: str, q: SearchQuery, today: str, vectors_of: DataFrame | None = None, resume_vector: list[float] | None = None) -> DataFrame:
    """The rows of a wide pool of matches that fit a résumé best: by cosine with its vector where there are vectors, else by
    the words of the query, or of the résumé."""
    limit = q.limit or LIMIT_DEFAULT
    pool = search(jobs, replace(public_defaults(q), limit=pool_size("resume", limit)), today)
    if vectors_of is not None and resume_vector is not None:
        own = F.array(*[F.lit(float(x)) for x in resume_vector])
        scored = pool.join(vectors_of.select("id", F.col("embedding").alias("__v")), "id", "left")
        scored = scored.withColumn("score", F.round(vectors.cosine(F.col("__v"), own), 4)).drop("__v")
    else:
        scored = ranking.bm25(pool, q.keywords or resume, (("title", 5.0), ("department", 2.0), ("company", 2.0), ("snippet", 1.0)))
    return scored.orderBy(F.coalesce("score", F.lit(0.0)).desc(), "id").limit(limit)


def assess_fit(rows: DataFrame, resume: str) -> DataFrame:
    """How a résumé's skills meet those of each row's description."""
    return rows.select("*", *[v.alias(k) for k, v in extract.fit(F.lit(resume), F.col("description_text")).items()])


def sponsor_jobs(jobs: DataFrame, sponsors: DataFrame, q: SearchQuery, today: str, min_filings: int = 0, filed_within_years: int | None = None) -> DataFrame:
    """Openings of sponsors, the strongest first: ``filings``, ``last_filed`` and whether the sponsor filed in two years
    (``sponsor_active``)."""
    limit = q.limit or LIMIT_DEFAULT
    own = replace(q, visa_sponsor=True, max_age_days=365, max_last_seen_age_days=21, limit=pool_size("sponsor", limit))
    pool = search(jobs, own, today)
    found = joins.match_sponsors(pool, sponsors).withColumn("filings", F.coalesce("filings", F.lit(0)))
    if "visa_last_filed" in jobs.columns:
        found = found.withColumn("last_filed", F.coalesce(F.col("last_filed").cast("string"), "visa_last_filed"))
    day = F.lit(today).cast("date")
    kept = found.where(F.col("filings") >= min_filings)
    if filed_within_years:
        kept = kept.where(F.col("last_filed").cast("date") >= F.date_sub(day, 365 * filed_within_years))
    kept = kept.withColumn("sponsor_active", F.coalesce(F.col("last_filed").cast("date") >= F.date_sub(day, ACTIVE_DAYS), F.lit(False)))
    return kept.orderBy(F.desc("filings"), F.desc("posted_at"), "id").limit(limit)


def list_companies(jobs: DataFrame, contains: str | None = None, limit: int = 50) -> DataFrame:
    """Companies with most open roles, of a name if one is given."""
    rows = jobs.where("status = 'active'")
    if contains:
        rows = rows.where(F.contains(F.lower("company"), F.lit(contains.lower())))
    return aggregates.count_by(rows, "company_key", limit)


def list_sources(jobs: DataFrame) -> DataFrame:
    return aggregates.count_by(jobs.where("status = 'active'"), "source")


def keyword_substrings(rows: DataFrame, q: SearchQuery, columns: tuple[str, ...] = ("title", "department", "company", "description_text")) -> DataFrame:
    """The object path of keywords: each word of the query stands somewhere in the row's texts, also within words."""
    hay = F.lower(F.concat_ws(" ", *columns))
    for word in (q.keywords or "").lower().split():
        rows = rows.where(F.contains(hay, F.lit(word)))
    return rows


class ResultCache:
    """Results by canonical query: kept for ``ttl`` seconds, the least used go first, and callers that ask for the same at the
    same time share one run."""

    def __init__(self, size: int = 256, ttl: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.size, self.ttl, self.clock = size, ttl, clock
        self.held: OrderedDict[str, tuple[float, object]] = OrderedDict()
        self.running: dict[str, threading.Event] = {}
        self.lock = threading.Lock()

    @staticmethod
    def key(request: dict, build: str) -> str:
        """The same for requests that mean the same, another one for each build."""
        canonical = json.dumps({k: v for k, v in request.items() if v is not None}, sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(f"{build}\n{canonical}".encode()).hexdigest()[:32]

    def get(self, key: str, compute: Callable[[], object]) -> object:
        while True:
            with self.lock:
                if key in self.held and self.clock() - self.held[key][0] <= self.ttl:
                    self.held.move_to_end(key)
                    return self.held[key][1]
                waiting = self.running.get(key)
                if waiting is None:
                    self.running[key] = threading.Event()
            if waiting is None:
                break
            waiting.wait()
        try:
            value = compute()
            with self.lock:
                self.held[key] = (self.clock(), value)
                self.held.move_to_end(key)
                while len(self.held) > self.size:
                    self.held.popitem(last=False)
            return value
        finally:
            with self.lock:
                self.running.pop(key).set()


def handle(request: dict, jobs: DataFrame, today: str, build: str, cache: ResultCache, etag: str | None = None) -> tuple[int, dict]:
    """Answers a request for ``/jobs`` as (status, body): 400 for fields that are unknown or of a wrong type, 501 for
    semantic search, 304 if the caller has the answer already."""
    if request.get("semantic"):
        return 501, {"error": "semantic search is not served here"}
    known = {f.name: f for f in fields(SearchQuery)}
    if unknown := sorted(set(request) - set(known) - {"semantic"}):
        return 400, {"error": f"unknown fields: {', '.join(unknown)}"}
    limit = request.get("limit", LIMIT_DEFAULT)
    if not isinstance(limit, int) or isinstance(limit, bool) or limit < 1:
        return 400, {"error": "limit must be a positive number"}
    q = SearchQuery(**{k: v for k, v in request.items() if k in known and k != "limit"}, limit=min(limit, LIMIT_MOST))
    key = cache.key(asdict(q), build)
    if etag == key:
        return 304, {}

    def run() -> dict:
        rows = [r.asDict(recursive=True) for r in search_jobs(jobs, q, today).collect()]
        return {"count": len(rows), "jobs": rows, "build_id": build, "etag": key}

    return 200, cache.get(key, run)


def health(jobs: DataFrame, build: str) -> dict:
    return {"status": "ok", "build_id": build, "rows": jobs.count()}


def whole(jobs: DataFrame, q: SearchQuery, today: str) -> DataFrame:
    """All matches in no order, for callers that go on with frames."""
    return matching(jobs, q, today)
