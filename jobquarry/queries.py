"""The engine's queries over the standard tables, each with SQL for the oracle where SQL can say the same.

``QUERIES`` maps names to callables of (spark, folder of tables); ``ORACLES`` has the SQL. Names start with the family:
search, rank, merge, change, rollup, join, order, fresh, text, vector, eval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobquarry.functions import extract, keys, text, vectors
from jobquarry.operators import aggregates, changes, dedup, freshness, joins, ordering
from jobquarry.plans import ranking
from jobquarry.plans.search import SearchQuery, matching, search, whats_new
from jobquarry.sources.bridge import JOBS_SQL, SNAPSHOTS_SQL, TODAY, jobs, snapshots, table
from jobquarry.streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query, with its SQL; ``JOBS`` in the SQL is the posting view."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("JOBS", f"({JOBS_SQL})").replace("TODAY", TODAY)
        return f

    return add


# ---- search ---------------------------------------------------------------------------------------------------------

SHOWN = ("id", "title", "level", "sector", "salary_min", "salary_max", "posted_at")
SELECT = f"SELECT {', '.join(SHOWN)} FROM JOBS WHERE status = 'active' AND "
NEWEST = " ORDER BY posted_at DESC NULLS LAST, id LIMIT "


def _searches() -> dict[str, tuple[SearchQuery, str]]:
    """Typed queries, and what they mean in SQL."""
    q = SearchQuery
    return {
        "search_active": (q(), "TRUE"),
        "search_default_limit": (SearchQuery(limit=0), "TRUE" + NEWEST + "1000"),
        "search_remote": (q(remote=True), "(remote IN ('remote', 'hybrid') OR lower(location) LIKE '%remote%')"),
        "search_not_remote": (q(remote=False), "TRUE"),
        "search_employment": (q(employment_type="full_time"), "employment_type IN ('full_time', 'unknown')"),
        "search_level_strict": (q(level="senior"), "level = 'senior'"),
        "search_level_lenient": (q(level="mid", include_unknown_level=True), "level IN ('mid', 'unknown')"),
        "search_sector_strict": (q(sector="Mach"), "lower(sector) LIKE '%mach%'"),
        "search_sector_lenient": (q(sector="build", include_unknown_sector=True), "(lower(sector) LIKE '%build%' OR sector IS NULL)"),
        "search_country": (q(country="Asia"), "(lower(country) = 'asia' OR lower(location) LIKE '%asia%')"),
        "search_city": (q(city=" NATION_3"), "trim(lower(city)) IN ('nation_3')"),
        "search_location": (q(location="EURO"), "lower(location) LIKE '%euro%'"),
        "search_visa": (q(visa_sponsor=True), "visa_sponsor"),
        "search_sponsorship": (q(sponsorship_offered=True), "(sponsorship_offered OR sponsorship_offered IS NULL)"),
        "search_sponsorship_strict": (q(sponsorship_offered=False, include_unknown_sponsorship=False), "NOT sponsorship_offered"),
        "search_salary": (
            q(salary_min=150000.0, salary_max=300000.0, salary_currency="usd"),
            "((salary_min IS NULL AND salary_max IS NULL) OR coalesce(salary_max, salary_min) >= 150000) AND ((salary_min IS NULL AND salary_max IS NULL) OR coalesce(salary_min, salary_max) <= 300000)"
            " AND (salary_currency IS NULL OR upper(salary_currency) = 'USD')",
        ),
        "search_salary_strict": (q(salary_min=200000.0, include_unknown_salary=False), "coalesce(salary_max, salary_min) >= 200000"),
        "search_years": (
            q(min_years=3, max_years=5),
            "((years_min IS NULL AND years_max IS NULL) OR coalesce(years_max, years_min) >= 3) AND ((years_min IS NULL AND years_max IS NULL) OR coalesce(years_min, years_max) <= 5)",
        ),
        "search_degree": (q(max_degree="bachelor"), "(degree_min IN ('highschool', 'associate', 'bachelor') OR degree_min IS NULL)"),
        "search_degree_strict": (q(max_degree="master", include_unknown_degree=False), "degree_min IN ('highschool', 'associate', 'bachelor', 'master')"),
        "search_posted_after": (q(posted_after="1999-06-01"), "(posted_at IS NULL OR posted_at >= '1999-06-01')"),
        "search_max_age": (q(max_age_days=400), "greatest(coalesce(posted_at, ''), coalesce(updated_at, '')) >= strftime(DATE 'TODAY' - INTERVAL 400 DAY, '%Y-%m-%d')"),
        "search_max_age_undated": (
            q(max_age_days=400, include_undated=True),
            "(greatest(coalesce(posted_at, ''), coalesce(updated_at, '')) >= strftime(DATE 'TODAY' - INTERVAL 400 DAY, '%Y-%m-%d') OR (posted_at IS NULL AND updated_at IS NULL))",
        ),
        "search_last_seen": (q(max_last_seen_age_days=21), "last_seen >= strftime(DATE 'TODAY' - INTERVAL 21 DAY, '%Y-%m-%d')"),
        "search_two_terms": (
            q(keywords="Data engineer"),
            "regexp_matches(' ' || regexp_replace(lower(concat_ws(' ', title, company, department, snippet)), '[^a-z0-9]+', ' ', 'g') || ' ', ' data ')"
            " AND regexp_matches(' ' || regexp_replace(lower(concat_ws(' ', title, company, department, snippet)), '[^a-z0-9]+', ' ', 'g') || ' ', ' engineer ')",
        ),
        "search_phrase": (q(keywords="sales development representative"), "lower(title) LIKE '%sales development representative%'"),
        "search_near": (q(keywords="scientist research associate"), "lower(title) LIKE '%research associate scientist%'"),
        "search_many_terms": (
            q(keywords="nurse pilot principal chef warehouse"),
            "regexp_matches(lower(title), '(^|[^a-z0-9])(nurse|pilot|principal|chef|warehouse)([^a-z0-9]|$)')",
        ),
        "search_combined": (
            SearchQuery(sector="mach", salary_min=100000.0, level="senior", include_unknown_level=True, posted_after="1997-01-01", limit=20),
            "lower(sector) LIKE '%mach%' AND level IN ('senior', 'unknown') AND ((salary_min IS NULL AND salary_max IS NULL) OR coalesce(salary_max, salary_min) >= 100000)"
            " AND (posted_at IS NULL OR posted_at >= '1997-01-01')" + NEWEST + "20",
        ),
    }


def _register_searches() -> None:
    for name, (q, where) in _searches().items():

        def run(spark: SparkSession, sf_dir: str, q=q) -> DataFrame:
            found = matching if q.limit is None else search
            return found(jobs(spark, sf_dir), q, TODAY).select(*SHOWN)

        run.__name__ = name
        query(SELECT + where)(run)


_register_searches()


@query(SELECT + "regexp_matches(lower(concat_ws(' ', title, company, department, snippet)), '(^|[^a-z0-9])engineer(s|ing)?([^a-z0-9]|$)') AND regexp_matches(lower(concat_ws(' ', title, company, department, snippet)), '(^|[^a-z0-9])data([^a-z0-9]|$)')")
def search_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(jobs(spark, sf_dir), SearchQuery(keywords="engineers data"), TODAY, stemmed=True).select(*SHOWN)


@query("SELECT id, first_seen, posted_at FROM JOBS WHERE status = 'active' AND employment_type IN ('contract', 'unknown') AND first_seen >= '2001-06-01' ORDER BY first_seen DESC, posted_at DESC NULLS LAST, id LIMIT 100")
def search_whats_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whats_new(jobs(spark, sf_dir), SearchQuery(employment_type="contract"), "2001-06-01", TODAY).select("id", "first_seen", "posted_at")


@query("SELECT id, first_seen, posted_at FROM JOBS WHERE status = 'active' AND (first_seen >= '2001-06-01' OR updated_at >= '2001-06-01') ORDER BY first_seen DESC, posted_at DESC NULLS LAST, id LIMIT 500")
def search_whats_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whats_new(jobs(spark, sf_dir), SearchQuery(limit=500), "2001-06-01", TODAY, include_changed=True).select("id", "first_seen", "posted_at")


# ---- ranking --------------------------------------------------------------------------------------------------------


def _bm25_sql(terms: list[str], fields: list[tuple[str, float]], source: str, key: str) -> str:
    toks = ", ".join(f"regexp_extract_all(lower(coalesce({f}, '')), '[a-z0-9]+') AS t_{f}" for f, _ in fields)
    stats = ", ".join(
        f"avg(CASE WHEN len(t_{f}) > 0 THEN len(t_{f}) END) AS a_{f}, " + ", ".join(f"count(*) FILTER (list_contains(t_{f}, '{t}')) AS d_{f}_{k}" for k, t in enumerate(terms)) for f, _ in fields
    )
    tf = lambda f, t: f"len(list_filter(t_{f}, lambda x: x = '{t}'))"
    part = lambda f, t, k: (
        f"CASE WHEN {tf(f, t)} > 0 THEN ln(1.0 + (n - d_{f}_{k} + 0.5) / (d_{f}_{k} + 0.5)) * ({tf(f, t)} * 2.5) / ({tf(f, t)} + 1.5 * (0.25 + 0.75 * greatest(len(t_{f}), 1) / a_{f})) ELSE 0.0 END"
    )
    total = " + ".join(f"{w} * (" + " + ".join(part(f, t, k) for k, t in enumerate(terms)) + ")" for f, w in fields)
    return f"WITH d AS (SELECT {key}, {toks} FROM {source}), s AS (SELECT count(*) AS n, {stats} FROM d) SELECT {key}, round({total}, 6) AS score FROM d, s"


@query(_bm25_sql(["data", "engineer"], [("title", 5.0), ("department", 2.0), ("company", 2.0), ("snippet", 1.0)], "JOBS", "id"))
def rank_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = (("title", 5.0), ("department", 2.0), ("company", 2.0), ("snippet", 1.0))
    return ranking.bm25(jobs(spark, sf_dir), "Data engineer data", fields).select("id", F.round("score", 6).alias("score"))


@query(_bm25_sql(["and", "the"], [("text", 1.0), ("source", 2.0)], "documents", "doc_id"))
def rank_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.bm25(table(spark, sf_dir, "documents"), "the and", (("text", 1.0), ("source", 2.0))).select("doc_id", F.round("score", 6).alias("score"))


COSINE_SQL = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 7").select("embedding").first()["embedding"]


@query(f"SELECT e.vec_id AS id, round({COSINE_SQL}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 7 ORDER BY {COSINE_SQL} DESC, e.vec_id LIMIT 25")
def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return ranking.vector_search(stored, _query_vector(spark, sf_dir), 25).select("id", F.round("score", 6).alias("score"))


@query(
    "WITH m AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x))) AS m FROM embeddings), s AS (SELECT vec_id, embedding, CASE WHEN m > 0 THEN (m::DOUBLE / 127.0::DOUBLE)::FLOAT ELSE 1.0::FLOAT END AS s FROM m)"
    " SELECT vec_id, round(s::DOUBLE, 9) AS scale, list_transform(embedding, lambda x: greatest(-127, least(127, round_even(((x::DOUBLE / s::DOUBLE)::FLOAT)::DOUBLE, 0)::INTEGER))) AS values FROM s"
)
def vector_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", vectors.quantize(F.col("embedding")).alias("q"))
    return e.select("vec_id", F.round(F.col("q.scale").cast("double"), 9).alias("scale"), F.col("q.values").alias("values"))


@query(
    f"WITH x AS (SELECT e.vec_id AS id, {COSINE_SQL} AS c FROM embeddings e, embeddings q WHERE q.vec_id = 7), u AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM x WHERE id % 3 = 0)"
    " SELECT x.id, CASE WHEN x.id % 3 <> 0 OR u.n <= 100 THEN round(c, 6) END AS score FROM x LEFT JOIN u ON x.id = u.id"
)
def vector_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third vector is not stored; of those the first hundred are embedded for the query."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    pool = e.select("id", F.col("id").alias("ord"))
    out = ranking.hybrid_rerank(pool, e.where("id % 3 <> 0"), _query_vector(spark, sf_dir), lambda missing: missing.join(e, "id"), None)
    return out.select("id", F.round("score", 6).alias("score"))


# ---- merging --------------------------------------------------------------------------------------------------------


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as canonical postings; a few companies share many postings, so groups form."""
    company = F.concat(F.lit("Acme "), (F.col("ord") % 300).cast("string"), F.when(F.col("ord") % 2 == 0, ", Inc.").otherwise(" GmbH"))
    j = jobs(spark, sf_dir)
    return j.select(
        "ord", "source", (F.col("ord") % 12000).cast("string").alias("source_job_id"), company.alias("company"), "company_domain", "title", F.col("snippet").alias("description_text"),
        F.lit(None).cast("string").alias("description_html"), F.array(F.struct(F.when(F.col("ord") % 4 != 0, F.col("city")).alias("city"), F.lit(None).cast("string").alias("region"), F.col("country").alias("country"), F.col("location").alias("raw"), F.lit(False).alias("is_remote"))).alias("locations"),
        "remote", "employment_type", "level", "department", "sector", F.when(F.coalesce("salary_min", "salary_max").isNotNull(), F.struct(F.col("salary_min").alias("min_amount"), F.col("salary_max").alias("max_amount"), F.col("salary_currency").alias("currency"), F.lit("year").alias("interval"))).alias("salary"),
        F.col("years_min").alias("years_experience_min"), F.col("years_max").alias("years_experience_max"), "degree_min", F.lit(None).cast("boolean").alias("degree_required"), "visa_sponsor",
        F.lit(None).cast("string").alias("visa_last_filed"), "sponsorship_offered", "apply_url", "board_token", "posted_at", "updated_at",
        F.array().cast("array<struct<source:string,source_job_id:string,apply_url:string,fetched_at:string>>").alias("provenance"),
    )


@query()
def merge_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy groups; the walk is order-dependent, which SQL doesn't express. Tested against a plain loop."""
    return dedup.cluster(_postings(spark, sf_dir))


@query()
def merge_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _postings(spark, sf_dir)
    return dedup.merge(p, dedup.cluster(p)).select("ord", "source", "source_job_id", "company", "title", "department", "salary", "posted_at", F.size("provenance").alias("sources"))


@query("SELECT source, ord % 12000 AS source_job_id, min(ord) AS first, count(*) AS copies FROM JOBS GROUP BY 1, 2")
def merge_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that have nothing in common leave only copies of one (source, id) in a group."""
    p = _postings(spark, sf_dir).withColumn("title", F.sha1(F.col("ord").cast("string")))
    grouped = dedup.cluster(p).groupBy(F.col("cluster").alias("ord")).agg(F.count(F.lit(1)).alias("copies"))
    return grouped.join(p.select("ord", "source", "source_job_id"), "ord").select("source", F.col("source_job_id").cast("long").alias("source_job_id"), F.col("ord").alias("first"), "copies")


@query(
    "SELECT ord, (company_domain IS NOT NULL)::INT + (snippet IS NOT NULL)::INT + (department IS NOT NULL)::INT + (coalesce(salary_min, salary_max) IS NOT NULL)::INT + 1 + (posted_at IS NOT NULL)::INT + (updated_at IS NOT NULL)::INT"
    " + 1 + (remote <> 'unknown')::INT + (employment_type <> 'unknown')::INT AS completeness, CASE WHEN source IN ('greenhouse', 'lever') THEN 0 WHEN source = 'remoteok' THEN 2 ELSE 1 END AS authority FROM JOBS"
)
def merge_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings(spark, sf_dir).select("ord", dedup.completeness().alias("completeness"), dedup.authority(F.col("source")).alias("authority"))


# ---- changes --------------------------------------------------------------------------------------------------------

SAME = " AND ".join(
    f"p.{c} IS NOT DISTINCT FROM c.{c}"
    for c in "id content_hash enrich_hash company_key source company company_domain title department sector location city country remote level employment_type salary_min salary_max salary_currency years_min years_max degree_min visa_sponsor sponsorship_offered apply_url board_token posted_at updated_at status expired_at expiry_reason snippet first_seen".split()
)


@query(f"WITH {SNAPSHOTS_SQL} SELECT id, salary_min, build_id FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE {SAME.replace(' AND p.first_seen IS NOT DISTINCT FROM c.first_seen', '')})")
def change_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = snapshots(spark, sf_dir)
    return changes.delta(p.drop("first_seen"), c.drop("first_seen"))[0].select("id", "salary_min", "build_id")


@query(f"WITH {SNAPSHOTS_SQL} SELECT id FROM p WHERE id NOT IN (SELECT id FROM c)")
def change_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.delta(*snapshots(spark, sf_dir))[1]


@query(f"WITH {SNAPSHOTS_SQL} SELECT id, salary_min, level FROM c")
def change_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delta applied to its base gives the current build."""
    p, c = snapshots(spark, sf_dir)
    return changes.apply_delta(p, *changes.delta(p, c), "b1", "b1").select("id", "salary_min", "level")


CRAWLED = "company_key LIKE '%1'"


@query(
    f"WITH {SNAPSHOTS_SQL}, f AS (SELECT * FROM c WHERE {CRAWLED}), b AS (SELECT company_key, content_hash, min(first_seen) AS first FROM p GROUP BY ALL),"
    " r AS (SELECT f.id, coalesce(b.first, f.first_seen) AS first_seen, f.build_id FROM f LEFT JOIN b ON f.company_key = b.company_key AND f.content_hash = b.content_hash)"
    f" SELECT * FROM r UNION ALL SELECT id, first_seen, build_id FROM p WHERE NOT ({CRAWLED}) AND id NOT IN (SELECT id FROM f)"
)
def change_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = snapshots(spark, sf_dir)
    fresh = c.where(CRAWLED)
    crawled = jobs(spark, sf_dir).where(CRAWLED).select("company_key")
    return changes.carry_forward(fresh, p, crawled).select("id", "first_seen", "build_id")


@query(
    f"WITH {SNAPSHOTS_SQL}, a AS (SELECT DISTINCT company_key, content_hash FROM c), b AS (SELECT DISTINCT company_key, content_hash FROM p WHERE company_key IN (SELECT company_key FROM c))"
    " SELECT company_key FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION SELECT company_key FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"
)
def change_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.changed_companies(*snapshots(spark, sf_dir))


@query("SELECT id, CASE WHEN level = 'unknown' THEN CASE WHEN coalesce(years_min, years_max) <= 1 THEN 'entry' WHEN coalesce(years_min, years_max) <= 4 THEN 'mid' WHEN coalesce(years_min, years_max) IS NOT NULL THEN 'senior' ELSE 'unknown' END ELSE level END AS level FROM JOBS")
def change_relevel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.relevel(jobs(spark, sf_dir)).select("id", "level")


@query("SELECT id FROM JOBS WHERE (posted_at IS NULL AND updated_at IS NULL) OR greatest(coalesce(posted_at, ''), coalesce(updated_at, '')) >= strftime(DATE 'TODAY' - INTERVAL 1825 DAY, '%Y-%m-%d')")
def change_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.purge(jobs(spark, sf_dir), TODAY).select("id")


@query(
    "SELECT id, CASE WHEN ord % 4 = 1 AND status = 'active' THEN 'expired' ELSE status END AS status, CASE WHEN ord % 4 = 1 AND status = 'active' THEN '2001-08-01' ELSE expired_at END AS expired_at,"
    " CASE WHEN ord % 4 = 1 AND status = 'active' THEN CASE WHEN ord % 8 = 1 THEN 'gone' ELSE 'departed_board' END ELSE expiry_reason END AS expiry_reason FROM JOBS"
)
def change_expiries(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir)
    expired = j.where("ord % 4 = 1").select("id", F.lit("2001-08-01").alias("expired_at"), F.when(F.col("ord") % 8 == 1, "gone").alias("reason"))
    return changes.apply_expiries(j, expired).select("id", "status", "expired_at", "expiry_reason")


@query("SELECT id, title, salary_min, NULL::VARCHAR AS snippet, NULL::VARCHAR AS department, NULL::INT AS years_min FROM JOBS")
def change_slim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.slim(jobs(spark, sf_dir)).select("id", "title", "salary_min", "snippet", "department", "years_min")


@query(f"WITH {SNAPSHOTS_SQL} SELECT c.id, coalesce(c.sector, p.sector) AS sector, p.id IS NOT NULL AS reused FROM c LEFT JOIN p ON c.id = p.id AND c.enrich_hash = p.enrich_hash")
def change_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = snapshots(spark, sf_dir)
    return changes.reuse_enrichment(c, p, ["sector"]).select("id", "sector", "reused")


@query(f"WITH {SNAPSHOTS_SQL} SELECT id, source FROM c WHERE (id, source) NOT IN (SELECT (id, source) FROM p)")
def change_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = snapshots(spark, sf_dir)
    return changes.unseen(c, p).select("id", "source")


@query("WITH u AS (SELECT user_id, event_type, ts, value FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS n FROM u) SELECT user_id, event_type, ts, value FROM r WHERE n = 1")
def change_prefer_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.prefer_latest(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "value"), ["user_id", "event_type"], "ts")


# ---- rollups --------------------------------------------------------------------------------------------------------


@query(
    "SELECT company_key, arg_min(company, ord) AS display_name, arg_min(company_domain, ord) FILTER (company_domain IS NOT NULL) AS domain, arg_min(source, ord) AS primary_ats,"
    " arg_min(sector, ord) FILTER (sector IS NOT NULL) AS sector, count(*) AS open_roles FROM JOBS GROUP BY company_key"
)
def rollup_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.company_rollup(jobs(spark, sf_dir))


@query(
    "SELECT count(*) AS total_jobs, count(*) FILTER (status = 'active') AS active_jobs, count(*) FILTER (status <> 'active') AS expired_jobs, count(*) FILTER (status = 'active' AND coalesce(salary_min, salary_max) IS NOT NULL) AS with_salary,"
    " count(*) FILTER (status = 'active' AND trim(snippet) <> '') AS with_jd, count(*) FILTER (status = 'active' AND visa_sponsor) AS visa_sponsors, count(*) FILTER (status = 'active' AND sponsorship_offered) AS sponsorship_offered,"
    " count(*) FILTER (status = 'active' AND sector <> '') AS with_sector FROM JOBS"
)
def rollup_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.coverage(jobs(spark, sf_dir))


@query("SELECT sector AS value, count(*) AS jobs FROM JOBS WHERE status = 'active' AND sector IS NOT NULL AND sector <> '' GROUP BY sector")
def rollup_by_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.count_by(jobs(spark, sf_dir), "sector")


@query("SELECT company AS value, count(*) AS jobs FROM JOBS WHERE status = 'active' GROUP BY company ORDER BY jobs DESC, value LIMIT 20")
def rollup_top_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's twenty largest."""
    return aggregates.count_by(jobs(spark, sf_dir), "company", 20)


@query("SELECT count(*) - count(DISTINCT ord % 12000) AS duplicates FROM JOBS")
def rollup_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.duplicate_ids(jobs(spark, sf_dir).withColumn("id", F.col("ord") % 12000))


@query(
    "WITH a AS (SELECT * FROM JOBS WHERE status = 'active') SELECT count(*) AS active_jobs, count(*) FILTER (trim(snippet) <> '') AS with_jd, round(count(*) FILTER (trim(snippet) <> '') / count(*) * 100, 2) AS jd_pct,"
    " count(*) FILTER (coalesce(salary_min, salary_max) IS NOT NULL) AS with_salary, round(count(*) FILTER (coalesce(salary_min, salary_max) IS NOT NULL) / count(*) * 100, 2) AS salary_pct, round(count(*) FILTER (sector <> '') / count(*) * 100, 2) AS sector_pct FROM a"
)
def rollup_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.metrics(jobs(spark, sf_dir))


@query(
    "WITH c AS (SELECT 'source:' || event_type AS m, count(*) AS v FROM events WHERE hour(ts) >= 12 GROUP BY 1), p AS (SELECT 'source:' || event_type AS m, count(*) * 2 AS v FROM events WHERE hour(ts) < 12 GROUP BY 1)"
    " SELECT p.m AS metric, p.v::DOUBLE AS prev, coalesce(c.v, 0)::DOUBLE AS curr, round((coalesce(c.v, 0) - p.v) / p.v * 100.0, 2) AS delta, -30.0 AS threshold FROM p LEFT JOIN c ON p.m = c.m WHERE (coalesce(c.v, 0) - p.v) / p.v * 100.0 < -30.0"
)
def rollup_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("source:"), "event_type").alias("metric"), F.hour("ts").alias("h"))
    c = e.where("h >= 12").groupBy("metric").agg(F.count(F.lit(1)).alias("value"))
    return aggregates.regressions(c, e.where("h < 12").groupBy("metric").agg((F.count(F.lit(1)) * 2).alias("value")))


@query(
    "WITH s AS (SELECT user_id::VARCHAR AS source, count(*) AS candidates, count(*) FILTER (event_type IN ('error', 'view', 'click')) AS expired FROM events GROUP BY 1)"
    " SELECT source, candidates, expired, expired / candidates AS rate FROM s WHERE expired / candidates > 0.5 AND expired >= 5"
)
def rollup_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.col("event_type").isin("error", "view", "click").cast("long")
    return aggregates.expiry_alarms(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source"), F.lit(1).cast("long").alias("candidates"), gone.alias("expired")))


@query("SELECT source, count(*) AS n, avg((salary_min IS NOT NULL)::INT) AS salary_min, avg((degree_min IS NOT NULL)::INT) AS degree_min, avg((snippet IS NOT NULL)::INT) AS snippet FROM JOBS GROUP BY source")
def rollup_field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.field_coverage(jobs(spark, sf_dir), "source", ["salary_min", "degree_min", "snippet"])


@query(
    "WITH o AS (SELECT replace(lower(c_name), '#', ' ') AS name, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F')"
    " SELECT name, count(*) AS n, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM o GROUP BY name"
)
def rollup_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    status = F.when(F.col("o_orderstatus") == "F", "Certified - Withdrawn").otherwise("Denied")
    return aggregates.sponsor_filings(o.select(status.alias("status"), F.concat("c_name", F.lit(", LLC")).alias("employer"), F.date_format("o_orderdate", "M/d/yyyy").alias("decision_date")))


@query(
    "WITH m AS (SELECT c_mktsegment AS s, avg(o_totalprice) AS a, count(*) AS k FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 10 = 0 GROUP BY 1), p AS (SELECT c_mktsegment AS s, count(*) AS n FROM customer GROUP BY 1)"
    " SELECT round(sum(a * n), 2) AS estimate, sum(k)::BIGINT AS sampled FROM m JOIN p ON m.s = p.s"
)
def rollup_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An estimate from a sampled tenth, which is the operator's input by its nature."""
    c = table(spark, sf_dir, "customer")
    sample = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("s"), "o_totalprice")
    out = aggregates.stratified_total(sample, c.groupBy(F.col("c_mktsegment").alias("s")).agg(F.count(F.lit(1)).alias("n")), "s", "o_totalprice")
    return out.select(F.round("estimate", 2).alias("estimate"), "sampled")


# ---- evaluation -----------------------------------------------------------------------------------------------------

GOLD = "SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'senior' WHEN '2-HIGH' THEN 'mid' ELSE 'unknown' END AS gold, CASE WHEN o_orderkey % 7 = 0 THEN 'mid' WHEN o_orderpriority < '3' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'senior' ELSE 'mid' END ELSE 'unknown' END AS pred, o_orderstatus AS source FROM orders"


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.selectExpr("o_orderkey AS id", *[x.rsplit(" FROM ", 1)[0] for x in (GOLD.split("AS id, ", 1)[1].split(", CASE WHEN")[0], "CASE WHEN" + GOLD.split(", CASE WHEN", 1)[1].rsplit(", ", 1)[0], "o_orderstatus AS source")])


@query(
    f"WITH g AS ({GOLD}), l AS (SELECT gold AS label, 1 AS g, 0 AS p, (gold = pred)::INT AS t FROM g UNION ALL SELECT pred, 0, 1, 0 FROM g), s AS (SELECT label, sum(t)::BIGINT AS tp, (sum(p) - sum(t))::BIGINT AS fp, (sum(g) - sum(t))::BIGINT AS fn FROM l GROUP BY label),"
    " r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM s) SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM r"
)
def eval_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.classification(_gold(spark, sf_dir), "gold", "pred")


@query(
    f"WITH g AS ({GOLD}), s AS (SELECT source, count(*) AS n, count(*) FILTER (gold <> 'unknown') AS k, count(*) FILTER (pred <> 'unknown') AS a, count(*) FILTER (gold <> 'unknown' AND gold = pred) AS c FROM g GROUP BY source)"
    " SELECT source, n, c / k AS accuracy, c / a AS precision, k / n AS coverage, greatest(0.0, (c / k + 1.96 * 1.96 / (2 * k) - 1.96 * sqrt((c / k * (1 - c / k) + 1.96 * 1.96 / (4 * k)) / k)) / (1 + 1.96 * 1.96 / k)) AS lo,"
    " least(1.0, (c / k + 1.96 * 1.96 / (2 * k) + 1.96 * sqrt((c / k * (1 - c / k) + 1.96 * 1.96 / (4 * k)) / k)) / (1 + 1.96 * 1.96 / k)) AS hi FROM s"
)
def eval_fields_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.field_scores(_gold(spark, sf_dir), "gold", "pred", ["source"])


@query(
    "WITH v AS (SELECT o_orderkey AS id, o_orderkey % 3 AS a, o_orderkey % 4 AS b, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 2 END AS c FROM orders)"
    " SELECT id, CASE WHEN a = b OR a IS NOT DISTINCT FROM c THEN a WHEN b IS NOT DISTINCT FROM c THEN b END AS gold, NOT (a = b OR a IS NOT DISTINCT FROM c OR b IS NOT DISTINCT FROM c) AS split FROM v"
)
def eval_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderkey % 3 AS a", "o_orderkey % 4 AS b", "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 2 END AS c")
    gold, split = aggregates.majority([F.col("a"), F.col("b"), F.col("c")])
    return v.select("id", gold.alias("gold"), split.alias("split"))


@query("WITH t AS (SELECT unnest([0.0, 0.05, 0.1]::DOUBLE[]) AS threshold) SELECT threshold, count(*) FILTER (l_discount >= threshold) / count(*) AS coverage, avg((l_returnflag = 'R')::INT) FILTER (l_discount >= threshold) AS accuracy FROM lineitem, t GROUP BY threshold")
def eval_risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_discount", (F.col("l_returnflag") == "R").alias("ok"))
    return aggregates.risk_coverage(rows, "l_discount", "ok", [0.0, 0.05, 0.1])


# ---- joins ----------------------------------------------------------------------------------------------------------


@query(
    "WITH s AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN replace(lower(s_name), '#', ' ') WHEN 1 THEN replace(lower(s_name), '#', '') ELSE replace(lower(s_name), '#', ' ') || ' usa services' END AS name, s_suppkey + 10 AS n FROM supplier)"
    " SELECT s_name AS company, s.name AS sponsor, s.n AS filings FROM supplier LEFT JOIN s ON s.n = s_suppkey + 10"
)
def join_sponsors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier matches in one of the three tiers."""
    s = table(spark, sf_dir, "supplier")
    low = F.lower("s_name")
    name = F.when(F.col("s_suppkey") % 3 == 1, F.replace(low, F.lit("#"), F.lit(""))).when(F.col("s_suppkey") % 3 == 0, F.replace(low, F.lit("#"), F.lit(" "))).otherwise(F.concat(F.replace(low, F.lit("#"), F.lit(" ")), F.lit(" usa services")))
    sponsors = s.select(name.alias("name"), (F.col("s_suppkey") + 10).alias("n"), F.lit(None).cast("string").alias("last"))
    return joins.match_sponsors(s.select(F.col("s_name").alias("company")), sponsors).select("company", "sponsor", "filings")


@query("WITH t AS (SELECT company_key AS key, min(sector) AS s FROM JOBS WHERE ord % 3 = 0 AND sector IS NOT NULL GROUP BY 1) SELECT j.id, coalesce(j.sector, t.s) AS sector FROM JOBS j LEFT JOIN t ON j.company_key = t.key")
def join_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir)
    known = j.where("ord % 3 = 0 AND sector IS NOT NULL").groupBy(F.col("company_key").alias("key")).agg(F.min("sector").alias("sector"))
    return joins.lookup_sector(j, known.withColumn("domain", F.lit(None).cast("string"))).select("id", "sector")


@query("SELECT j.company_key, count(*) AS rows FROM JOBS j ANTI JOIN (SELECT DISTINCT company_key FROM JOBS WHERE ord % 2 = 0) c ON j.company_key = c.company_key GROUP BY 1")
def join_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir)
    return aggregates.orphans(j, j.where("ord % 2 = 0").select("company_key").distinct()).groupBy("company_key").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "WITH r AS (SELECT c_name AS company, c_custkey FROM customer WHERE c_custkey % 2 = 0 OR c_custkey > 1400), g AS (SELECT replace(lower(c_name), '#', ' ') AS k, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)"
    " SELECT company, coalesce(n, 0) AS open_roles, CASE WHEN n > 0 THEN 'active' ELSE 'dormant' END AS status FROM r LEFT JOIN g ON replace(lower(company), '#', ' ') = k"
    " UNION ALL SELECT k, n, 'index_only' FROM g WHERE k NOT IN (SELECT replace(lower(company), '#', ' ') FROM r)"
)
def join_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0 OR c_custkey > 1400").select(F.col("c_name").alias("company"), F.lit("x").alias("ats"))
    roles = jobs(spark, sf_dir).groupBy("company_key").agg(F.count(F.lit(1)).alias("open_roles"))
    return joins.company_directory(registry, roles).select("company", "open_roles", "status")


@query("SELECT id, coalesce(board_token, CASE WHEN status = 'active' AND ord % 2 = 0 THEN 't' || ord % 40 END) AS board_token FROM JOBS")
def join_board_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a registry that knows every second row's company, by key and source."""
    j = jobs(spark, sf_dir)
    own = j.withColumn("company_key", F.col("id")).withColumn("company_domain", F.lit(None).cast("string")).withColumn("listing_url", F.col("apply_url"))
    registry = j.where("ord % 2 = 0").select(F.col("id").alias("key"), F.lit(None).cast("string").alias("domain"), F.col("source").alias("ats"), F.concat(F.lit("t"), (F.col("ord") % 40).cast("string")).alias("token"))
    return joins.backfill_tokens(own, registry, {}).select("id", "board_token")


@query("SELECT o_orderkey AS id, list_sort(list('s' || l_suppkey || '/' || l_linenumber)) AS sources FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def join_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    sources = l.select(F.col("l_orderkey").alias("job_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.col("l_linenumber").cast("string").alias("source_job_id"), F.lit("").alias("apply_url"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    out = joins.with_provenance(rows, sources).where("provenance IS NOT NULL")
    return out.select("id", F.array_sort(F.transform("provenance", lambda p: F.concat(p["source"], F.lit("/"), p["source_job_id"]))).alias("sources"))


# ---- orders ---------------------------------------------------------------------------------------------------------

RATIO = "(row_number() OVER (PARTITION BY source ORDER BY ord) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source)"


@query(f"SELECT id, {RATIO} AS position, min(ord) OVER (PARTITION BY source) AS bucket FROM JOBS")
def order_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.interleave(jobs(spark, sf_dir), "source", "ord").select("id", "position", "bucket")


@query("WITH b AS (SELECT company_key, row_number() OVER (ORDER BY company_key) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT company_key FROM JOBS)) SELECT company_key FROM b WHERE (p - 700 % n + n) % n < 500 OR n <= 500")
def order_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boards of one run, from a cursor on."""
    boards = jobs(spark, sf_dir).select("company_key").distinct()
    return ordering.rotating_window(boards, ["company_key"], 700, 500).select("company_key")


@query("WITH r AS (SELECT id, source, row_number() OVER (PARTITION BY company_key ORDER BY posted_at DESC NULLS LAST, id) AS n FROM JOBS) SELECT id, source FROM r WHERE n <= 3")
def order_first_of_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.first_of(jobs(spark, sf_dir), ["company_key"], [F.col("posted_at").desc_nulls_last(), F.col("id")], 3).select("id", "source")


# ---- freshness ------------------------------------------------------------------------------------------------------

DAYS = "SELECT user_id::VARCHAR AS token, strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'purchase') > 0 AS changed, count(*) FILTER (event_type = 'error') > 1 AS error, count(*) FILTER (event_type = 'click') AS pushed, count(*) AS requests FROM events GROUP BY 1, 2"


@query(
    f"WITH d AS ({DAYS}), o AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY day) AS n FROM d), l AS (SELECT token, list((day, changed, error, pushed / requests) ORDER BY day) AS h, max(day) AS day FROM d GROUP BY token),"
    " e AS (SELECT token, count(*) AS consecutive_errors FROM (SELECT token, day, error, sum((NOT error)::INT) OVER (PARTITION BY token ORDER BY day DESC) AS g FROM d) WHERE error AND g = 0 GROUP BY token),"
    " u AS (SELECT token, count(*) AS consecutive_unchanged FROM (SELECT token, day, changed, sum(changed::INT) OVER (PARTITION BY token ORDER BY day DESC) AS g FROM d) WHERE NOT changed AND g = 0 GROUP BY token)"
    " SELECT l.token, l.day AS last_crawled, (SELECT max(day) FROM d WHERE d.token = l.token AND changed) AS last_changed, coalesce(consecutive_errors, 0)::INT AS consecutive_errors, coalesce(consecutive_unchanged, 0)::INT AS consecutive_unchanged"
    " FROM l LEFT JOIN e ON l.token = e.token LEFT JOIN u ON l.token = u.token"
)
def fresh_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board_states(spark, sf_dir).select("token", "last_crawled", "last_changed", "consecutive_errors", "consecutive_unchanged")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, is_ = table(spark, sf_dir, "events"), lambda t: F.count_if(F.col("event_type") == t)
    return e.groupBy(F.col("user_id").cast("string").alias("token"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        (is_("purchase") > 0).alias("changed"), (is_("error") > 1).alias("error"), is_("click").alias("http_429"), F.count(F.lit(1)).alias("requests")
    )


def _board_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freshness.fold_outcomes(_outcomes(spark, sf_dir), ["token"])


@query(
    "WITH o AS (SELECT user_id::VARCHAR AS token, strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'purchase') > 0 AS changed, count(*) FILTER (event_type = 'error') > 1 AS error,"
    " count(*) FILTER (event_type = 'click') / count(*)::DOUBLE AS rate FROM events GROUP BY 1, 2), k AS (SELECT token, max(day) FILTER (NOT error) AS fine FROM o GROUP BY token),"
    " s AS (SELECT o.token, max(day) AS last, max(day) FILTER (changed) AS changed, count(*) FILTER (day > coalesce(fine, '')) AS errors,"
    " list_reduce(list_prepend(0.0::DOUBLE, list(rate ORDER BY day)), lambda a, b: (floor((CAST(CAST(a * 0.5::DOUBLE + b * 0.5::DOUBLE AS VARCHAR) AS DECIMAL(30,20)) * 10000::DECIMAL(8,0)))::BIGINT + CASE WHEN (CAST(CAST(a * 0.5::DOUBLE + b * 0.5::DOUBLE AS VARCHAR) AS DECIMAL(30,20)) * 10000::DECIMAL(8,0)) - floor((CAST(CAST(a * 0.5::DOUBLE + b * 0.5::DOUBLE AS VARCHAR) AS DECIMAL(30,20)) * 10000::DECIMAL(8,0))) > 0.5 OR ((CAST(CAST(a * 0.5::DOUBLE + b * 0.5::DOUBLE AS VARCHAR) AS DECIMAL(30,20)) * 10000::DECIMAL(8,0)) - floor((CAST(CAST(a * 0.5::DOUBLE + b * 0.5::DOUBLE AS VARCHAR) AS DECIMAL(30,20)) * 10000::DECIMAL(8,0))) = 0.5 AND floor((CAST(CAST(a * 0.5::DOUBLE + b * 0.5::DOUBLE AS VARCHAR) AS DECIMAL(30,20)) * 10000::DECIMAL(8,0)))::BIGINT % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE / 1e4::DOUBLE) AS throttle_score FROM o JOIN k ON o.token = k.token GROUP BY o.token),"
    " t AS (SELECT *, CASE WHEN errors >= 3 OR throttle_score >= 0.5 THEN 'quarantine' WHEN changed IS NULL OR date_diff('day', changed::DATE, last::DATE) <= 4 THEN 'hot'"
    " WHEN date_diff('day', changed::DATE, last::DATE) <= 14 THEN 'warm' ELSE 'cold' END AS tier FROM s)"
    " SELECT token, throttle_score, tier, strftime(last::DATE + CASE tier WHEN 'hot' THEN 0 WHEN 'warm' THEN 3 ELSE 7 END, '%Y-%m-%d') AS next_due FROM t"
)
def fresh_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed rates, tiers and due days."""
    return _board_states(spark, sf_dir).select("token", "throttle_score", "tier", "next_due")


def _memberships(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    j = jobs(spark, sf_dir).select(F.col("source"), F.concat(F.lit("t"), (F.col("ord") % 90).cast("string")).alias("token"), "id", "ord")
    live = j.where("ord % 90 NOT IN (3, 4) AND (ord % 90 >= 45 OR ord % 11 <> 0) AND (ord % 90 <> 60 OR ord % 4 = 0)")
    boards = j.select("source", "token", (F.col("ord") % 90 != 4).alias("fetched")).distinct()
    return j.where("ord % 13 <> 5").drop("ord"), live.drop("ord"), boards


@query(
    "WITH j AS (SELECT source, 't' || ord % 90 AS token, id, ord FROM JOBS), s AS (SELECT * FROM j WHERE ord % 13 <> 5), v AS (SELECT * FROM j WHERE ord % 90 NOT IN (3, 4) AND (ord % 90 >= 45 OR ord % 11 <> 0) AND (ord % 90 <> 60 OR ord % 4 = 0)),"
    " i AS (SELECT coalesce(s.source, v.source) AS source, coalesce(s.token, v.token) AS token, s.id AS sid, v.id AS vid FROM s FULL JOIN v ON s.source = v.source AND s.token = v.token AND s.id = v.id),"
    " g AS (SELECT source, token, count(sid) AS stored, count(vid) AS live, count(*) FILTER (vid IS NULL) AS missing, count(*) FILTER (sid IS NULL) AS added FROM i GROUP BY ALL), b AS (SELECT DISTINCT source, token, ord % 90 <> 4 AS fetched FROM j)"
    " SELECT b.source, b.token, coalesce(stored, 0) AS stored, coalesce(live, 0) AS live, coalesce(missing, 0) AS missing, coalesce(added, 0)::INT AS added,"
    " NOT fetched OR (coalesce(live, 0) = 0 AND coalesce(stored, 0) > 0) OR (coalesce(stored, 0) >= 20 AND coalesce(missing, 0) > 0.5 * coalesce(stored, 0)) AS undetermined FROM b LEFT JOIN g ON b.source = g.source AND b.token = g.token"
)
def fresh_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, _ = freshness.sweep(*_memberships(spark, sf_dir))
    return b.select("source", "token", "stored", "live", "missing", F.size("added_ids").alias("added"), "undetermined")


@query(
    "WITH j AS (SELECT source, 't' || ord % 90 AS token, id, ord FROM JOBS), s AS (SELECT * FROM j WHERE ord % 13 <> 5), v AS (SELECT * FROM j WHERE ord % 90 NOT IN (3, 4) AND (ord % 90 >= 45 OR ord % 11 <> 0) AND (ord % 90 <> 60 OR ord % 4 = 0)),"
    " m AS (SELECT s.*, NOT EXISTS (SELECT 1 FROM v WHERE v.id = s.id) AS gone FROM s), t AS (SELECT source, token, count(*) AS n, count(*) FILTER (gone) AS k FROM m GROUP BY ALL)"
    " SELECT m.id, 'departed_board' AS reason FROM m JOIN t ON m.source = t.source AND m.token = t.token WHERE gone AND ord % 90 <> 4 AND n > k AND NOT (n >= 20 AND k > 0.5 * n)"
)
def fresh_departed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freshness.sweep(*_memberships(spark, sf_dir))[1].select("id", "reason")


# ---- texts and keys -------------------------------------------------------------------------------------------------


@query("SELECT ord, sha1(string_agg(x || chr(0), '' ORDER BY x)) AS idset FROM (SELECT ord % 500 AS ord, id AS x FROM JOBS) GROUP BY ord")
def text_idset(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir).select((F.col("ord") % 500).alias("ord"), "id")
    return j.groupBy("ord").agg(keys.idset_hash(F.collect_list("id")).alias("idset"))


@query("SELECT id, regexp_extract(apply_url, '^https://([^/]*)', 1) AS host, CASE WHEN ord % 2 = 0 THEN 'acme' || ord % 40 || '.co.uk' ELSE 'acme' || ord % 40 || '.com' END AS domain, CASE WHEN sector IS NULL THEN 'unknown' ELSE lower(sector) END AS slug FROM JOBS")
def text_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = text.host_of(F.col("apply_url"))
    return jobs(spark, sf_dir).select("id", host.alias("host"), text.registrable_domain(host).alias("domain"), keys.sector_slug(F.col("sector")).alias("slug"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM pages")
def text_strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.strip_tags(F.col("html")).alias("plain"))


def _language_sql() -> str:
    hits = ", ".join(f"len(list_filter(w, lambda x: list_contains({stop.split()}, x))) AS n_{lang}" for lang, stop in extract.STOPWORDS.items())
    return (
        f"WITH d AS (SELECT doc_id, regexp_extract_all(lower(substr(coalesce(text, ''), 1, 500)), '[\\p{{L}}]+') AS w FROM documents), h AS (SELECT doc_id, {hits} FROM d)"
        " SELECT doc_id, CASE WHEN greatest(n_de, n_fr, n_es) - n_en < 3 THEN 'en' WHEN n_de = greatest(n_de, n_fr, n_es) THEN 'de' WHEN n_fr = greatest(n_de, n_fr, n_es) THEN 'fr' ELSE 'es' END AS language FROM h"
    )


@query(_language_sql())
def text_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", extract.language(F.col("text")).alias("language"))


TITLE_LEVELS = dict(
    zip(
        ("Senior Data Engineer", "Staff Accountant", "Engineering Manager", "Product Manager", "Software Engineer II", "Data Analyst I/II", "Sales Development Representative", "Head of Research", "Research Associate Scientist", "Principal Engineer", "Warehouse Associate", "Junior Data Engineer"),
        ("senior", "unknown", "manager", "unknown", "mid", "unknown", "entry", "director", "unknown", "principal", "unknown", "junior"),
        strict=True,
    )
)


@query("SELECT id, CASE title " + " ".join(f"WHEN '{t}' THEN '{v}'" for t, v in TITLE_LEVELS.items()) + " END AS level FROM JOBS")
def text_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).select("id", extract.level_from_title(F.col("title")).alias("level"))


@query("SELECT id, CASE WHEN salary_min IS NULL THEN 'None' WHEN salary_min = floor(salary_min) THEN (salary_min::BIGINT)::VARCHAR || '.0' ELSE salary_min::VARCHAR END AS printed FROM JOBS")
def text_python_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).select("id", keys.python_float(F.col("salary_min")).alias("printed"))


# ---- events by window -----------------------------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def fresh_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.activity(table(spark, sf_dir, "events")).select(F.col("window.start").alias("day"), "event_type", "n")


from jobquarry import more_queries, text_queries  # noqa: E402, F401  (they register their queries with the functions above)
