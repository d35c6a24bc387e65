"""Further queries of the engine: ranked search, boards and registries, vectors, sectors, links, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobquarry.functions import sectors
from jobquarry.operators import boards, embeddings, enrich
from jobquarry.plans import tools
from jobquarry.plans.search import SearchQuery, search
from jobquarry.queries import query
from jobquarry.sources import documents, resolver
from jobquarry.sources.bridge import TODAY, jobs, table

# ---- ranked search --------------------------------------------------------------------------------------------------

TOKENS = "list_filter(regexp_split_to_array(lower(replace(coalesce({c}, ''), '&', ' and ')), '[^a-z0-9]+'), lambda x: x <> '')"


def _ranked_sql(terms: list[str], match: str, limit: int) -> str:
    columns = {"title": 10.0, "company": 3.0, "department": 3.0, "snippet": 1.0}
    read = ", ".join(f"{TOKENS.format(c=c)} AS t_{c}" for c in columns)
    tf = {k: " + ".join(f"{w} * len(list_filter(t_{c}, lambda x: x = '{t}'))" for c, w in columns.items()) for k, t in enumerate(terms)}
    held = {k: " OR ".join(f"list_contains(t_{c}, '{t}')" for c in columns) for k, t in enumerate(terms)}
    df = ", ".join(f"count(*) FILTER ({held[k]}) AS df{k}" for k in held)
    score = " + ".join(f"greatest(ln((r - df{k} + 0.5) / (df{k} + 0.5)), 1e-6) * (({tf[k]}) * 2.2) / (({tf[k]}) + 1.2 * (0.25 + 0.75 * n / m))" for k in tf)
    return (
        f"WITH j AS (SELECT *, {read} FROM JOBS), k AS (SELECT *, len(t_title) + len(t_company) + len(t_department) + len(t_snippet) AS n FROM j),"
        f" s AS (SELECT count(*)::DOUBLE AS r, avg(n) AS m, {df} FROM k), f AS (SELECT id, title, company, round(({score})::DOUBLE, 9) AS score FROM k, s WHERE status = 'active' AND {match.format(**{f'h{x}': held[x] for x in held})})"
        f" SELECT id, title, company FROM f ORDER BY score DESC, id LIMIT {limit}"
    )


@query(_ranked_sql(["data", "engineer"], "({h0}) AND ({h1})", 40))
def search_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword results come best first; the limit cuts the others."""
    return search(jobs(spark, sf_dir), SearchQuery(keywords="data engineer", limit=40), TODAY).select("id", "title", "company")


@query(_ranked_sql(["nurse", "pilot", "principal", "chef", "research"], "({h0} OR {h1} OR {h2} OR {h3} OR {h4})", 60))
def search_best_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(jobs(spark, sf_dir), SearchQuery(keywords="nurse pilot principal chef research", limit=60), TODAY).select("id", "title", "company")


@query("SELECT id, title FROM JOBS WHERE lower(concat_ws(' ', title, department, company, snippet)) LIKE '%eer%' AND lower(concat_ws(' ', title, department, company, snippet)) LIKE '%data%'")
def search_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object path of keywords: pieces of words, in any column."""
    return tools.keyword_substrings(jobs(spark, sf_dir), SearchQuery(keywords="EER data"), ("title", "department", "company", "snippet")).select("id", "title")


@query("SELECT company_key AS value, count(*) AS n FROM JOBS WHERE status = 'active' AND lower(company) LIKE '%7%' GROUP BY 1 ORDER BY n DESC, value LIMIT 25")
def tool_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tools.list_companies(jobs(spark, sf_dir), "7", 25)
    return found.select(F.col(found.columns[0]).alias("value"), F.col(found.columns[1]).alias("n"))


def _sponsors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0")
    return c.select(F.regexp_replace(F.lower("c_name"), "#", " ").alias("name"), (F.col("c_custkey") % 50).alias("n"), F.lit("2001-01-01").alias("last"))


@query(
    "WITH j AS (SELECT * FROM JOBS), p AS (SELECT * FROM j WHERE status = 'active' AND visa_sponsor AND last_seen >= strftime(DATE 'TODAY' - INTERVAL 21 DAY, '%Y-%m-%d')"
    " AND greatest(coalesce(posted_at, ''), coalesce(updated_at, '')) >= strftime(DATE 'TODAY' - INTERVAL 365 DAY, '%Y-%m-%d') ORDER BY posted_at DESC NULLS LAST, id LIMIT 300),"
    " s AS (SELECT replace(lower(c_name), '#', ' ') AS name, c_custkey % 50 AS n FROM customer WHERE c_custkey % 3 = 0)"
    " SELECT p.id, p.company, coalesce(s.n, 0) AS filings, s.name IS NOT NULL AS sponsor_active FROM p LEFT JOIN s ON p.company_key = s.name ORDER BY filings DESC, posted_at DESC, id LIMIT 50"
)
def tool_sponsor_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings of sponsors, the strongest first, from a pool of six times the limit."""
    found = tools.sponsor_jobs(jobs(spark, sf_dir).drop("visa_last_filed"), _sponsors(spark, sf_dir), SearchQuery(limit=50), TODAY)
    return found.select("id", "company", "filings", "sponsor_active")


# ---- boards ---------------------------------------------------------------------------------------------------------


@query("SELECT source, CASE source WHEN 'greenhouse' THEN 'membership' WHEN 'lever' THEN 'membership' ELSE 'liveness' END AS strategy, count(*) AS n FROM JOBS GROUP BY 1, 2")
def board_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).groupBy("source", boards.strategy(F.col("source")).alias("strategy")).agg(F.count(F.lit(1)).alias("n"))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.lower("s_name").alias("company"), F.when(F.col("s_suppkey") % 5 != 0, F.lit("greenhouse")).alias("ats"), F.concat(F.lit("t"), F.col("s_suppkey")).alias("token"), F.lit(None).cast("string").alias("domain"), "s_suppkey")


@query("SELECT lower(s_name) AS company, 't' || s_suppkey AS token FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 4 <> 0 ORDER BY company LIMIT 2000")
def board_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _registry(spark, sf_dir)
    states = r.where("s_suppkey % 4 = 0").select(F.lit("greenhouse").alias("source"), "token")
    return boards.new_boards(r, states).select("company", "token")


@query(
    "WITH c AS (SELECT lower(s_name) AS company, CASE WHEN s_suppkey % 11 = 0 THEN 'demo' WHEN s_suppkey % 2 = 0 THEN 't' || s_suppkey ELSE 'n' || (s_suppkey // 4) END AS token, s_suppkey AS k FROM supplier),"
    " r AS (SELECT company, CASE WHEN token = 'demo' THEN 'demo' WHEN k % 6 = 0 THEN 'dup_slug' WHEN k % 2 = 0 AND k % 10 = 0 THEN 'dup_board' END AS early, token FROM c)"
    " SELECT company, coalesce(early, CASE WHEN row_number() OVER (PARTITION BY token, early IS NULL ORDER BY company) > 1 THEN 'dup_board' ELSE 'added' END) AS outcome FROM r"
)
def board_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates against a registry: demo boards, known companies, known boards, two candidates for one board."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    token = F.when(k % 11 == 0, "demo").when(k % 2 == 0, F.concat(F.lit("t"), k)).otherwise(F.concat(F.lit("n"), F.floor(k / 4).cast("string")))
    candidates = s.select(F.lower("s_name").alias("company"), F.lit("lever").alias("ats"), token.alias("token"), F.lit(None).cast("string").alias("domain"), F.lit(1).alias("jobs"))
    known = s.where("s_suppkey % 6 = 0").select(F.upper("s_name").alias("company"), F.lit("ashby").alias("ats"), F.lit("x").alias("token"))
    taken = s.where("s_suppkey % 10 = 0").select(F.concat(F.lit("other"), k).alias("company"), F.lit("lever").alias("ats"), F.concat(F.lit("t"), k).alias("token"))
    return boards.merge_registry(known.unionByName(taken), candidates).select("company", "outcome")


@query("SELECT s_name AS company, 'greenhouse' AS ats, max(s_suppkey) AS token FROM supplier GROUP BY s_nationkey, s_name")
def board_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    one = s.select(F.col("s_name").alias("company"), F.lit("greenhouse").alias("ats"), F.col("s_suppkey").alias("token"), F.lit("d").alias("domain"), F.lit(9).alias("jobs"))
    worse = one.withColumns({"ats": F.lit("other"), "token": F.col("token") + 1}).unionByName(one.withColumns({"jobs": F.lit(8), "token": F.col("token") + 2}))
    return boards.best_candidates(one.unionByName(worse), {"greenhouse": 1}).select("company", "ats", "token")


@query("SELECT source, board_token AS token, list(DISTINCT company_key ORDER BY company_key)::VARCHAR AS company_keys FROM JOBS WHERE board_token LIKE '%7' GROUP BY ALL")
def board_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir)
    own = j.where("board_token IS NOT NULL").select("source", F.col("board_token").alias("token")).distinct().withColumn("rows", F.when(F.col("token").endswith("7"), 0).otherwise(5))
    found = boards.empty_boards(own, j)
    return found.select("source", "token", F.concat(F.lit("["), F.array_join("company_keys", ", "), F.lit("]")).alias("company_keys"))


@query("SELECT source, board_token AS token, count(*) FILTER (status = 'active') AS stored FROM JOBS WHERE board_token IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (status = 'active') <> count(*)")
def board_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir)
    counts = j.where("board_token IS NOT NULL").groupBy("source", F.col("board_token").alias("token")).agg(F.count(F.lit(1)).alias("count"))
    return boards.change_candidates(counts, j).select("source", "token", "stored")


@query("SELECT CASE o_orderkey % 3 WHEN 0 THEN 'hot' WHEN 1 THEN 'warm' ELSE 'cold' END AS tier, count(*) AS boards, count(*) FILTER (o_orderkey % 4 = 0) AS throttled FROM orders GROUP BY 1")
def board_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    tier = F.element_at(F.array(F.lit("hot"), F.lit("warm"), F.lit("cold")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return boards.tier_mix(o.select(tier.alias("tier"), F.when(F.col("o_orderkey") % 4 == 0, 0.5).otherwise(0.0).alias("throttle_score")))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 0 ELSE 2 END AS attempts, NOT (o_orderkey % 2 = 0 AND o_orderkey % 3 = 0) AS \"read\" FROM orders")
def board_requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("id", F.col("o_orderkey").cast("string"))
    none = F.lit(None).cast("string")
    details = o.select("id", F.lit("2001-01-01").alias("fetched_at"), F.lit(2).alias("attempts"), F.when(F.col("o_orderkey") % 3 != 0, F.lit("X")).alias("city"), none.alias("country"), "o_orderkey")
    found = boards.requeue_places(details, o.where("o_orderkey % 2 = 0").select("id"))
    return found.select("id", "attempts", F.col("fetched_at").isNotNull().alias("read"))


URLS = (
    ("https://boards.greenhouse.io/acme{k}/jobs/1", "greenhouse", "acme{k}"), ("https://jobs.lever.co/acme{k}?x=1", "lever", "acme{k}"), ("https://acme{k}.wd5.myworkdayjobs.com/en-US/Careers", "workday", "acme{k}|wd5|Careers"),
    ("https://acme{k}.recruitee.com/o/dev", "recruitee", "acme{k}"), ("https://careers-ACME{k}.icims.com/jobs/search", "icims", "careers-acme{k}.icims.com"), ("https://join.com/companies/acme{k}", "join", "acme{k}"),
    ("https://www.example.org/{k}", None, None), ("schema: https://a.example/{k}", "schemaorg", "https://a.example/{k}"),
)


def _of_urls(n: int) -> str:
    cells = ["NULL" if u[n] is None else "'" + u[n].replace("{k}", "' || c_custkey || '") + "'" for u in URLS]
    return f"CASE c_custkey % {len(URLS)} " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(cells)) + " END"


@query(f"SELECT c_custkey, {_of_urls(1)} AS source, {_of_urls(2)} AS token FROM customer")
def link_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of boards to their source and token."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_of_urls(0)} AS url")
    b = resolver.resolve(F.col("url"))
    return c.select("c_custkey", b["source"].alias("source"), b["token"].alias("token"))


@query(f"SELECT c_custkey, {_of_urls(1)} AS source FROM customer WHERE c_custkey % 8 IN (0, 1, 2, 3, 4, 5)")
def link_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards that pages link to, each one once, and of those the first live one."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"'<a href=\"https://x.example/\">x</a><a href=\"' || {_of_urls(0)} || '\">jobs</a> <a href=''https://jobs.lever.co/late''>y</a>' AS html")
    found = resolver.embedded_boards(c)
    probes = found.select("source", "token", (F.col("token") != "late").alias("live"))
    return resolver.first_live(found, probes, "c_custkey").select("c_custkey", "source")


# ---- vectors and sectors ----------------------------------------------------------------------------------------------


@query("SELECT q.vec_id AS query, a.vec_id AS id FROM embeddings a, embeddings q WHERE q.vec_id IN (1, 2, 3) QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, a.vec_id) <= 10")
def vector_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of three queries at once, in Arrow batches."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    queries = {str(r.id): [float(x) for x in r.embedding] for r in e.where("id IN (1, 2, 3)").collect()}
    return embeddings.nearest_by_matrix(e, queries, 10).select(F.col("query").cast("long").alias("query"), "id")


@query("SELECT a.vec_id AS id FROM embeddings a, embeddings q WHERE q.vec_id = 5 AND a.vec_id % 3 = 0 ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, a.vec_id LIMIT 20")
def vector_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = [float(x) for x in e.where("id = 5").first().embedding]
    return embeddings.candidates(e, e.where("id % 3 = 0"), q, 20).select("id")


@query("SELECT id, concat_ws(' — ', nullif(title, ''), nullif(department, ''), nullif(coalesce(snippet, ''), '')) AS text FROM JOBS WHERE status = 'active' AND ord % 2 = 1")
def vector_to_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of rows without a vector; every second one has one."""
    j = jobs(spark, sf_dir)
    have = embeddings.to_embed(j.where("ord % 2 = 0"), j.limit(0).select("id", F.lit("").alias("sig")), 10**9).select("id", "sig")
    return embeddings.to_embed(j, have, 10**9).select("id", "text")


@query("SELECT id, CASE WHEN ord % 5 = 0 THEN 'new' ELSE 'old' END AS sig FROM JOBS WHERE status = 'active' AND (ord % 5 = 0 OR ord % 2 = 0)")
def vector_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors of rows that are gone go, fresh ones replace them."""
    j = jobs(spark, sf_dir)
    with_ = lambda rows, sig: rows.select("id", F.lit(sig).alias("sig"), F.array(F.lit(1.0)).alias("embedding"))
    return embeddings.reconcile(with_(j.where("ord % 2 = 0"), "old"), j, with_(j.where("ord % 5 = 0"), "new")).select("id", "sig")


SLUGS = (
    ("first-national-banking", "Banking/Finance"), ("solar_grid", "Energy/Climate"), ("acme", None), ("neo game co", "Gaming"), ("acme-ml", "AI/ML"), ("cityofreno", "Government/Public"), ("quantum photonic", "Semiconductors/Hardware"),
)
ENDINGS = ((".xyz", None), (".health", "Healthcare"), (".io", "Software/SaaS"))


@query(
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN 'Healthcare' WHEN c_custkey % 7 = 0 THEN 'Banking/Finance' WHEN c_custkey % 7 = 1 THEN 'Energy/Climate' WHEN c_custkey % 7 = 5 THEN 'Government/Public'"
    " WHEN c_custkey % 7 = 6 THEN 'Semiconductors/Hardware' WHEN c_custkey % 3 = 2 THEN 'Software/SaaS' WHEN c_custkey % 7 = 3 THEN 'Gaming' WHEN c_custkey % 7 = 4 THEN 'AI/ML' END AS sector FROM customer"
)
def text_sector_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = F.element_at(F.array(*[F.lit(s) for s, _ in SLUGS]), (F.col("c_custkey") % len(SLUGS) + 1).cast("int"))
    domain = F.concat(F.lit("x"), F.col("c_custkey").cast("string"), F.element_at(F.array(*[F.lit(e) for e, _ in ENDINGS]), (F.col("c_custkey") % len(ENDINGS) + 1).cast("int")))
    return table(spark, sf_dir, "customer").select("c_custkey", sectors.sector_from_slug(slug, domain).alias("sector"))


@query("SELECT id, company || '. acme' || ord % 40 || '. ' || title AS text FROM (SELECT id, ord, company, title FROM JOBS)")
def text_sector_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir)
    host = F.regexp_extract("apply_url", "^https://([^/]*)", 1)
    return j.select("id", sectors.model_text(F.col("company"), host, F.col("title")).alias("text"))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS length, CASE WHEN vec_id % 2 = 0 THEN 'health' ELSE 'tech' END AS ending FROM embeddings")
def text_sector_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the sector model: a centred unit vector and one group of domain endings."""
    e = table(spark, sf_dir, "embeddings")
    width = len(e.first().embedding)
    domain = F.when(F.col("vec_id") % 2 == 0, F.lit("a.care")).otherwise(F.lit("b.io/x"))
    f = sectors.model_features(F.col("embedding"), domain, [0.0] * width)
    own = F.sqrt(F.aggregate(F.slice(f, 1, width), F.lit(0.0), lambda s, x: s + x * x))
    ending = F.element_at(F.array(*[F.lit(g) for g in sectors.ENDING_GROUPS]), F.array_position(F.slice(f, width + 1, len(sectors.ENDING_GROUPS)), F.lit(1.0)).cast("int"))
    return e.select("vec_id", F.round(own, 6).alias("length"), ending.alias("ending"))


# ---- documents and enrichment ---------------------------------------------------------------------------------------


@query("SELECT s_suppkey AS k, s_name AS title, 'R & D <' || s_nationkey || '>' AS place FROM supplier UNION ALL SELECT s_suppkey, 'second', NULL FROM supplier WHERE s_suppkey % 3 = 0")
def source_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of XML feeds: CDATA, entities, namespaces, several items and none closed."""
    item = (
        "'<rss><channel><title>Board</title><item><title><![CDATA[' || s_name || ']]></title><j:place>R &amp; D &lt;' || s_nationkey || '&gt;</j:place></item>' || "
        "CASE WHEN s_suppkey % 3 = 0 THEN '<item id=\"2\"><title> second </title></item>' ELSE '<item><title>cut' END || '</channel></rss>'"
    )
    feeds = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k", f"{item} AS xml")
    found = documents.xml_records(feeds, "item", {"title": "title", "place": "place"})
    return found.select("k", F.get_json_object("payload", "$.title").alias("title"), F.get_json_object("payload", "$.place").alias("place"))


@query("SELECT page_id, url FROM pages WHERE url >= 'https://m' AND url < 'https://n'")
def source_key_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.key_range(table(spark, sf_dir, "pages"), "url", "https://m", "https://n").select("page_id", "url")


@query("SELECT c_name AS employer, 'Certified' AS status, strftime(DATE '2001-01-01' + (c_custkey % 300)::INT, '%Y-%m-%d') AS decided FROM customer WHERE c_custkey % 5 <> 0")
def source_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings with dates in three forms; rows without an employer go."""
    day = "date_add(DATE'2001-01-01', CAST(c_custkey % 300 AS INT))"
    form = f"CASE c_custkey % 3 WHEN 0 THEN date_format({day}, 'yyyy-MM-dd') WHEN 1 THEN date_format({day}, 'M/d/yyyy') ELSE CAST(datediff({day}, DATE'1899-12-30') AS STRING) END"
    rows = table(spark, sf_dir, "customer").selectExpr("CASE WHEN c_custkey % 5 <> 0 THEN ' ' || c_name ELSE '  ' END AS employer", "'Certified' AS status", f"{form} AS decided")
    return documents.filings(rows)


#: Rows that one task enriches, about.
ENRICHED_BY_A_TASK = 50_000


@query(
    "SELECT o_orderkey AS ord, o_orderkey % 9 + 1 AS years, CASE WHEN o_orderkey % 2 = 0 THEN 'director' WHEN o_orderkey % 9 + 1 <= 1 THEN 'entry' WHEN o_orderkey % 9 + 1 <= 4 THEN 'mid' ELSE 'senior' END AS level, 'bachelor' AS degree,"
    " 100000.0::DOUBLE AS low, 'Energy' AS company_word, FALSE AS sponsorship, CASE WHEN o_orderkey % 4 = 0 THEN 'United States' END AS country FROM orders"
)
def enrich_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All extractors in their order, over orders as postings."""
    k = F.col("o_orderkey")
    body = F.concat(F.lit("We need "), (k % 9 + 1).cast("string"), F.lit("+ years of experience. A Bachelor's degree is required. Salary: $100,000 - $120,000 per year. We do not sponsor visas."))
    from jobquarry.schemas import POSTING

    have = {
        "ord": k, "source": F.when(k % 4 == 0, "workday").otherwise("lever"), "title": F.when(k % 2 == 0, "Head of Things").otherwise("Worker"), "company": F.lit("Acme Energy"), "description_text": body,
        "locations": F.array(F.struct(F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("country"), F.lit("Reno, NV 89501").alias("raw"), F.lit(False).alias("is_remote"))),
    }
    # A row of a few bytes becomes a text that takes a millisecond to read, so keys are spread first: splits of files go by bytes.
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    tasks = max(spark.sparkContext.defaultParallelism, -(-o.count() // ENRICHED_BY_A_TASK))
    p = o.repartition(tasks).select(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in POSTING.fields])
    done = enrich.enrich(p)
    return done.select(
        "ord", F.col("years_experience_min").cast("long").alias("years"), "level", F.col("degree_min").alias("degree"), F.col("salary.min_amount").alias("low"), F.when(F.col("sector").startswith("Energy"), "Energy").alias("company_word"),
        F.col("sponsorship_offered").alias("sponsorship"), F.col("locations")[0]["country"].alias("country"),
    )
