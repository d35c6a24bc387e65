"""Merging of postings across sources: exact, then greedy within a company, then fields from the best record.

The greedy step depends on the order of postings: a posting joins the first group of its company whose first member
has a similar title, the same level and a compatible city. This is no connected-components problem, so each block
is walked in order by ``applyInPandas``. Level never differs within a group, so blocks are (company, level).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobquarry.functions import keys

# Sources that are employers' own systems, and those that list others' postings.
EMPLOYER_SOURCES = (
    "greenhouse", "lever", "ashby", "workday", "smartrecruiters", "workable", "recruitee", "personio", "bamboohr", "breezy", "teamtailor", "join", "rippling",
    "pinpoint", "eightfold", "successfactors", "oracle", "taleo", "icims", "avature", "jazzhr", "jobvite", "phenom", "brassring", "schemaorg", "apicapture",
)
AGGREGATORS = ("remoteok", "remotive", "arbeitnow", "jobicy", "himalayas", "themuse", "adzuna", "usajobs")
#: Fields that a merged posting takes from the next best record where its own is missing.
FILLED = ("company_domain", "description_text", "description_html", "department", "salary", "apply_url", "posted_at", "updated_at")
THRESHOLD = 90.0


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of an integer."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def token_sort_ratio(a: str, b: str) -> float:
    """100 times the share of characters that two texts keep in common once their words are sorted; 100 for two
    empty texts."""
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * lcs_length(a, b) / total


def authority(source: Column) -> Column:
    """0 for employers' systems, 2 for aggregators, 1 for anything else."""
    own = F.lower(source)
    return F.when(own.isin(*EMPLOYER_SOURCES), 0).when(own.isin(*AGGREGATORS), 2).otherwise(1)


def completeness(p: Column | None = None) -> Column:
    """How many fields of a posting say something."""
    get = (lambda c: p[c]) if p is not None else F.col
    known = [get(f).isNotNull() for f in FILLED] + [F.size(get("locations")) > 0, get("remote") != "unknown", get("employment_type") != "unknown"]
    return sum((F.coalesce(k, F.lit(False)).cast("int") for k in known[1:]), known[0].cast("int"))


def cities(locations: Column) -> Column:
    named = F.filter(F.coalesce(locations, F.array()), lambda x: F.coalesce(x["city"], F.lit("")) != "")
    return F.array_distinct(F.transform(named, lambda x: F.lower(F.trim(x["city"]))))


def cluster(postings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``ord`` and ``cluster`` (the ``ord`` of the group's first posting) of every posting.

    Copies of one (source, source_job_id) share the first one's group, whatever their own company says."""
    p = postings.select(
        "ord", "source", "source_job_id", keys.company_key(F.col("company")).alias("block"), F.coalesce("level", F.lit("unknown")).alias("level"),
        keys.role_family(F.col("title")).alias("title"), cities(F.col("locations")).alias("cities"),
    )
    first = F.min("ord").over(Window.partitionBy("source", "source_job_id"))
    p = p.withColumn("first", first)

    def walk(block: pd.DataFrame) -> pd.DataFrame:
        groups: list[tuple[int, str, frozenset]] = []
        out = []
        # The first group that fits a title and its cities stays the first one, so each such pair is looked up once.
        known: dict[tuple[str, frozenset], int] = {}
        for one, title, own in block.sort_values("ord")[["ord", "title", "cities"]].itertuples(index=False):
            own = frozenset(own)
            found = known.get((title, own))
            for head, head_title, head_cities in groups if found is None else ():
                # The ratio can reach the threshold only if the lengths are close; then it is worked out.
                short, long = sorted((len(title), len(head_title)))
                if 200.0 * short >= threshold * (short + long) and (not own or not head_cities or own & head_cities) and token_sort_ratio(title, head_title) >= threshold:
                    found = head
                    break
            if found is None:
                groups.append((one, title, own))
                found = one
            if title:
                known[title, own] = found
            out.append((one, found))
        return pd.DataFrame(out, columns=["first", "cluster"])

    heads = p.where(F.col("ord") == F.col("first")).select("ord", "block", "level", "title", "cities")
    found = heads.groupBy("block", "level").applyInPandas(walk, "first long, cluster long")
    return p.select("ord", "first").join(found, "first").select("ord", "cluster")


def merge(postings: DataFrame, clusters: DataFrame) -> DataFrame:
    """One posting for each group: the most authoritative and complete record, its gaps filled from the next ones, with
    the sources of all. ``ord`` is that of the group's first posting; level, years, sector and visa are never filled."""
    own = F.array(F.struct("source", "source_job_id", "apply_url", F.lit(None).cast("string").alias("fetched_at")))
    sources = F.when(F.size("provenance") > 0, F.col("provenance")).otherwise(own)
    p = postings.withColumn("provenance", sources).join(clusters, "ord")
    record = F.struct(authority(F.col("source")).alias("a"), (-completeness()).alias("c"), F.col("ord").alias("o"), F.struct(*[F.col(c) for c in postings.columns]).alias("p"))
    # Ranks are unique within a group, so the sort never compares the nested posting.
    listed = F.array_sort(F.collect_list(record), lambda x, y: F.when(F.struct(x["a"], x["c"], x["o"]) < F.struct(y["a"], y["c"], y["o"]), -1).otherwise(1))
    g = p.groupBy("cluster").agg(listed.alias("m"))
    members = F.transform("m", lambda x: x["p"])
    best = F.get(members, 0)

    def first(field: str, good) -> Column:
        return F.get(F.filter(F.transform(members, lambda x: x[field]), good), 0)

    out = []
    for c in postings.columns:
        if c == "ord":
            out.append(F.col("cluster").alias("ord"))
        elif c in FILLED:
            out.append(first(c, lambda x: x.isNotNull()).alias(c))
        elif c == "locations":
            out.append(F.coalesce(first(c, lambda x: F.size(x) > 0), best[c]).alias(c))
        elif c in ("remote", "employment_type"):
            out.append(F.coalesce(first(c, lambda x: x != "unknown"), best[c]).alias(c))
        elif c == "provenance":
            every = F.flatten(F.transform(members, lambda x: x["provenance"]))
            seen = lambda acc, x: F.when(F.exists(acc, lambda y: (y["source"] == x["source"]) & (y["source_job_id"] == x["source_job_id"])), acc).otherwise(F.concat(acc, F.array(x)))
            out.append(F.aggregate(every, F.slice(every, 1, 0), seen).alias(c))
        else:
            out.append(best[c].alias(c))
    return g.select(*out)


def deduplicate(postings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Merged postings in the order of first occurrence."""
    return merge(postings, cluster(postings, threshold)).orderBy("ord")


def similar_pairs(postings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of postings of one company with similar titles, for evaluation (``a`` < ``b``)."""
    p = postings.select("ord", keys.company_key(F.col("company")).alias("block"), keys.role_family(F.col("title")).alias("title"))
    a, b = p.select(F.col("ord").alias("a"), "block", F.col("title").alias("ta")), p.select(F.col("ord").alias("b"), "block", F.col("title").alias("tb"))

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([token_sort_ratio(s, t) for s, t in zip(x, y, strict=True)], dtype=float)

    near = 200.0 * F.least(F.length("ta"), F.length("tb")) >= threshold * (F.length("ta") + F.length("tb"))
    pairs = a.join(b, "block").where((F.col("a") < F.col("b")) & near)
    return pairs.withColumn("score", ratio("ta", "tb")).where(F.col("score") >= threshold).select("a", "b", "score")


def pair_quality(predicted: DataFrame, labelled: DataFrame) -> DataFrame:
    """Precision and recall of predicted pairs (``a``, ``b``) against labelled ones (``a``, ``b``, ``same``)."""
    p = predicted.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("hit", F.lit(1))
    y = labelled.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "same").join(p, ["a", "b"], "left")
    tp, fp, fn = (F.count_if(c) for c in (F.col("same") & F.col("hit").isNotNull(), ~F.col("same") & F.col("hit").isNotNull(), F.col("same") & F.col("hit").isNull()))
    return y.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn")).select(
        "*", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0)).alias("recall")
    )
