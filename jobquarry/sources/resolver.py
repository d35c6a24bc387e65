"""From an address of a careers page to the source and the token of its board, as column expressions.

Sources are tried in the order in which they are registered; each has patterns whose group is the token. Where none fits, the
registry's longest parent domain decides (``joins.lookup_domain``). Links in a page are candidates in page order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobquarry.functions.spots import let
from jobquarry.operators import joins

# By source, patterns of addresses (the groups, joined by "|", are the token) and tokens that are none.
ADDRESSES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "greenhouse": ((r"(?i)boards-api\.greenhouse\.io/v1/boards/([^/?#]+)", r"(?i)(?:job-)?boards\.greenhouse\.io/([^/?#]+)"), ("v1", "boards")),
    "lever": ((r"(?i)jobs\.lever\.co/([^/?#\s]+)",), ()),
    "ashby": ((r"^(?:https?:)?(?://)?jobs\.ashbyhq\.com/+([^/?#]+)",), ()),
    "workday": ((r"(?i)^(?:https?://)?([^./]+)\.(wd\d+)\.myworkdayjobs\.com/(?:[a-z]{2}(?:-[a-z]{2})?/)?([^/?#]+)",), ()),
    "smartrecruiters": ((r"(?i)api\.smartrecruiters\.com/v1/companies/([^/?#]+)", r"(?i)(?:careers|jobs)\.smartrecruiters\.com/([^/?#]+)"), ("v1", "companies")),
    "workable": ((r"(?i)apply\.workable\.com/(?:api/v1/widget/accounts/)?([^/?#]+)", r"(?i)([^./?#]+)\.workable\.com"), ("apply", "www", "api")),
    "recruitee": ((r"(?i)([^/.\s]+)\.recruitee\.com",), ("www",)),
    "personio": ((r"(?i)([^/.\s]+)\.jobs\.personio\.(?:de|com)",), ("www",)),
    "bamboohr": ((r"(?i)([^/.\s]+)\.bamboohr\.com",), ("www",)),
    "breezy": ((r"(?i)([^/.\s]+)\.breezy\.hr",), ("www",)),
    "teamtailor": ((r"(?i)([^/.\s]+)\.teamtailor\.com",), ("www", "app", "api", "career")),
    "join": ((r"(?i)join\.com/companies/([^/?#\s]+)",), ()),
    "rippling": ((r"(?i)ats\.rippling\.com/([^/?#]+)",), ()),
    "pinpoint": ((r"(?i)([^/.\s]+)\.pinpointhq\.com",), ("www",)),
    "paylocity": ((r"(?i)recruiting\.paylocity\.com.*?([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})",), ()),
    "eightfold": ((r"(?i)(?:https?://)?([a-z0-9][a-z0-9-]*)\.eightfold\.ai",), ("www", "static", "app")),
    "oracle": ((r"(?i)([a-z0-9-]+\.fa\.[a-z0-9-]+\.oraclecloud\.com).*?/sites/(CX[0-9_]*)\b", r"(?i)([a-z0-9-]+\.fa\.[a-z0-9-]+\.oraclecloud\.com)"), ()),
    "taleobe": ((r"(?i)([a-z0-9.-]+\.tbe\.taleo\.net)",), ()),
    "taleo": ((r"(?i)([a-z0-9-]+\.taleo\.net).*?/careersection/([a-z0-9_]+)/", r"(?i)([a-z0-9-]+\.taleo\.net)"), ()),
    "icims": ((r"(?i)([a-z0-9.-]+\.icims\.com)",), ()),
    "avature": ((r"(?i)([a-z0-9.-]+\.avature\.net)/([^/?#]+)/(?:SearchJobs|JobDetail)", r"(?i)([a-z0-9.-]+\.avature\.net)"), ()),
    "applicantpro": ((r"(?i)([a-z0-9-]+)\.applicantpro\.com",), ("www", "jobs", "static")),
    "jazzhr": ((r"(?i)app\.jazz\.co/feeds/export/jobs/([a-z0-9][a-z0-9-]+)", r"(?i)(?:^|//)([a-z0-9][a-z0-9-]*)\.applytojob\.com"), ("www", "app")),
    "jobvite": ((r"(?i)jobs\.jobvite\.com/(?:careers/)?([^/?#]+)",), ()),
    "phenom": ((r"(?i)([a-z0-9.-]+\.phenompeople\.com)",), ()),
    "brassring": ((r"(?i)brassring\.com.*?partnerid=([^&#]+).*?siteid=([^&#]+)",), ()),
    "schemaorg": ((r"(?i)^\s*schema(?:org)?:\s*(\S+)",), ()),
    "apicapture": ((r"(?i)^\s*api(?:capture)?:\s*(\S+)",), ()),
    "tesla": ((r"(?i)(tesla)\.com/.*career",), ()),
    "coveo": ((r"(?i)^\s*coveo:\s*(\S+)",), ()),
    "peopleadmin": ((r"(?i)([a-z0-9.-]+\.peopleadmin\.com)",), ()),
    "jobdiva": ((r"(?i)([a-z0-9.-]*jobdiva\.com)",), ()),
    "ripplehire": ((r"(?i)([a-z0-9.-]+\.ripplehire\.com)",), ()),
    "ukg": ((r"(?i)([a-z0-9.-]+(?:ultipro\.com|rec\.pro\.ukg\.net))/([A-Za-z0-9]{6,})/JobBoard/([0-9a-fA-F-]{36})",), ()),
    "adp": ((r"(?i)workforcenow\.adp\.com.*?cid=([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})",), ()),
    "dayforce": ((r"(?i)dayforcehcm\.com/(?:[a-z]{2}(?:-[a-z]{2})?/)?([a-z0-9_]+)",), ()),
    "paycom": ((r"(?i)paycomonline\.net.*?clientkey=([0-9A-Fa-f]{32})",), ()),
}
LOWERED = ("eightfold", "taleo", "taleobe", "icims", "avature", "applicantpro", "jazzhr", "jobvite", "phenom", "peopleadmin", "jobdiva", "ripplehire", "tesla")


def token_of(url: Column, source: str) -> Column:
    """The token of an address, if it is one of the source."""
    patterns, none = ADDRESSES[source]

    def parts(pattern: str) -> Column:
        groups = pattern.count("(") - pattern.count("(?")
        found = [F.nullif(F.regexp_extract(url, pattern, k + 1), F.lit("")) for k in range(groups)]
        joined = found[0] if groups == 1 else F.when(found[-1].isNotNull(), F.concat_ws("|", *found))
        return F.when(~F.lower(joined).isin(*none), joined) if none else joined

    token = F.coalesce(*[parts(p) for p in patterns])
    return F.lower(token) if source in LOWERED else token


def resolve(url: Column) -> Column:
    """The first source that an address belongs to, with its token: a struct of ``source`` and ``token``, or null."""

    def named(u: Column, source: str) -> Column:
        return let(token_of(u, source), lambda t: F.when(t.isNotNull(), F.struct(F.lit(source).alias("source"), t.alias("token"))))

    return let(url, lambda u: F.coalesce(*[named(u, s) for s in ADDRESSES]))


def resolve_urls(urls: DataFrame, registry: DataFrame, url: str = "url") -> DataFrame:
    """Rows with ``source`` and ``token`` of their address: by its form, else by the registry's longest parent domain."""
    host = F.lower(F.regexp_extract(F.col(url), r"^(?:[a-zA-Z]+://)?(?:[^/@]*@)?([^/:?#]+)", 1))
    rows = urls.withColumns({"__found": resolve(F.col(url)), "__host": host})
    known = joins.lookup_domain(rows, registry, "__host")
    return known.select(*urls.columns, F.coalesce("__found.source", "ats").alias("source"), F.when(F.col("__found").isNull(), F.col("token")).otherwise(F.col("__found.token")).alias("token"))


def embedded_boards(pages: DataFrame, html: str = "html") -> DataFrame:
    """Boards that a page links to: a row for each different one, with its ``source``, ``token`` and first place ``pos``."""
    links = F.regexp_extract_all(F.col(html), F.lit(r"(?i)https?://[^\s\"'<>\\)]+"), F.lit(0))
    each = pages.select(*[c for c in pages.columns if c != html], F.posexplode(links).alias("pos", "link")).withColumn("__b", resolve(F.col("link"))).where("__b IS NOT NULL")
    rest = [c for c in pages.columns if c != html]
    return each.groupBy(*rest, F.col("__b.source").alias("source"), F.col("__b.token").alias("token")).agg(F.min("pos").alias("pos"))


def first_live(candidates: DataFrame, probes: DataFrame, page: str) -> DataFrame:
    """Of each page's boards the earliest one that a probe found live (``probes``: source, token, live)."""
    live = candidates.join(probes.where("live").select("source", "token").distinct(), ["source", "token"])
    best = live.groupBy(page).agg(F.min(F.struct("pos", "source", "token")).alias("b"))
    return best.select(page, "b.source", "b.token")
