"""Boards and their registry: merging candidates, new boards, tiers, routing to ways of checking, requeues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sources whose lists are complete; those where a missing posting is a candidate only, by how it is confirmed.
COMPLETE = (
    "greenhouse", "lever", "ashby", "breezy", "workable", "jazzhr", "rippling", "join", "dejobs", "recruitee", "teamtailor", "personio", "bamboohr", "brassring", "jobdiva", "jobvite", "applicantpro",
    "ripplehire",
)
CONFIRM_BY_LIST = ("oracle", "smartrecruiters", "successfactors", "workday", "radancy", "ukg", "pinpoint", "taleo", "taleobe", "avature", "adp", "phenom")
CONFIRM_BY_POSTING = ("icims", "eightfold")
DEMO_TOKENS = ("demo", "test", "sandbox", "example")
#: New boards that are taken ahead of the cursor, at most; the bound is the rule.
NEW_BOARDS = 2000


def strategy(source: Column) -> Column:
    """How postings of a source are known to be gone: ``membership``, ``relist``, ``posting``, or ``liveness`` for the others."""
    return F.when(source.isin(*COMPLETE), "membership").when(source.isin(*CONFIRM_BY_LIST), "relist").when(source.isin(*CONFIRM_BY_POSTING), "posting").otherwise("liveness")


def is_demo(token: Column) -> Column:
    return F.lower(token).isin(*DEMO_TOKENS) | F.regexp_like(F.lower(token), F.lit(r"(^|[-_])(demo|sandbox)([-_]|$)"))


def read_registry(csv: DataFrame, path: Column) -> DataFrame:
    """Rows of registry files (``company``, ``token``, ``domain``, maybe ``ats``); a missing ``ats`` is the file's stem."""
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    own = F.nullif(F.trim("ats"), F.lit("")) if "ats" in csv.columns else F.lit(None).cast("string")
    clean = lambda c: F.nullif(F.trim(c), F.lit("")) if c in csv.columns else F.lit(None).cast("string")
    rows = csv.select(F.lower(F.trim("company")).alias("company"), F.lower(F.coalesce(own, stem)).alias("ats"), clean("token").alias("token"), clean("domain").alias("domain"))
    return rows.where("company IS NOT NULL AND company <> '' AND token IS NOT NULL")


def best_candidates(verified: DataFrame, priority: dict[str, int]) -> DataFrame:
    """One candidate for each company: most jobs, then the best source, then the smallest token."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv]), F.col("ats")), F.lit(99))
    best = F.min(F.struct((-F.col("jobs")).alias("m"), rank.alias("r"), "token", "ats", "domain"))
    return verified.groupBy("company").agg(best.alias("b")).select("company", "b.ats", "b.token", "b.domain", (-F.col("b.m")).alias("jobs"))


def merge_registry(registry: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (``company``, ``ats``, ``token``, ``domain``, ``jobs``) with what becomes of them: ``demo``, ``dup_slug``, ``dup_board``,
    or ``added``. Of candidates that name one board the first company gets it."""
    have = registry.select(F.lower("company").alias("__c")).distinct()
    boards = registry.select(F.col("ats").alias("__a"), F.col("token").alias("__t")).distinct().withColumn("__known", F.lit(True))
    c = candidates.withColumn("__lower", F.lower("company")).join(have, F.col("__lower") == F.col("__c"), "left")
    c = c.join(boards, (F.col("ats") == F.col("__a")) & (F.col("token") == F.col("__t")), "left")
    early = F.when(is_demo(F.col("token")), "demo").when(F.col("__c").isNotNull(), "dup_slug").when(F.col("__known"), "dup_board")
    c = c.withColumn("__early", early)
    nth = F.row_number().over(Window.partitionBy("ats", "token", F.col("__early").isNull()).orderBy("company"))
    outcome = F.coalesce("__early", F.when(nth > 1, "dup_board").otherwise("added"))
    return c.withColumn("outcome", outcome).select(*candidates.columns, "outcome")


def new_boards(registry: DataFrame, states: DataFrame, limit: int = NEW_BOARDS) -> DataFrame:
    """Registered boards that were never crawled, by company, at most ``limit``."""
    named = registry.where("ats IS NOT NULL AND token IS NOT NULL AND ats <> '' AND token <> ''")
    unseen = named.join(states.select(F.col("source").alias("ats"), "token"), ["ats", "token"], "left_anti")
    return unseen.select(*registry.columns).orderBy("company").limit(limit)


def tier_mix(states: DataFrame) -> DataFrame:
    """Boards by tier, and how many of them were throttled."""
    return states.groupBy("tier").agg(F.count(F.lit(1)).alias("boards"), F.count_if(F.col("throttle_score") > 0).alias("throttled"))


def empty_boards(boards: DataFrame, previous: DataFrame) -> DataFrame:
    """Boards that came back empty, with the company keys that they had in the previous index."""
    before = previous.where("board_token IS NOT NULL AND company_key IS NOT NULL").groupBy("source", F.col("board_token").alias("token")).agg(F.array_sort(F.collect_set("company_key")).alias("company_keys"))
    none = boards.where(F.col("rows") == 0).join(before, ["source", "token"], "left")
    return none.select("source", "token", F.coalesce("company_keys", F.array().cast("array<string>")).alias("company_keys"))


def changed_feeds(boards: DataFrame, stored: DataFrame) -> DataFrame:
    """Boards whose feed must be read: those whose validator (``etag``) is missing, new, or not the stored one."""
    s = stored.select("source", "token", F.col("etag").alias("__etag"))
    out = boards.join(s, ["source", "token"], "left")
    return out.where(F.col("etag").isNull() | ~F.col("etag").eqNullSafe(F.col("__etag"))).select(*boards.columns)


def change_candidates(counts: DataFrame, stored: DataFrame) -> DataFrame:
    """Boards whose cheap count differs from the rows that are stored for them; unknown counts are candidates."""
    s = stored.where("status = 'active'").groupBy("source", F.col("board_token").alias("token")).agg(F.count(F.lit(1)).alias("stored"))
    out = counts.join(s, ["source", "token"], "left").withColumn("stored", F.coalesce("stored", F.lit(0)))
    return out.where(F.col("count").isNull() | (F.col("count") != F.col("stored"))).select("source", "token", "count", "stored")


def requeue_places(details: DataFrame, ids: DataFrame) -> DataFrame:
    """Detail states where the rows of ``ids`` that were read but have no place are to be read again; nothing that was
    recovered is lost."""
    named = details.join(ids.select("id").distinct().withColumn("__in", F.lit(True)), "id", "left")
    again = F.coalesce(F.col("__in"), F.lit(False)) & F.col("fetched_at").isNotNull() & F.col("city").isNull() & F.col("country").isNull()
    changed = {"fetched_at": F.when(~again, F.col("fetched_at")), "attempts": F.when(again, 0).otherwise(F.col("attempts"))}
    return named.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in details.columns])


def confirmed_relist(candidates: DataFrame, listed: DataFrame) -> DataFrame:
    """Candidates that a second full list of their board doesn't show either; boards without one keep theirs."""
    seen = listed.select("source", "token").distinct()
    return candidates.join(seen, ["source", "token"], "left_semi").join(listed.select("source", "token", "id"), ["source", "token", "id"], "left_anti")
