"""Boards over time: crawl scheduling, membership sweeps, liveness, the drain of detail pages.

Fetching is outside; what was fetched comes as tables. A board that could not be read expires nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobquarry.functions import keys

# Days, counts and shares of the rules below.
HOT_DAYS, WARM_DAYS = 4, 14
INTERVALS = {"hot": 0, "warm": 3, "cold": 7, "quarantine": 7}
ERROR_LIMIT, THROTTLE_LIMIT = 3, 0.5
GUARD_SIZE, GUARD_SHARE = 20, 0.5
CONFIRM_BOUND = 200
RECHECK_DAYS, UNCONFIRMED_STREAK = 7, 2
RETRY_CAP = 3


def tier(errors: Column, throttle: Column, last_changed: Column, today: Column) -> Column:
    age = F.abs(F.datediff(today.cast("date"), last_changed.cast("date")))
    return (
        F.when((errors >= ERROR_LIMIT) | (throttle >= THROTTLE_LIMIT), "quarantine").when(last_changed.isNull() | (age <= HOT_DAYS), "hot").when(age <= WARM_DAYS, "warm").otherwise("cold")
    )


def next_due(tier_: Column, today: Column) -> Column:
    days = F.lit(0)
    for name, n in INTERVALS.items():
        days = F.when(tier_ == name, n).otherwise(days)
    return F.date_add(today.cast("date"), days).cast("string")


def due(states: DataFrame, today: str) -> DataFrame:
    """Boards to crawl: all hot ones, and those whose day has come."""
    return states.where((F.col("tier") == "hot") | F.col("next_due").isNull() | (F.col("next_due") <= today))


def fold_outcomes(outcomes: DataFrame, keys_: list[str]) -> DataFrame:
    """Board states after their outcomes in order of ``day``: error and unchanged runs, the smoothed rate of pushed-back
    requests, tier and next day. ``outcomes``: day, changed, error, http_429, requests."""
    listed = F.array_sort(F.collect_list(F.struct("day", "changed", "error", "http_429", "requests")))
    zero = F.struct(F.lit(0).alias("errors"), F.lit(0).alias("unchanged"), F.lit(0.0).alias("throttle"), F.lit(None).cast("string").alias("changed"), F.lit(None).cast("string").alias("day"))

    def step(s: Column, o: Column) -> Column:
        rate = F.coalesce(F.try_divide(o["http_429"].cast("double"), o["requests"].cast("double")), F.lit(0.0))
        return F.struct(
            F.when(o["error"], s["errors"] + 1).otherwise(0).alias("errors"),
            F.when(o["changed"], 0).otherwise(s["unchanged"] + 1).alias("unchanged"),
            F.bround(s["throttle"] * 0.5 + rate * 0.5, 4).alias("throttle"),
            F.when(o["changed"], o["day"]).otherwise(s["changed"]).alias("changed"),
            o["day"].alias("day"),
        )

    s = outcomes.groupBy(*keys_).agg(F.aggregate(listed, zero, step).alias("s"))
    t = tier(F.col("s.errors"), F.col("s.throttle"), F.col("s.changed"), F.col("s.day"))
    return s.select(
        *keys_, F.col("s.day").alias("last_crawled"), F.col("s.changed").alias("last_changed"), F.col("s.errors").alias("consecutive_errors"),
        F.col("s.unchanged").alias("consecutive_unchanged"), F.col("s.throttle").alias("throttle_score"), t.alias("tier"), next_due(t, F.col("s.day")).alias("next_due"),
    )


def sweep(stored: DataFrame, live: DataFrame, boards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Membership of boards whose list is complete: (board deltas, departed ids).

    ``stored`` and ``live`` have source, token, id; ``boards`` has source, token, fetched (false: it failed). A board is
    undetermined if it failed, is empty while postings are stored, or seems to have lost more than half of twenty or
    more; then nothing is said about it. One full join of ids and one aggregate for each board.
    """
    on = ["source", "token"]
    s = stored.select(*on, "id").distinct().withColumn("__s", F.lit(1))
    v = live.select(*on, "id").distinct().withColumn("__v", F.lit(1))
    ids = s.join(v, [*on, "id"], "full_outer")
    g = ids.groupBy(*on).agg(
        F.count("__s").alias("stored"), F.count("__v").alias("live"), F.count_if(F.col("__v").isNull()).alias("missing"),
        F.array_sort(F.collect_list(F.when(F.col("__s").isNull(), F.col("id")))).alias("added_ids"), keys.idset_hash(F.collect_list(F.when(F.col("__v").isNotNull(), F.col("id")))).alias("idset_hash"),
    )
    b = boards.select(*on, "fetched").join(g, on, "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    unsure = ~F.col("fetched") | ((n("live") == 0) & (n("stored") > 0)) | ((n("stored") >= GUARD_SIZE) & (n("missing") > GUARD_SHARE * n("stored")))
    b = b.select(*on, n("stored").alias("stored"), n("live").alias("live"), n("missing").alias("missing"), F.coalesce("added_ids", F.array().cast("array<string>")).alias("added_ids"), F.coalesce("idset_hash", keys.idset_hash(F.array().cast("array<string>"))).alias("idset_hash"), unsure.alias("undetermined"))
    sure = b.where("NOT undetermined")
    departed = ids.where(F.col("__v").isNull()).select(*on, "id").join(sure.select(*on), on, "left_semi").withColumn("reason", F.lit("departed_board"))
    return b, departed


def confirm_bounded(candidates: DataFrame, limit: int = CONFIRM_BOUND) -> DataFrame:
    """The first candidates of each board by id; the bound is the rule, the rest is confirmed on later runs."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("source", "token").orderBy("id"))
    return candidates.withColumn("__n", nth).where(F.col("__n") <= limit).drop("__n")


def confirm(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Candidates with what a look at each says: expired if it is gone, alive, or unconfirmed. ``verdicts``: id, verdict
    (gone, alive, unknown)."""
    out = candidates.join(verdicts, "id", "left")
    return out.select(*[F.col(c) for c in candidates.columns], F.when(F.col("verdict") == "gone", "expired").when(F.col("verdict") == "alive", "alive").otherwise("unconfirmed").alias("outcome"))


def liveness(rows: DataFrame, state: DataFrame, listed: DataFrame, boards: DataFrame, verdicts: DataFrame, confirm_sources: tuple[str, ...], now: str) -> DataFrame:
    """New liveness states of active rows that are due: ``id``, ``dead_streak``, ``verdict`` (live, candidate, dead).

    A row is due if it was never checked or a week ago. A listed row is live. An unlisted one of a source with detail pages
    dies at the first look that finds it gone, is live if it is there, and stays as it was if the look failed; of other
    sources it dies at the second miss. Rows of boards that failed are left out.
    """
    due_ = rows.where(F.col("status") == "active").join(state, "id", "left")
    late = F.col("checked_at").isNull() | (F.datediff(F.lit(now).cast("date"), F.col("checked_at").cast("date")) >= RECHECK_DAYS)
    due_ = due_.where(late).join(boards.where("fetched").select("source", F.col("token").alias("board_token")), ["source", "board_token"], "left_semi")
    hit = due_.join(listed.select("id").distinct().withColumn("__on", F.lit(True)), "id", "left").join(verdicts.select("id", F.col("verdict").alias("__look")), "id", "left")
    streak = F.coalesce("dead_streak", F.lit(0)) + 1
    looked = F.col("source").isin(*confirm_sources)
    new = (
        F.when(F.col("__on"), F.struct(F.lit(0).alias("dead_streak"), F.lit("live").alias("verdict")))
        .when(looked & (F.col("__look") == "alive"), F.struct(F.lit(0).alias("dead_streak"), F.lit("live").alias("verdict")))
        .when(looked & (F.col("__look") == "gone"), F.struct(streak.alias("dead_streak"), F.lit("dead").alias("verdict")))
        .when(~looked, F.struct(streak.alias("dead_streak"), F.when(streak >= UNCONFIRMED_STREAK, "dead").otherwise("candidate").alias("verdict")))
    )
    return hit.withColumn("__new", new).where(F.col("__new").isNotNull()).select("id", "__new.dead_streak", "__new.verdict")


def drain_candidates(rows: DataFrame, state: DataFrame, location_sources: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose detail page should be read: without a body (or, for some sources, without a place), and never read, changed
    since, or failed fewer than three times."""
    c = F.col
    wanted = (F.coalesce(F.trim("snippet"), F.lit("")) == "") | (c("source").isin(*location_sources) & c("city").isNull() & c("country").isNull() if location_sources else F.lit(False))
    sig = keys.detail_signature(c("content_hash"), c("title"), c("level"))
    out = rows.where(wanted).withColumn("sig", sig).join(state.select(c("id"), c("sig").alias("__sig"), c("fetched_at").alias("__at"), c("attempts").alias("__n")), "id", "left")
    ready = c("__sig").isNull() | (c("__sig") != c("sig")) | (c("__at").isNull() & (F.coalesce("__n", F.lit(0)) < RETRY_CAP))
    return out.where(ready).select(*[c(x) for x in rows.columns], "sig")


def fold_detail(state: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """Detail states after a drain: a success resets the attempts, a failure counts one more, or 1 for changed content.
    ``results``: id, sig, ok."""
    s = state.select("id", F.col("sig").alias("__sig"), F.col("attempts").alias("__n"), F.col("fetched_at").alias("__at"))
    both = s.join(results, "id", "full_outer")
    seen = F.col("ok").isNotNull()
    attempts = F.when(F.col("ok"), 0).when(F.col("__sig") == F.col("sig"), F.coalesce("__n", F.lit(0)) + 1).otherwise(1)
    return both.select(
        "id", F.when(seen, F.col("sig")).otherwise(F.col("__sig")).alias("sig"), F.when(seen, attempts).otherwise(F.col("__n")).alias("attempts"),
        F.when(F.col("ok"), F.lit(now)).when(seen & (F.col("__sig") == F.col("sig")), F.col("__at")).when(seen, F.lit(None)).otherwise(F.col("__at")).alias("fetched_at"),
    )


def unchanged_boards(states: DataFrame, deltas: DataFrame) -> DataFrame:
    """Boards whose membership is as it was when they were last crawled; they may be skipped."""
    return states.join(deltas.where("NOT undetermined").select("source", "token", F.col("idset_hash").alias("__h")), ["source", "token"]).where(F.col("idset_hash") == F.col("__h")).select(*states.columns)


def shard_of(bucket: Column, shards: int, isolated: tuple[str, ...] = ("join.com",)) -> Column:
    """The shard of a rate bucket: isolated hosts have shard 0 to themselves, the others share the rest by SHA-1."""
    if shards <= 1:
        return F.lit(0).cast("long")
    return F.when(bucket.isin(*isolated), F.lit(0).cast("long")).otherwise(keys.sha1_mod(bucket, shards - 1) + 1)
