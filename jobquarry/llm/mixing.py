"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every source is a queue of its documents in a shuffled order that depends on the document alone. A document's virtual finish
time is the number of words its queue has served when it ends, divided by the source's target; a queue whose target exceeds
its size is served again from the front, up to ``repeats`` times, each serving with a finish time of its own. All servings
stand in one global order, by virtual finish time, then by source. It is truncated at the total budget (``share`` times all
words): the servings of the longest beginning whose words add up to the budget at most are taken. Queues that are served in
this order share the output by their targets at any moment, so each source ends within about a document of its target.

The order is never made in one task. Running sums within a source come in two steps: the shuffled order is cut into ranges of
about ``max(1000, sqrt(rows))`` rows, sums of ranges are added up first, and sums within a range are added to them. The
running sum over all sources comes the same way, over ranges of virtual time that hold about as many rows: sums by range tell
in which range the budget ends, and only that one is ordered row by row. The result is range-sorted by virtual finish time.

States: a null text has size 0; a document of size 0 takes 0 words; the null source is a source of its own, sorted last; a
null id is shuffled like an empty one; rows with equal ids are ordered by their text, and equal rows are interchangeable; if
all sizes are 0, so are the targets; an empty table gives an empty result. Input columns are kept, except those with the names
of the added ones, which are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobquarry.llm.common import PREFIX, WORD, Workspace


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, repeats: float) -> DataFrame:
    """``source``, its number ``nth``, ``source_size`` and ``n`` with ``target``: ``share`` times all sizes, divided by weights that
    repeat along the sources in code-point order; no target exceeds ``repeats`` times its source's size, and what is
    cut off goes to the others by weight. There is one row for each source, so this is a small table.

    Sorted by the level at which a source fills up, the full ones come first; the level that the rest shares
    follows from running sums."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighted = sizes.withColumn("nth", nth).withColumn("w", F.element_at(w, (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int")))
    most = F.col("source_size") * F.lit(float(repeats))
    by_level = Window.orderBy(most / F.col("w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    left = total * F.lit(float(share)) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(repeats))
    to_share = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    levels = weighted.select("*", (left / to_share).alias("level"), total.alias("total"))
    full = F.col("level") * F.col("w") >= most
    # The first one that is not full has the level; those after it lie lower.
    shared = F.max(F.when(~full, F.col("level"))).over(everything)
    return levels.select("source", "nth", "source_size", "n", F.when(full | shared.isNull(), most).otherwise(shared * F.col("w")).alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    repeats: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """All rows of ``docs`` with ``size`` (words), ``source_size``, ``target``, ``taken`` (words that the mix takes, repeats
    counted) and ``virtual_finish`` (of the first serving; null if the target is 0), globally sorted by it.

    Times are worked out on a written table of digests and sizes; texts are shuffled once, to meet them, and once more to
    be sorted. Rows are told apart by a 128-bit digest of id, text and source."""
    p = PREFIX
    ws = Workspace(docs.sparkSession, "mix")
    text, source = F.col(text_col).cast("string"), F.col(source_col).cast("string")
    own = F.col(id_col).cast("string")
    known = [F.coalesce(c, F.lit("\x00")) for c in (own, F.md5(text), source)]
    key = F.md5(F.concat_ws("\x1f", *known))
    shuffled = F.struct(F.md5(F.concat_ws("\x1f", F.lit(seed), F.coalesce(own, F.lit("")))).alias("id"), word_count(text).alias("size"), F.md5(F.coalesce(text, F.lit(""))).alias("text"))
    rows = ws.write(docs.select(key.alias("key"), source.alias("source"), word_count(text).alias("size"), shuffled.alias("order")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per_range = F.greatest(F.lit(1000.0), F.sqrt(F.sum("n").over(everything).cast("double")))
    targets = source_targets(sizes, weights, share, repeats)
    ranges = F.ceil(F.col("n") / per_range)
    targets = ws.write(targets.select(F.col("source").alias("of"), "nth", "source_size", "target", ranges.alias("ranges"), F.sum("n").over(everything).alias("rows")))
    at = F.conv(F.substring("order.id", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    placed = rows.join(targets, F.col("source").eqNullSafe(F.col("of"))).withColumn("range", F.floor(at * F.col("ranges")).cast("long"))
    sums = placed.groupBy(F.col("nth").alias("s"), F.col("range").alias("r")).agg(F.sum("size").alias("sum"))
    earlier = Window.partitionBy("s").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("s", "r", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("nth", "range").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("cum", F.sum("size").over(within)).join(sums, (F.col("nth") == F.col("s")) & (F.col("range") == F.col("r")))
    placed = ws.write(placed.select("key", "nth", "size", "source_size", "target", "rows", (F.col("base") + F.col("cum")).alias("done")))
    last, last_of = _last_taken(placed, share, repeats)

    # Rows of one key follow each other, so the first one's time tells the others'.
    times = placed.groupBy(F.col("key").alias(f"{p}key")).agg(F.min("done").alias(f"{p}done"), *[F.first(c).alias(f"{p}{c}") for c in ("nth", "size", "source_size", "target")])
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map", "variant"))]
    copy = F.row_number().over(Window.partitionBy(f"{p}key").orderBy(F.xxhash64(*hashed)))
    met = docs.withColumn(f"{p}key", key).join(times, f"{p}key").withColumn(f"{p}copy", copy)
    size, target = F.col(f"{p}size"), F.col(f"{p}target")
    divisor = F.when(target > 0, target)
    done = F.col(f"{p}done") + (F.col(f"{p}copy") - 1) * size
    taken = F.lit(0).cast("long")
    for k in range(repeats):
        finish = (done + F.col(f"{p}source_size") * k) / divisor
        before = (finish < F.lit(last)) | ((finish == F.lit(last)) & (F.col(f"{p}nth") <= F.lit(last_of)))
        taken = taken + F.when(before, size).otherwise(F.lit(0))
    added = {"size": size, "source_size": F.col(f"{p}source_size"), "target": target, "taken": taken, "virtual_finish": done / divisor}
    mixed = met.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added], *[v.alias(c) for c, v in added.items()])
    return mixed.orderBy(F.col("virtual_finish").asc_nulls_last(), id_col)


def _last_taken(placed: DataFrame, share: float, repeats: int) -> tuple[float, int]:
    """Virtual finish time and source of the last serving before the budget is spent; (-1, 0) if there is none.

    ``placed`` has a row for each document with ``done`` (words its queue has served when it first ends). Servings are cut
    into ranges of virtual time, which are added up; the range in which the budget ends is added up row by row."""
    finish = (F.col("done") + F.col("source_size") * F.col("pass")) / F.when(F.col("target") > 0, F.col("target"))
    served = placed.where("target > 0 AND size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    served = served.select("nth", "size", finish.alias("finish"), F.floor(finish * F.greatest(F.lit(16.0), F.sqrt(F.col("rows").cast("double")))).cast("long").alias("range"))
    totals = placed.groupBy("nth").agg(F.first("source_size").alias("size")).agg(F.sum("size")).first()[0] or 0
    budget = totals * float(share)
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = served.groupBy("range").agg(F.sum("size").alias("sum")).select("range", "sum", F.sum("sum").over(upto).alias("total"))
    over = ranges.where(F.col("total") > F.lit(budget)).orderBy("range").select("range", (F.col("total") - F.col("sum")).alias("base")).first()
    if over is None:
        return math.inf, 0
    in_order = Window.orderBy("finish", "nth").rowsBetween(Window.unboundedPreceding, 0)
    cut = served.where(F.col("range") == over["range"]).withColumn("total", F.sum("size").over(in_order) + F.lit(over["base"]))
    last = cut.where(F.col("total") <= F.lit(budget)).agg(F.max(F.struct("finish", "nth")).alias("last")).first()["last"]
    if last is None:
        last = served.where(F.col("range") < over["range"]).agg(F.max(F.struct("finish", "nth")).alias("last")).first()["last"]
    return (last["finish"], last["nth"]) if last is not None else (-1.0, 0)
