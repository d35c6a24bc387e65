"""Streaming forms of the stateful steps: what is new, per-board states, posting events by window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def new_postings(stream: DataFrame, watermark: str = "30 days") -> DataFrame:
    """Each (source, id) once, as long as the watermark keeps it; ``stream`` has source, id, ts."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["source", "id"])


def activity(stream: DataFrame, key: str = "event_type", size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by window and kind; late ones count until the watermark passes."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), key).agg(F.count(F.lit(1)).alias("n"))


STATE = "errors int, unchanged int, throttle double, last_changed string"
OUTPUT = "source string, token string, day string, consecutive_errors int, consecutive_unchanged int, throttle_score double, last_changed string"


def board_states(stream: DataFrame) -> DataFrame:
    """States of boards as their outcomes arrive (source, token, day, changed, error, http_429, requests)."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        errors, unchanged, throttle, last = state.get if state.exists else (0, 0, 0.0, None)
        rows = pd.concat(list(batches)).sort_values("day")
        day = None
        for day, changed, error, pushed, requests in rows[["day", "changed", "error", "http_429", "requests"]].itertuples(index=False):
            errors = errors + 1 if error else 0
            unchanged, last = (0, day) if changed else (unchanged + 1, last)
            throttle = round(throttle * 0.5 + (pushed / requests if requests else 0.0) * 0.5, 4)
        state.update((errors, unchanged, throttle, last))
        yield pd.DataFrame([(*key, day, errors, unchanged, throttle, last)], columns=["source", "token", "day", "consecutive_errors", "consecutive_unchanged", "throttle_score", "last_changed"])

    return stream.groupBy("source", "token").applyInPandasWithState(fold, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def build_from_stream(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Appends the stream's rows to the table at ``path`` batch by batch, each id once over all batches. A batch that is run again
    after a failure replaces its own part, so none is written twice."""

    def add(batch: DataFrame, nth: int) -> None:
        spark = batch.sparkSession
        first = batch.dropDuplicates(["id"])
        others = spark.read.schema(T.StructType([*batch.schema.fields, T.StructField("part", T.LongType())])).parquet(path) if nth else None
        fresh = first if others is None else first.join(others.where(F.col("part") != nth).select("id"), "id", "left_anti")
        fresh.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/part={nth}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class Heartbeat(StreamingQueryListener):
    """Keeps the last progress of each query, and hands it to ``report`` as a dictionary, for example to be written."""

    def __init__(self, report=None):
        self.last: dict[str, dict] = {}
        self.report = report or (lambda progress: None)

    def _note(self, query: str, **more) -> None:
        self.last[query] = self.last.get(query, {}) | more
        self.report({"query": query} | self.last[query])

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._note(str(event.id), state="running", batches=0, rows=0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p, before = event.progress, self.last.get(str(event.progress.id), {})
        self._note(str(p.id), batches=p.batchId + 1, rows=before.get("rows", 0) + p.numInputRows, at=p.timestamp)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._note(str(event.id), at=event.timestamp)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._note(str(event.id), state="failed" if event.exception else "done")
