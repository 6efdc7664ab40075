"""Streams of a crawl: new URLs, activity of mappings, and status snapshots of jobs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagewright.functions import urls
from pagewright.schemas import PAGE_STATUSES

STALL_MS = 120_000


def new_urls(discovered: DataFrame) -> DataFrame:
    """A stream of (job_id, url): each canonical URL of a job once, with its kind."""
    rows = discovered.select("job_id", F.coalesce(urls.canonicalize(F.col("url")), F.col("url")).alias("url"))
    return rows.dropDuplicates(["job_id", "url"]).withColumn("kind", urls.kind(F.col("url")))


def activity(events: DataFrame) -> DataFrame:
    """A stream of events (job_id, seq, type, phase, url, message) folded into each job's latest activity."""
    latest = lambda c, kind: F.max_by(c, F.when(F.col("type") == kind, F.col("seq")))
    return events.groupBy("job_id").agg(
        latest("phase", "phase").alias("phase"), latest("url", "fetching").alias("lastUrl"), F.count_if(F.col("type") == "fetch-error").alias("fetchErrors"), F.max_by(F.struct("url", "message"), F.when(F.col("type") == "fetch-error", F.col("seq"))).alias("lastError")
    )


def status_counts(changes: DataFrame) -> DataFrame:
    """Latest status of each page from a stream of changes (job_id, slug, seq, status): job_id, slug, status."""
    return changes.groupBy("job_id", "slug").agg(F.max_by("status", "seq").alias("status"))


def snapshot(latest: DataFrame) -> DataFrame:
    """Status counts of each job from the latest page statuses."""
    return latest.groupBy("job_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in PAGE_STATUSES], F.count("*").alias("pages"))


def changed_only(sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that passes on a batch only where it has rows."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch.limit(1).count():
            sink(batch, batch_id)

    return run


def append_new(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends a micro-batch to the inventory, one folder a batch, so a repeated batch replaces itself."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run


class StallTimer(StatefulProcessor):
    """Emits (job_id, stalled) for jobs from which no event came for a while; every event sets the timer anew."""

    def __init__(self, timeout_ms: int = STALL_MS):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues):
        for _ in rows:
            pass
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        at = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
        self.handle.registerTimer(at)
        self.timer.update((at,))
        yield pd.DataFrame({"job_id": [key[0]], "stalled": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.clear()
        yield pd.DataFrame({"job_id": [key[0]], "stalled": [True]})

    def close(self) -> None:
        pass


def stalled_jobs(events: DataFrame, timeout_ms: int = STALL_MS) -> DataFrame:
    """A stream of (job_id, stalled): false with each batch of a job's events, true when none came for `timeout_ms`."""
    return events.groupBy("job_id").transformWithStateInPandas(StallTimer(timeout_ms), "job_id string, stalled boolean", "Update", "ProcessingTime")
