"""Queries over the streams that keep state by job: stored rows are replayed to their end, and SQL states the same events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.plans.knowledge import Stages
from pagewright.plans.queries import CANON, HOST, STATUS, host_pages, query, table
from pagewright.streaming import jobs

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replayed(spark: SparkSession, name: str, rows: DataFrame, stream: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream gives for stored rows. State by job needs the state store that keeps it outside the heap."""
    save = Stages(spark, name)
    stored = save("rows", rows)
    given = spark.readStream.schema(stored.schema).parquet(f"{save.root}/rows")
    before = spark.conf.get(PROVIDER)
    try:
        spark.conf.set(PROVIDER, ROCKS)
        out = stream(given)
        out.writeStream.format("parquet").option("path", f"{save.root}/out").option("checkpointLocation", f"{save.root}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(out.schema).parquet(f"{save.root}/out")


@query(f"""
WITH p AS (SELECT {HOST} AS job_id, page_id, {STATUS} AS s FROM pages),
c AS (SELECT job_id, 1000 * page_id + 1 AS "at", 'pending' AS plus, NULL AS minus FROM p UNION ALL SELECT job_id, 1000 * page_id + 501, s, 'pending' FROM p WHERE s <> 'pending'
      UNION ALL SELECT job_id, 1000 * max(page_id) + 900, NULL, NULL FROM p GROUP BY job_id),
r AS (SELECT job_id, "at", plus, row_number() OVER w AS n, {", ".join(f"CAST(sum(CASE plus WHEN '{s}' THEN 1 ELSE 0 END - CASE minus WHEN '{s}' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS {s}" for s in jobs.PAGE_STATUSES)}
      FROM c WINDOW w AS (PARTITION BY job_id ORDER BY "at"))
SELECT job_id, n, "at", 'status' AS event, CASE WHEN plus IS NULL THEN 'mapped' ELSE 'mapping' END AS mapping, {", ".join(jobs.PAGE_STATUSES)} FROM r
UNION ALL SELECT job_id, n + 1, "at", 'done', NULL, {", ".join("NULL" for _ in jobs.PAGE_STATUSES)} FROM r WHERE plus IS NULL AND scraping = 0
""")
def streaming_status_events(spark, sf_dir):
    """Status events of hosts as jobs: each page appears and gets its status, then the mapping ends."""
    pages = table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("job_id"), F.col("page_id").alias("p"), F.col("page_id").cast("string").alias("slug"), F.expr(STATUS).alias("s"))
    none = F.lit(None).cast("string")
    found = pages.select("job_id", (F.col("p") * 1000 + 1).alias("at"), F.lit("mapping").alias("mapping"), "slug", F.lit("pending").alias("status"))
    seen = pages.select("job_id", F.col("p") * 1000 + 501, none, "slug", "s")
    over = pages.groupBy("job_id").agg(F.max("p") * 1000 + 900, F.lit("mapped"), none, none)
    rows = found.union(seen).union(over).withColumn("seq", F.lit(0).cast("long"))
    return replayed(spark, "status-events", rows, lambda s: jobs.status_stream(s, heartbeat_ms=10**15))


BATCH, LIMIT = 3, 7


@query(f"""
WITH u AS (SELECT job_id, canonical AS url, min(page_id) AS "at" FROM ({CANON}) GROUP BY ALL),
r AS (SELECT job_id, url, row_number() OVER (PARTITION BY job_id ORDER BY "at") AS i FROM u QUALIFY i <= {LIMIT})
SELECT job_id, (i - 1) // {BATCH} + 1 AS n, string_agg(url, ' ' ORDER BY i) AS urls FROM r GROUP BY ALL
""")
def streaming_discovery(spark, sf_dir):
    """New URLs of hosts in batches of three, seven at most, in the order of pages."""
    pages = host_pages(spark, sf_dir)
    found = pages.select("job_id", (F.col("ord") + 1).alias("at"), F.lit("url").alias("type"), "url")
    over = pages.groupBy("job_id").agg(F.max("ord") + 2, F.lit("end"), F.lit(None).cast("string"))
    rows = found.union(over).withColumn("seq", F.lit(0).cast("long"))
    out = replayed(spark, "discovery", rows, lambda s: jobs.discovery_stream(s, BATCH, LIMIT))
    return out.filter("event = 'batch'").select("job_id", "n", F.array_join("urls", " ").alias("urls"))


EVERY = 6 * 3_600_000


@query(f"""
WITH RECURSIVE v AS (SELECT CAST(user_id AS VARCHAR) AS job_id, epoch_us(ts) // 1000 AS "at", event_id, event_type FROM events WHERE event_type <> 'purchase'),
e AS (
  SELECT *, event_type IN ('signup', 'error') AS forced, row_number() OVER w AS i, count(*) FILTER (event_type = 'error') OVER w AS errors, CASE WHEN count(*) FILTER (event_type = 'signup') OVER w > 0 THEN 'crawl' END AS phase,
         'e' || max(CASE WHEN event_type IN ('click', 'view') THEN event_id END) OVER w AS last_url, 'e' || max(CASE WHEN event_type = 'error' THEN event_id END) OVER w || ': error' AS last_error
  FROM v WINDOW w AS (PARTITION BY job_id ORDER BY "at", event_id)),
w AS (
  SELECT job_id, i, "at" AS written, true AS wrote FROM e WHERE i = 1
  UNION ALL SELECT e.job_id, e.i, CASE WHEN forced OR e.at - w.written >= {EVERY} THEN e.at ELSE w.written END, forced OR e.at - w.written >= {EVERY} FROM w JOIN e ON e.job_id = w.job_id AND e.i = w.i + 1)
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY i) AS n, "at", phase, last_url AS lastUrl, errors AS fetchErrors, last_error AS lastError FROM e JOIN w USING (job_id, i) WHERE wrote
""")
def streaming_activity_writes(spark, sf_dir):
    """Events of users as crawl activity: views are fetches, errors failed ones, signups a new phase; one write in six hours."""
    events = table(spark, sf_dir, "events").filter("event_type != 'purchase'")
    kind = F.when(F.col("event_type") == "signup", "phase").when(F.col("event_type") == "error", "fetch-error").otherwise("fetching")
    at = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    rows = events.select(F.col("user_id").cast("string").alias("job_id"), at.alias("at"), F.col("event_id").alias("seq"), kind.alias("type"), F.when(kind == "phase", "crawl").alias("phase"), F.concat(F.lit("e"), "event_id").alias("url"), F.col("event_type").alias("message"))
    return replayed(spark, "activity", rows, lambda s: jobs.throttled_activity(s, every_ms=EVERY))
