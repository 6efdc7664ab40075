"""Stored jobs: tolerant scans of job metadata, scraped pages and files, and job listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.schemas import JOB, MAPPING_STATUSES, PAGE_STATUSES, PHASES

# File kinds by extension.
FILE_KINDS = {"markdown": ["md"], "json": ["json", "jsonl"], "html": ["html", "htm"], "code": ["ts", "tsx", "js", "css"], "archive": ["zip"]}
HIDDEN_FILES = ["metadata.json"]


def read_jobs(spark: SparkSession, root: str) -> DataFrame:
    """`<host>/<timestamp>/metadata.json` files under a folder, one row per job, malformed values as null."""
    raw = spark.read.schema(JOB).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").json(root)
    parts = F.split(F.regexp_replace(F.input_file_name(), "/metadata\\.json$", ""), "/")
    return raw.withColumn("job_id", F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1)))


def job_timestamp(job_id: Column) -> Column:
    """Milliseconds in a job id `host/timestamp`; 0 where there are none."""
    return F.coalesce(F.element_at(F.split(job_id, "/"), -1).try_cast("bigint"), F.lit(0).cast("bigint"))


def job_host(job_id: Column) -> Column:
    return F.split_part(job_id, F.lit("/"), F.lit(1))


def new_job_id(source: Column, at_ms: Column) -> Column:
    return F.concat_ws("/", F.regexp_replace(urls.host(source), "[^a-zA-Z0-9.-]", ""), at_ms.cast("string"))


def normalize_mapping(mapping: Column) -> Column:
    """A mapping block with a known status, else null; activity only with a known phase, counts at least 0."""
    activity = mapping["activity"]
    activity = F.when(activity["phase"].isin(PHASES), activity.withField("fetchErrors", F.greatest(F.lit(0), F.coalesce(activity["fetchErrors"], F.lit(0)))))
    fixed = mapping.withField("activity", activity).withField("discovered", F.greatest(F.lit(0), F.coalesce(mapping["discovered"], F.lit(0))))
    return F.when(mapping["status"].isin(MAPPING_STATUSES), fixed)


def normalize_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("mapping", normalize_mapping(F.col("mapping"))).withColumn("sourceKey", F.coalesce("sourceKey", urls.source_key(F.col("source"))))


def job_pages(jobs: DataFrame) -> DataFrame:
    """Page inventory: one row per entry with a URL; an unknown status becomes pending, an unknown kind follows from the URL.

    `ord` is the entry's place, slugs that are whole numbers first.
    """
    rows = jobs.select("job_id", F.posexplode("pages").alias("pos", "slug", "page")).filter("page.url is not null")
    whole = F.when(F.col("slug").rlike(r"^(0|[1-9]\d{0,9})\z"), F.col("slug").cast("bigint"))
    status = F.when(F.col("page.status").isin(PAGE_STATUSES), F.col("page.status")).otherwise("pending")
    kind = F.when(F.col("page.kind").isin(urls.KINDS), F.col("page.kind")).otherwise(urls.kind(F.col("page.url")))
    place = F.coalesce(whole, F.lit(1 << 32) + F.col("pos"))
    return rows.select("job_id", place.alias("ord"), "slug", "page.url", status.alias("status"), kind.alias("kind"), "page.contentHash", "page.scrapedAt", "page.error")


def load_pages(inventory: DataFrame, contents: DataFrame) -> DataFrame:
    """Finished pages with readable, non-blank text: inventory joined with (job_id, slug, raw, title, description, structure)."""
    ready = inventory.filter(F.col("status").isin("done", "skipped"))
    return ready.join(contents, ["job_id", "slug"]).filter(F.trim("raw") != "")


def list_jobs(jobs: DataFrame, limit: int = 20) -> DataFrame:
    """The newest jobs by the time in their id, shown by last update."""
    newest = jobs.orderBy(job_timestamp(F.col("job_id")).desc(), "job_id").limit(limit)
    return newest.orderBy(F.desc("updatedAt"), "job_id")


def job_files(spark: SparkSession, root: str) -> DataFrame:
    """Files of a job's folder but for its page files: path, name, kind, length."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(~F.col("path").contains("/pages/")).select("path", name.alias("name"), file_kind(name).alias("kind"), "length").filter(~F.col("name").isin(HIDDEN_FILES))


def file_kind(name: Column) -> Column:
    extension = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    out = F.when(F.lit(False), "")
    for kind, known in FILE_KINDS.items():
        out = out.when(extension.isin(known), kind)
    return out.otherwise("other")


def is_safe_slug(slug: Column) -> Column:
    return F.coalesce(slug.rlike(r"^[a-z0-9][a-z0-9-]*\z"), F.lit(False))
