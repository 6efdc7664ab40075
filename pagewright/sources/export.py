"""Sinks: records, facts and documents of jobs, partitioned by job and overwritten job by job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXCERPT, CONTENT = 3_000, 40_000


def write_json(df: DataFrame, path: str, by: tuple[str, ...] = ("job_id",)) -> None:
    """JSON lines without null fields, one folder per partition value; only the partitions written are replaced."""
    df.repartition(*by).sortWithinPartitions(*by, *[c for c in ("isDuplicate", "ord", "n") if c in df.columns]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", True).partitionBy(*by).json(path)


def write_records(records: DataFrame, path: str) -> None:
    """Records by job and cluster: canonical pages first, then their duplicates."""
    write_json(records, path, ("job_id", "cluster_id"))


def write_facts(facts: DataFrame, path: str) -> None:
    """Facts in two folders: reliable ones, and those that need review."""
    write_json(facts.filter("not needsReview"), f"{path}/facts")
    write_json(facts.filter("needsReview"), f"{path}/facts-review")


def _line(label: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"- {label}: "), value.cast("string")))


def unique_page_document(pages: DataFrame) -> DataFrame:
    """Content documents of pages outside clusters: job_id, slug, document."""
    text = F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce("title", "slug")), F.lit(""), _line("URL", F.col("url")), _line("Description", F.col("description")), _line("Confidence", F.col("diagnostics.contentConfidence")), F.lit(""), F.substring("cleanedMarkdown", 1, CONTENT))
    return pages.select("job_id", "slug", text.alias("document"))


def template_document(clusters: DataFrame, pages: DataFrame) -> DataFrame:
    """One document per cluster from its longest page: headings and an excerpt. Pages come with cluster_id."""
    best = pages.groupBy("job_id", "cluster_id").agg(F.max_by(F.struct("slug", "url", "structure", "cleanedMarkdown"), F.struct(F.length("raw"), -F.col("ord"))).alias("p"))
    heads = F.array_join(F.transform("p.structure.headings", lambda h: F.concat(F.lit("- h"), h["level"].cast("string"), F.lit(" "), h["text"])), "\n")
    text = F.concat_ws("\n", F.concat(F.lit("# "), F.col("pageType")), F.lit(""), _line("Pages", F.col("n")), _line("Confidence", F.col("confidence")), _line("Example", F.col("p.url")), _line("Data", F.col("dataSourcePath")), F.lit("\n## Headings\n"), heads, F.lit("\n## Excerpt\n"), F.substring("p.cleanedMarkdown", 1, EXCERPT))
    return clusters.join(best, ["job_id", "cluster_id"]).select("job_id", "cluster_id", text.alias("document"))


def site_document(pages: DataFrame, clusters: DataFrame, groups: DataFrame) -> DataFrame:
    """One summary document per job, from sections that are grouped lists of lines."""
    per_cluster = clusters.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "number", F.concat(F.lit("- "), F.col("cluster_id"), F.lit(": "), F.col("n").cast("string"), F.lit(" pages")).alias("line")))).alias("c"))
    per_job = pages.groupBy("job_id").agg(F.count("*").alias("n"), F.count_if("isDuplicate").alias("dups"), F.min_by("structure.nav", F.when(F.size("structure.nav") > 0, F.col("ord"))).alias("nav"))
    dup = groups.groupBy("job_id").agg(F.count("*").alias("groups"))
    out = per_job.join(per_cluster, "job_id", "left").join(dup, "job_id", "left")
    lines = lambda c: F.array_join(F.transform(F.coalesce(c, F.expr("cast(array() as array<struct<m:bigint,number:int,line:string>>)")), lambda x: x["line"]), "\n")
    nav = F.array_join(F.transform("nav", lambda x: F.concat(F.lit("- "), x["text"], F.lit(" ("), x["href"], F.lit(")"))), "\n")
    text = F.concat_ws("\n", F.concat(F.lit("# "), F.col("job_id")), _line("Pages", F.col("n")), _line("Duplicates", F.col("dups")), _line("Duplicate groups", F.coalesce("groups", F.lit(0))), F.lit("\n## Templates\n"), lines(F.col("c")), F.lit("\n## Navigation\n"), F.coalesce(nav, F.lit("")))
    return out.select("job_id", text.alias("document"))


def audit_document(audit: DataFrame) -> DataFrame:
    cols = [c for c, t in audit.dtypes if c != "job_id" and t in ("bigint", "int", "double", "string")]
    return audit.select("job_id", F.concat_ws("\n", F.concat(F.lit("# Audit of "), F.col("job_id")), *[_line(c, F.col(c)) for c in cols]).alias("document"))


def manifest(clusters: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per job: numbers of clusters, unique pages and duplicate groups; jobs with neither clusters nor pages are absent."""
    a = members.groupBy("job_id").agg(F.count_if(F.col("cluster_id").isNull()).alias("uniquePages"))
    b = clusters.groupBy("job_id").agg(F.count("*").alias("clusters"))
    c = groups.groupBy("job_id").agg(F.count("*").alias("duplicateGroups"))
    return a.join(b, "job_id", "full").join(c, "job_id", "left").fillna(0, ["uniquePages", "clusters", "duplicateGroups"])


def write_knowledge(built: dict[str, DataFrame], path: str) -> None:
    """All tables of a knowledge build under one folder."""
    write_records(built["records"], f"{path}/data")
    write_facts(built["facts"], path)
    for name in ("audit", "manifest", "duplicate_groups", "clusters"):
        write_json(built[name], f"{path}/{name}")
    for name in ("content_documents", "template_documents", "site_documents"):
        write_json(built[name], f"{path}/{name}")
    write_json(built["pages"].select("job_id", "slug", "diagnostics"), f"{path}/diagnostics")
