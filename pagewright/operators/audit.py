"""Audit figures of a job, review lists and status counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators.numbering import prefix_sums, saver
from pagewright.schemas import PAGE_STATUSES

LOW_CONFIDENCE = 0.7


def review_list(pages: DataFrame) -> DataFrame:
    """Pages for manual review, each once, with the first reason that lists it: job_id, ord, slug, url, reason."""
    has = lambda w: F.coalesce(F.array_contains("diagnostics.warnings", w), F.lit(False))
    reason = F.when(F.col("diagnostics.contentConfidence") < LOW_CONFIDENCE, "low_confidence").when(has("mostly_navigation_content"), "mostly_navigation_content").when(has("empty_or_short_body"), "empty_or_short_body")
    return pages.withColumn("reason", reason).filter("reason is not null").select("job_id", "ord", "slug", "url", "diagnostics.contentConfidence", "diagnostics.warnings", "reason")


def audit(pages: DataFrame, members: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per job: page, cluster, duplicate, cleaning and fact counts."""
    has = lambda w: F.coalesce(F.array_contains("diagnostics.warnings", w), F.lit(False))
    by_page = pages.groupBy("job_id").agg(
        F.count("*").alias("totalPagesScraped"), F.count_if("isDuplicate").alias("duplicatePages"), F.sum("diagnostics.removedLineCount").alias("noisySectionsRemoved"), F.count_if(F.col("diagnostics.contentConfidence") < LOW_CONFIDENCE).alias("lowConfidencePages"),
        F.count_if(has("mostly_navigation_content")).alias("mostlyNavigationPages"), F.count_if(has("empty_or_short_body")).alias("shortPages"),
    )
    by_member = members.groupBy("job_id").agg(F.count("cluster_id").alias("clusteredPages"), F.count_if(F.col("cluster_id").isNull()).alias("uniquePages"))
    kinds = facts.groupBy("job_id", "kind").agg(F.count("*").alias("n"), F.count_if("needsReview").alias("weak"))
    by_fact = kinds.groupBy("job_id").agg(F.sum("n").alias("factsCount"), F.sum("weak").alias("reviewFactsCount"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("factsByKind"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("weak") > 0, F.struct("kind", "weak"))))).alias("suspiciousFactsByKind"))
    out = by_page.join(by_member, "job_id", "left").join(by_fact, "job_id", "left").fillna(0, ["clusteredPages", "uniquePages", "factsCount", "reviewFactsCount"])
    return out.withColumn("reliableFactsCount", F.col("factsCount") - F.col("reviewFactsCount")).withColumn("pagesSuccessfullyClassified", F.col("clusteredPages") + F.col("uniquePages") + F.col("duplicatePages"))


def status_counts(pages: DataFrame) -> DataFrame:
    """Pages of each job by status, absent ones 0."""
    return pages.groupBy("job_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in PAGE_STATUSES])


def kind_counts(pages: DataFrame) -> DataFrame:
    """Pages by kind, a missing kind counted as content."""
    return pages.groupBy(F.coalesce("kind", F.lit("content")).alias("kind")).agg(F.count("*").alias("n"))


def kind_breakdown(counts: DataFrame) -> DataFrame:
    """One text per job, like `price: 3, phone: 1`, by count descending: from rows (job_id, kind, n)."""
    rows = counts.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "kind"))).alias("k"))
    return rows.select("job_id", F.array_join(F.transform("k", lambda x: F.concat(x["kind"], F.lit(": "), (-x["m"]).cast("string"))), ", ").alias("breakdown"))


def representatives(pages: DataFrame) -> DataFrame:
    """The page with the longest raw text of each cluster, the first of equals."""
    return pages.groupBy("job_id", "cluster_id").agg(F.max_by(F.struct("ord", "slug", "url"), F.struct(F.length("raw"), -F.col("ord"))).alias("page")).select("job_id", "cluster_id", "page.*")


def page_slice(rows: DataFrame, order: list, page: int, size: int = 10) -> DataFrame:
    """One page of an ordered listing."""
    return rows.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)


def site_tree(pages: DataFrame, path_col: str = "path", most: int | None = 200, save=None, collation: str = "UNICODE") -> DataFrame:
    """Path prefixes of each job in tree order: job_id, line_no (the root is line 0), depth, segment; at most `most` lines with the root.

    Siblings are in the order of a Unicode collation. A prefix stands after its parent and its earlier siblings with all
    they hold: subtree sizes come from a grouped count, sums over siblings from `prefix_sums`, and a line's number is the
    sum of these steps along its path. So neither a job's tree nor a folder's content is one task's work.
    """
    parts = F.filter(F.split(path_col, "/"), lambda s: s != "")
    paths = pages.select("job_id", parts.alias("parts")).distinct().filter(F.size("parts") > 0)
    above = lambda c: F.transform(F.sequence(F.lit(1), F.size(c)), lambda n: F.slice(c, 1, n))
    prefixes = saver(pages, save, "tree")("tree", paths.select("job_id", F.explode(above("parts")).alias("prefix")).distinct())
    along = prefixes.select("job_id", "prefix", F.explode(above("prefix")).alias("node"))
    sizes = along.groupBy("job_id", "node").agg(F.count("*").alias("size")).withColumn("parent", F.slice("node", 1, F.size("node") - 1))
    named = sizes.withColumn("collated", F.collate(F.element_at("node", -1), collation)).withColumn("segment", F.element_at("node", -1))
    steps = prefix_sums(named, ["job_id", "parent"], ["collated", "segment"], F.col("size"), "before", save, "tree-sums")
    steps = steps.select("job_id", "node", (F.col("before") + 1).alias("step"))
    lines = along.join(steps, ["job_id", "node"]).groupBy("job_id", "prefix").agg(F.sum("step").alias("line_no"))
    if most is not None:
        lines = lines.filter(F.col("line_no") < most)
    return lines.select("job_id", "line_no", F.size("prefix").alias("depth"), F.element_at("prefix", -1).alias("segment"))


def tree_text(tree: DataFrame, most: int = 200) -> DataFrame:
    """job_id, text: a tree of `most` lines at most, indented under a root line, with an ellipsis where the bound is reached."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), "segment")
    rows = tree.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("line_no", line.alias("line")))).alias("lines"), F.count("*").alias("n"))  # bounded by `most`
    text = F.array_join(F.concat(F.array(F.lit("/")), F.transform("lines", lambda x: x["line"]), F.when(F.col("n") + 1 >= most, F.array(F.lit("  …"))).otherwise(F.array().cast("array<string>"))), "\n")
    return rows.select("job_id", text.alias("text"))
