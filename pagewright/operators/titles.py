"""Title suffixes that a job's pages share, and titles without them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = "-–—|·»"
SEPARATOR = rf"\s+[{SEPARATORS}]\s*|\s*[{SEPARATORS}]\s+"
SHORTEST = 12


def suffixes(pages: DataFrame) -> DataFrame:
    """Candidate suffixes: for each title the tails that begin at a separator with white space on a side."""
    rows = pages.filter("title != ''").select("job_id", "ord", "title")
    # Tails are rebuilt from the parts between separators and the separators themselves.
    parts, marks = F.split("title", SEPARATOR), F.regexp_extract_all("title", F.lit(f"({SEPARATOR})"), 1)
    tail = lambda i: F.array_join(F.transform(F.sequence(i, F.size("marks") - 1), lambda j: F.concat(F.element_at("marks", j + 1), F.element_at("parts", j + 2))), "")
    rows = rows.withColumn("parts", parts).withColumn("marks", marks).filter(F.size("marks") > 0)
    rows = rows.withColumn("suffix", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("marks") - 1), tail))))
    return rows.filter(F.length("suffix") >= SHORTEST).select("job_id", "ord", "suffix")


def common_suffixes(pages: DataFrame) -> DataFrame:
    """Suffixes on a twentieth of a job's titled pages, four at least."""
    titled = pages.filter("title != ''").groupBy("job_id").agg(F.count("*").alias("n"))
    counts = suffixes(pages).groupBy("job_id", "suffix").agg(F.count("*").alias("pages"))
    return counts.join(titled, "job_id").filter(F.col("pages") >= F.greatest(F.lit(4), F.ceil(F.col("n") / 20))).select("job_id", "suffix", "pages")


def strip_suffixes(pages: DataFrame) -> DataFrame:
    """Titles without their longest common suffix; `fullTitle` keeps the whole one. A title that is only the suffix stays."""
    longest = suffixes(pages).join(common_suffixes(pages), ["job_id", "suffix"]).groupBy("job_id", "ord").agg(F.max_by("suffix", F.length("suffix")).alias("suffix"))
    out = pages.join(longest, ["job_id", "ord"], "left")
    short = F.trim(F.substr("title", F.lit(1), F.length("title") - F.length("suffix")))
    strips = F.col("suffix").isNotNull() & (short != "")
    return out.withColumn("fullTitle", F.when(strips, F.col("title"))).withColumn("title", F.when(strips, short).otherwise(F.col("title"))).drop("suffix")
