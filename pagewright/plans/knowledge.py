"""The knowledge build of jobs: pages cleaned, duplicates marked, templates clustered, records, facts and audit."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import audit, clusters, duplicates, facts, layout, records, titles
from pagewright.sources import export


class Stages:
    """Tables written between stages, in the folder that `spark.checkpoint.dir` names, or a temporary one where a local master has none."""

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='pagewright-')}"
        self.spark, self.root = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def __call__(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Tables of a build that need facts, and those that need clusters.
FACTS = {"page_facts", "facts", "audit"}
CLUSTERS = {"pages", "clusters", "members", "records", "audit", "manifest", "content_documents", "template_documents", "site_documents"}
TABLES = FACTS | CLUSTERS | {"duplicate_groups", "review"}


def build_knowledge(pages: DataFrame, threshold: float = 0.94, wanted: set[str] = frozenset(TABLES)) -> dict[str, DataFrame]:
    """The `wanted` tables of a build from scraped pages (schema PAGE); what only others need isn't made.

    Cleaning and duplicate marking are written once and reread, clusters and facts where several tables read them.
    """
    save = Stages(pages.sparkSession, "knowledge")
    named = titles.strip_suffixes(pages.select("job_id", "ord", "title"))
    cleaned = layout.clean_pages(pages, save).drop("normalized", "title").join(named, ["job_id", "ord"])
    typed = save("cleaned", clusters.with_fingerprints(cleaned))
    marked = save("marked", duplicates.mark_duplicates(typed, save, threshold))
    flagged = F.when(F.col("isDuplicate"), F.array_append("diagnostics.warnings", "duplicate_page")).otherwise(F.col("diagnostics.warnings"))
    marked = marked.withColumn("diagnostics", F.col("diagnostics").withField("warnings", flagged))
    groups = duplicates.duplicate_groups(marked)
    out = {"duplicate_groups": groups, "review": audit.review_list(marked)}
    if wanted & FACTS:
        every = facts.extract_facts(marked)
        every = save("facts", every if wanted & {"page_facts", "facts"} else every.select("job_id", "kind", "needsReview"))
        out |= {"page_facts": every, "facts": facts.collapse_facts(every)} if wanted & {"page_facts", "facts"} else {}
    if wanted & CLUSTERS:
        found, members = clusters.cluster_pages(marked.filter("not isDuplicate"))
        found = save("clusters", found)
        if wanted & (CLUSTERS - {"clusters"}):
            members = save("members", members)
        own = members.select("job_id", F.col("ord").alias("canonical_ord"), "cluster_id")
        placed = marked.join(own, ["job_id", "canonical_ord"], "left").join(found.select("job_id", "cluster_id", F.col("confidence").alias("templateConfidence")), ["job_id", "cluster_id"], "left")
        unique = placed.filter("cluster_id is null and not isDuplicate")
        out |= {
            "pages": placed, "clusters": found, "members": members, "records": records.records(marked, found, members), "manifest": export.manifest(found, members, groups),
            "content_documents": export.unique_page_document(unique), "template_documents": export.template_document(found, placed.filter("cluster_id is not null and not isDuplicate")), "site_documents": export.site_document(marked, found, groups),
        }
        if "audit" in wanted:
            out["audit"] = audit.audit(marked, members, every)
    return {k: v for k, v in out.items() if k in wanted}
