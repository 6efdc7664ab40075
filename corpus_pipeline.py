"""A corpus pipeline of training-data operators over `documents`.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns the documents that the next
stage gets. All but the last keep the columns of `documents`, whatever further columns there are.

Defined cases: every stage takes null ids, null, empty and very long texts, repeated rows and empty tables. A row with a
null id is judged by its text for toxicity, never matched by id (so it stays in the stages that drop by id), mixed with
the rows of its source and encoded first. Rows of one id stay or go together where a stage drops by id; of near
duplicates with equal ids all stay, as the smallest id is theirs. Ties in similarity at a threshold count as reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import decontamination, minhash_dedup, mixing, token_output, toxicity
from pagewright.llm.common import Scratch, read
from pagewright.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more go. The model learns from labelled rows of the whole table."""
    labels = read(spark, sf_dir, "labels").filter(~toxicity.held_out())
    model = toxicity.fit(read(spark, sf_dir, "documents"), labels)
    return toxicity.filter_documents(docs, model, threshold=0.3)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id isn't among `ids` (a column doc_id)."""
    gone = ids.select(F.struct(F.col("doc_id").cast("long").alias("id")).alias("gone")).distinct()
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(gone, F.col("row.doc_id").cast("long") == F.col("gone.id"), "left_anti").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8) stays: the one with the smallest id."""
    return without(docs, minhash_dedup.near_duplicates(docs, percent=80).filter("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item's words or more, in tiles of five words or more, go."""
    return without(docs, decontamination.contaminated(docs, read(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is read once, those of light sources up to twice, by temperature-mixed weights."""
    return mixing.mixed_documents(docs, max_repeats=2.0)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in wavelet-matrix shards; returns what the shard files hold of each document copy."""
    out = Scratch(spark, "pipeline").path("shards")
    token_output.write_tokens(docs, out, tokenizer_path())
    return token_output.read_documents(spark, out)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("token_ids", write_token_ids)]

#: SQL can express neither the learned toxicity model nor the tokenizer; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    scratch = Scratch(spark, "corpus")
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.table(name, stage(spark, docs, sf_dir))
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
