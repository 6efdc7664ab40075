"""Quality scores by hierarchical empirical Bayes over documents, hosts and paths.

1. Surface features of each whole text go through a logistic model fitted on labelled rows: the document's evidence.
2. Evidence is summed by host and by path within host (grouped sums, combined before the shuffle).
3. A host's posterior mean shrinks its sum toward the global mean, a path's toward its host's, both by a prior strength
   estimated from the spread between groups; groups with few documents stay near the prior.
4. A document's score moves its own log-odds by what its path's posterior, without the document itself, says beyond the
   global mean, times `group_weight`.

Defined cases: a null, empty or blank text has all features zero; a null host or path is a group of its own; null
labels are ignored; without labels of both kinds the evidence is the share of good labels (0.5 without any); repeated
rows count each; extra columns are ignored; an empty table gives an empty result. Scores, sums and groups cover all
rows; only the logistic fit is bounded, by `max_train` labelled rows chosen by hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import Scratch
from pagewright.llm.toxicity import logistic

UPPER = bytes(range(0x41, 0x5B))
SYMBOLS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,'-:;()\"!?")
DIGITS = bytes(range(0x30, 0x3A))
STOPS = b".,:;?"


def features(text: str) -> list[float]:
    words = text.split()
    if not words:
        return [0.0] * 11
    raw = text.encode("utf-8", "replace")
    n, size = len(words), len(raw)
    share = lambda drop: (size - len(raw.translate(None, drop))) / size
    lines = text.split("\n")
    distinct = set(words)
    repeats = sum(a == b for a, b in zip(words, words[1:])) / n
    return [
        np.log1p(n) / 5, len(distinct) / n, repeats, sum(map(len, words)) / n / 10, share(UPPER), share(SYMBOLS), share(DIGITS), share(STOPS), raw.count(b"!") / n,
        sum(len(w) == 1 and not w.isalnum() for w in words) / n, len(set(lines)) / len(lines),
    ]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [[float(v) for v in features(t or "")] for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "host", "path", "f"])


def _logit(p):
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: float) -> float:
    """Prior strength (in documents) by moments: the spread of group means beyond what their sizes explain."""
    r = groups.filter("n > 1").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)).alias("between"), F.sum(F.col("sq") - F.col("s") * F.col("s") / F.col("n")).alias("within"), F.count("*").alias("k")).first()
    if not r.k or r.n <= r.k:
        return 100.0
    within = r.within / (r.n - r.k)
    spread = max((r.between - r.k * within) / r.n, 1e-9)
    return float(min(1e6, max(1.0, within / spread)))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", host_col="source", path_col="lang", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5, group_weight: float = 0.5, max_train: int = 100_000) -> DataFrame:
    """One row per document: doc_id, evidence, host_posterior, path_posterior, score, keep. Hosts and paths are column names or columns."""
    scratch = Scratch(docs.sparkSession, "quality")
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_column(host_col).cast("string").alias("host"), as_column(path_col).cast("string").alias("path"), F.col(text_col).alias("text"))
    feats = scratch.table("features", rows.mapInArrow(_features, "doc_id long, host string, path string, f array<double>"))
    truth = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").dropDuplicates(["doc_id"])
    n = truth.count()
    if n > max_train:
        truth = truth.filter(F.expr(f"pmod(xxhash64(doc_id), 1000000) < {max_train * 1_000_000 // n}"))
    train = feats.join(truth, "doc_id").select("f", "y").collect()
    y = np.array([r.y for r in train], float)
    if len(set(y)) == 2:
        w = logistic(np.array([r.f for r in train]), y, ridge=0.01, rounds=60)
    else:
        mean = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        w = [0.0] * 11 + [float(np.log(mean / (1 - mean)))]
    z = F.lit(w[-1]) + F.aggregate(F.zip_with("f", F.array(*[F.lit(v) for v in w[:-1]]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    evidence = scratch.table("evidence", feats.select("doc_id", "host", "path", (1 / (1 + F.exp(-z))).alias("p")))
    paths = scratch.table("paths", evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("sq")))
    hosts = scratch.table("hosts", paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("sq").alias("sq")))
    total = hosts.agg(F.sum("s") / F.sum("n")).first()[0]
    mean = float(total) if total is not None else 0.5
    a, b = _strength(hosts, mean), _strength(paths, mean)
    groups = paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.host", "p.path", F.col("p.n").alias("pn"), F.col("p.s").alias("ps"), F.col("h.n").alias("hn"), F.col("h.s").alias("hs"))
    out = evidence.alias("e").join(groups.alias("g"), F.col("e.host").eqNullSafe(F.col("g.host")) & F.col("e.path").eqNullSafe(F.col("g.path"))).select("e.doc_id", "e.p", "g.pn", "g.ps", "g.hn", "g.hs")
    host = (F.col("hs") - F.col("p") + a * mean) / (F.col("hn") - 1 + a)
    out = out.withColumn("host_posterior", host).withColumn("path_posterior", (F.col("ps") - F.col("p") + b * F.col("host_posterior")) / (F.col("pn") - 1 + b))
    moved = _logit(F.col("p")) + group_weight * (_logit(F.col("path_posterior")) - _logit(F.lit(mean)))
    out = out.withColumn("score", 1 / (1 + F.exp(-moved)))
    return out.select("doc_id", F.col("p").alias("evidence"), "host_posterior", "path_posterior", "score", (F.col("score") >= threshold).alias("keep"))
