"""Near-duplicate embeddings by spherical-cap filters from structured random product codes.

A table of filters is a random rotation and, for each of PARTS blocks of its coordinates, a code of random directions;
every combination of one direction per block is a filter. A vector is stored under every filter that it exceeds by the
cap's height. These are listed from the blocks' scores without visiting the others: two halves are summed, sorted, and
searched for the sums that reach the height. Vectors that share a filter meet in a join, a 128-bit sign sketch drops
pairs far below the threshold, and the rest are verified by cosine in double precision.

The number of filters follows the number of vectors, so a filter holds a constant number of unrelated vectors at any
size; a filter with more than BLOCK members is joined in blocks. Vectors with equal components form one class.

Defined cases: a null or zero vector, or one with null or non-finite components, links with nothing; vectors of
different lengths never link; rows with equal ids are separate vectors of one node; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import Scratch
from pagewright.llm.components import connected

TABLES, PARTS, LISTED, LOAD, BLOCK = 8, 4, 14.0, 3.0, 1024


def cap_height(dim: int, share: float) -> float:
    """The height above which a random unit vector lies with the given probability."""
    t = np.linspace(-1, 1, 200_001)
    w = np.maximum(1 - t * t, 0) ** ((dim - 3) / 2) if dim > 3 else np.ones_like(t)
    above = np.cumsum(w[::-1])[::-1] / w.sum()
    return float(t[np.searchsorted(-above, -share)])


class Filters:
    """Filters of one dimension, enough for `n` vectors."""

    def __init__(self, dim: int, n: int, tables: int = TABLES):
        self.dim, self.tables = dim, tables
        self.parts = PARTS if dim >= 4 * PARTS else 1
        self.code = max(2, int(np.ceil(max(2.0, LISTED * max(n, 1000) / LOAD) ** (1 / self.parts)))) if self.parts > 1 else 4096
        self.height = cap_height(dim, min(0.5, LISTED / self.code**self.parts))
        rng = np.random.default_rng([dim, self.code, 7])
        self.rotations = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(tables)]
        self.cuts = np.linspace(0, dim, self.parts + 1).astype(int)
        self.codes = []
        for _ in range(tables):
            blocks = [rng.standard_normal((self.code, b - a)) for a, b in zip(self.cuts, self.cuts[1:])]
            self.codes.append([c / np.linalg.norm(c, axis=1, keepdims=True) / self.parts**0.5 for c in blocks])
        self.signs = rng.standard_normal((dim, 128))

    def sketch(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.signs > 0, axis=1).view(">i8").astype(np.int64)

    def listed(self, x: np.ndarray) -> list[np.ndarray]:
        """For each unit vector the numbers of all filters that it exceeds."""
        out: list[list[np.ndarray]] = [[] for _ in x]
        for t in range(self.tables):
            y = x @ self.rotations[t]
            s = [y[:, a:b] @ c.T for a, b, c in zip(self.cuts, self.cuts[1:], self.codes[t])]
            if self.parts == 1:
                for i in range(len(x)):
                    out[i].append(np.flatnonzero(s[0][i] >= self.height) + t * self.code)
                continue
            h, n = self.parts // 2, len(x)
            half = [s[0], s[h]]
            for k, (first, rest) in enumerate(((0, s[1:h]), (h, s[h + 1 :]))):
                for more in rest:
                    half[k] = (half[k][:, :, None] + more[:, None, :]).reshape(n, -1)
            for i in range(n):
                right = np.argsort(half[1][i])
                sorted_right = half[1][i][right]
                left = np.flatnonzero(half[0][i] >= self.height - sorted_right[-1])
                start = np.searchsorted(sorted_right, self.height - half[0][i][left])
                count = len(sorted_right) - start
                total = int(count.sum())
                within = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)
                out[i].append((np.repeat(left, count) * half[1].shape[1] + right[within]) * self.tables + t)
        return [np.concatenate(f).astype(np.int64) for f in out]


UNIT_SCHEMA = "vec_id long, class string, dim int, unit binary"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.array(v, float) if v and None not in v else np.zeros(0)
            if not len(x) or not np.isfinite(x).all() or not x.any():
                rows.append((i, None, None, None))
                continue
            x = x / np.abs(x).max()
            rows.append((i, hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest(), len(x), (x / np.linalg.norm(x)).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.binary()))], names=["vec_id", "class", "dim", "unit"])


def _keys(n: int):
    made: dict[int, Filters] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column(1).to_pylist(), int)
            for dim in np.unique(dims):
                f = made.setdefault(int(dim), Filters(int(dim), n))
                at = np.flatnonzero(dims == dim)
                for part in np.array_split(at, -(-len(at) // 512)):
                    x = np.array([np.frombuffer(batch.column(2)[int(i)].as_py()) for i in part])
                    keys, sketch = f.listed(x), f.sketch(x)
                    count = [len(k) for k in keys]
                    reps = np.repeat(np.array(batch.column(0).take(pa.array(part)).to_pylist(), np.int64), count)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(reps), dim, np.int32)), pa.array(np.concatenate(keys)), pa.array(reps), pa.array(np.repeat(sketch[:, 0], count)), pa.array(np.repeat(sketch[:, 1], count))], names=["dim", "key", "rep", "s1", "s2"])

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [float(np.frombuffer(x) @ np.frombuffer(y)) >= threshold for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def blocked_pairs(rows: DataFrame, keys: list[str], id_col: str, block: int, condition: str) -> DataFrame:
    """Pairs (l.*, r.*) with equal keys and l.id < r.id under `condition`; a key of more than `block` rows is joined in blocks."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys, F.ceil(F.col("n") / block).cast("int").alias("parts"))
    rows = rows.join(sizes, keys).withColumn("mine", F.expr(f"cast(pmod(xxhash64({id_col}), parts) as int)")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    left = rows.withColumnsRenamed({"mine": "i", "other": "j"}).alias("l")
    right = rows.withColumnsRenamed({"mine": "j", "other": "i"}).alias("r")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, "i", "j"]]
    return left.join(right, on).filter(f"l.{id_col} < r.{id_col} and {condition}")


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, class_id (least id with the same direction)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "caps")
    units = scratch.table("units", vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col)).mapInArrow(_units, UNIT_SCHEMA))
    classes = units.filter("class is not null and vec_id is not null").groupBy("class").agg(F.min_by(F.struct("dim", "unit"), "vec_id").alias("v"), F.min("vec_id").alias("rep"), F.count("*").alias("size"))
    classes = scratch.table("classes", classes.select("class", "rep", "size", "v.dim", "v.unit"))
    keyed = scratch.table("keys", classes.select("rep", "dim", "unit").repartition(F.col("rep")).mapInArrow(_keys(classes.count()), "dim int, key long, rep long, s1 long, s2 long"))
    angle = np.arccos(np.clip(threshold, -1, 1)) / np.pi
    most = int(np.ceil(128 * angle + 6 * (128 * angle * (1 - angle)) ** 0.5))
    pairs = blocked_pairs(keyed, ["dim", "key"], "rep", BLOCK, f"bit_count(l.s1 ^ r.s1) + bit_count(l.s2 ^ r.s2) <= {most}").select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b")).distinct()
    side = lambda c, v: classes.select(F.col("rep").alias(c), F.col("unit").alias(v))
    links = scratch.table("links", pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(_verify(threshold), "a long, b long"))
    nodes = scratch.table("nodes", connected(links, scratch))
    both = links.select("a", "b").union(links.select("b", "a"))
    degree = both.join(classes.select(F.col("rep").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("others"))
    per_class = classes.select("class", "rep", "size").join(degree.withColumnRenamed("a", "rep"), "rep", "left").join(nodes.withColumnRenamed("id", "rep"), "rep", "left")
    per_class = per_class.select("class", "rep", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    scratch.drop("keys")
    out = units.select("vec_id", "class").join(per_class, "class", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"), F.coalesce("rep", "vec_id").alias("class_id"))
