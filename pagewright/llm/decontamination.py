"""Benchmark decontamination by greedy string tiling.

1. Every benchmark item gives its word k-grams (seeds); an item of fewer than k words gives its whole sequence.
2. A bit table of fixed size, filled from the seeds by a grouped aggregation, tells each document's task which of its
   positions may match; only runs of such positions leave the task, as word hashes. The table's size doesn't depend on
   the data, so shipping it to every task is safe; what it lets through wrongly, the next join drops.
3. The runs' seeds are joined with the benchmark's seeds. A pair goes on only if the item words that its shared seeds
   cover reach the threshold, which bounds what tiling can cover.
4. Greedy tiling of each pair: the longest common run of unmarked words is marked in both, again and again, until none
   of k words is left. Candidates of a length are found through rolling Karp-Rabin hashes and compared word by word.
   The covered share of the item is its coverage; as tiles may come in any order, reordered passages are caught.

Words are lower-cased runs without ASCII white space or punctuation. Two words count as equal when their 64-bit hashes
do. Defined cases: a null or empty text or item matches nothing; repeated items are each reported; rows with equal ids
are tiled apart and reported by their largest coverage; a null id is never contaminated; extra columns are ignored; an
empty table gives an empty result. No text, run or candidate is cut or capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import shingles as sh
from pagewright.llm.common import Scratch, bit_table, in_table

TABLE_BITS = 24
ROLL = np.uint64(0xD6E8FEB86659FD93)


def greedy_tiles(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in a, start in b, length) of two arrays of word hashes; value 0 in `a` never matches."""
    free_a, free_b = a != 0, np.ones(len(b), bool)
    tiles: list[tuple[int, int, int]] = []
    length = min(len(a), len(b))
    while length >= least:
        spots = _matches(a, b, free_a, free_b, length)
        if not spots:
            # Fall to the longest length that still matches, by halving: a common run of n words holds one of n-1.
            lo, hi = least - 1, length - 1
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if _matches(a, b, free_a, free_b, mid) else (lo, mid - 1)
            if lo < least:
                break
            length = lo
            spots = _matches(a, b, free_a, free_b, length)
        for i, j in spots:
            if free_a[i : i + length].all() and free_b[j : j + length].all():
                free_a[i : i + length] = free_b[j : j + length] = False
                tiles.append((i, j, length))
        length -= 1
    return tiles


def _rolling(x: np.ndarray, n: int, top: int) -> np.ndarray:
    """Hashes of the runs of n words, from one running sum; `top` is the greater length of the two arrays compared."""
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(top, ROLL, np.uint64)]), dtype=np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(x * power[: len(x)], dtype=np.uint64)])
    return (total[n:] - total[:-n]) * power[top - np.arange(len(x) - n + 1)]


def _matches(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Common unmarked runs of n words, those of equal hash compared word by word."""
    if n > min(len(a), len(b)):
        return []
    whole = lambda free: np.flatnonzero(np.convolve(free, np.ones(n, int), "valid") == n)
    pa_, pb = whole(free_a), whole(free_b)
    top = max(len(a), len(b))
    ha, hb = _rolling(a, n, top)[pa_], _rolling(b, n, top)[pb]
    at: dict[int, list[int]] = {}
    for h, j in zip(hb.tolist(), pb.tolist()):
        at.setdefault(h, []).append(j)
    return [(i, j) for h, i in zip(ha.tolist(), pa_.tolist()) for j in at.get(h, ()) if (a[i : i + n] == b[j : j + n]).all()]


def _items(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in sh.slices(batch.column(1)):
                w = sh.words(raw, off, sh.PUNCT)
                tokens, seeds, lengths = [], [], []
                for t in range(j - i):
                    h = w.hashes[w.offsets[t] : w.offsets[t + 1]]
                    n = min(k, len(h))
                    tokens.append(h.view(np.int64).tolist())
                    lengths.append(n)
                    seeds.append(_seeds(h, n).view(np.int64).tolist() if n else [])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(tokens, pa.list_(pa.int64())), pa.array(seeds, pa.list_(pa.int64())), pa.array(lengths, pa.int32())], names=["item_id", "tokens", "seeds", "k"])

    return run


def _seeds(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of an array of word hashes."""
    acc = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        acc += h[i : len(acc) + i] * sh.PLACE[i]
    return sh.mix(acc + np.uint64(n))


def _runs(table: bytes, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in sh.slices(batch.column(1)):
                w = sh.words(raw, off, sh.PUNCT)
                n = len(w.hashes)
                mark = np.zeros(n, bool)
                owner = np.repeat(np.arange(j - i), np.diff(w.offsets))
                for k in sizes:
                    s = _seeds(w.hashes, k)
                    if not len(s):
                        continue
                    hit = in_table(table, TABLE_BITS, s)
                    hit &= owner[: len(s)] == owner[k - 1 :]
                    for x in range(k):
                        mark[x : x + len(s)] |= hit
                # A zero between the runs keeps tiles from joining words that don't follow each other.
                docs, tokens = [], []
                for t in np.unique(owner[mark]):
                    lo, hi = w.offsets[t], w.offsets[t + 1]
                    m = mark[lo:hi]
                    h = np.where(m, w.hashes[lo:hi], np.uint64(0))
                    docs.append(int(t))
                    tokens.append(h[m | np.concatenate([[False], m[:-1]])].view(np.int64).tolist())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i + t for t in docs], pa.int64())), pa.array(tokens, pa.list_(pa.int64()))], names=["doc_id", "tokens"])

    return run


def _document_seeds(sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                h = np.array(batch.column(1)[row].as_py(), np.int64).view(np.uint64)
                seeds = np.unique(np.concatenate([_seeds(h, k) for k in sizes])) if len(h) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([row] * len(seeds), pa.int64())), pa.array(seeds.view(np.int64))], names=["run_id", "seed"])

    return run


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, item, k, a, b in zip(*(batch.column(c).to_pylist() for c in range(5))):
            tiles = greedy_tiles(np.array(a, np.int64).view(np.uint64), np.array(b, np.int64).view(np.uint64), k)
            rows.append((doc, item, len(tiles), sum(t[2] for t in tiles), len(b)))
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(5)], names=["doc_id", "item_id", "tiles", "covered", "item_words"])


def tilings(docs: DataFrame, benchmark: DataFrame, k: int = 5, min_coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, tiles, covered, item_words, coverage) of every pair whose coverage reaches the threshold."""
    scratch = Scratch(docs.sparkSession, "tiling")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).mapInArrow(_items(k), "item_id long, tokens array<long>, seeds array<long>, k int")
    items = scratch.table("items", items.filter("k > 0").withColumn("item", F.monotonically_increasing_id()))
    seeds = scratch.table("seeds", items.select("item", "k", F.size("tokens").alias("n"), F.posexplode("seeds").alias("at", "seed")))
    sizes = sorted(r.k for r in items.select("k").distinct().collect())
    table = bit_table(seeds.select(F.col("seed").alias("h")), TABLE_BITS)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    runs = texts.mapInArrow(_runs(table, sizes), "doc_id long, tokens array<long>").withColumn("run_id", F.monotonically_increasing_id())
    runs = scratch.table("runs", runs)
    # The item words under the seeds that a pair shares bound the coverage from above.
    shared = runs.select("run_id", "tokens").mapInArrow(_document_seeds(sizes or [k]), "run_id long, seed long").join(seeds, "seed")
    reach = shared.select("run_id", "item", "n", F.explode(F.expr("sequence(at, at + k - 1)")).alias("word")).groupBy("run_id", "item", "n").agg(F.size(F.collect_set("word")).alias("covered"))
    pairs = scratch.table("pairs", reach.filter(F.col("covered") >= min_coverage * F.col("n")).select("run_id", "item"))
    full = pairs.join(items.select("item", "item_id", "k", F.col("tokens").alias("b")), "item").join(runs.withColumnRenamed("tokens", "a"), "run_id")
    found = full.select("doc_id", "item_id", "k", "a", "b").mapInArrow(_tile, "doc_id long, item_id long, tiles long, covered long, item_words long")
    return found.withColumn("coverage", F.col("covered") / F.col("item_words")).filter(F.col("coverage") >= min_coverage)


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per contaminated document: doc_id, n_items, coverage (the largest), item_id (of that coverage, the least)."""
    found = tilings(docs, benchmark, **options)
    return found.groupBy("doc_id").agg(F.count_distinct("item_id").alias("n_items"), F.max(F.struct("coverage", (-F.col("item_id")).alias("m"))).alias("best")).select("doc_id", "n_items", F.col("best.coverage").alias("coverage"), (-F.col("best.m")).alias("item_id"))


def mark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Every document's id with contaminated, n_items, coverage and item_id."""
    found = contaminated(docs, benchmark, id_col=id_col, **options)
    out = docs.select(F.col(id_col).cast("long").alias("doc_id")).join(found, "doc_id", "left")
    return out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), "item_id")
