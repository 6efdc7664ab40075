"""Near-duplicate documents: many universal-hash minima, banding, signature check, exact check, large-star/small-star.

1. Each text becomes its set of word shingles, a signature of minima under universal hashes and a hash of the set.
2. Texts with the same set form one class; only the class's smallest id goes on, so copies cost nothing further.
3. Each band of the signature is a bucket. Every member is paired with the bucket's smallest id, never with all others.
4. Pairs whose signatures agree too little to reach the threshold go; the rest are confirmed on the full sets.
5. Components come from alternating star steps. A bucket that then still spans several components has its members of
   different components compared in blocks of bounded size, which emit confirmed links only, so a member that misses the
   first one's threshold still meets the others.

Defined cases: a null or blank text has an empty set, links with nothing and is kept; fewer than k words give the whole
sequence as one shingle; rows with the same id share a node; a null id has a null component and is kept; extra columns
are ignored; an empty table gives an empty result. The operator does not sample, cap buckets or cut texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import shingles as sh
from pagewright.llm.common import Scratch, bit_table, in_table
from pagewright.llm.components import connected

BANDS, ROWS = 24, 5
#: A pair this many standard deviations below the threshold's expected agreement is not confirmed further.
SLACK = 6.0
#: Size of the table that tells tasks which ids are candidates.
TABLE_BITS = 23
#: Rows of a chunk whose signatures are compared; rows, and shingles of 8 bytes, of a chunk whose sets are.
BLOCK_ROWS, SET_ROWS, SET_SHINGLES = 2048, 256, 1 << 18
#: Bytes of a batch of set pairs that a Python worker gets at once.
PAIR_BYTES = 16 << 20


def _signatures(k: int, bands: int, rows: int):
    n = bands * rows
    mult, add = sh.spread(101, n) | np.uint64(1), sh.spread(202, n)
    place = sh.spread(303, rows) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in sh.slices(batch.column(1)):
                h, _, at = sh.shingles(sh.words(raw, off), k)
                counts, lo, hi = np.zeros(j - i, np.int64), np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                for t in range(j - i):
                    s = np.unique(h[at[t] : at[t + 1]])
                    counts[t], lo[t], hi[t] = len(s), sh.mix(s).sum(dtype=np.uint64), sh.mix(s ^ sh.BASE).sum(dtype=np.uint64)
                full = np.flatnonzero(counts)
                sig = np.zeros((j - i, n), np.uint32)
                if len(full):
                    for f in range(n):
                        sig[full, f] = np.minimum.reduceat((h * mult[f] + add[f]) >> np.uint64(32), at[:-1][full])
                keys = np.zeros((j - i, bands), np.uint64)
                for b in range(bands):
                    keys[:, b] = sh.mix((sig[:, b * rows : (b + 1) * rows].astype(np.uint64) * place).sum(axis=1, dtype=np.uint64) + np.uint64(b))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), pa.array(counts), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * bands, bands, dtype=np.int32)), pa.array(keys.view(np.int64).ravel())),
                    pa.array([sig[t].tobytes() if counts[t] else None for t in range(j - i)], pa.binary()),
                    pa.array([sig[t].astype(np.uint8).tobytes() if counts[t] else None for t in range(j - i)], pa.binary()),
                ], names=["doc_id", "n_shingles", "h1", "h2", "bands", "sig", "tag"])

    return run


def _sets(k: int, table: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_table(table, TABLE_BITS, batch.column(2).to_numpy().view(np.uint64))))
            for i, j, raw, off in sh.slices(batch.column(1)):
                h, _, at = sh.shingles(sh.words(raw, off), k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([np.unique(h[at[t] : at[t + 1]]).tobytes() for t in range(j - i)], pa.binary())], names=["rep", "shingles"])

    return run


def _full_sets(texts: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """Shingle sets (rep, shingles) of the given ids (a column rep). Texts are not shuffled, only the candidates' sets are."""
    table = bit_table(ids.select(F.xxhash64("rep").alias("h")), TABLE_BITS)
    return texts.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(_sets(k, table), "rep long, shingles binary").join(ids, "rep", "left_semi")


def _agreement(least: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in (2, 3))
                keep = (a == b).sum(axis=1) >= least
                yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _overlap(percent: int):
    def run(batches):
        for batch in batches:
            rows = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                last, other = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(last, other, assume_unique=True))
                union = len(last) + len(other) - both
                if 100 * both >= percent * union:
                    rows.append((a, b, both, union))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], names=["a", "b", "inter", "uni"])

    return run


def _confirm(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, scratch: Scratch, tag: str, k: int, percent: int, least: int) -> DataFrame:
    """Rows (a, b, inter, uni) of the candidate pairs whose full sets reach the threshold."""
    x, y = sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb"))
    close = pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(_agreement(least), "a long, b long")
    close = scratch.table(f"close-{tag}", close)
    ids = close.select(F.col("a").alias("rep")).union(close.select("b")).distinct()
    sets = scratch.table(f"sets-{tag}", _full_sets(texts, ids, k))
    x, y = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    found = close.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(_overlap(percent), "a long, b long, inter long, uni long")
    found = scratch.table(f"links-{tag}", found.distinct(), PAIR_BYTES)
    scratch.drop(f"close-{tag}", f"sets-{tag}")
    return found


def _blocks(placed: DataFrame, rows: int, shingles: int | None = None) -> DataFrame:
    """Rows (bucket, kind, i, j, side, part, rep, component): a bucket of several components, cut into blocks of bounded size.

    The bucket's largest component is never compared with itself: its chunks meet the other members' chunks (kind m), and
    those meet each other (kind o). A chunk holds about `rows` rows and, if given, about `shingles` shingles at most.
    """
    sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    sizes = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component", "w")).alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w")).filter("n > main.n")
    parts = lambda n, w: F.expr(f"cast(ceil(greatest(0, ({n}) / {rows}" + (f", ({w}) / {shingles}" if shingles else "") + ")) as int)")
    sizes = sizes.select("bucket", F.col("main.component").alias("main"), parts("main.n", "main.w").alias("nm"), parts("n - main.n", "w - main.w").alias("no"))
    cut = placed.join(sizes, "bucket").withColumn("side", F.col("component") == F.col("main"))
    cut = cut.withColumn("part", F.expr("cast(pmod(xxhash64(rep), if(side, nm, no)) as int)"))
    mine = "transform(sequence(0, no - 1), x -> named_struct('kind', 'm', 'i', part, 'j', x))"
    theirs = "concat(transform(sequence(0, nm - 1), x -> named_struct('kind', 'm', 'i', x, 'j', part)), transform(sequence(0, no - 1), x -> named_struct('kind', 'o', 'i', least(x, part), 'j', greatest(x, part))))"
    return cut.withColumn("at", F.explode(F.expr(f"if(side, {mine}, {theirs})"))).select("bucket", "at.*", "side", "part", "rep", "component")


def _cross(kind: str, i: int, j: int, table: pa.Table):
    """For each row of a block the rows (of greater id) that another component has on the block's other side."""
    rep, comp, part = (table.column(c).to_numpy() for c in ("rep", "component", "part"))
    group = np.array(table.column("side").to_pylist()) if kind == "m" else part
    for x in range(len(rep)):
        y = np.flatnonzero((comp != comp[x]) & (rep > rep[x]) & ((group != group[x]) | (kind == "o" and i == j)))
        if len(y):
            yield x, y


def _promising(least: int):
    """Ids of a block whose signature agrees enough with that of a row of another component.

    One byte of each minimum is compared: equal minima agree in it, so this lets no pair go that whole minima would keep.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, kind, i, j = (x.as_py() for x in key)
        sig = np.frombuffer(b"".join(table.column("tag").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        keep = np.zeros(table.num_rows, bool)
        for x, y in _cross(kind, i, j, table):
            y = y[(sig[y] == sig[x]).sum(axis=1) >= least]
            keep[y] = True
            keep[x] |= len(y) > 0
        return table.select(["rep"]).filter(pa.array(keep))

    return run


def _intersections(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Intersection sizes of all pairs of sets, as products of 0/1 matrices over the elements that two sets or more hold."""
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    if not sum(map(len, sets)):
        return out
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    shared = count[code] > 1
    row, code = row[shared], (np.cumsum(count > 1) - 1)[code[shared]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        lo, hi = np.searchsorted(code, [first, first + width])
        part = np.zeros((n, width), np.float32)
        part[row[lo:hi], code[lo:hi] - first] = 1
        out += part @ part.T
    return out


def _compare(percent: int):
    """Links across components in one block, as few as join what the block can join."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, kind, i, j = (x.as_py() for x in key)
        rep, comp = (table.column(c).to_numpy() for c in ("rep", "component"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        size = np.array([len(x) for x in sets])
        inter = _intersections(sets)
        out, joined = [], {}

        def root(x):
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        for x, y in _cross(kind, i, j, table):
            y = y[100 * inter[x, y] >= percent * (size[y] + size[x] - inter[x, y])]
            for z in y:
                if (a := root(comp[x])) != (b := root(comp[z])):
                    joined[a] = b
                    both = int(inter[x, z])
                    out.append((int(rep[x]), int(rep[z]), both, int(size[x] + size[z]) - both))
        return pa.table({c: pa.array([r[n] for r in out], pa.int64()) for n, c in enumerate(("a", "b", "inter", "uni"))})

    return run


def _across(placed: DataFrame, reps: DataFrame, texts: DataFrame, scratch: Scratch, k: int, percent: int, least: int) -> DataFrame:
    """Links between rows of one bucket and different components. Signatures alone say which rows need their sets.

    A block's sets are bounded by their bytes, so only a single text longer than that makes a larger one.
    """
    block = ["bucket", "kind", "i", "j"]
    rough = _blocks(placed, BLOCK_ROWS).join(reps.select("rep", "tag"), "rep").groupBy(*block).applyInArrow(_promising(least), "rep long")
    ids = scratch.table("promising", rough.distinct())
    sets = scratch.table("sets-rest", _full_sets(texts, ids, k))
    blocks = _blocks(scratch.table("placed-rest", placed.join(ids, "rep", "left_semi")), SET_ROWS, SET_SHINGLES)
    return blocks.join(sets, "rep").groupBy(*block).applyInArrow(_compare(percent), "a long, b long, inter long, uni long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, class_id (smallest id with the same set)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    n = bands * rows
    j = percent / 100
    least = max(0, int(n * j - SLACK * (n * j * (1 - j)) ** 0.5))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sigs = scratch.table("sigs", texts.mapInArrow(_signatures(k, bands, rows), "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sig binary, tag binary"))

    usable = sigs.filter("n_shingles > 0 and doc_id is not null")
    classes = scratch.table("classes", usable.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    copies = usable.select("doc_id", "h1", "h2", "n_shingles").join(classes, ["h1", "h2", "n_shingles"]).select("doc_id", "rep", "h1", "h2", "n_shingles")
    copies = scratch.table("copies", copies)
    # A class's own row is the one of its smallest id; rows of the same id and set count once.
    reps = usable.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "h1", "h2", "n_shingles"], "left_semi").select(F.col("doc_id").alias("rep"), "n_shingles", "bands", "sig", "tag")
    reps = scratch.table("reps", reps.dropDuplicates(["rep", "sig"]))
    rep_texts = texts.filter("doc_id is not null")

    keyed = reps.select("rep", "n_shingles", F.explode("bands").alias("bucket"))
    hubs = keyed.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).filter("hub < top").select("bucket", "hub")
    hubs = scratch.table("hubs", hubs)
    shared = scratch.table("shared", keyed.join(hubs, "bucket"))
    pairs = shared.filter("hub < rep").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    links = _confirm(pairs, reps, rep_texts, scratch, "star", k, percent, least)
    nodes = scratch.table("nodes", connected(links.select("a", "b"), scratch, "star"))

    # Buckets that the first round leaves in several components: pairs across components, once each.
    placed = shared.select("bucket", "rep", "n_shingles").join(nodes.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = scratch.table("placed", placed)
    more = scratch.table("links-rest", _across(placed, reps, rep_texts, scratch, k, percent, least))

    same_id = copies.filter("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    every = links.select("a", "b").unionByName(more.select("a", "b")).unionByName(same_id)
    nodes = scratch.table("final", connected(every, scratch, "all"))
    scratch.drop("shared", "placed", "hubs", "nodes", "reps", "sets-rest")
    out = sigs.select("doc_id", "n_shingles", "h1", "h2").join(classes, ["h1", "h2", "n_shingles"], "left").join(nodes.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), F.coalesce("rep", "doc_id").alias("class_id"))
