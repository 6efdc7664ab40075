"""Near-duplicate passages by compact windows.

1. A text is its sequence of word shingles. Under a hash function, the Cartesian tree of the shingles' hashes groups all
   stretches with the same least shingle into one compact window (first, least, last); only windows that can hold a
   passage of `min_words` are kept, which are few: a position has one exactly when it is the least of some stretch of
   that length, so a sliding minimum finds them and the tree is built over them alone.
2. Windows meet that have the same least shingle and the same least one, by a further hash function, in the half
   passage to its right or to its left; a passage holds one of these halves. Around windows of which another document
   holds a whole half every stretch of the passage length is hashed whole, and all documents that hold an equal one are tied to the first of them: equality
   carries over, so no pairs are needed and none is lost, however large the key.
   For near-equal stretches, each window is paired with the key's first and last document. The widest overlap of each
   piece of a document is verified first, then all overlaps but those between places of one group. Members of larger keys
   that are not all in one group meet again by short runs of shingles, sampled by their hashes so that any half passage
   has one, and are again paired with a run's first and last document. So a near-equal stretch without an equal passage in
   it, shared by none of these ends, may be missed.
3. An interval join keeps pairs whose windows, laid over each other at the least shingle, overlap by the passage length.
4. Verification cuts both texts' overlapping shingles, finds every longest near-equal stretch of the cut, and confirms it
   if its Jaccard similarity reaches `percent`. Confirmed stretches of a document that overlap or touch are united into
   spans, and spans that share a stretch are a group, by components.

Texts with equal words form a class first; its smallest id stands for it, and its copies are reported whole.

Defined cases: a null, empty or short text has no passage; a passage repeated inside one document only isn't reported;
rows with equal ids count as one document (of different texts of one id, the one of least hashes is compared, without the step for equal stretches); null ids are ignored; extra columns are ignored; an empty table gives an
empty result. No group is capped, and no text cut: the parts compared are bounded by the windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm import shingles as sh
from pagewright.llm.common import Scratch, bit_table, in_table
from pagewright.llm.components import connected

HASHES = 4
TABLE_BITS = 23
KEY_BITS = 25
#: Shingles on each side of the least one that are compared at once; longer passages have further windows.
REACH = 96
#: Comparisons that a task remembers: some 2 KB each.
REMEMBERED = 8192
PLACES = "first array<int>, least array<int>, last array<int>"
WINDOW_SCHEMA = f"key long, right_key long, left_key long, rep long, {PLACES}, halves array<long>"


def _sliding(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over every run of n values."""
    out, width = x, 1
    while width < n:
        step = min(width, n - width)
        out = op(out[: len(out) - step], out[step:])
        width += step
    return out


def least_of_stretches(v: np.ndarray, begins: np.ndarray, width: int) -> np.ndarray:
    """Positions that are the least of some stretch of `width` values; `begins` are the sequences' bounds in v."""
    if len(v) < width:
        return np.zeros(0, np.int64)
    end = np.repeat(begins[1:], np.diff(begins))
    low = _sliding(v, width, np.minimum)
    low = np.where(np.arange(len(low)) + width <= end[: len(low)], low, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    reach = _sliding(np.concatenate([pad, low, pad]), width, np.maximum)
    return np.flatnonzero((v == reach) & (reach > 0))


def compact_windows(v: np.ndarray, begins: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, least, last) of the compact windows of at least `width` values; `begins` are the sequences' bounds in v."""
    at, lengths = least_of_stretches(v, begins, width), np.diff(begins)
    end = np.repeat(begins[1:], lengths)
    first, last = np.repeat(begins[:-1], lengths)[at], end[at] - 1
    doc = np.repeat(np.arange(len(lengths)), lengths)[at].tolist()
    stack: list[int] = []
    value, place = v[at].tolist(), at.tolist()
    for i in range(len(place)):
        while stack and doc[stack[-1]] == doc[i] and value[stack[-1]] > value[i]:
            last[stack.pop()] = place[i] - 1
        if stack and doc[stack[-1]] == doc[i]:
            first[i] = place[stack[-1]] + 1
        stack.append(i)
    return first, at, last


def _totals(h: np.ndarray) -> np.ndarray:
    """Running sums from which `_run_hash` takes the hash of any run."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * sh._power(len(h))[0][: len(h)], dtype=np.uint64)])


def _run_hash(total: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each whole run of values, wherever it stands."""
    return (total[end] - total[begin]) * sh._power(len(total))[1][begin]


def _halves(total: np.ndarray, first: np.ndarray, at: np.ndarray, last: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the half passage on each side of windows' least shingles, that shingle included, and whether the window holds it: (right, has right, left, has left)."""
    right, left = at + half <= last, at - half >= first
    return sh.mix(_run_hash(total, at, np.where(right, at + half + 1, at))), right, sh.mix(_run_hash(total, np.where(left, at - half, at), at + 1)), left


def _alike(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order in which rows of one key follow each other, otherwise as they were, and where each run of such rows begins."""
    order = np.argsort(key, kind="stable")
    x = key[order]
    return order, np.flatnonzero(np.append(np.ones(min(len(x), 1), bool), x[1:] != x[:-1]))


def _lists(starts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), values)


def _windows(k: int, width: int, table: bytes, keys: bytes | None = None):
    """Compact windows of the documents in `table`: their keys alone, or, of the keys that `keys` may hold, whole rows.

    A text that repeats its lines has many windows of the same keys: they are one row with all their places. Those of the
    first hash function have the hashes of their half passages too, which `_grams` needs.
    """
    mult, add = sh.spread(11, HASHES) | np.uint64(1), sh.spread(12, HASHES)
    half = width // 2 - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_table(table, TABLE_BITS, batch.column(2).to_numpy().view(np.uint64))))
            for i, j, raw, off in sh.slices(batch.column(1)):
                h, _, begins = sh.shingles(sh.words(raw, off), k, short=False)
                lengths = np.diff(begins)
                owner = np.repeat(np.arange(j - i), lengths)
                ids = batch.column(0).to_numpy()[i:j]
                other = sh.mix(h ^ sh.BASE)
                near = _sliding(np.concatenate([np.full(half, ~np.uint64(0)), other, np.full(half, ~np.uint64(0))]), half, np.minimum) if len(h) else other
                total = None if keys is None else _totals(h)
                for f in range(HASHES):
                    first, at, last = compact_windows(sh.mix(h * mult[f] + add[f]), begins, width)
                    key, doc = sh.mix(h[at] + np.uint64(f)), owner[at]
                    if keys is None:
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[doc])], names=["key", "rep"])
                        continue
                    keep = in_table(keys, KEY_BITS, key)
                    first, at, last, key, doc = first[keep], at[keep], last[keep], key[keep], doc[keep]
                    if not len(at):
                        continue
                    left, right = sh.mix(key ^ near[at]), sh.mix(key + near[at + half + 1])
                    order, starts = _alike(sh.mix(sh.mix(left + doc.astype(np.uint64)) + right))
                    one = order[starts]
                    hashes, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                    if not f:
                        r, has_r, l, has_l = (x[order] for x in _halves(total, first, at, last, half))
                        row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
                        hashes, of = np.concatenate([r[has_r], l[has_l]]), np.concatenate([row[has_r], row[has_l]])
                        by = np.argsort(of, kind="stable")
                        hashes, of = hashes[by], of[by]
                    places = [_lists(starts, pa.array((x - begins[doc])[order].astype(np.int32))) for x in (first, at, last)]
                    halves = _lists(np.searchsorted(of, np.arange(len(starts))), pa.array(hashes.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([*(pa.array(x[one].view(np.int64)) for x in (key, right, left)), pa.array(ids[doc[one]]), *places, halves], names=["key", "right_key", "left_key", "rep", "first", "least", "last", "halves"])

    return run


def _runs(k: int, width: int, table: bytes, keys: bytes):
    """Keys of short runs of shingles in the compact windows of `keys`, with the whole document around them.

    A run is a quarter of `width` long, and of the runs that begin in any stretch of as many shingles the one of least hash
    is taken. So whatever half passage two documents share, they share a run that is taken in both.
    """
    mult, add = sh.spread(11, HASHES) | np.uint64(1), sh.spread(12, HASHES)
    size = (width // 2 + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_table(table, TABLE_BITS, batch.column(2).to_numpy().view(np.uint64))))
            for i, j, raw, off in sh.slices(batch.column(1)):
                h, _, begins = sh.shingles(sh.words(raw, off), k, short=False)
                mark = np.zeros(len(h) + 1, np.int64)
                for f in range(HASHES):
                    first, at, last = compact_windows(sh.mix(h * mult[f] + add[f]), begins, width)
                    keep = in_table(keys, KEY_BITS, sh.mix(h[at] + np.uint64(f)))
                    np.add.at(mark, first[keep], 1)
                    np.add.at(mark, last[keep] + 2 - size, -1)
                if not mark.any():
                    continue
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sh.mix(h + sh.BASE), dtype=np.uint64)])
                inside = np.arange(len(h)) + size <= np.repeat(begins[1:], np.diff(begins))
                value = np.full(len(h), ~np.uint64(0))
                p = np.flatnonzero(inside)
                value[p] = sh.mix(total[p + size] - total[p])
                p = least_of_stretches(value, begins, size)
                p = p[inside[p] & (np.cumsum(mark)[p] > 0)]
                owner = np.searchsorted(begins, p, "right") - 1
                order, starts = _alike(sh.mix(value[p] + owner.astype(np.uint64)))
                one = order[starts]
                places = [_lists(starts, pa.array(x[order].astype(np.int32))) for x in (np.zeros(len(p)), p - begins[owner] + size // 2, begins[owner + 1] - begins[owner] - 1)]
                yield pa.RecordBatch.from_arrays([pa.array(value[p[one]].view(np.int64)), pa.array(batch.column(0).to_numpy()[i:j][owner[one]]), *places], names=["key", "rep", "first", "least", "last"])

    return run


def _grams(k: int, width: int, table: bytes, halves: bytes):
    """(key, rep, pos) of the stretches of `width` shingles that hold a half passage beside a window's least one that is in `halves`.

    One hash function is enough: two documents with an equal stretch have a window each around its least shingle, and the
    stretch holds the whole half on one side of it, which is then equal too. Texts that only have two least shingles in
    common, of which there are the more the more texts there are, give no stretches.
    """
    mult, add = sh.spread(11, HASHES) | np.uint64(1), sh.spread(12, HASHES)
    half = width // 2 - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_table(table, TABLE_BITS, batch.column(2).to_numpy().view(np.uint64))))
            for i, j, raw, off in sh.slices(batch.column(1)):
                h, _, begins = sh.shingles(sh.words(raw, off), k, short=False)
                first, at, last = compact_windows(sh.mix(h * mult[0] + add[0]), begins, width)
                if not len(at):
                    continue
                total = _totals(h)
                right, has_right, left, has_left = _halves(total, first, at, last, half)
                mark = np.zeros(len(h) + 1, np.int64)
                for keep, least, most in ((has_right & in_table(halves, KEY_BITS, right), at + half - width + 1, at), (has_left & in_table(halves, KEY_BITS, left), at - width + 1, at - half)):
                    np.add.at(mark, np.maximum(first, least)[keep], 1)
                    np.add.at(mark, np.minimum(most, last - width + 1)[keep] + 1, -1)
                p = np.flatnonzero(np.cumsum(mark) > 0)
                owner = np.searchsorted(begins, p, "right") - 1
                value = sh.mix(_run_hash(total, p, p + width))
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(batch.column(0).to_numpy()[i:j][owner]), pa.array((p - begins[owner]).astype(np.int32))], names=["key", "rep", "pos"])

    return run


def _met_halves(windows: DataFrame) -> DataFrame:
    """Hashes (h) of the half passages that windows of two documents hold."""
    each = windows.select("rep", F.explode("halves").alias("h"))
    return each.groupBy("h").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("h")


def _equal(grams: DataFrame, scratch: Scratch, k: int, width: int) -> DataFrame:
    """Equal stretches, as `_verify` gives them, of every document with one of the others that hold the same.

    Equal stretches are a relation that carries over, so each is tied to its first document, and places in a row of one
    document with one partner are one stretch. Nothing grows but with the number of places.
    """
    # Plain numbers: a least or greatest struct would be found by sorting. Any place of the document will do.
    met = grams.groupBy("key").agg(F.min("rep").alias("a"), F.min_by("pos", "rep").alias("a_pos"), F.max("rep").alias("z"), F.max_by("pos", "rep").alias("z_pos")).filter("a < z")
    rows = grams.join(met.hint("shuffle_hash"), "key").filter("rep != a or pos != a_pos")
    rows = rows.select("rep", F.expr("if(rep != a, a, z)").alias("hub"), "pos", F.expr("pos - if(rep != a, a_pos, z_pos)").alias("d"))
    place = F.row_number().over(Window.partitionBy("rep", "hub", "d").orderBy("pos"))
    rows = rows.withColumn("run", F.col("pos") - place).groupBy("rep", "hub", "d", "run").agg(F.min("pos").cast("long").alias("begin"), (F.max("pos") + width - 1 + k).cast("long").alias("end"))
    found = rows.select("rep", "hub", "begin", "end", (F.col("begin") - F.col("d")).alias("hub_begin"), (F.col("end") - F.col("d")).alias("hub_end"))
    return scratch.table("found-equal", found)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, raw, off in sh.slices(batch.column(1)):
            w = sh.words(raw, off)
            h1, h2 = (_run_hash(_totals(h), w.offsets[:-1], w.offsets[1:]).view(np.int64) for h in (w.hashes, sh.mix(w.hashes)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(x) for x in (h1, h2, np.diff(w.offsets).astype(np.int64)))], names=["doc_id", "h1", "h2", "n"])


def _sequences(k: int, table: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_table(table, TABLE_BITS, batch.column(2).to_numpy().view(np.uint64))))
            for i, j, raw, off in sh.slices(batch.column(1)):
                h, _, at = sh.shingles(sh.words(raw, off), k, short=False)
                short = (h >> np.uint64(32)).astype("<u4")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([short[at[t] : at[t + 1]].tobytes() for t in range(j - i)], pa.binary())], names=["rep", "seq"])

    return run


def stretches(a: np.ndarray, b: np.ndarray, percent: int, width: int) -> list[tuple[int, int, int, int]]:
    """Stretches of `a` that are near-equal to one of `b`, longest first, none inside another: (first, last) in a and in b."""
    n = len(a)
    if n == len(b) and n >= width and (a == b).all():
        return [(0, n - 1, 0, n - 1)]
    gain = percent / 100
    need = 2 * gain / (1 + gain)  # share of equal shingles at which sets of one size reach the similarity
    # Sets of Python numbers: on a few hundred shingles a sort by numpy takes several times as long.
    a, b = a.tolist(), b.tolist()
    there = set(b)
    at = [i for i, x in enumerate(a) if x in there]
    if len(at) < need * width - 1:
        return []
    lo, hi = at[0], at[-1]
    if hi - lo + 1 >= width and len(at) - need * (hi - lo + 1) >= -1e-9 and (found := _same(a, b, lo, hi, percent)):
        return [(lo, hi, *found)]  # all others lie inside
    # The farthest end of each beginning; whatever shorter stretch begins there lies inside. An end serves a beginning if the
    # equal shingles between exceed the share that is needed, so the last end with a surplus as large is looked up.
    at, rank = np.array(at), np.arange(len(at))
    surplus = np.maximum.accumulate((rank + 1 - need * (at + 1))[::-1])
    ends = at[len(at) - 1 - np.searchsorted(surplus, rank - need * at - 1e-9)]
    lengths = ends - at + 1
    out: list[tuple[int, int, int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        lo, hi = int(at[i]), int(ends[i])
        if hi - lo + 1 < width:
            break
        if not any(x <= lo and hi <= y for x, y, _, _ in out) and (found := _same(a, b, lo, hi, percent)):
            out.append((lo, hi, *found))
    return out


def _same(a: list[int], b: list[int], lo: int, hi: int, percent: int) -> tuple[int, int] | None:
    """First and last place in b of the shingles lo to hi of a, if the similarity of both stretches is reached."""
    x = set(a[lo : hi + 1])
    spots = [i for i, y in enumerate(b) if y in x]
    # A shingle that also stands elsewhere in b stretches its span: the span around the same place is tried next.
    for part in (spots, [i for i in spots if lo - 4 <= i <= hi + 4]):
        if not part:
            return None
        y = set(b[part[0] : part[-1] + 1])
        both = len(x & y)
        if 100 * both >= percent * (len(x) + len(y) - both):
            return part[0], part[-1]
    return None


def _confirm(k: int, percent: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A text that repeats its lines brings the same two cuts again and again.
        done: dict[tuple[bytes, bytes], list[tuple[int, int, int, int]]] = {}
        for batch in batches:
            rows = []
            for rep, hub, i0, j0, x, y in zip(*(batch.column(n).to_pylist() for n in range(6))):
                if (found := done.get((x, y))) is None:
                    if len(done) >= REMEMBERED:
                        done.clear()
                    found = done[x, y] = stretches(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), percent, width)
                for a, b, p, q in found:
                    rows.append((rep, hub, i0 + a, i0 + b + k, j0 + p, j0 + q + k))
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], pa.int64()) for n in range(6)], names=["rep", "hub", "begin", "end", "hub_begin", "hub_end"])

    return run


def _overlaps(windows: DataFrame, scratch: Scratch, width: int) -> DataFrame:
    """Overlaps by the least shingle together with the least one to its right, and with the least one to its left; those by both stand twice."""
    return _sided_overlaps(windows, scratch, "right_key", width).union(_sided_overlaps(windows, scratch, "left_key", width))


def _sided_overlaps(windows: DataFrame, scratch: Scratch, key: str, width: int) -> DataFrame:
    """Windows laid over the group's first and last document's: (rep, hub, i0, j0, n, c), i0 and j0 where the overlap begins.

    The groups' ends are combined before the shuffle and written first, so that what remains is a plain join, of which
    Spark splits the parts of a key that many windows have.
    """
    at = lambda n: F.struct("rep", *(F.element_at(c, n).alias(c) for c in ("first", "least", "last")))
    ends = scratch.table(f"ends-{key}", windows.groupBy(key).agg(F.min(at(1)).alias("a"), F.max(at(-1)).alias("z")).filter("a.rep < z.rep"))
    rows = windows.select(key, "rep", "first", "least", "last").join(ends.hint("shuffle_hash"), key).select("rep", "a", "z", "first", "last", F.posexplode("least").alias("i", "least"))
    rows = rows.select("rep", "a", "z", F.expr("first[i]").alias("first"), "least", F.expr("last[i]").alias("last"))
    hubs = F.array(F.when(F.expr("rep != a.rep"), F.col("a")), F.when(F.expr("rep != z.rep and (rep != a.rep or least != a.least)"), F.col("z")))
    both = rows.withColumn("h", F.explode(hubs)).filter("h is not null")
    before = F.least(F.col("least") - F.col("first"), F.col("h.least") - F.col("h.first"))
    after = F.least(F.col("last") - F.col("least"), F.col("h.last") - F.col("h.least"))
    both = both.withColumn("before", before).withColumn("after", after).filter(F.col("before") + F.col("after") + 1 >= width)
    both = both.withColumn("before", F.least("before", F.lit(REACH))).withColumn("after", F.least("after", F.lit(REACH)))
    return both.select("rep", F.col("h.rep").alias("hub"), (F.col("least") - F.col("before")).alias("i0"), (F.col("h.least") - F.col("before")).alias("j0"), (F.col("before") + F.col("after") + 1).alias("n"), F.col("least").alias("c"))


def _edges(overlaps: DataFrame) -> DataFrame:
    """One diagonal of a pair needs one comparison for each stretch of text; overlapping ones of a stretch are one."""
    merged = overlaps.groupBy("rep", "hub", (F.col("i0") - F.col("j0")).alias("d"), F.floor(F.col("c") / REACH).alias("piece")).agg(F.min("i0").alias("i0"), F.max(F.col("i0") + F.col("n")).alias("end"), F.min("c").alias("c"))
    return merged.select("rep", "hub", "i0", (F.col("i0") - F.col("d")).alias("j0"), (F.col("end") - F.col("i0")).alias("n"), "c")


def _unsettled(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges that can still tell something: those whose least shingle's two places no two spans of one group hold.

    Members of a group are tied already, and what they share there is reported.
    """
    spans = groups.select("rep", "begin", "end", "group_id")
    one = edges.alias("e").join(spans.hint("shuffle_hash").alias("g"), F.expr("e.rep = g.rep and e.c >= g.begin and e.c < g.end"), "left").select("e.*", F.col("g.group_id").alias("mine"))
    both = one.alias("e").join(spans.hint("shuffle_hash").alias("h"), F.expr("e.hub = h.rep and e.c - e.i0 + e.j0 >= h.begin and e.c - e.i0 + e.j0 < h.end"), "left")
    return both.filter("e.mine is null or h.group_id is null or e.mine != h.group_id").select(*(f"e.{c}" for c in edges.columns))


def _unresolved_keys(windows: DataFrame, groups: DataFrame) -> DataFrame:
    """Keys (h) of three documents or more whose windows aren't all inside spans of one group.

    Their members met the key's first and last document only, and may share a passage with each other.
    """
    # A text has many windows of a key if it repeats its lines: they are one before anything is shuffled.
    crowded = windows.select("key", "rep").distinct().groupBy("key").agg(F.count("*").alias("n")).filter("n > 2").select("key")
    held = windows.select("key", "rep", "least").join(crowded.hint("shuffle_hash"), "key").select("key", "rep", F.explode("least").alias("least")).alias("w").join(groups.hint("shuffle_hash").alias("g"), F.expr("w.rep = g.rep and w.least >= g.begin and w.least < g.end"), "left")
    return held.groupBy("w.key").agg(F.min("g.group_id").alias("a"), F.max("g.group_id").alias("z"), F.bool_or(F.col("g.group_id").isNull()).alias("outside")).filter("outside or a != z").select(F.col("key").alias("h"))


def _sequences_of(edges: DataFrame, texts: DataFrame, scratch: Scratch, tag: str, k: int) -> DataFrame:
    """(rep, seq) of the documents that stored edges name."""
    ids = edges.select("rep").union(edges.select("hub")).distinct()
    table = bit_table(ids.select(F.xxhash64("rep").alias("h")), TABLE_BITS)
    seqs = texts.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(_sequences(k, table), "rep long, seq binary").join(ids, "rep", "left_semi").groupBy("rep").agg(F.min("seq").alias("seq"))
    return scratch.table(f"seqs-{tag}", seqs)


def _verify(edges: DataFrame, seqs: DataFrame, scratch: Scratch, tag: str, percent: int, width: int, k: int) -> DataFrame:
    cut = lambda start: F.expr(f"substring(seq, 4 * {start} + 1, 4 * n)")
    rows = edges.join(seqs, "rep").select("rep", "hub", "i0", "j0", "n", cut("i0").alias("x"))
    rows = rows.join(seqs.withColumnRenamed("rep", "hub"), "hub").select("rep", "hub", "i0", "j0", "x", cut("j0").alias("y"))
    found = rows.mapInArrow(_confirm(k, percent, width), "rep long, hub long, begin long, end long, hub_begin long, hub_end long").filter("rep != hub")
    found = scratch.table(f"found-{tag}", found.distinct())
    return found


def _groups(found: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(rep, begin, end, other, group_id) of the spans that confirmed stretches cover: those that overlap or touch are one.

    Stretches of one place in a document, however many partners they have, are combined before the spans are put in order,
    so a document that holds what very many repeat has few rows there. A group is a component of spans joined by
    stretches, named after its first one.
    """
    both = found.select("rep", "begin", "end", F.col("hub").alias("other")).union(found.select("hub", "hub_begin", "hub_end", "rep"))
    places = both.groupBy("rep", "begin", "end").agg(F.min("other").alias("other"))
    order = Window.partitionBy("rep").orderBy("begin", "end")
    runs = places.withColumn("new", F.coalesce(F.col("begin") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    runs = scratch.table(f"places-{tag}", runs.withColumn("start", F.max(F.when(F.col("new"), F.col("begin"))).over(order)))
    spans = scratch.table(f"spans-{tag}", runs.groupBy("rep", "start").agg(F.max("end").alias("end"), F.min("other").alias("other")))
    node = F.struct("rep", F.col("start").alias("begin"))
    at = lambda rep, begin, end, to: runs.select(F.col("rep").alias(rep), F.col("begin").alias(begin), F.col("end").alias(end), node.alias(to)).hint("shuffle_hash")
    edges = found.join(at("rep", "begin", "end", "a"), ["rep", "begin", "end"]).join(at("hub", "hub_begin", "hub_end", "b"), ["hub", "hub_begin", "hub_end"]).select("a", "b").distinct()
    nodes = connected(scratch.table(f"span-edges-{tag}", edges), scratch, f"spans-{tag}")
    out = spans.withColumn("id", node).join(nodes, "id").select("rep", F.col("start").alias("begin"), "end", "other", F.concat_ws(":", "component.rep", "component.begin").alias("group_id"))
    out = scratch.table(f"groups-{tag}", out)
    scratch.drop(f"places-{tag}", f"spans-{tag}", f"span-edges-{tag}")
    return out


def repeated_passages(docs: DataFrame, min_words: int = 50, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, begin, end, partner_id, group_id, n_links): word spans that another document repeats.

    partner_id is the least document found to share the span, or null for the first of equal texts. Spans joined by shared
    stretches, directly or through others, have one group_id; n_links is the number of the group's other documents.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    width = min_words - k + 1
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    heads = scratch.table("heads", texts.mapInArrow(_texts, "doc_id long, h1 long, h2 long, n long").filter(F.col("n") >= min_words))
    classes = scratch.table("classes", heads.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("size")))
    table = bit_table(classes.select(F.xxhash64("rep").alias("h")), TABLE_BITS)
    hashed = texts.select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    # Most keys stand in one document only; a first pass over the keys alone spares shuffling those windows.
    met = hashed.mapInArrow(_windows(k, width, table), "key long, rep long").groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select(F.col("key").alias("h"))
    keys = bit_table(met, KEY_BITS)
    # What the table lets through wrongly meets nobody in the groups below, so these windows need no further join.
    windows = scratch.table("windows", hashed.mapInArrow(_windows(k, width, table, keys), WINDOW_SCHEMA))
    # All equal stretches; near-equal ones by the widest overlap of each piece of a document, then those that no group settles.
    widest = F.max_by(F.struct("hub", "i0", "j0", "n", "c"), F.struct("n", -F.col("hub"), "i0", "j0", "c")).alias("e")
    edges = scratch.table("edges", _edges(_overlaps(windows, scratch, width)))
    scratch.free("ends-right_key", "ends-left_key")
    halves = bit_table(_met_halves(windows), KEY_BITS)
    # Ids of different texts are left to the comparisons below, which choose one of these.
    one = heads.groupBy(F.col("doc_id").alias("rep")).agg(F.count_distinct("h1", "h2", "n").alias("texts")).filter("texts = 1").join(classes, "rep", "left_semi")
    grams = scratch.table("grams", hashed.mapInArrow(_grams(k, width, table, halves), "key long, rep long, pos int").join(one.hint("shuffle_hash"), "rep", "left_semi").select("key", "rep", "pos"))
    equal = _equal(grams, scratch, k, width)
    scratch.free("grams")
    best = edges.groupBy("rep", F.floor(F.col("c") / REACH).alias("piece")).agg(widest).select("rep", "e.*")
    seqs = _sequences_of(edges, texts, scratch, "edges", k)
    found = _verify(scratch.table("edges-best", best), seqs, scratch, "best", percent, width, k)
    scratch.free("edges-best")
    groups = _groups(found, scratch, "best")
    found = found.union(_verify(scratch.table("edges-rest", _unsettled(edges, groups)), seqs, scratch, "rest", percent, width, k))
    scratch.free("edges", "edges-rest", "seqs-edges")
    groups = _groups(found, scratch, "rest")
    scratch.drop("groups-best")
    # Members of a key of more documents may share a passage with each other only: they meet by short runs inside it.
    crowded = bit_table(_unresolved_keys(windows, groups), KEY_BITS)
    scratch.free("windows")
    runs = scratch.table("runs", hashed.mapInArrow(_runs(k, width, table, crowded), f"key long, rep long, {PLACES}").join(classes.select("rep").distinct().hint("shuffle_hash"), "rep", "left_semi"))
    met = scratch.table("met", _edges(_sided_overlaps(runs, scratch, "key", width)))
    scratch.free("runs", "ends-key")
    # Equal stretches come last: they settle no comparison of near-equal ones, which may reach beyond them.
    rest = scratch.table("edges-runs", _unsettled(met, groups))
    found = found.union(_verify(rest, _sequences_of(rest, texts, scratch, "runs", k), scratch, "runs", percent, width, k)).union(equal)
    scratch.free("edges-runs", "seqs-runs")
    groups = _groups(found, scratch, "all")
    copies = heads.select("doc_id", "h1", "h2", "n").distinct().join(classes, ["h1", "h2", "n"])
    members = groups.join(classes.select("rep", "size"), "rep")
    held = members.select("group_id", "rep", "size").distinct().groupBy("group_id").agg(F.sum("size").alias("documents"))
    whole = copies.filter("size > 1").select("doc_id", F.lit(0).cast("long").alias("begin"), F.col("n").alias("end"), F.when(F.col("doc_id") != F.col("rep"), F.col("rep")).alias("partner_id"), F.concat("rep", F.lit(":copies")).alias("group_id"), (F.col("size") - 1).alias("n_links"))
    own = copies.select("doc_id", "rep").join(groups, "rep").join(held, "group_id").select("doc_id", "begin", "end", F.col("other").alias("partner_id"), "group_id", (F.col("documents") - 1).alias("n_links"))
    scratch.free("met", "groups-rest")
    return own.unionByName(whole)
