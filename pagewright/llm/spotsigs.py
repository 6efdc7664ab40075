"""Document fingerprints by SpotSigs: chains of content words after common words, compared by Jaccard similarity.

A spot is an occurrence of a common word (an anchor); its signature is the anchor with the next `chain` words that aren't
common. A text's fingerprint is its set of signatures. Where a text has no common word for GAP words, as in menus and
lists, or at its beginning, every word stands in as an anchor, so such texts can be told apart too. Words are runs of
characters other than ASCII white space and punctuation, compared without regard to the case of A-Z. Signatures are
hashes of 48 bits, so a fingerprint is written as 8 characters for each, in ascending order.

`near_documents` joins near-duplicates. Sets whose sizes differ by more than the threshold's ratio can't be near, so sizes
are cut into ranges of that ratio and only a range and the next one meet. Of its signatures a set needs to show only the
rarest few (as many as it could lack, and one more), and none that no other set holds. Sets that meet are compared with
the smallest id first, and then only across components, in blocks of bounded size.

`following` gives each document its neighbour in the order of ids without sorting the table in one task: ids are cut into
ranges, whole texts are dealt by range and sorted, and each range also gets the first text of the next one.

Defined cases: a null text is empty; an empty text has an empty fingerprint; a text of no spot that a word follows has one
signature, of all its words (of its bytes, if it has no words); a chain at the text's end takes the words there are. Two empty
fingerprints are alike (1.0) but not joined. Rows of equal id follow each other in the order of their texts (in one task,
as a stream); null ids come last; the last row is followed by the first, a single row by itself. Extra columns are ignored;
an empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm import minhash_dedup
from pagewright.llm import shingles as sh
from pagewright.llm.common import Scratch
from pagewright.llm.components import connected

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be been but by can for from had has have in is it its not of on or that the this to was were which will with "
    "au aux avec ce cette dans de des du elle en est et il la le les mais ne on ou par pas pour que qui se son sur un une "
    "als auch auf aus bei das dem den der des die ein eine einem einen einer er es für im ist mit nicht oder sich sie und von war wie zu zum zur "
    "al como con del el ella en era es esta este la las lo los más no o para pero por que se si sin su sus un una y"
)
CHAIN, GAP = 2, 12
MARK = np.uint64((1 << 48) - 1)
#: Documents of a range of ids, and bytes of text that a task takes apart at once.
RANGE_ROWS, PIECE = 50_000, 1 << 20


def anchor_hashes(words: str) -> np.ndarray:
    raw = np.frombuffer(" ".join(sorted(set(words.split()))).encode(), np.uint8)
    return np.unique(sh.words(raw, np.array([0, len(raw)]), sh.PUNCT).hashes)


def signatures(texts: pa.Array, anchors: np.ndarray, chain: int = CHAIN) -> list[np.ndarray]:
    """The sorted distinct signatures of each text."""
    out: list[np.ndarray] = []
    for i, j, raw, off in sh.slices(texts):
        w = sh.words(raw, off, sh.PUNCT)
        common = anchors[np.minimum(np.searchsorted(anchors, w.hashes), len(anchors) - 1)] == w.hashes
        owner, place = np.repeat(np.arange(j - i), np.diff(w.offsets)), np.arange(len(w.hashes))
        last = np.maximum.accumulate(np.where(common, place, -1))
        content, spots = np.flatnonzero(~common), np.flatnonzero(common | (last < w.offsets[owner]) | (place - last > GAP))
        after = np.searchsorted(content, spots, "right")
        held, some = w.hashes[spots] * sh.PLACE[0], np.zeros(len(spots), bool)
        for k in range(chain):
            at = content[np.minimum(after + k, len(content) - 1)] if len(content) else np.zeros(len(spots), int)
            there = (after + k < len(content)) & (owner[at] == owner[spots])
            held += np.where(there, w.hashes[at] * sh.PLACE[k + 1], np.uint64(0))
            some |= there
        sig, of = sh.mix(held[some]) & MARK, owner[spots[some]]
        cuts = np.searchsorted(of, np.arange(j - i + 1))
        for t in range(j - i):
            if cuts[t] < cuts[t + 1]:
                out.append(np.unique(sig[cuts[t] : cuts[t + 1]]))
                continue
            rest = w.hashes[w.offsets[t] : w.offsets[t + 1]]
            rest = rest if len(rest) else raw[off[t] : off[t + 1]].astype(np.uint64)
            whole = sh.mix(rest + sh.spread(6, len(rest))).sum(dtype=np.uint64, keepdims=True)
            out.append(sh.mix(whole + np.uint64(len(rest))) & MARK if len(rest) else np.zeros(0, np.uint64))
    return out


def written(signature: np.ndarray) -> str:
    """A fingerprint as text: 8 characters for each signature."""
    return base64.b64encode(np.ascontiguousarray(signature.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()).decode()


def read_fingerprint(text: str) -> np.ndarray:
    """The signatures of a written fingerprint."""
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).copy().view(">u8").ravel().astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 1.0 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def fingerprints(docs: DataFrame, anchors: str = ANCHORS, chain: int = CHAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_signatures, signatures): the last as the sorted 8-byte numbers of a text's set."""
    known = anchor_hashes(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = signatures(batch.column(1), known, chain)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "n_signatures", "signatures"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_signatures long, signatures binary")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(2)]
        n = [len(s) for s in sets]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(np.repeat(batch.column(1).to_numpy(), n)), pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], names=["rep", "n", "signature"])


def near_documents(docs: DataFrame, percent: int = 80, anchors: str = ANCHORS, chain: int = CHAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_signatures, component_id, kept, class_id (smallest id with the same fingerprint)."""
    scratch = Scratch(docs.sparkSession, "spotsigs")
    prints = scratch.table("prints", fingerprints(docs, anchors, chain, id_col, text_col).withColumn("mark", F.md5("signatures")))
    usable = prints.filter("n_signatures > 0 and doc_id is not null")
    classes = scratch.table("classes", usable.groupBy("mark", "n_signatures").agg(F.min("doc_id").alias("rep")))
    reps = usable.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "mark", "n_signatures"], "left_semi").dropDuplicates(["doc_id", "mark"])
    # Rows of one id and different texts are joined by the id; each set is a node of its own until then.
    reps = scratch.table("reps", reps.select(F.xxhash64("doc_id", "mark").alias("rep"), "doc_id", "n_signatures", F.col("signatures").alias("shingles")))

    shown = reps.select("rep", "n_signatures", "shingles").mapInArrow(_exploded, "rep long, n long, signature long")
    shown = scratch.table("shown", shown)
    common = shown.groupBy("signature").agg(F.count("*").alias("df")).filter("df > 1")
    shared = shown.join(common, "signature")
    spare = F.expr(f"n - div(n * {percent} + 99, 100) + 1")  # signatures that a near set may lack, and one more
    own = shared.groupBy("rep").agg(F.count("*").alias("in_common"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("df", "signature"))
    rare = shared.join(own, "rep").withColumn("place", place).filter(F.col("place") <= spare - (F.col("n") - F.col("in_common")))
    size_range = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9) if percent < 100 else F.col("n")
    ranged = rare.withColumn("range", F.explode(F.array(size_range, size_range + 1)))
    keyed = scratch.table("keyed", ranged.select(F.xxhash64("range", "signature").alias("bucket"), "rep", F.col("n").alias("n_shingles")))

    hubs = keyed.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).filter("hub < top").select("bucket", "hub")
    met = scratch.table("met", keyed.join(hubs, "bucket"))
    sets = reps.select("rep", "shingles")
    side = lambda c, v: sets.select(F.col("rep").alias(c), F.col("shingles").alias(v))
    pairs = met.filter("hub < rep").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    links = scratch.table("links", pairs.join(side("b", "y"), "b").join(side("a", "x"), "a").select("a", "b", "x", "y").mapInArrow(minhash_dedup._overlap(percent), "a long, b long, inter long, uni long"))
    nodes = scratch.table("nodes", connected(links.select("a", "b"), scratch, "star"))
    placed = met.join(nodes.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "rep", "n_shingles", F.coalesce("component", "rep").alias("component"))
    blocks = minhash_dedup._blocks(scratch.table("placed", placed), minhash_dedup.SET_ROWS, minhash_dedup.SET_SHINGLES)
    more = blocks.join(sets, "rep").groupBy("bucket", "kind", "i", "j").applyInArrow(minhash_dedup._compare(percent), "a long, b long, inter long, uni long")
    more = scratch.table("more", more)

    ids = reps.select("rep", "doc_id")
    named = links.select("a", "b").union(more.select("a", "b")).join(ids.select(F.col("rep").alias("a"), F.col("doc_id").alias("x")), "a").join(ids.select(F.col("rep").alias("b"), F.col("doc_id").alias("y")), "b")
    copies = usable.join(classes, ["mark", "n_signatures"]).filter("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    every = named.select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a != b").union(copies)
    final = scratch.table("final", connected(every, scratch, "all"))
    scratch.drop("shown", "keyed", "met", "placed", "nodes")
    out = prints.select("doc_id", "n_signatures", "mark").join(classes, ["mark", "n_signatures"], "left").join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_signatures", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), F.coalesce("rep", "doc_id").alias("class_id"))


def _range_of(bounds: list[float], key):
    """The number of bounds that a key reaches, by halving steps over a constant array."""
    steps = max(1, len(bounds).bit_length())
    held = F.split(F.lit(",".join(map(repr, [*bounds, *[1e308] * ((1 << steps) - len(bounds))]))), ",").cast("array<double>")
    return F.aggregate(F.array(*[F.lit(1 << s) for s in reversed(range(steps))]), F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) <= key, at + step).otherwise(at))


def following(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows (range, extra, doc_id, text) of a table (doc_id, text), each range in one partition, sorted: by descending id,
    then text, and last the row that follows the range (extra = 1)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "following")
    key = F.coalesce(-F.col("doc_id").cast("double"), F.lit(1e300))
    n = docs.count()
    ranges = max(1, min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // range_rows))))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = docs.agg(F.percentile_approx(key, shares, min(20 * ranges, 200_000))).first()[0] if shares else []
    placed = docs.select(_range_of(sorted(set(bounds or [])), key).alias("range"), "doc_id", "text")
    tops = placed.groupBy("range").agg(F.max("doc_id").alias("top"))
    around = Window.orderBy("range")  # one row for each range
    tops = tops.select("range", "top", F.lag("range").over(around).alias("before"), F.max("range").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"))
    tops = scratch.table("tops", tops.select(F.col("range").alias("of"), "top", F.coalesce("before", "last").alias("before")))
    heads = placed.join(F.broadcast(tops), (F.col("range") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("before").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = placed.select("range", F.lit(0).alias("extra"), "doc_id", "text").union(heads.select(F.col("before").alias("range"), F.lit(1), F.lit(None).cast("long"), "text"))
    return rows.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "extra", F.col("doc_id").desc_nulls_last(), "text")


def _edited(anchors: np.ndarray, chain: int):
    def piece(rows: list[tuple]) -> pa.RecordBatch:
        """Rows (range, extra, doc_id, text), each but the last with the one that follows it."""
        texts = [r[3] for r in rows]
        own = signatures(pa.array(texts, pa.string()), anchors, chain)
        out = []
        for (here, extra, doc, text), after, sig, sig_after in zip(rows, rows[1:], own, own[1:]):
            if extra:
                continue
            k = len(text) // 3
            out.append((doc, len(text), text[: len(text) - k] + after[3][:k], sig, sig_after))
        changed = signatures(pa.array([r[2] for r in out], pa.string()), anchors, chain)
        columns = [
            pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([hashlib.sha256(r[2].encode()).hexdigest() for r in out], pa.string()), pa.array([written(r[3]) for r in out], pa.string()),
            pa.array([written(s) for s in changed], pa.string()), pa.array([likeness(r[3], s) for r, s in zip(out, changed)], pa.float64()), pa.array([likeness(r[3], r[4]) for r in out], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for at, extra, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                held.append((at, extra, doc, text.as_py() or ""))
                size += len(held[-1][3])
                if size > PIECE and len(held) > 1:
                    yield piece(held)
                    held, size = held[-1:], len(held[-1][3])
        if len(held) > 1:
            yield piece(held)

    return run


def compare_edited(docs: DataFrame, anchors: str = ANCHORS, chain: int = CHAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of the text with its last third replaced by the beginning of the next document's.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    rows = following(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    return rows.mapInArrow(_edited(anchor_hashes(anchors), chain), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
