"""Mixing sources to target weights, in DataFrame operations only.

A source's weight is its token share to the power alpha, normalised: alpha 1 keeps the shares, alpha 0 levels them. The
exponent is found by bisection on a grid of GRID steps: the greatest alpha whose entropy reaches `target_entropy`, or the
least whose most repeated source is read no more than `max_repeats` times as often as the least repeated one. Each
round evaluates several exponents in one grouped aggregation, so any number of sources works.

The budget is `budget_tokens`, or the least for which every source is read at least once. A source's quota is its
weight's part of it: whole epochs, each in a new pseudo-random order by hash, and a last one cut where the quota is
full. Orders are dealt into hash buckets, whose token sums give every copy its place without a window over a whole
source, and a copy's place in its source's quota gives its block, so each block holds all sources in their weights.

Defined cases: a null source is a source of its own; a null or blank text has no tokens; documents of sources without
tokens are read once; a copy that crosses the quota's end is left out unless it is in epoch 0 under the default budget,
which reads every document once; equal rows are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import Scratch, word_count

GRID = 1_000_000
FAN = 32
BUCKET_BITS = 12


def _entropies(sources: DataFrame, exponents: list[int]) -> dict[int, tuple[float, float]]:
    """Entropy in nats and greatest ratio of repetitions for each exponent (in grid steps), over sources with tokens."""
    grid = sources.filter("tokens > 0").select("tokens", F.explode(F.array(*[F.lit(e) for e in exponents])).alias("e"))
    grid = grid.withColumn("w", F.pow(F.col("tokens").cast("double"), F.col("e") / GRID))
    rows = grid.groupBy("e").agg(F.sum("w").alias("z"), F.sum(F.when(F.col("w") > 0, F.col("w") * F.log("w")).otherwise(0.0)).alias("wl"), F.max(F.col("w") / F.col("tokens")).alias("hi"), F.min(F.col("w") / F.col("tokens")).alias("lo")).collect()
    return {r.e: (math.log(r.z) - r.wl / r.z, r.hi / r.lo) for r in rows}


def exponent(sources: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None) -> float:
    """Alpha in [0, 1] for a table (source, tokens). Entropy falls and repetition becomes more even as alpha grows."""
    if sources.filter("tokens > 0").limit(1).count() == 0:
        return 1.0

    def fits(v: tuple[float, float]) -> bool:
        return v[0] >= target_entropy if target_entropy is not None else v[1] <= max_repeats * (1 + 1e-12)

    rising = target_entropy is None  # the limit holds from some alpha on; the entropy target up to some alpha
    lo, hi = 0, GRID
    ends = _entropies(sources, [lo, hi])
    if fits(ends[lo]) and rising or (not rising and not fits(ends[lo])):
        return 0.0
    if (fits(ends[hi]) and not rising) or (rising and not fits(ends[hi])):
        return 1.0
    while hi - lo > 1:
        at = sorted({lo + (hi - lo) * i // FAN for i in range(1, FAN)} - {lo, hi})
        for e, v in sorted(_entropies(sources, at).items()):
            if fits(v) != rising:
                lo = max(lo, e)
            else:
                hi = min(hi, e)
    return (hi if rising else lo) / GRID


def _hash(epoch) -> F.Column:
    return F.expr(f"conv(substring(md5(concat_ws('|', {epoch}, coalesce(cast(doc_id as string), ''))), 1, 13), 16, 10)").cast("long")


class Mixture:
    """Quotas of a corpus: `quotas` (source, tokens, weight, quota, epochs), `alpha`, `budget`, and document sizes."""

    def __init__(self, docs: DataFrame, scratch: Scratch, target_entropy: float | None, max_repeats: float, budget_tokens: int | None, id_col: str, source_col: str, text_col: str):
        sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("n_tokens"))
        self.sizes = scratch.table("sizes", sizes)
        sources = scratch.table("sources", self.sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))
        self.alpha = exponent(sources, target_entropy, None if target_entropy is not None else max_repeats)
        weighed = sources.withColumn("w", F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(self.alpha))).otherwise(0.0))
        z = weighed.agg(F.sum("w").alias("z"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / F.col("w"))).alias("once")).first()
        total, once = float(z.z or 1.0) or 1.0, float(z.once or 0.0)
        self.once = budget_tokens is None
        self.budget = int(math.ceil(once * total)) if budget_tokens is None else int(budget_tokens)
        quotas = weighed.withColumn("weight", F.col("w") / total).withColumn("quota", F.floor(F.round(F.col("weight") * self.budget, 3)).cast("long"))
        if self.once:
            quotas = quotas.withColumn("quota", F.greatest("quota", "tokens"))
        quotas = quotas.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(0).cast("long"))
        self.quotas = scratch.table("quotas", quotas.select("source", "tokens", "docs", "weight", "quota", "epochs"))

    def placed(self) -> DataFrame:
        """Every copy of a document in its epoch with its first token's place in the source: doc_id, source, epoch, n_tokens, place, quota."""
        near = F.col("s.source").eqNullSafe(F.col("q.source"))
        rows = self.sizes.alias("s").join(self.quotas.alias("q"), near).select("s.*", "q.tokens", "q.quota", "q.epochs")
        copies = rows.withColumn("epoch", F.explode(F.expr("sequence(0L, epochs)"))).withColumn("h", _hash("epoch")).withColumn("bucket", F.shiftright("h", 52 - BUCKET_BITS))
        sums = copies.groupBy("source", "epoch", "bucket").agg(F.sum("n_tokens").alias("t"))
        before = sums.withColumn("before", F.sum("t").over(Window.partitionBy("source", "epoch").orderBy("bucket")) - F.col("t")).alias("b")
        on = near_keys("c", "b", ["source", "epoch", "bucket"])
        # Of the last, partial epoch only buckets that begin before its end matter.
        kept = copies.alias("c").join(before, on).select("c.*", "before").filter("epoch < epochs or tokens = 0 or before < quota - epochs * tokens")
        order = Window.partitionBy("source", "epoch", "bucket").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        kept = kept.withColumn("inside", F.sum("n_tokens").over(order) - F.col("n_tokens")).withColumn("place", F.col("epoch") * F.col("tokens") + F.col("before") + F.col("inside"))
        return kept.filter("tokens = 0 or place + n_tokens <= quota and (n_tokens > 0 or epoch < epochs)").select("doc_id", "source", "epoch", "n_tokens", "place", "quota", "h")


def near_keys(a: str, b: str, keys: list[str]):
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def mix(docs: DataFrame, target_entropy: float | None = None, max_repeats: float = 2.0, budget_tokens: int | None = None, block_tokens: int = 1 << 20, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per copy read: doc_id, source, epoch, n_tokens, place (in its source), block, order_key (place in a block)."""
    mixture = Mixture(docs, Scratch(docs.sparkSession, "mixing"), target_entropy, max_repeats, budget_tokens, id_col, source_col, text_col)
    blocks = max(1, -(-mixture.budget // block_tokens))
    block = F.when(F.col("quota") > 0, F.least(F.lit(blocks - 1), F.floor(F.col("place").cast("double") * blocks / F.col("quota")))).otherwise(0)
    return mixture.placed().select("doc_id", "source", "epoch", "n_tokens", "place", block.cast("long").alias("block"), F.col("h").alias("order_key"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The documents with each row as often as the mixture reads it.

    Texts of ids that stand once are not shuffled by source: a copy count per document id joins back to them. Rows of one id
    and source share its copies: each gets the whole part, and the first ones by hash of the text one of the rest.
    """
    copies = mix(docs, id_col=id_col, source_col=source_col, text_col=text_col, **options).groupBy("doc_id", "source").agg(F.count("*").alias("copies"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"))
    same = rows.groupBy("doc_id", "source").agg(F.count("*").alias("rows"))
    counts = copies.alias("k").join(same.alias("r"), near_keys("k", "r", ["doc_id", "source"])).select("k.doc_id", "k.source", "copies", "rows")
    met = rows.alias("d").join(counts.alias("k"), near_keys("d", "k", ["doc_id", "source"])).select("d.row", "k.*")
    single = met.filter("rows = 1").select("row", "copies")
    text = F.col("row").getField(text_col)
    many = met.filter("rows > 1").withColumn("h", F.xxhash64(text)).withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKET_BITS))
    sums = many.groupBy("doc_id", "source", "bucket").agg(F.count("*").alias("t"))
    before = sums.withColumn("before", F.sum("t").over(Window.partitionBy("doc_id", "source").orderBy("bucket")) - F.col("t"))
    many = many.alias("m").join(before.alias("b"), near_keys("m", "b", ["doc_id", "source", "bucket"])).select("m.*", "b.before")
    number = F.col("before") + F.row_number().over(Window.partitionBy("doc_id", "source", "bucket").orderBy("h"))
    many = many.withColumn("number", number).select("row", F.expr("copies div rows + int(number <= copies % rows)").alias("copies"))
    return single.unionByName(many).filter("copies > 0").select("row", F.explode(F.expr("sequence(1L, copies)"))).select("row.*")
