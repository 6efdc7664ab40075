"""Exact and near duplicates among a job's pages, with the first page of each group as its canonical one.

Near duplicates are decided greedily in page order: a page is a leader unless an earlier leader absorbed it. That is the
lexicographically first maximal independent set of the similarity graph, found in rounds of joins in which leaders come
first, so a template of many near-equal pages costs as many rows as it has pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import hashed_shingles, length_bucket, normalize_body

SHORTEST, LENGTH_RATIO = 50, 0.82
#: Undecided sets of one shingle that are compared with each other in the first round, how many times more in each later
#: one, and pairs of a round for each entry, counted once for each shingle they share; so many pairs are few in any table.
SMALL, MORE, PAIRS, FEW_PAIRS = 64, 8, 8, 10_000_000
#: Sets in pairs up to which their ids are sent to all tasks, some 60 bytes each, so that other sets aren't shuffled.
SENT = 2_000_000


def with_bodies(pages: DataFrame, text_col: str = "cleanedMarkdown") -> DataFrame:
    """Normalised body, its length and length bucket."""
    out = pages.withColumn("body", normalize_body(F.col(text_col))).withColumn("chars", F.length("body"))
    return out.withColumn("bucket", length_bucket(F.col("chars")))


def exact_duplicates(rows: DataFrame, save) -> DataFrame:
    """job_id, ord, first_ord: the first page of the job with the same body, for bodies of 50 characters or more.

    Bodies meet by hash, which is written once with `save(name, df)`; the first page comes from a grouped minimum and joins back.
    """
    hashed = rows.select("job_id", "ord", F.when(F.col("chars") >= SHORTEST, F.sha2("body", 256)).alias("h"))
    keyed = save("body-hashes", hashed).filter("h is not null")
    firsts = keyed.groupBy("job_id", "h").agg(F.min("ord").alias("first_ord"))
    return keyed.join(firsts, ["job_id", "h"]).select("job_id", "ord", "first_ord")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """Hashed sets of 3-word shingles: job_id, ord, fingerprint, chars, bucket, s."""
    return rows.select("job_id", "ord", "fingerprint", "chars", "bucket", hashed_shingles(F.col("body")).alias("s"))


def thousandths(threshold: float) -> int:
    """The least similarity, in thousandths, that rounds to the threshold in hundredths."""
    return round(threshold * 1000) - 5


def rare_entries(sets: DataFrame, threshold: float, key: str = "fingerprint") -> DataFrame:
    """Rows (job_id, s, ord, n, rest, indexed): the rarest shingles of each set, by which similar sets must meet.

    With shingles in one order, rarest first, two sets of similarity t or more have a common one among the first
    n - ceil(t n) + 1 of the larger set and the first m - ceil(2t/(1+t) m) + 1 of the smaller one, so of two sets the
    smaller is met by its `indexed` shingles only. `rest` counts a set's shingles from this one on. Shingles of one page come first in the order and meet nobody: they are
    counted and not carried further. `s` is mixed with the job and key, so it alone brings rows together; should two groups
    have equal numbers, both count too high, which is an order too. Rows are dealt and sorted once: a shingle has one row
    for each page at most, and beside the many shingles of a page these are few.
    """
    least = thousandths(threshold)
    group = F.xxhash64("job_id", F.lit("/"), key)
    each = sets.select("job_id", "ord", F.size("s").alias("n"), group.alias("g"), F.explode("s").alias("s")).withColumn("s", F.col("s").bitwiseXOR(F.col("g"))).drop("g")
    ranked = each.withColumn("df", F.count("*").over(Window.partitionBy("s"))).filter("df > 1")
    ranked = ranked.withColumn("rest", F.row_number().over(Window.partitionBy("ord", "job_id").orderBy(F.desc("df"), F.desc("s"))))
    first = lambda share, whole: F.expr(f"rest >= div(n * {share} + {whole - 1}, {whole})")
    return ranked.filter(first(least, 1000)).select("job_id", "s", "ord", "n", "rest", first(2 * least, 1000 + least).alias("indexed"))


def meeting(left: DataFrame, right: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Pairs (job_id, a, b), a before b, of entries of two tables that may be similar.

    Two sets have no shingle in common before their first common one, so from that one on both must hold as many as the
    threshold asks of their overlap. An entry that leaves fewer isn't the first common one of a similar pair.
    """
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("s", "job_id")]
    least = max(thousandths(threshold), 0)
    may = F.expr(f"l.ord < r.ord and (l.indexed and l.n <= r.n or r.indexed and r.n <= l.n) and least(l.rest, r.rest) * {1000 + least}L >= (l.n + r.n) * {least}L")
    return left.alias("l").join(right.alias("r"), on).filter(may).select("l.job_id", F.col("l.ord").alias("a"), F.col("r.ord").alias("b")).distinct()


def sharing_pairs(sets: DataFrame, threshold: float, key: str = "fingerprint") -> DataFrame:
    """All pairs (a before b) that may reach the threshold."""
    entries = rare_entries(sets, threshold, key)
    return meeting(entries, entries, threshold)


def ranked_pairs(pairs: DataFrame, rows: DataFrame, key: str = "fingerprint") -> DataFrame:
    """`rank` of b among a's candidates: later pages of equal fingerprint with length buckets at most two apart, by (offset, order).

    The candidates aren't built. A page's place in each of the five buckets tells how many later pages a bucket holds, and
    b's rank is those of nearer offsets with its own place after a.
    """
    near = rows.select("job_id", key, "ord", "bucket", F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("offset"))
    near = near.withColumn("bucket", F.col("bucket") + F.col("offset")).withColumn("own", (F.col("offset") == 0).cast("int"))
    bucket = Window.partitionBy("job_id", key, "bucket")
    upto = F.sum("own").over(bucket.orderBy("ord").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    placed = near.withColumn("upto", upto).withColumn("later", F.sum("own").over(bucket) - F.col("upto"))
    later = placed.groupBy("job_id", F.col("ord").alias("a")).agg(F.map_from_entries(F.collect_list(F.struct("offset", F.struct("upto", "later")))).alias("at"), F.max(F.when(F.col("offset") == 0, F.col("bucket"))).alias("a_bucket"))
    own = placed.filter("offset = 0").select("job_id", F.col("ord").alias("b"), F.col("bucket").alias("b_bucket"), F.col("upto").alias("place"))
    met = pairs.join(later, ["job_id", "a"]).join(own, ["job_id", "b"]).withColumn("offset", F.col("b_bucket") - F.col("a_bucket")).filter("abs(offset) <= 2")
    nearer = F.aggregate(F.sequence(F.lit(-2), F.lit(2)), F.lit(0).cast("long"), lambda n, o: n + F.when(o < F.col("offset"), F.try_element_at("at", o)["later"]).otherwise(0))
    return met.withColumn("rank", nearer + F.col("place") - F.try_element_at("at", F.col("offset"))["upto"]).select("job_id", "a", "b", "rank")


def similar_pairs(sets: DataFrame, save, threshold: float = 0.94, most: int | None = None) -> DataFrame:
    """job_id, a, b, overlap, union of pairs whose 3-word shingles' similarity, in hundredths, reaches the threshold.

    Pairs are of one fingerprint with length buckets at most two apart; with `most`, b is among a's first `most` candidates.
    """
    met = sharing_pairs(sets, threshold)
    if most is not None:
        met = ranked_pairs(met, sets).filter(F.col("rank") <= most).drop("rank")
    return confirmed(save("met", met), sets, threshold)


def sets_of(pairs: DataFrame, sets: DataFrame, sent: int = SENT) -> DataFrame:
    """The sets that stand in a pair, before any shuffle; all sets where their ids are too many to be sent to the tasks."""
    page = F.xxhash64("job_id", F.lit("/"), F.col("ord"))
    ids = pairs.select("job_id", F.explode(F.array("a", "b")).alias("ord")).select(page.alias("page")).distinct()
    return sets.withColumn("page", page).join(F.broadcast(ids), "page", "left_semi").drop("page") if ids.limit(sent + 1).count() <= sent else sets


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: float, key: str = "fingerprint") -> DataFrame:
    """Rows (job_id, a, b, overlap, union) of the (stored) pairs that reach the threshold and whose lengths are near."""
    sets = sets_of(pairs, sets)
    side = lambda name: sets.select("job_id", F.col("ord").alias(name), F.col(key).alias(f"{name}_key"), F.col("chars").alias(f"{name}_chars"), F.col("bucket").alias(f"{name}_bucket"), F.col("s").alias(f"{name}_s"))
    met = pairs.join(side("a"), ["job_id", "a"]).join(side("b"), ["job_id", "b"]).filter("a_key = b_key")
    met = met.filter((F.abs(F.col("a_bucket") - F.col("b_bucket")) <= 2) & (F.least("a_chars", "b_chars") >= LENGTH_RATIO * F.greatest("a_chars", "b_chars")))
    met = met.withColumn("overlap", F.size(F.array_intersect("a_s", "b_s"))).withColumn("union", F.greatest(F.lit(1), F.size("a_s") + F.size("b_s") - F.col("overlap")))
    # A similarity that rounds to the threshold or more, in whole numbers.
    return met.filter(F.col("overlap") * 1000 >= F.col("union") * thousandths(threshold)).select("job_id", "a", "b", "overlap", "union")


def greedy_leaders(nodes: DataFrame, edges: DataFrame, save) -> DataFrame:
    """job_id, ord, leader: each node's earliest leader neighbour, itself for leaders.

    A node whose earlier neighbours are all absorbed leads; a node with an earlier leading neighbour is absorbed. Rounds
    grow with the longest chain of decisions, and each decides one node at least. `save(name, df)` writes a round's table and reads it back.
    Nodes that are marked in a column `waits` stay undecided, and so do those that depend on them: they have no leader.
    """
    waits = F.col("waits") if "waits" in nodes.columns else F.lit(False)
    state = save("leaders-0", nodes.select("job_id", "ord", F.lit(None).cast("boolean").alias("leads"), waits.alias("waits")))
    i, still, left = 0, True, None
    while still:
        i += 1
        seen = edges.join(state.select("job_id", F.col("ord").alias("a"), "leads"), ["job_id", "a"])
        seen = seen.groupBy("job_id", F.col("b").alias("ord")).agg(F.bool_or(F.coalesce("leads", F.lit(False))).alias("led"), F.bool_and(F.coalesce(~F.col("leads"), F.lit(False))).alias("free"))
        now = state.join(seen, ["job_id", "ord"], "left")
        decided = F.when(F.col("leads").isNotNull() | F.col("waits"), F.col("leads")).when(F.col("led").isNull() | F.col("free"), True).when(F.col("led"), False)
        state = save(f"leaders-{i}", now.select("job_id", "ord", decided.alias("leads"), "waits"))
        before, left = left, state.filter("leads is null and not waits").count()
        still = left > 0 and left != before
    led = edges.join(state.filter("leads").select("job_id", F.col("ord").alias("a")), ["job_id", "a"]).groupBy("job_id", F.col("b").alias("ord")).agg(F.min("a").alias("first"))
    return state.join(led, ["job_id", "ord"], "left").select("job_id", "ord", F.when(F.col("leads"), F.col("ord")).otherwise(F.col("first")).alias("leader"))


def front_of(sizes: list[tuple[int, int]], small: int, pairs: int) -> int:
    """How many sets of a shingle are compared with each other: `small`, or fewer if their pairs, with SMALL sets or fewer
    free, would be more than `pairs`. Sizes are (sets of a shingle, shingles)."""
    while small > SMALL and sum(many * min(size, small) ** 2 for size, many in sizes) > 2 * pairs:
        small = max(SMALL, small * 3 // 4)
    return small


def near_leaders(sets: DataFrame, threshold: float, save, key: str = "fingerprint", small: int = SMALL) -> DataFrame:
    """job_id, ord, leader, overlap, union: each set's earliest leader of similarity `threshold` or more, itself for leaders.

    Leaders come first, so near-equal pages hardly meet each other. In a round the first `small` undecided sets of every
    shingle are compared among each other, and those that are among the first of all their shingles are decided by their
    links. The new leaders, and only they, meet the other sets of their shingles; what is similar is absorbed. What is left
    differs from its leaders, so the next round takes MORE times as many sets of a shingle, as long as their pairs are few
    beside all entries: a shingle that many different sets hold takes a number of rounds that grows with its logarithm.
    When no shingle has more than `small` undecided sets, all are decided. Tables of a round are deleted when the next one is written.
    """
    entries = save("entries", rare_entries(sets, threshold, key))
    page = ["job_id", "ord"]
    nobody = [F.lit(None).cast("boolean").alias("leads"), F.lit(None).cast(f"struct<leader:{dict(sets.dtypes)['ord']},overlap:int,union:int>").alias("led")]
    state = save("state-0", sets.select(*page, *nobody))

    def absorbed(state: DataFrame, leaders: DataFrame) -> DataFrame:
        """The state after new leaders (job_id, ord) have met all sets that don't lead and have no earlier leader."""
        heads = entries.join(leaders, page, "left_semi")
        others = entries.join(state.filter("not coalesce(leads, false)").select(*page, "led.leader").join(leaders, page, "left_anti"), page)
        pairs = save(f"met-{i}", meeting(heads, others.drop("leader"), threshold))
        links = confirmed(pairs, sets, threshold, key).groupBy("job_id", F.col("b").alias("ord")).agg(F.min(F.struct(F.col("a").alias("leader"), "overlap", "union")).alias("now"))
        new = state.join(leaders.withColumn("new", F.lit(True)), page, "left").join(links, page, "left")
        leads = F.when(F.col("new") | F.col("leads"), True).when(F.coalesce("led", "now").isNotNull(), False)
        return new.select(*page, leads.alias("leads"), F.least("led", "now").alias("led"))

    i, every = 0, None
    while True:
        i += 1
        undecided = state.filter("leads is null").select(*page)
        open_ = save(f"open-{i}", entries.join(undecided, page, "left_semi")) if i > 1 else entries
        sizes = [tuple(r) for r in open_.groupBy("s", "job_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("many")).collect()]
        every = sum(size * many for size, many in sizes) if every is None else every
        if i > 1:
            small = front_of(sizes, small * MORE, max(PAIRS * every, FEW_PAIRS))
        last = max((size for size, _ in sizes), default=0) <= small
        if last:
            edges = save("edges", confirmed(save("met", meeting(open_, open_, threshold)), sets, threshold, key))
            found = greedy_leaders(undecided, edges.select("job_id", "a", "b"), save)
            leaders = save(f"leaders-of-{i}", found.filter("leader = ord").select(*page))
        else:
            placed = save(f"placed-{i}", open_.withColumn("place", F.row_number().over(Window.partitionBy("s", "job_id").orderBy("ord"))))
            front = placed.filter(F.col("place") <= small)
            behind = placed.groupBy(*page).agg((F.max("place") > small).alias("waits"))
            edges = save("edges", confirmed(save("met", meeting(front, front, threshold)), sets, threshold, key))
            nodes = undecided.join(behind, page, "left").withColumn("waits", F.coalesce("waits", F.lit(False)))
            leaders = save(f"leaders-of-{i}", greedy_leaders(nodes, edges.select("job_id", "a", "b"), save).filter("leader = ord").select(*page))
        state = save(f"state-{i}", absorbed(state, leaders))
        drop = getattr(save, "drop", lambda *names: None)
        drop(f"open-{i}", f"state-{i - 1}", f"leaders-of-{i}", f"met-{i}", f"placed-{i}")
        if last:
            return state.select(*page, F.when(F.col("leads"), F.col("ord")).otherwise(F.col("led.leader")).alias("leader"), "led.overlap", "led.union")


def mark_duplicates(pages: DataFrame, save, threshold: float = 0.94, most: int | None = None, text_col: str = "cleanedMarkdown") -> DataFrame:
    """Pages (with a fingerprint) with canonical_ord, duplicateConfidence and isDuplicate.

    An exact copy keeps confidence 1 and follows its representative to that one's leader. With `most`, a page is compared
    with its first `most` candidates only; that needs all pairs of pages that may be similar.
    """
    rows = save("bodies", with_bodies(pages, text_col).select("job_id", "ord", "fingerprint", "body", "chars", "bucket"))
    exact = exact_duplicates(rows, save)
    reps = rows.join(exact.filter("ord = first_ord").select("job_id", "ord"), ["job_id", "ord"], "left_semi")
    sets = save("sets", shingle_sets(reps))
    if most is None:
        led = near_leaders(sets, threshold, save)
    else:
        edges = save("similar", similar_pairs(sets, save, threshold, most))
        led = greedy_leaders(sets, edges.select("job_id", "a", "b"), save).join(edges.select("job_id", F.col("a").alias("leader"), F.col("b").alias("ord"), "overlap", "union"), ["job_id", "leader", "ord"], "left")
    score = F.floor((F.col("overlap") * 200 + F.col("union")) / (F.col("union") * 2)) / 100
    near = led.select("job_id", F.col("ord").alias("first_ord"), "leader", F.when(F.col("leader") != F.col("ord"), score).alias("near"))
    found = exact.join(near, ["job_id", "first_ord"])
    found = found.select("job_id", "ord", F.col("leader").alias("canonical"), F.when(F.col("ord") != F.col("first_ord"), 1.0).otherwise(F.coalesce("near", F.lit(1.0))).alias("duplicateConfidence"))
    out = pages.join(found, ["job_id", "ord"], "left")
    out = out.withColumn("canonical_ord", F.coalesce("canonical", "ord")).withColumn("duplicateConfidence", F.coalesce("duplicateConfidence", F.lit(1.0)))
    return out.drop("canonical").withColumn("isDuplicate", F.col("canonical_ord") != F.col("ord"))


def duplicate_groups(marked: DataFrame) -> DataFrame:
    """One row per group: job_id, canonical_ord and its duplicates in page order."""
    return marked.filter("isDuplicate").groupBy("job_id", "canonical_ord").agg(F.array_sort(F.collect_list(F.struct("ord", "slug", "url", "duplicateConfidence"))).alias("duplicates"))
