"""Leader-first rounds against a plain greedy loop, and their work on a template of many near-equal pages."""

import random

import pytest

from pagewright.operators import duplicates
from pagewright.plans.knowledge import Stages

SETS = "job_id string, fingerprint string, ord long, chars int, bucket int, s array<long>"


def plain_leaders(rows, least):
    """The first set of a job and fingerprint leads; each later one follows its first similar leader, or leads."""
    out, leaders = {}, {}
    for job, key, ord_, chars, bucket, s in sorted(rows, key=lambda r: (r[0], r[2])):
        s = set(s)
        for other, c, k, t in leaders.setdefault((job, key), []):
            both = len(s & t)
            if abs(bucket - k) <= 2 and min(chars, c) >= 0.82 * max(chars, c) and 1000 * both >= least * (len(s) + len(t) - both):
                out[job, ord_] = (other, both, len(s) + len(t) - both)
                break
        else:
            leaders[job, key].append((ord_, chars, bucket, s))
            out[job, ord_] = (ord_, None, None)
    return out


def random_sets(seed):
    rng = random.Random(seed)
    rows, base = [], [rng.sample(range(10_000), rng.randint(20, 60)) for _ in range(8)]
    for i in rng.sample(range(5000), 160):
        s = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 3, 6])):  # chains of ever less similar sets
            s[rng.randrange(len(s))] = rng.choice([rng.randrange(10_000), 99_000 + rng.randrange(5)])
        s = sorted(set(s) | set(range(99_100, 99_100 + rng.choice([0, 0, 30]))))  # boilerplate that dissimilar sets share
        rows.append((f"j{rng.randrange(2)}", f"f{rng.randrange(3) // 2}", i, 1000 + rng.randrange(3) * 150, 70 + rng.randrange(4), s))
    return rows


@pytest.mark.parametrize(("seed", "small", "threshold"), [(1, 0, 0.8), (2, 3, 0.94), (3, 64, 0.8)])
def test_leaders_equal_those_of_a_plain_loop(spark, seed, small, threshold):
    rows = random_sets(seed)
    got = duplicates.near_leaders(spark.createDataFrame(rows, SETS), threshold, Stages(spark, "t"), small=max(small, 1))
    want = plain_leaders(rows, duplicates.thousandths(threshold))
    found = {(r.job_id, r.ord): (r.leader, r.overlap, r.union) for r in got.collect()}
    assert found == want
    assert sum(v[0] != k[1] for k, v in want.items()) > 10


def test_no_similar_pair_is_missed(spark):
    rows = [r for r in random_sets(7)]
    sets = spark.createDataFrame(rows, SETS)
    for threshold in (0.5, 0.8, 0.94):
        least, want = duplicates.thousandths(threshold), set()
        for x in rows:
            for y in rows:
                if x[:2] == y[:2] and x[2] < y[2]:
                    both = len(set(x[5]) & set(y[5]))
                    if 1000 * both >= least * (len(set(x[5]) | set(y[5]))):
                        want.add((x[2], y[2]))
        assert want <= {(r.a, r.b) for r in duplicates.sharing_pairs(sets, threshold).collect()}


def test_a_template_of_near_equal_pages_makes_few_rows(spark):
    """Half of the pages are near the first one, a quarter near another, the rest near nothing; none may meet all others."""
    rng, n = random.Random(5), 2000
    common = list(range(200))
    rows = []
    for i in range(n):
        own = [10_000 + 50 * i + k for k in range(2 if i % 4 < 2 else 6 if i % 4 == 2 else 40)]
        rows.append(("j", "f", i, 1000, 70, (common[:-8] if i % 4 == 2 else common) + own))
    rng.shuffle(rows)
    sets = spark.createDataFrame(rows, SETS)
    counts = {}

    class Counting(Stages):
        def __call__(self, name, df):
            out = super().__call__(name, df)
            counts[name] = out.count()
            return out

    entries = duplicates.rare_entries(sets, 0.94)
    first = entries.filter("ord = 0")
    assert duplicates.meeting(first, entries).count() < n
    got = duplicates.near_leaders(sets, 0.94, Counting(spark, "t"))
    assert {(r.job_id, r.ord): (r.leader, r.overlap, r.union) for r in got.collect()} == plain_leaders(rows, duplicates.thousandths(0.94))
    assert max(counts.values()) <= entries.count() + n and len([c for c in counts if c.startswith("state")]) <= 6


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], SETS)
    assert duplicates.near_leaders(empty, 0.9, Stages(spark, "t")).count() == 0
    one = spark.createDataFrame([("j", None, 4, 100, 48, [1, 2]), ("j", "f", 5, 100, 48, [])], SETS)
    assert sorted((r.ord, r.leader) for r in duplicates.near_leaders(one, 0.9, Stages(spark, "t")).collect()) == [(4, 4), (5, 5)]


def test_different_sets_of_one_shingle_take_few_rounds(spark):
    """Sixty sets share a rare shingle and nothing else; a round decides more than the first of them."""
    rows = [("j", "f", i, 1000, 70, [7, *range(1000 * i + 100, 1000 * i + 103)]) for i in range(60)] + [("j", "f", 100 + i, 1000, 70, [7, *range(1000 * i + 100, 1000 * i + 103)]) for i in range(0, 60, 7)]
    names = []

    class Named(Stages):
        def __call__(self, name, df):
            names.append(name)
            return super().__call__(name, df)

    got = duplicates.near_leaders(spark.createDataFrame(rows, SETS), 0.5, Named(spark, "t"), small=16)
    assert {(r.job_id, r.ord): (r.leader, r.overlap, r.union) for r in got.collect()} == plain_leaders(rows, duplicates.thousandths(0.5))
    assert len([n for n in names if n.startswith("state-")]) <= 7


def test_rounds_grow_slower_than_the_sets_of_a_shingle(spark):
    """Different sets of few common shingles: pairs that can't be similar aren't made, and a few rounds decide all."""
    rng = random.Random(11)
    rows = [("j", "f", i, 1000, 70, sorted(rng.sample(range(60), 20))) for i in range(1200)]
    rows += [("j", "f", 2000 + i, 1000, 70, sorted(set(rows[i][5][:-1]) | {70 + i % 7})) for i in range(0, 1200, 40)]
    sets = spark.createDataFrame(rows, SETS)
    names = []

    class Named(Stages):
        def __call__(self, name, df):
            names.append(name)
            return super().__call__(name, df)

    got = duplicates.near_leaders(sets, 0.8, Named(spark, "t"))
    want = plain_leaders(rows, duplicates.thousandths(0.8))
    assert {(r.job_id, r.ord): (r.leader, r.overlap, r.union) for r in got.collect()} == want and sum(v[0] != k[1] for k, v in want.items()) >= 25
    assert len([n for n in names if n.startswith("state-")]) <= 4
    entries = duplicates.rare_entries(sets, 0.8)
    assert duplicates.meeting(entries, entries, 0.8).count() < duplicates.meeting(entries, entries).count()


def test_pairs_of_a_round_are_few_beside_the_entries():
    assert duplicates.front_of([(100, 5)], 512, 10**9) == 512
    sizes = [(9000, 40), (3, 10_000)]
    small = duplicates.front_of(sizes, 4096, 8 * sum(a * b for a, b in sizes))
    assert 64 < small < 4096 and sum(many * min(size, small) ** 2 for size, many in sizes) <= 16 * sum(a * b for a, b in sizes)
    assert duplicates.front_of([(10**6, 1000)], 512, 1) == duplicates.SMALL
