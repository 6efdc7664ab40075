"""Near-duplicate operators against plain versions on small tables with copies, ties, nulls and extra columns."""

import itertools
import random
import re

import numpy as np

from pagewright.llm import components, embedding_dedup, minhash_dedup, passages
from pagewright.llm.common import Scratch

WORDS = [f"w{i}" for i in range(400)]


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def components_of(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 90))) for _ in range(n)]
    for i in range(25):  # near copies of earlier texts, and chains of them
        w = texts[rng.randrange(len(texts))].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w))
    return [*texts, None, "", " \n", "one two", "One\ttwo", "É x", "é x", texts[0].upper(), "z " * 5000]


def test_minhash_matches_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, h1 string")
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(df, percent=85).collect()}
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []) for w in map(words, texts)]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = components_of(range(len(texts)), links)
    assert len(links) > 5
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in enumerate(sets)}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_minhash_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash_dedup.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.component_id or -1, r.kept) for r in minhash_dedup.near_duplicates(odd).collect())
    assert got == [(-1, -1, True), (7, 7, True), (7, 7, True), (9, 7, False)]


def test_blocks_find_what_the_hub_misses(spark):
    """Members that miss the bucket's first text but reach each other, in blocks of few rows."""
    rng = random.Random(5)
    base = rng.choices(WORDS, k=300)
    texts = [" ".join(base)]
    for _ in range(3):
        w = list(base)
        for _ in range(9):
            w[rng.randrange(300)] = rng.choice(WORDS)
        for _ in range(6):
            v = list(w)
            v[rng.randrange(300)] = rng.choice(WORDS)
            texts.append(" ".join(v))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [frozenset(tuple(t.split()[k : k + 5]) for k in range(296)) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(df, percent=85).collect()}
    assert got == components_of(range(len(texts)), links)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)]
    df = spark.createDataFrame([*edges, (None, 1), (5, 5)], "a long, b long")
    ids = {x for e in edges for x in e} | {1, 5}
    got = {r.id: r.component for r in components.connected(df, Scratch(spark, "t")).collect()}
    assert got == components_of(ids, edges)


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 32))
    near = x[:60] + 0.15 * rng.standard_normal((60, 32))
    x = np.vstack([x, near, x[:10], 3 * x[10:15]]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(900, None), (901, []), (902, [0.0] * 32), (903, [float("nan")] * 32), (904, [None] * 32), (905, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    m = u @ u.T >= 0.95
    links = [(a, b) for a, b in zip(*np.nonzero(np.triu(m, 1)))]
    want = components_of(range(len(x)), [(int(a), int(b)) for a, b in links])
    assert {i: got[i].n_links for i in range(len(x))} == {i: int(m[i].sum()) - 1 for i in range(len(x))}
    assert {i: got[i].component_id for i in range(len(x))} == want
    assert all(got[i].n_links == 0 and got[i].kept for i, _ in bad)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_compact_windows_match_definition():
    rng = np.random.default_rng(4)
    v = rng.integers(1, 1 << 40, 400).astype(np.uint64)
    begins = np.array([0, 3, 150, 150, 400])
    want = set()
    for s, e in zip(begins, begins[1:]):
        for c in range(s, e):
            x, y = c, c
            while x > s and v[x - 1] > v[c]:
                x -= 1
            while y < e - 1 and v[y + 1] > v[c]:
                y += 1
            if y - x + 1 >= 12:
                want.add((x, c, y))
    assert set(zip(*(a.tolist() for a in passages.compact_windows(v, begins, 12)))) == want


def test_passages_match_brute_force(spark):
    rng = random.Random(8)
    fresh = itertools.count()
    prose = lambda n: [f"t{next(fresh)}" for _ in range(n)]
    shared = [prose(60) for _ in range(4)]
    line = prose(15)  # frequent but short
    texts = []
    for i in range(30):
        w = prose(40) + line + prose(rng.randrange(30))
        if i % 3 == 0:
            w += shared[i % 4] + prose(20)
        texts.append(" ".join(w))
    edited = list(shared[0])
    edited[30] = "changed"
    texts += [" ".join(prose(30) + edited), texts[1], texts[1], None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = passages.repeated_passages(df).collect()
    want = {i for i in range(0, 30, 3)} | {30, 1, 31, 32}
    assert {r.doc_id for r in got} == want
    for r in got:
        if r.doc_id < 30 and r.doc_id % 3 == 0:
            span = texts[r.doc_id].split()[r.begin : r.end]
            assert set(shared[r.doc_id % 4]) <= set(span) and len(span) <= 90  # a line repeated close by may join
    assert passages.repeated_passages(df.limit(0)).count() == 0


def test_a_passage_after_a_short_common_stretch(spark):
    """Equal words 0-29, other words 30-39, equal words 40-95, at the same places of both documents."""
    fresh = itertools.count()
    prose = lambda n: [f"t{next(fresh)}" for _ in range(n)]
    texts = []
    for _ in range(60):
        head, tail = prose(30), prose(56)
        texts += [" ".join(head + prose(10) + tail) for _ in range(2)]
    got = passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.begin <= 40 and r.end == 96} == set(range(120))


def test_a_confirmed_stretch_leaves_other_partners(spark):
    """A document's words 0-95 stand in one document and its words 60-114 in another: both are its partners."""
    fresh = itertools.count()
    prose = lambda n: [f"t{next(fresh)}" for _ in range(n)]
    texts = []
    for _ in range(60):
        w = prose(131)
        texts += [" ".join(prose(20) + w[60:115] + prose(20)), " ".join(w), " ".join(w[:96] + prose(20))]
    got = passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    spans = {(r.doc_id, r.begin, r.end) for r in got}
    assert spans == {x for i in range(0, 180, 3) for x in ((i, 20, 75), (i + 1, 0, 115), (i + 2, 0, 96))}


def test_members_that_share_only_a_core_with_the_first_and_last(spark):
    """Forty documents hold one core of 45 words; pairs of them, not the first and the last, share the words after it too."""
    fresh = itertools.count()
    prose = lambda n: [f"t{next(fresh)}" for _ in range(n)]
    core = prose(45)
    texts = [" ".join(prose(60) + core + prose(60))]
    for _ in range(19):
        after = prose(5)
        texts += [" ".join(prose(60) + core + after + prose(60)) for _ in range(2)]
    texts.append(" ".join(prose(60) + core + prose(60)))
    got = passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.begin, r.end, r.partner_id) for r in got} == {(i, 60, 110, i + 1 if i % 2 else i - 1) for i in range(1, 39)}
