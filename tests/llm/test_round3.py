"""Whitening, SpotSigs and spelling variants against plain versions, with nulls, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pagewright.llm import queries, spelling, spotsigs, whitening
from tests.llm.test_dedup import components_of

# Whitening


def vectors(seed=3, n=300, d=20):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, d)) @ np.diag(np.linspace(2, 0.2, d)) @ np.linalg.qr(rng.standard_normal((d, d)))[0] + 3
    return [[float(c) for c in row] for row in v]


def plain_whitening(rows, k=16):
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in r] for r in rows], object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), object)
    n, s = len(fit), fit.sum(0)
    centred = (n * fit - s).astype(float) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(1), ((n * x - s).astype(float) / n) @ v / np.sqrt(e), e / (centred**2).sum() * n


def test_whitening_matches_plain_eigenvectors(spark):
    rows = vectors()
    rows += [rows[0]] * 150 + [rows[1]]  # copies count once in the fit
    table = [(i, r, 1) for i, r in enumerate(rows)]
    table += [(9000, None, 1), (9001, [1.0, None] * 10, 1), (9002, [float("nan")] * 20, 1), (9003, [float("inf")] + [0.0] * 19, 1), (9004, [], 1), (None, rows[2], 1)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, n int").repartition(7)
    got = whitening.whiten(df).collect()
    n, deviation, white, explained = plain_whitening(rows)
    assert len(got) == 16 * (len(rows) + 1)
    by = {(r.vec_id, r.component): r for r in got if r.vec_id is not None}
    sign = [np.sign(by[5, c + 1].whitened * white[5, c]) for c in range(16)]
    for i, c in itertools.product(range(len(rows)), range(16)):
        r = by[i, c + 1]
        assert (r.n, r.deviation) == (n, deviation[i])
        assert r.whitened == pytest.approx(sign[c] * white[i, c], abs=1e-8)
        assert r.explained == pytest.approx(explained[c], rel=1e-9) and r.identity_error < 1e-9
    assert {(r.component, r.whitened) for r in got if r.vec_id is None} == {(c, by[2, c].whitened) for c in range(1, 17)}


def test_whitening_edges(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no spread
    flat = whitening.whiten(frame([(i, [float(i), 5.0, 2.0 * i]) for i in range(9)])).collect()
    assert {r.component for r in flat} == {1} and len(flat) == 9  # one direction holds all of the spread
    mixed = whitening.whiten(frame([(1, [0.0]), (2, [2.0]), (3, [1.0, 0.0]), (4, [0.0, 4.0]), (5, [3.0, 1.0])])).collect()
    assert Counter(r.vec_id for r in mixed) == {1: 1, 2: 1, 3: 2, 4: 2, 5: 2}
    big = whitening.whiten(frame([(1, [-1e12, 0.0]), (2, [1e12, 1.0]), (3, [0.0, 2.0])]), shift=0).collect()
    assert all(r.deviation is None for r in big if r.vec_id != 3)


def test_jacobi_keeps_small_deviations():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    a = q * np.logspace(0, -9, 40)  # columns of very different norms
    v, s = whitening.jacobi(a)
    assert np.abs(v.T @ v - np.eye(40)).max() < 1e-13
    assert np.abs(s / np.logspace(0, -9, 40) - 1).max() < 1e-12


# SpotSigs

COMMON = set(spotsigs.ANCHORS.split())


def plain_signatures(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D!-/:-@\[-`{-~]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    out, last = set(), None
    for i, w in enumerate(words):
        if w in COMMON:
            last = i
        if last is None or w in COMMON or i - last > spotsigs.GAP:
            chain = [x for x in words[i + 1 :] if x not in COMMON][: spotsigs.CHAIN]
            if chain:
                out.add((w, *chain))
    return out or ({tuple(words)} if words else {text} if text else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def spot_corpus(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary, common = [f"word{i}" for i in range(300)], sorted(COMMON)[:30]
    texts = [" ".join(rng.choice(common) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(rng.randint(1, 200))) for _ in range(n)]
    for _ in range(40):
        w = texts[rng.randrange(len(texts))].split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    return [*texts, None, "", "  \n", "!!! ?", "?!", "word1", "Menu | word2 | word3 - word4, word5", "the the the of", "für Ähre und Öl", "x" * 100_000, "the word7 " * 30_000, texts[0].upper(), texts[0]]


def test_signatures_match_plain_ones():
    import pyarrow as pa

    texts = spot_corpus()
    got = spotsigs.signatures(pa.array(texts), spotsigs.anchor_hashes(spotsigs.ANCHORS))
    want = [plain_signatures(t) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in want]
    for a, b in itertools.combinations(range(len(texts)), 2):
        assert spotsigs.likeness(got[a], got[b]) == jaccard(want[a], want[b])
    assert all((spotsigs.read_fingerprint(spotsigs.written(s)) == s).all() for s in got)


def test_edited_texts_and_their_fingerprints(spark):
    texts = spot_corpus()
    ids = random.Random(2).sample(range(10_000), len(texts))
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, fingerprint string").repartition(5)
    got = {r.doc_id: r for r in spotsigs.compare_edited(df).collect()}
    order = sorted(zip(ids, texts), key=lambda r: -r[0])
    assert len(got) == len(order)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after, r = text or "", after or "", got[i]
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == jaccard(plain_signatures(text), plain_signatures(edited))
        assert r.near_next == jaccard(plain_signatures(text), plain_signatures(after))
    same = [r.fingerprint for i, r in got.items() if (dict(order)[i] or "") == texts[0]]
    assert len(same) > 1 and len(set(same)) == 1


def test_following_edges(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert spotsigs.compare_edited(frame([])).count() == 0
    (one,) = spotsigs.compare_edited(frame([(7, "abcdef")])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    # Equal ids follow each other by text; a null id comes last, and the first row follows it.
    rows = spotsigs.compare_edited(frame([(2, "bbb"), (2, "aaa"), (None, "nnn"), (9, None), (9, "zzz")]).repartition(3)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(r.edited_sha256 for r in rows) == sorted(map(sha, ["", "zza", "aab", "bbn", "nn"]))


def test_near_documents_match_brute_force(spark):
    texts = spot_corpus()
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, rep int")
    got = {r.doc_id: r for r in spotsigs.near_documents(df, percent=80).collect()}
    sets = [plain_signatures(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(links) > 20
    assert {i: r.component_id for i, r in got.items()} == components_of(range(len(texts)), links)
    odd = spark.createDataFrame([(None, texts[1]), (4, texts[1]), (4, texts[2]), (6, texts[2]), (5, texts[1])], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in spotsigs.near_documents(odd).filter("doc_id is not null").collect()) == [(4, 4), (4, 4), (5, 4), (6, 4)]


# Spelling variants


def plain_variants(texts, edit=None, least=5, ratio=5):
    counts = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            counts[edit(i)(run) if edit else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, n in counts.items():
        found = [v for v in counts if near(w, v)]
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form = best if best and counts[best] >= ratio * n else None
        out[w] = [form, w, n, len(found), counts.get(form)]
    for w, r in out.items():
        while out[r[1]][0]:
            r[1] = out[r[1]][0]
    return {w: tuple(r) for w, r in out.items()}


def spelling_corpus(seed=4):
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abcéñ", k=rng.randint(6, 9))) for _ in range(30)]
    words = []
    for w in stems:
        n = 1000
        for _ in range(4):  # chains of ever rarer spellings
            words += [w] * n
            n //= 6
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "y" + w[i + 1 :]])
    words += ["aaaaaaa"] * 50 + ["aaaaaaaa"] * 9 + ["aaaaaa"] * 9 + ["baaaaaa"] * 9 + ["STRASSE", "Strasse", "straSSe", "ÀÉÎÕÜ×", "àéîõü×"] * 6
    rng.shuffle(words)
    texts = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
    long_word = "".join(rng.choices("abc", k=3_000))
    return [*enumerate(texts), (900, None), (901, ""), (901, "12 34 the"), (902, f"{long_word} " * 20), (903, f"{long_word[:700]}z{long_word[701:]},"), (None, "Strasse." * 5), (904, (long_word[:-1] + ";") * 5)]


@pytest.mark.parametrize("edit", [None, queries.dropped_letters])
def test_variants_match_brute_force(spark, edit):
    texts = spelling_corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, n int").repartition(5)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(spelling.word_counts(df, edit=edit)).collect()}
    want = plain_variants(texts, edit)
    assert got == want
    assert sum(r[1] != r[0] and r[0] is not None for r in want.values()) > 10  # chains of two steps or more


def test_variants_survive_colliding_keys(spark, monkeypatch):
    from pyspark.sql import functions as F

    words = spark.createDataFrame([("aaaaaa", 90), ("bbbbbb", 5), ("aaaaab", 6), ("aaaaabb", 7)], "word string, n long")
    real = spelling.deletion_keys
    rows = [(int(k) % 3, int(i), int(kind), int(place)) for k, i, kind, place in zip(*real(["aaaaaa", "bbbbbb", "aaaaab", "aaaaabb"], 6))]
    table = spark.createDataFrame(rows, "key long, id long, kind byte, place int").join(words.withColumn("id", F.expr("case word when 'aaaaaa' then 0 when 'bbbbbb' then 1 when 'aaaaab' then 2 else 3 end").cast("long")), "id")
    near = table.select("key", "kind", "place", "id", "word", "n").coalesce(1).sortWithinPartitions("key").mapInArrow(spelling._near, "id long, near long, best_n long, best string")
    got = {r.id: (r.near, r.top) for r in near.groupBy("id").agg(F.sum("near").alias("near"), F.max("best_n").alias("top")).collect()}
    assert got == {0: (1, 6), 2: (2, 90), 3: (1, 6)}


def test_spelling_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.word_counts(empty)).count() == 0
    seed = zlib.crc32(b"12:")
    runs = ["".join(random.Random(i).choices("abcdef", k=8)) for i in range(3000)]
    changed = [r for r in runs if queries.dropped_letters(12)(r) != r]
    assert changed == [r for r in runs if zlib.crc32(f"12:{r}".encode()) % 199 == 0] and zlib.crc32(b"ab", seed) == zlib.crc32(b"12:ab")


# Passages


def test_passage_groups_are_whole(spark):
    """Groups of 2 to 12 documents that share one planted passage each, some edited, some through other members only."""
    from pagewright.llm import passages

    rng, fresh = random.Random(9), itertools.count()
    prose = lambda n: [f"t{next(fresh)}" for _ in range(n)]
    line = prose(12)  # frequent, but short
    texts, of = [], {}
    for size in (2, 3, 5, 12):
        shared = prose(rng.randint(55, 180))
        for m in range(size):
            w = list(shared)
            if m % 3 == 2:
                w[len(w) // 2] = f"edit{m}"
            of[len(texts)] = size
            texts.append(" ".join([*prose(rng.randint(0, 30)), *line, *prose(rng.randint(30, 60)), *w, *prose(rng.randint(5, 300))]))
    lone = len(texts)
    texts += [" ".join([*prose(60), *line, *prose(40)]) for _ in range(10)] + [texts[0], " ".join(prose(40_000)), None, ""]
    rows = [(i, t, -1, "x") for i, t in enumerate(texts)] + [(3, texts[3], 5, "y"), (None, texts[5], 0, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep long, group_id string").repartition(5)
    got = [r for r in passages.repeated_passages(df).collect() if not r.group_id.endswith(":copies")]
    copy = lone + 10
    assert {r.doc_id for r in got} == {*of, copy}
    groups = {}
    for r in got:
        groups.setdefault(r.group_id, set()).add(r.doc_id)
        assert r.partner_id is not None and r.partner_id != r.doc_id
    want, at = [], 0
    for size in (2, 3, 5, 12):
        want.append(set(range(at, at + size)) | ({copy} if at == 0 else set()))
        at += size
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want))
    assert all(r.n_links == len(groups[r.group_id]) - 1 for r in got)
    whole = [r for r in passages.repeated_passages(df).collect() if r.group_id.endswith(":copies")]
    assert sorted((r.doc_id, r.partner_id, r.n_links) for r in whole) == [(0, None, 1), (copy, 0, 1)]
