"""Decontamination, toxicity, licences, quality, mixing, tokens and archives on small tables."""

import gzip
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import decontamination, licences, mixing, quality, token_output, toxicity, warc
from pagewright.llm.common import Scratch, word_count
from pagewright.llm.queries import tokenizer_path


def plain_tiles(a, b, least):
    """Greedy string tiling by its definition."""
    free_a, free_b, tiles = [x != 0 for x in a], [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return tiles
        for k in range(n):
            free_a[i + k] = free_b[j + k] = False
        tiles.append((i, j, n))


def test_tiles_cover_as_much_as_the_definition():
    rng = np.random.default_rng(1)
    for _ in range(40):
        a, b = (rng.integers(0 if i else 1, 6, rng.integers(1, 40)).astype(np.uint64) for i in (1, 0))
        got, want = decontamination.greedy_tiles(a, b, 3), plain_tiles(a.tolist(), b.tolist(), 3)
        assert sorted(t[2] for t in got)[-1:] == sorted(t[2] for t in want)[-1:]
        assert all((a[i : i + n] == b[j : j + n]).all() for i, j, n in got)
        assert len({x for i, _, n in got for x in range(i, i + n)}) == sum(n for _, _, n in got)


def test_decontamination(spark):
    item = [f"b{i}" for i in range(40)]
    moved = item[20:] + ["and", "so"] + item[:20]
    docs = {0: "x " * 30 + " ".join(item), 1: " ".join(moved).upper(), 2: " ".join(item[:10]) + " end", 3: "clean text without any match in it at all", 4: None, 5: "", 6: "a, b. c", 7: "z " * 20000 + " ".join(item[5:35])}
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "a b c")], "item_id long, text string")
    df = spark.createDataFrame([(i, t, 1) for i, t in docs.items()], "doc_id long, text string, item_id int")
    got = {r.doc_id: r for r in decontamination.mark(df, bench).collect()}
    assert {i for i, r in got.items() if r.contaminated} == {0, 1, 6, 7}
    assert got[1].coverage == 1.0 and got[7].coverage == 0.75 and got[6].item_id == 4 and got[3].n_items == 0
    assert decontamination.mark(df, bench.limit(0)).filter("contaminated").count() == 0 and decontamination.mark(df.limit(0), bench).count() == 0


def test_automaton_matches_edit_distance():
    terms = ["moron", "worthless", "scum", "pathetic"]
    automaton = toxicity.LexiconAutomaton(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, left = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, left[j] + 1, left[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(2)
    for term in terms:
        for _ in range(150):
            w = list(term)
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(1, len(w))
                op = rng.randrange(3)
                w[i : i + 1] = [] if op == 0 and len(w) > 2 else [rng.choice("abcmorn")] if op == 1 else [w[i], rng.choice("abcmorn")]
            word = "".join(w)
            fits = [(distance(word, t), t) for t in terms if word[0] == t[0] and distance(word[1:], t[1:]) <= automaton.allowed(t)]
            found = automaton.match(word)
            want = min(((distance(word[1:], t[1:]), t) for _, t in fits), default=None)
            assert (found and (found[1], found[0])) == want, word


def test_automaton_edits_the_first_letter():
    automaton = toxicity.LexiconAutomaton(["stinkard", "worthless", "scum"])
    for word in ("*tinkard", "tinkard", "tsinkard", "xstinkard", "zxworthless", "orthles"):
        d = 2 if word in ("tsinkard", "zxworthless", "orthles") else 1
        assert automaton.match(word) == ((("worthless" if "o" in word else "stinkard"), d) if d == 1 or "o" in word else None), word
    assert automaton.match("xcum") is None and automaton.match("zzworthles") is None


def toxic_corpus(n=600):
    rng = random.Random(3)
    clean = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "ne") for b in ("ral", "min", "tos", "ver", "gup")]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = [rng.choice(clean) for _ in range(40)]
        if toxic:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(["grumpface", "stinkard", "blockhead"])
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity(spark):
    docs, labels = toxic_corpus()
    more = [(1000, "a blokhead and a st1nkard and grumpfaze here"), (1001, 'he said "grumpface" in the report'), (1002, None), (1003, ""), (1004, "kimin doral " * 3000)]
    df = spark.createDataFrame(docs + more, "doc_id long, text string")
    truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, truth.filter(~toxicity.held_out()))
    assert {"grumpface", "stinkard", "blockhead"} <= set(model.terms)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    kept = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((got[i] >= 0.3) == (i % 5 == 0) for i in kept) and len(kept) > 100
    assert got[1000] > got[1001] and got[1002] == got[1003] < 0.3 and got[1004] < 0.3
    left = {r.doc_id for r in toxicity.filter_documents(df, model).collect()}
    assert left == {i for i, s in got.items() if s < 0.3}
    assert toxicity.score(df.limit(0), model).count() == 0
    assert 0 <= toxicity.score(df, toxicity.fit(df, truth.limit(0))).agg(F.max("score")).first()[0] <= 1


def test_licences(spark):
    texts = {0: "Prose first.\nReleased under the MIT License.\nmore", 1: "Licensed under CC BY-NC 4.0.", 2: "She asked for permission to leave.", 3: None, 4: "", 5: "This work is licensed under the GNU General Public License, version 3.", 6: "nothing here", 7: "Licensed under the Frobnicate Guild Charter of rivers, hills and seasons."}
    df = spark.createDataFrame([(i, t, "p") for i, t in texts.items()], "doc_id long, text string, paragraph string")
    got = {(r.doc_id, r.line): r for r in licences.scan(df).collect()}
    assert got[0, 1].family == "mit" and got[0, 1].confirmed and got[1, 0].family == "cc-by-nc" and got[5, 0].family == "gpl" and got[5, 0].confirmed
    assert not got[2, 0].confirmed and not got[7, 0].confirmed and set(got) == {(0, 1), (1, 0), (2, 0), (5, 0), (7, 0)}
    assert licences.scan(df.limit(0)).count() == 0


def test_licences_without_keywords_and_wrapped(spark):
    gpl = "# This program is free software: you can redistribute it and/or\r\n# modify it under the terms of the GNU General Public License as\r\n# published by the Free Software Foundation"
    texts = {0: "SPDX: Apache-2.0", 1: "Released under MIT terms, MIT License", 2: "Title\n\n" + gpl + "\n\nEnd.", 3: "Er ging mit den Kindern.\nSie kam mit ihm.", 4: "a\x01b\n\x02 Released under the MIT License.", 5: "of the\nin the\nto any", 6: "word " * 50_000 + "\nAll rights reserved.", 7: "Released under the MIT License.\nReleased under the MIT License."}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(0, "Licensed under the MIT license."), (None, "MIT License")], "doc_id long, text string")
    rows = licences.scan(df).collect()
    got = {(r.doc_id, r.line, r.lines): r for r in rows}
    assert got[2, 2, 3].family == "gpl" and got[2, 2, 3].confirmed
    assert got[1, 0, 1].family == "mit" and got[4, 1, 1].family == "mit" and got[6, 1, 1].family == "proprietary" and got[None, 0, 1].family == "mit"
    assert (0, 0, 1) in got and sum(r.doc_id == 0 for r in rows) == 2
    assert not {3, 5} & {r.doc_id for r in rows} and {(r.line, r.family) for r in rows if r.doc_id == 7} == {(0, "mit"), (1, "mit")}


def test_licence_paragraphs_score_as_the_plain_model(spark):
    """The native scores against the same model computed plainly, for every paragraph of random licence-like texts."""
    rng = random.Random(11)
    known = [t for ts in licences.TEMPLATES.values() for t in ts] + licences.OTHERS
    words = [w for t in known for w in t.split()]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) + "." for _ in range(150)] + known
    families, grams, weights, temperature = licences.trained()
    at, phrases = {g: i for i, g in enumerate(grams)}, set(licences.phrases())
    known_pairs = [(f, [g for g in licences.ngrams(t) if " " in g]) for f, ts in licences.TEMPLATES.items() for t in ts]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        mine = licences.ngrams(t)
        hits = [at[g] for g in mine if g in at]
        z = (weights[hits].sum(axis=0) / max(1, len(hits)) ** 0.5 + weights[-1]) / temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        family = families[int(p.argmax())] if p.max() >= 0.5 else licences.UNKNOWN
        assert (i in got) == (family != licences.UNKNOWN or bool(phrases & set(mine)))
        if i in got:
            assert abs(got[i].probability - p.max()) < 1e-9 and got[i].family == family
            best = max((len(set(mine) & set(pairs)) / len(pairs) for f, pairs in known_pairs if f == family), default=0.0)
            assert got[i].similarity == best or family == licences.UNKNOWN
            assert got[i].confirmed == (family != licences.UNKNOWN and best >= licences.CONFIRM)


def test_licence_gate_is_sound_and_the_model_holds():
    """No paragraph without gate words can get a family, by the bound and by trial; short statements and unlisted licences."""
    gate, (families, grams, weights, _) = set(licences.gate()), licences.trained()
    assert licences.most_without(gate) < 0 and not gate & {"the", "of", "and", "de", "la", "der", "die"}
    rng, at = random.Random(2), {g: i for i, g in enumerate(grams)}
    free = [w for w in {w for g in grams for w in g.split()} if w not in gate]
    for _ in range(3000):
        hits = [at[g] for g in licences.ngrams(" ".join(rng.choices(free, k=rng.randint(1, 12)))) if g in at]
        assert (weights[hits].sum(axis=0) / max(1, len(hits)) ** 0.5 + weights[-1]).argmax() == len(families) - 1
    right, sure, other = licences.held_out()
    assert right > 0.85 and abs(right - sure) < 0.1 and other > 0.9


def test_short_statements_and_unlisted_licences(spark):
    want = {"License: MIT": "mit", "MPL 2.0": "mpl", "Lizenziert unter der MIT-Lizenz": "mit", "This code is MIT licensed": "mit", "Licence: GPL": "gpl", "CC0": "public-domain"}
    unlisted = ["Eclipse Public License - v 2.0", "Boost Software License 1.0", "The zlib License", "Licensed under the Academic Free License 3.0"]
    prose = ["Er kam mit dem Auto.", "Sie ging mit ihrer Schwester nach Hause und sprach mit den Kindern", "by the river", "Gehein mit verlich und schein der lich"]
    texts = [*want, *unlisted, *prose]
    got = {r.paragraph: r for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {t: got[t].family for t in want} == want
    assert all(t not in got or got[t].family == licences.UNKNOWN for t in [*unlisted, *prose]) and not set(prose) & set(got)


def test_quality(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = [rng.choice(["river", "house", "small", "green", "walks", "over"]) for _ in range(60)]
        rows.append((i, " ".join(x.upper() + "!!" if bad else x for x in w), "en", "a" if i < 300 else f"s{i}"))
        labels.append((i, int(not bad), 0))
    df = spark.createDataFrame([*rows, (900, None, None, None), (901, "", "en", "a")], "doc_id long, text string, lang string, source string")
    truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(df, truth).collect()}
    assert all(got[i].keep == (i % 4 != 0) for i in range(400)) and len(got) == 402
    assert all(0 <= r.score <= 1 and 0 <= r.path_posterior <= 1 for r in got.values())
    assert quality.score(df.limit(0), truth).count() == 0


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(1, 40), "big" if i % 4 else f"s{i % 3}") for i in range(400)] + [(500, None, "none"), (501, "a b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, max_repeats=2.0, block_tokens=1000).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    n = {}
    for i, t, s in rows:
        n[s] = n.get(s, 0) + len((t or "").split())
    read = {}
    for r in got:
        read[r.source] = read.get(r.source, 0) + r.n_tokens
    ratios = {s: read.get(s, 0) / n[s] for s in n if n[s]}
    assert min(ratios.values()) >= 1 and 1.5 < max(ratios.values()) <= 2.01 and ratios["s0"] > ratios["big"]
    places = sorted((r.place, r.n_tokens) for r in got if r.source == "big")
    assert all(a + x == b for (a, x), (b, _) in zip(places, places[1:]))
    mixed = mixing.mixed_documents(df, max_repeats=2.0)
    assert mixed.columns == df.columns and mixed.count() == len(got) and mixed.select("doc_id").distinct().count() == len(rows)
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixed_documents_shares_copies_among_rows_of_one_id(spark):
    """Every row of `mix` is one row of the mixed documents, also for repeated ids and small budgets."""
    rows = [(i % 7, f"word {'x ' * (i % 5)}", "ab"[i % 2], i) for i in range(40)] + [(None, "a b c", None, 0)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _n long")
    for options in ({"max_repeats": 2.0}, {"max_repeats": 2.0, "budget_tokens": 31}):
        plan, mixed = mixing.mix(df, **options).collect(), mixing.mixed_documents(df, **options).collect()
        assert Counter((r.doc_id, r.source) for r in mixed) == Counter((r.doc_id, r.source) for r in plan)
        again = mixing.mixed_documents(df, **options).collect()
        assert Counter((r.doc_id, r.text) for r in again) == Counter((r.doc_id, r.text) for r in mixed)


def test_exponent_meets_targets(spark):
    sources = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10), ("z", 0)], "source string, tokens long")
    alpha = mixing.exponent(sources, max_repeats=4.0)
    assert abs((1000 / 10) ** (1 - alpha) - 4) < 0.01
    alpha = mixing.exponent(sources, target_entropy=0.9)
    w = np.array([1000.0, 100, 10]) ** alpha
    p = w / w.sum()
    assert abs(-(p * np.log(p)).sum() - 0.9) < 1e-3
    assert mixing.exponent(sources, target_entropy=5.0) == 0.0 and mixing.exponent(sources, max_repeats=1e9) == 0.0 and mixing.exponent(sources.limit(0), max_repeats=2.0) == 1.0


def test_word_count(spark):
    df = spark.createDataFrame([(None,), ("",), (" \n",), ("a",), ("  a\tb\n",), ("é x",)], "t string")
    assert [r[0] for r in df.select(word_count(F.col("t"))).collect()] == [0, 0, 0, 1, 2, 2]


def test_token_round_trip(spark):
    from tokenizers import Tokenizer

    texts = ["", None, "Hello  world", "a b\n c", "x " * 3000, " lead", "trail ", "dou  ble   three", "été — ok", "<|endoftext|> it's", "a <|endoftext|> b", "a<|endoftext|>", " <|endoftext|>  x", "<|endoftext|><|endoftext|>", "<|endoftext |> <|ENDOFTEXT|>"]
    df = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = Scratch(spark, "t").path("shards")
    token_output.write_tokens(df, out, tokenizer_path())
    got = sorted(token_output.read_documents(spark, out).collect())
    tokenizer = Tokenizer.from_file(tokenizer_path())
    start = 0
    for row, t in zip(got, texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    shard = token_output.shard_matrix(token_output.read_shards(spark, out).orderBy("part", "seq").collect()[-1].asDict())
    flat = shard.decode().tolist()
    assert [shard.access(i) for i in range(len(flat))] == flat
    for symbol in set(flat[:20]):
        at = [i for i, x in enumerate(flat) if x == symbol]
        assert shard.occurrences(symbol) == at and shard.count(symbol, 2, 9) == flat[2:9].count(symbol) and shard.rank(symbol, len(flat)) == len(at)
    assert shard.select(flat[0], 10**6) == -1 and shard.count(60000) == 0


@pytest.mark.parametrize("rows", [[], [(1, "http://a.de/x", "h" * 200), (0, "http://a.de/y", "h" * 200), (2, None, None), (3, "http://a.de/\r\nz", "short"), (4, "u", "short"), (0, "http://a.de/y", "h" * 200), (5, "u", "tail \r\n\r\nWARC/1.1\r\n é" * 9)]])
def test_warc_round_trip(spark, rows):
    scratch = Scratch(spark, "t")
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    warc.write_warc(df, scratch.path("w"))
    got = warc.assemble(warc.read_warc(spark, scratch.path("w"))).withColumn("page_id", warc.page_id(F.col("metadata"))).collect()
    assert len(got) == len(rows)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == sorted((i, len((t or "").encode()), digest(t)) for i, _, t in rows)
    kinds = sorted((r.page_id, r.type) for r in got)
    if rows:
        assert kinds == [(0, "response"), (0, "revisit"), (1, "revisit"), (2, "response"), (3, "response"), (4, "response"), (5, "response")]
        assert all(r.request and r.metadata for r in got)


def test_warc_members_and_binary_payloads():
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <a>\r\nContent-Length: 4\r\n\r\n\x00\r\n\r\r\n\r\n"
    found = list(warc.parse(gzip.compress(record) + gzip.compress(record)))
    assert [(r["type"], r["payload"]) for r in found] == [("resource", b"\x00\r\n\r")] * 2
