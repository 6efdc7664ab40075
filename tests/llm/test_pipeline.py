"""The corpus pipeline against a plain version of each stage's decision."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pagewright.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    vocabulary = [f"{a}{b}{c}" for a in ("ba", "do", "ki", "lu") for b in ("ral", "min", "tos", "ver") for c in ("a", "o", "ek")]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs, labels, kinds = [], [], {}
    for i in range(400):
        w, kinds[i] = prose(60), "clean"
        if i % 5 == 0:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["grumpface", "stinkard", "blockhead"])
            kinds[i] = "toxic"
        docs.append([i, " ".join(w)])
        labels.append((i, 1, int(i % 5 == 0)))
    item = [f"bench{i}" for i in range(40)]
    for j, i in enumerate(x for x in range(300, 320) if x % 5):
        docs[i][1] += " " + " ".join(item[20:] + item[:20])
        kinds[i] = "leak"
    for i in (101, 102, 103, 104):  # copies and a near copy of 101
        docs[i][1] = docs[101][1] + (" end" if i == 104 else "")
        kinds[i] = "clean" if i == 101 else "copy"
    path = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", "big" if i < 350 else "small", len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), dict(docs), kinds, {i: s for i, _, _, s, _ in rows}


def test_pipeline(spark, folder):
    path, texts, kinds, sources = folder
    got = corpus_pipeline.run(spark, path).collect()
    want = {i for i, k in kinds.items() if k == "clean"}
    assert {r.doc_id for r in got} == want
    # Documents of the light source are read twice at most, the others once.
    copies = Counter(r.doc_id for r in got)
    assert all(n == 1 for i, n in copies.items() if sources[i] == "big") and max(copies.values()) == 2
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        ids = [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(copies.elements())


def test_stages_keep_columns_and_take_empty_tables(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), path)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), path).count() == 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_take_odd_rows(spark, folder):
    """Null ids and texts, repeated rows, one very long text and further columns with clashing names pass every stage."""
    path = folder[0]
    long = " ".join(f"v{i % 977}" for i in range(60_000))
    odd = [(None, "no id here at all today"), (1, None), (2, ""), (3, long), (4, "same row twice over there"), (4, "same row twice over there"), (5, "Same row twice  over there")]
    rows = [(i, t, "en", None if i == 1 else "s", 0, "d", 1, 2, 3) for i, t in odd]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _drop string, _n int, copies int, row int")
    want = [[None, 1, 2, 3, 4, 4, 5], [None, 1, 2, 3, 4, 4], [None, 1, 2, 3, 4, 4]]
    for (name, stage), ids in zip(corpus_pipeline.STAGES, want):
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        assert sorted((r.doc_id for r in out.collect()), key=lambda i: -1 if i is None else i) == ids, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, path)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == {None, 1, 2, 3, 4}
    assert corpus_pipeline.STAGES[4][1](spark, mixed, path).count() == mixed.count()
