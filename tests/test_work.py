"""How much work the plans hold: texts normalised once, shingles dealt once, no table that isn't asked for."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.functions import text
from pagewright.operators import duplicates, facts, layout
from pagewright.plans import knowledge, queries
from pagewright.sources import html

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_squeeze_is_one_search_over_any_white_space(spark):
    marks = " \t\n\r\v\f        　﻿"
    rows = [(f"{a}{b}x{b}{a}ß{a}ɐ{b}{b}{a}",) for a in marks for b in marks] + [("",), (" ",), ("a b",), (None,)]
    for r in spark.createDataFrame(rows, "t string").select("t", text.squeeze(F.col("t")).alias("s")).collect():
        assert r.s == (None if r.t is None else re.sub(f"[{marks}]+", " ", r.t).strip(" "))
    # Spaces inside a line aren't tried against the class, nor ends in a search of their own.
    assert plan(spark.range(1).select(text.squeeze(F.col("id").cast("string")).alias("s"))).count("regexp_replace") == 1


def test_confidence_normalises_each_body_once(spark):
    assert plan(queries.content_confidence(spark, SF)).count("jpg|jpeg") == 2


@pytest.mark.parametrize("t", ["", "a", "a b", "a b c", "a b c d a b c d a b", "x x x x x"])
def test_hashed_shingles_are_as_many_as_shingles(spark, t):
    r = spark.createDataFrame([(t,)], "t string").select(F.size(text.shingles(F.col("t"))).alias("a"), F.size(text.hashed_shingles(F.col("t"))).alias("b")).first()
    assert r.a == r.b


def test_shingles_are_dealt_once_and_only_sets_in_pairs_after(spark):
    rows = [("j", "f", i, 100, 48, [1, 2, 3, 4, 5, 6, 7, 8, 9] if i < 2 else [100 + 9 * i + k for k in range(9)]) for i in range(50)] + [("j", None, 90 + i, 100, 48, [1, 2, 3]) for i in range(2)]
    sets = spark.createDataFrame(rows, "job_id string, fingerprint string, ord long, chars int, bucket int, s array<long>")
    entries = duplicates.rare_entries(sets, 0.8)
    assert " Join " not in plan(entries)
    pairs = duplicates.meeting(entries, entries)
    assert duplicates.sets_of(pairs, sets).count() == 4 and duplicates.sets_of(pairs, sets, sent=1).count() == 52
    got = duplicates.confirmed(pairs, sets, 0.8).collect()
    assert [(r.a, r.b, r.overlap, r.union) for r in got] == [(0, 1, 9, 9)]  # sets without a fingerprint meet nothing


def test_a_build_makes_what_is_asked(spark, monkeypatch):
    written = []

    class Named(knowledge.Stages):
        def __call__(self, name, df):
            written.append(name)
            return super().__call__(name, df)

    pages = knowledge.Stages(spark, "t")("pages", queries.scraped(spark, SF))
    monkeypatch.setattr(knowledge, "Stages", Named)
    assert set(knowledge.build_knowledge(pages, wanted={"clusters"})) == {"clusters"}
    assert "facts" not in written and "members" not in written and written.count("lines") == 1
    written.clear()
    built = knowledge.build_knowledge(pages, wanted={"audit"})
    assert set(built) == {"audit"} and built["audit"].count() > 0 and "facts" in written


def test_lines_are_made_once(spark):
    made = []

    def save(name, df):
        made.append(name)
        return knowledge.Stages(spark, "t")(name, df)

    pages = knowledge.Stages(spark, "t")("pages", queries.scraped(spark, SF))
    kept = sorted(map(repr, layout.line_reasons(pages, save).collect()))
    assert made == ["lines"] and kept == sorted(map(repr, layout.line_reasons(pages).collect()))


def test_python_holds_few_pages_at_a_time():
    """A batch of many pages comes back in parts, and trees have no cycles that wait for the collector."""
    n = 3 * html.AT_ONCE + 1
    batch = pa.RecordBatch.from_arrays([pa.array([f"https://x.y/{i}" for i in range(n)]), pa.array(["<main><h1>A</h1><p>text</p></main>"] * n)], names=["url", "html"])
    schema = pa.schema([("url", pa.string()), ("markdown", pa.string())])
    parts = list(html._parse(schema)(iter([batch])))
    assert [p.num_rows for p in parts] == [html.AT_ONCE] * 3 + [1] and [u for p in parts for u in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    rows = pa.RecordBatch.from_arrays([pa.array(["j"] * 600), pa.array(range(600)), pa.array(["s"] * 600), pa.array([""] * 600), pa.array([f"tel. 500 600 {i + 100}" for i in range(600)])], names=["job_id", "ord", "slug", "url", "text"])
    parts = list(facts._extract(iter([rows])))
    assert max(p.num_rows for p in parts) <= facts.AT_ONCE and sum(p.num_rows for p in parts) == 600
