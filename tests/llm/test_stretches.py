"""Comparison of two passages' shingles: which stretches are found, and by what means."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pagewright.llm import passages


def _near(a, b, lo, hi, percent):
    """Whether shingles lo to hi of a reach the similarity with what stands in b between their first and last place."""
    x = set(a[lo : hi + 1].tolist())
    spots = [i for i, v in enumerate(b.tolist()) if v in x]
    y = set(b[spots[0] : spots[-1] + 1].tolist())
    return 100 * len(x & y) >= percent * len(x | y)


def test_stretches_are_compared_without_sorting(monkeypatch):
    """A numpy sort for each of these sets took most of the time of op9_passages' slowest stage."""
    for name in ("isin", "unique", "intersect1d"):
        monkeypatch.setattr(np, name, None)
    rnd = np.random.default_rng(3)
    number = lambda n: rnd.integers(0, 1 << 32, n).astype("<u4")
    for _ in range(200):
        n, at = int(rnd.integers(46, 120)), int(rnd.integers(0, 60))
        both = number(n)
        edited = both.copy()
        edited[n // 2] = number(1)[0]
        a, b = np.concatenate([number(at), both, number(40)]), np.concatenate([number(at), edited, number(40)])
        [(lo, hi, p, q)] = passages.stretches(a, b, 80, 46)
        assert (lo, hi, p, q) == (at, at + n - 1, at, at + n - 1)
        assert _near(a, b, lo, hi, 80)
    assert passages.stretches(number(100), number(100), 80, 46) == []


def _document(text):
    every = np.full(1 << 20, 0xFF, np.uint8).tobytes()  # a table that has all ids
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([text]), pa.array([0])], names=["doc_id", "text", "h"])
    return batch, every


def test_equal_cuts_are_compared_once(monkeypatch):
    """A text that repeats its lines gave a comparison of the same two cuts for each repetition."""
    calls = []
    monkeypatch.setattr(passages, "stretches", lambda a, b, *_: calls.append(1) or [(0, len(a) - 1, 0, len(b) - 1)])
    n, cut = 300, np.arange(50, dtype="<u4").tobytes()
    columns = [pa.array([1] * n), pa.array([2] * n), pa.array([60 * i for i in range(n)]), pa.array([5] * n), pa.array([cut] * n), pa.array([cut] * n)]
    [out] = passages._confirm(5, 80, 46)(iter([pa.RecordBatch.from_arrays(columns, names=list("abcdef"))]))
    assert len(calls) == 1
    assert out.column("begin").to_pylist() == [60 * i for i in range(n)]
    assert out.column("end").to_pylist() == [60 * i + 54 for i in range(n)]


def test_windows_of_a_text_that_repeats_its_lines_are_few_rows():
    """Each repetition had rows of its own, and all of them were shuffled for both of their keys."""
    text = " ".join([f"w{i}" for i in range(60)] * 40)
    batch, table = _document(text)
    every = np.full(1 << 22, 0xFF, np.uint8).tobytes()
    rows = [r for b in passages._windows(5, 46, table, every)(iter([batch])) for r in b.to_pylist()]
    places = {(f, a, z) for r in rows for f, a, z in zip(r["first"], r["least"], r["last"])}
    assert len(places) > 100 and len(rows) < len(places) / 5
    assert all(r["least"] == sorted(r["least"]) and r["rep"] == 7 for r in rows)
    assert any(r["halves"] for r in rows)


def test_stretches_are_hashed_only_where_a_whole_half_is_met():
    """They were hashed wherever another document had the same two least shingles, so there were more of them the more texts."""
    batch, table = _document(" ".join(f"w{i}" for i in range(120)))
    every, none = np.full(1 << 22, 0xFF, np.uint8).tobytes(), np.zeros(1 << 22, np.uint8).tobytes()
    met = [b for b in passages._grams(5, 46, table, every)(iter([batch]))]
    assert sum(b.num_rows for b in met) == 120 - 4 - 46 + 1  # with all halves met, every stretch of the length
    assert not sum(b.num_rows for b in passages._grams(5, 46, table, none)(iter([batch])))
