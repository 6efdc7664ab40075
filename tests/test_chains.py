"""Slugs by rounds against taking turns, and redirect chains by doubling against a plain walk."""

import random

import pytest

from pagewright.operators import crawl


def in_turn(rows):
    out, used = {}, set()
    for job, ord_, base in sorted(rows):
        slug, i = base, 2
        while (job, slug) in used:
            slug, i = f"{base}-{i}", i + 1
        used.add((job, slug))
        out[job, ord_] = slug
    return out


@pytest.mark.parametrize("seed", range(3))
def test_slugs_equal_taking_turns(spark, seed):
    rng = random.Random(seed)
    bases = ["a", "a-2", "a-3", "a-2-2", "a-2-3", "a-10", "b", "b-1", "b-02", "c-2", "2", "2-2", "root-2"]
    rows = [(f"j{rng.randrange(3)}", i, rng.choice(bases)) for i in rng.sample(range(10_000), 120)]
    if seed == 2:  # one page claims 25 taken names in a row, and a long base moves on as a whole
        rows = [("j", i, f"x-{i}") for i in range(2, 26)] + [("j", 100 + i, "x") for i in range(40)] + [("j", 500, "x-60")]
    df = spark.createDataFrame([(j, o, f"https://h.de/{b}" if b != "root-2" else "https://h.de/root-2/") for j, o, b in rows], "job_id string, ord long, url string")
    got = {(r.job_id, r.ord): r.slug for r in crawl.unique_slugs(df).collect()}
    assert got == in_turn(rows)
    assert len({(j, s) for (j, _), s in got.items()}) == len(rows)


def walk(url, stored, private):
    hops = 0
    while True:
        if url in private:
            return url, hops, "blocked"
        if url not in stored:
            return url, hops, "missing"
        status, location = stored[url]
        if status not in (301, 302, 303, 307, 308):
            return url, hops, "ok" if 200 <= status < 300 else f"http {status}"
        if not location:
            return url, hops, "no location"
        if hops == 5:
            return url, hops, "too many"
        url, hops = location if "://" in location else f"https://h.de{location}", hops + 1


def test_redirect_chains_equal_a_plain_walk(spark):
    rng, u = random.Random(3), lambda i: f"https://h.de/p{i}"
    stored = {u(i): (301, u(i + 1)) for i in range(12)} | {u(12): (200, None), u(20): (302, u(21)), u(21): (307, u(20)), u(30): (308, u(30)), u(40): (301, None), u(41): (404, None), u(42): (301, "/p12"), u(43): (301, "http://10.0.0.8/x"), u(44): (302, "https://gone.de/"), u(45): (301, ""), u(46): (301, "ftp://h.de/f"), u(47): (303, "https://inside.de/x"), u(48): (301, u(43)), "http://127.0.0.1/": (200, None), "https://8.8.8.8/": (200, None), u(49): (301, "https://8.8.8.8/"), "http://localhost/": (200, None)}
    stored |= {u(i): (rng.choice([301, 302, 200, 500]), rng.choice([u(rng.randrange(100, 140)), "/p12", None])) for i in range(100, 140)}
    private = {"http://10.0.0.8/x", "ftp://h.de/f", "https://inside.de/x", "http://127.0.0.1/", "http://localhost/"}
    df = spark.createDataFrame([(url, s, to, "x") for url, (s, to) in stored.items()] + [(u(12), 200, None, "y"), (None, 200, None, "z")], "url string, status int, location string, hops string").repartition(3)
    addresses = spark.createDataFrame([("inside.de", "8.8.8.8"), ("INSIDE.de", "192.168.0.1"), ("h.de", "1.1.1.1")], "host string, ip string")
    got = {r.url: (r.final_url, r.hops, r.outcome) for r in crawl.redirect_chains(df, addresses).collect()}
    assert got == {url: walk(url, stored, private) for url in stored}
    assert {"ok", "blocked", "too many", "missing", "no location", "http 404"} <= {v[2] for v in got.values()}
    assert crawl.redirect_chains(df.limit(0)).count() == 0
