"""Footer lines against a plain search, and the work on lines and footers that all begin alike."""

import random

from pyspark.sql import functions as F

from pagewright.operators import layout

PAGES = "job_id string, structure struct<footerText:string>"


def frames(spark, footers, lines):
    pages = spark.createDataFrame([(j, (f,)) for j, f in footers], PAGES).repartition(3)
    return pages, spark.createDataFrame(lines, "job_id string, line string").repartition(3)


def test_footer_lines_match_a_plain_search(spark):
    rng = random.Random(6)
    words = ["rights", "reserved", "all", "(c)", "2024", "żółw", "imprint", "x"]
    phrase = lambda n: " ".join(rng.choices(words, k=n))
    footers = [(f"j{i % 3}", phrase(rng.randint(1, 12))) for i in range(60)] + [("j0", None), ("j1", ""), ("j2", "12345678"), ("j2", "123456789")]
    lines = [(f"j{i % 3}", rng.choice(["", "  "]) + phrase(rng.randint(1, 5))) for i in range(300)] + [("j2", "12345678"), ("j2", "123456789 "), ("j2", "23456789"), ("j0", ""), ("j0", None), (None, "all rights reserved")]
    lines += [(j, f[a : a + rng.randint(7, 30)]) for j, f in footers if f for a in (0, 3, len(f) // 2)]
    pages, rows = frames(spark, footers, lines)
    want = {(j, line.strip(" ")) for j, line in lines if line and len(line.strip(" ")) > 8 and any(k == j and f and line.strip(" ") in f for k, f in footers)}
    got = [(r.job_id, r.trimmed) for r in layout.footer_lines(pages, rows).collect()]
    assert len(want) > 30 and len(got) == len(set(got)) and set(got) == want
    assert layout.footer_lines(pages.limit(0), rows).count() == layout.footer_lines(pages, rows.limit(0)).count() == 0


def test_common_beginnings_make_few_pairs(spark):
    n = 3000
    footers = [("j", f"All rights reserved by the company, page {i:06d} of the site. Imprint and privacy.") for i in range(n)]
    lines = [("j", f"All rights reserved by the company, page {i:06d} of the site.") for i in range(0, 2 * n, 2)] + [("j", f"All rights reserved by nobody {i}") for i in range(n)] + [("j", "All rights reserved by the company")]
    pages, rows = frames(spark, footers, lines)
    candidates, grams, foot = layout.footer_candidates(pages, rows)
    candidates = candidates.cache()
    assert candidates.count() < n  # lines of a gram that no footer has are gone
    one = candidates.join(foot, ["job_id", "of"])
    missed = one.filter(~F.contains("footer", F.col("trimmed")))
    assert one.count() + missed.join(grams, ["job_id", "gram"]).count() < 4 * n
    got = {r.trimmed for r in layout.footer_lines(pages, rows).collect()}
    assert got == {line for _, line in lines if any(line in f for _, f in footers[:1])} | {line for _, line in lines[:n] if int(line[41:47]) < n}
