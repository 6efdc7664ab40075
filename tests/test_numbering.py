"""Prefix sums over range parts, the site tree and its text against plain versions."""

import random

from pyspark.sql import functions as F

from pagewright.operators import audit, numbering


def test_prefix_sums_equal_a_plain_scan(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.randrange(50), rng.randrange(5)) for i in range(600)]
    df = spark.createDataFrame(rows, "job_id string, i int, at int, v int").repartition(7)
    got = {r.i: r.before for r in numbering.prefix_sums(df, ["job_id"], ["at", "i"], F.col("v").cast("long"), "before").collect()}
    sums, want = {}, {}
    for job, i, at, v in sorted(rows, key=lambda r: (r[2], r[1])):
        want[i] = sums.get(job, 0)
        sums[job] = want[i] + v
    assert got == want
    places = [r.place for r in numbering.numbered(df.filter("job_id = 'hot'"), ["job_id"], ["at", "i"], "place").collect()]
    assert sorted(places) == list(range(len(places)))
    assert numbering.numbered(df.limit(0), ["job_id"], ["at"], "place").count() == 0


def plain_tree(paths, most=200):
    root = {}
    for path in paths:
        node = root
        for s in filter(None, path.split("/")):
            node = node.setdefault(s, {})
    out = ["/"]

    def render(node, depth):
        for s in sorted(node):
            if len(out) >= most:
                return
            out.append("  " * (depth + 1) + s)
            render(node[s], depth + 1)

    render(root, 0)
    return "\n".join([*out, *(["  …"] if len(out) >= most else [])])


def test_tree_text_equals_a_plain_rendering(spark):
    rng = random.Random(3)
    jobs = {f"j{k}": ["/" + "/".join(rng.choices("abcde", k=rng.randint(0, 5))) for _ in range(n)] for k, n in enumerate((1, 30, 200, 3))}
    jobs["wide"] = [f"/dir/page{i:04d}" for i in range(500)]
    jobs["full"] = [f"/p{i:03d}" for i in range(199)]  # with the root just as many lines as there may be
    df = spark.createDataFrame([(j, p) for j, ps in jobs.items() for p in ps], "job_id string, path string").repartition(5)
    for most in (200, 7):
        tree = audit.site_tree(df, most=most, collation="UTF8_BINARY")
        got = {r.job_id: r.text for r in audit.tree_text(tree, most).collect()}
        assert got == {j: plain_tree(ps, most) for j, ps in jobs.items() if any(p.strip("/") for p in ps)}


def test_tree_order_is_a_collation(spark):
    df = spark.createDataFrame([("j", p) for p in ["/zoo", "/Äpfel", "/apfel/x", "/Bar", "/bar", "/Zebra", "/apfel"]], "job_id string, path string")
    rows = sorted((r.line_no, r.depth, r.segment) for r in audit.site_tree(df).collect())
    assert [s for _, _, s in rows] == ["apfel", "x", "Äpfel", "bar", "Bar", "Zebra", "zoo"] and [n for n, _, _ in rows] == list(range(1, 8))
