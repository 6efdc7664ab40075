import pytest
from pyspark.sql import functions as F

from pagewright.functions import net, urls
from pagewright.operators import crawl

KINDS = {
    "content": ["/about", "/docs/getting-started.html", "/index.php", "/page.aspx", "/page/about-us", "/2023/05/my-post"],
    "image": ["/logo.SVG", "/photo.jpg?w=800"],
    "document": ["/report.pdf", "/data.csv"],
    "asset": ["/app.js", "/sitemap.xml", "/video.mp4"],
    "listing": ["/tag/react", "/archives", "/feed", "/blog/page/3", "/2023", "/2023/05", "/products?sort=price"],
}


def apply(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_kinds(spark):
    paths = [(k, p) for k, ps in KINDS.items() for p in ps]
    assert apply(spark, [f"https://example.com{p}" for _, p in paths] + ["no url"], urls.kind) == [k for k, _ in paths] + ["content"]


def test_canonical_form(spark):
    given = ["https://Example.com/blog/?utm_source=x&id=1&fbclid=z#top", "https://example.com/p?utm_campaign=a", "https://example.com/search?q=test&page=2", "https://example.com", "nothing", None]
    assert apply(spark, given, urls.canonicalize) == ["https://example.com/blog?id=1", "https://example.com/p", "https://example.com/search?q=test&page=2", "https://example.com/", None, None]


def test_slugs(spark):
    assert apply(spark, ["https://a.de/Über uns/Zażółć", "https://a.de/", "x", "https://a.de/a/b.html?q=1"], urls.base_slug) == ["uber-uns-zazo-c", "root", "page", "a-b-html"]
    rows = spark.createDataFrame([("j", i, f"https://a.de/{p}") for i, p in enumerate(["a", "a?x=1", "a-2", "a?x=2"])], "job_id string, ord long, url string")
    assert [r.slug for r in crawl.unique_slugs(rows).orderBy("ord").collect()] == ["a", "a-2", "a-2-2", "a-3"]


def test_absolutize(spark):
    base = "https://a.de/x/y?q=1"
    given = ["/p", "p", "../p", "//b.de/p", "?z=2", "#t", "mailto:a@b", "./p"]
    assert apply(spark, given, lambda c: urls.absolutize(c, F.lit(base))) == ["https://a.de/p", "https://a.de/x/p", "https://a.de/p", "https://b.de/p", "https://a.de/x/y?z=2", "https://a.de/x/y?q=1#t", "mailto:a@b", "https://a.de/x/p"]


@pytest.mark.parametrize("ip,public", [("8.8.8.8", True), ("10.0.0.1", False), ("127.0.0.1", False), ("169.254.169.254", False), ("172.16.0.1", False), ("172.32.0.1", True), ("192.168.1.1", False), ("100.64.0.1", False), ("198.18.0.1", False), ("224.0.0.1", False), ("192.0.0.1", False), ("1.2.3", False), ("1.2.3.256", False), ("a.b.c.d", False)])
def test_ipv4(spark, ip, public):
    assert apply(spark, [ip], net.is_public_ipv4) == [public]


def test_ipv6(spark):
    assert apply(spark, ["::1", "::", "fe80::1", "fd00::1", "ff02::1", "2606:4700::1111", "::ffff:10.0.0.1", "::ffff:8.8.8.8"], net.is_public_ipv6) == [False, False, False, False, False, True, False, True]


def test_robots(spark):
    texts = {"wild": "User-agent: *\nDisallow: /private", "long": "User-agent: *\nDisallow: /a\nAllow: /a/b", "own": "User-agent: *\nDisallow: /\n\nUser-agent: bot\nDisallow: /x", "star": "User-agent: *\nDisallow: /*.pdf$", "empty": "User-agent: *\nDisallow:", "note": "# no\nUser-agent: * # all\nDisallow: /p # here"}
    robots = spark.createDataFrame(list(texts.items()), "job_id string, robots string")
    cases = [("wild", "/private/x", False), ("wild", "/public", True), ("long", "/a/c", False), ("long", "/a/b/c", True), ("own", "/y", True), ("own", "/x/1", False), ("star", "/f.pdf", False), ("star", "/f.pdf?x", True), ("empty", "/z", True), ("note", "/p1", False), ("none", "/q", True)]
    targets = spark.createDataFrame([(j, f"https://h.de{p}") for j, p, _ in cases], "job_id string, url string")
    got = {(r.job_id, r.url): r.allowed for r in crawl.robots_allowed(targets, robots, "Bot/1.0").collect()}
    assert got == {(j, f"https://h.de{p}"): a for j, p, a in cases}


def test_sitemaps(spark, tmp_path):
    from pagewright.plans.knowledge import Stages

    roots = spark.createDataFrame([("j", "https://h.de/")], "job_id string, root string")
    robots = spark.createDataFrame([("j", "Sitemap: https://h.de/extra.xml")], "job_id string, robots string")
    docs = spark.createDataFrame([("https://h.de/sitemap_index.xml", "<sitemapindex><loc>https://h.de/a.xml</loc></sitemapindex>"), ("https://h.de/a.xml", "<urlset><loc> https://h.de/1?a=1&amp;b=2 </loc><loc>https://h.de/2</loc></urlset>"), ("https://h.de/extra.xml", "<urlset><loc>https://h.de/3</loc></urlset>")], "url string, xml string")
    found = crawl.crawl_sitemaps(roots, robots, docs, Stages(spark, "t"))
    assert sorted(r.url for r in found.collect()) == ["https://h.de/1?a=1&b=2", "https://h.de/2", "https://h.de/3"]


def test_discover_and_state(spark):
    from pagewright.plans.knowledge import Stages

    edges = spark.createDataFrame([("https://h.de/", "https://h.de/a"), ("https://h.de/a", "https://h.de/b"), ("https://h.de/a", "https://h.de/i.png"), ("https://h.de/i.png", "https://h.de/never")], "source string, target string")
    roots = spark.createDataFrame([("j", "https://h.de")], "job_id string, root string")
    got = {r.url: r.depth for r in crawl.discover(edges, roots, Stages(spark, "t")).collect()}
    assert got == {"https://h.de/": 0, "https://h.de/a": 1, "https://h.de/b": 2, "https://h.de/i.png": 2}
    stored = spark.createDataFrame([("j", 0, "root", "https://h.de/", "content", "done", None)], "job_id string, ord long, slug string, url string, kind string, status string, error string")
    new = spark.createDataFrame([("j", 0, "https://h.de/", None), ("j", 1, "https://h.de/x", None)], "job_id string, ord long, url string, kind string")
    rows = {r.url: (r.status, r.ord) for r in crawl.append_pages(stored, new).collect()}
    assert rows == {"https://h.de/": ("done", 0), "https://h.de/x": ("pending", 1)}
    scraping = stored.withColumn("status", F.lit("scraping"))
    assert crawl.recover_stale(scraping, scraping.filter("false").select("job_id", "slug")).first().status == "failed"
    patch = spark.createDataFrame([("j", "root", "failed", "HTTP 404")], "job_id string, slug string, status string, error string")
    patched = crawl.patch_pages(stored, patch)
    assert crawl.error_status(patched).first().httpStatus == 404
