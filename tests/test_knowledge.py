import random

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagewright.operators import brand, clusters, duplicates, facts, layout, records, titles
from pagewright.plans.knowledge import Stages, build_knowledge
from pagewright.schemas import PAGE
from pagewright.sources import brand_html
from pagewright.sources.html import parse_page
from pagewright.streaming import state

NO_SIGNALS = {"ogType": None, "jsonLdTypes": [], "product": None, "hasPrice": False, "hasCartButton": False}


def page(ord, slug, url, raw, title=None, heads=(), nav=(), footer=None, **signals):
    structure = {"headings": [{"level": a, "text": b} for a, b in heads], "forms": [], "nav": [{"text": t, "href": h} for t, h in nav], "footerText": footer, "signals": NO_SIGNALS | signals}
    return {"job_id": "j", "ord": ord, "slug": slug, "url": url, "status": "done", "kind": "content", "raw": raw, "title": title, "description": None, "structure": structure}


def frame(spark, rows):
    return spark.createDataFrame(rows, StructType.fromDDL(PAGE))


PRODUCT = {"name": "Box", "description": "d", "price": "10", "currency": "PLN", "sku": "A1", "brand": None, "category": "c", "images": ["i.png"]}


def test_build_clusters_products(spark):
    body = "# Box {0}\n\n## Opis\n\nA birch box number {0} for birds with a long roof {0}.\n\n## Wymiary\n\n- Wysokość: {0} cm\n"
    rows = [page(i, f"p{i}", f"https://h.de/x{i}", body.format(i), f"Box {i}", product=PRODUCT, hasPrice=True, hasCartButton=True) for i in range(3)]
    rows.append(page(3, "about", "https://h.de/info", "# Firma\n\nWe have made boxes since 1999 in a small town by the river.\n", "Firma"))
    built = build_knowledge(frame(spark, rows))
    cluster = built["clusters"].collect()
    assert [(c.label, c.confidence, c.n) for c in cluster] == [("product", 0.92, 3)]
    got = built["records"].collect()
    assert len(got) == 3 and {(r.price, r.currency) for r in got} == {("10", "PLN")} and got[0].technicalData
    assert [r.slug for r in built["members"].filter("cluster_id is null").collect()] == ["about"]
    audit = built["audit"].first()
    assert audit.totalPagesScraped == audit.pagesSuccessfullyClassified == 4 and audit.factsCount == audit.reliableFactsCount + audit.reviewFactsCount
    assert built["manifest"].first().clusters == 1


def test_layout_and_duplicates(spark):
    text = "Company text that tells where we are and how to find us, with enough words to count as a body for the comparison."
    menu = "[Home](/)\n[Kontakt](/kontakt)\n"
    first = f"{menu}# Anfahrt\n\n{text}\n\n## Polecane produkty\n\n[Box](/box)\n\nMore of the box\n"
    second = f"{menu}# Anfahrt\n\n{text}\n"
    rows = [page(i, f"c{i}", f"https://h.de/k{i}", raw, nav=[("Home", "/"), ("Kontakt", "/kontakt")]) for i, raw in enumerate((first, second))]
    built = build_knowledge(frame(spark, rows))
    pages = {r.slug: r for r in built["pages"].collect()}
    assert pages["c0"].cleanedMarkdown == pages["c1"].cleanedMarkdown == f"# Anfahrt\n\n{text}\n"
    assert pages["c1"].isDuplicate and "duplicate_page" in pages["c1"].diagnostics.warnings and not pages["c0"].isDuplicate
    group = built["duplicate_groups"].first()
    assert group.canonical_ord == 0 and [d.slug for d in group.duplicates] == ["c1"]


def test_section_fold(spark):
    raw = "# A\n## Menu\nx\n### Search\ny\n### Other\nkept by the lowered bar\n# B\nz"
    rows = {r.no: r.reason for r in layout.line_reasons(frame(spark, [page(0, "a", "https://h.de/", raw)])).collect()}
    assert rows == {0: None, 1: "section:Menu", 2: "", 3: "section:Search", 4: "", 5: None, 6: None, 7: None, 8: None}


def test_near_duplicate_leaders(spark):
    a = " ".join(f"w{i}" for i in range(80))
    rows = spark.createDataFrame([("j", 0, "a", "u", a, "f"), ("j", 1, "b", "u", f"{a} extra", "f"), ("j", 2, "c", "u", f"{a} extra", "f")], "job_id string, ord long, slug string, url string, cleanedMarkdown string, fingerprint string")
    got = {r.ord: (r.canonical_ord, r.duplicateConfidence, r.isDuplicate) for r in duplicates.mark_duplicates(rows, Stages(spark, "t")).collect()}
    assert got == {0: (0, 1.0, False), 1: (0, 0.99, True), 2: (0, 1.0, True)}


def test_greedy_leaders_follow_order(spark):
    nodes = spark.createDataFrame([("j", i) for i in range(5)], "job_id string, ord long")
    edges = spark.createDataFrame([("j", 0, 1), ("j", 1, 2), ("j", 2, 3), ("j", 3, 4)], "job_id string, a long, b long")
    assert {r.ord: r.leader for r in duplicates.greedy_leaders(nodes, edges, Stages(spark, "t")).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


def test_title_suffix(spark):
    tail = " - Boxes for birds and bats"
    names = [f"Kontakt{tail}", f"Oferta{tail}", f"Blog{tail}", f"Nowe{tail}", "Other"]
    got = {r.ord: (r.title, r.fullTitle) for r in titles.strip_suffixes(frame(spark, [page(i, str(i), "u", "x", t) for i, t in enumerate(names)])).collect()}
    assert got[0] == ("Kontakt", names[0]) and got[4] == ("Other", None)


def values(text, kind):
    return [f["value"] for f in facts.page_facts(text) if f["kind"] == kind]


def test_facts():
    assert values("Cena: 45,50 PLN oraz €19.99 i 1 200 zł.", "price") == ["45,50 PLN", "€19.99", "1 200 zł"]
    assert values("ma 2,8 cm, 3 m i 500 g", "measurement") == ["2,8 cm", "3 m", "500 g"]
    assert values("rabat 9% od 2018 roku, firma od 1999", "percentage") == ["9%"]
    assert values("rabat 9% od 2018 roku, firma od 1999", "year") == ["2018 roku", "1999"]
    assert values("dnia 03.01.2011", "date") == ["03.01.2011"] and not values("dnia 03.01.2011", "year")
    assert values("ponad 500 projektów", "count") == ["500"] and not values("1200 zł ponad", "count")
    assert values("Kod: BX-200, Artikelnummer: 4711-A, item no. AB123", "sku") == ["BX-200", "4711-A", "AB123"]
    assert not values("skutecznego działania, kodeks postępowania", "sku") and not values("3 lęgów i 2 gąsienice", "measurement")
    assert len(values("9% i 9% i 9%", "percentage")) == 1
    found = {f["kind"]: f for f in facts.page_facts("Telefon: +48 600 700 800, mail biuro@example.com, NIP: 123-456-78-90")}
    assert found["phone"]["label"] == "Telefon" and found["email"]["confidence"] == 0.9 and found["tax_id"]["label"] == "NIP"


def test_collapse(spark):
    rows = [("j", i, 0, s, "u", "phone", "600 700 800", None, "Telefon", "c", 0.9, review) for i, (s, review) in enumerate([("a", True), ("b", False), ("c", False)])]
    df = spark.createDataFrame(rows, "job_id string, ord long, n int, slug string, url string, kind string, value string, unit string, label string, context string, confidence double, needsReview boolean")
    got = facts.collapse_facts(df).first()
    assert (got.slug, got.occurrences, got.alsoOn) == ("b", 3, ["a", "c"])


def test_page_types(spark):
    cases = {"https://h.de/blog/x": "article", "https://h.de/kontakt": "contact", "https://h.de/sklep/x": "category", "https://h.de/faq": "utility", "https://h.de/uslugi/x": "service", "https://h.de/x": "template"}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r.u: r.t for r in df.select("u", clusters.page_type(F.col("u"), F.lit(None), F.lit(None)).alias("t")).collect()} == cases


def test_brand(spark):
    css = ":root{--brand:#ABC;--x:1} a{color:#abc;color:rgb(170, 187, 204)} b{color:#fff;color:#FFFFFF;color:#fff;color:#fff}"
    df = spark.createDataFrame([("j", css)], "job_id string, css string")
    assert [(r.hex, r.n) for r in brand.brand_colors(df).orderBy("rank").collect()] == [("#aabbcc", 3), ("#ffffff", 4)]
    assert [(v.name, v.value) for v in df.select(brand.css_vars(F.col("css"))).first()[0]] == [("--brand", "#ABC"), ("--x", "1")]


def test_records_sections(spark):
    md = "# T\n## Dane techniczne\n| Kolor | biały |\n| --- | --- |\n- Waga: 2 kg\n## Opis\nX: y\n"
    df = spark.createDataFrame([(md,)], "m string").select(records.technical_data(F.col("m")).alias("t"), records.first_date(F.lit("od 2011, 03.01.2012")).alias("d"))
    assert df.first().t == {"Kolor": "biały", "Waga": "2 kg"} and df.first().d == "03.01.2012"


def test_html():
    html = """<html><head><title>T</title><meta name=description content=D><script type="application/ld+json">{"@graph":[{"@type":"Product","name":"N","offers":{"price":5,"priceCurrency":"EUR"}}]}</script></head>
    <body><nav><a href="/a">A</a><a href="/a">A</a><a href="#x">X</a></nav><main><h1>One</h1><p>See <a href="/p?utm_source=x&id=1">page</a> and <b>bold</b><ul><li>a<li>b</ul><pre><code class="language-py">x = 1</code></pre>
    <table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>2</td></tr></table><form><label for=e>Mail</label><input id=e type=email required><input type=hidden name=h><button>Send</button></form></main><footer>Foot</footer></body></html>"""
    got = parse_page(html, "https://h.de/x")
    assert got["markdown"] == "# One\n\nSee [page](https://h.de/p?id=1) and **bold**\n\n- a\n- b\n\n```py\nx = 1\n```\n\n| k | v |\n| --- | --- |\n| 1 | 2 |\n"
    s = got["structure"]
    assert s["nav"] == [{"text": "A", "href": "/a"}] and s["footerText"] == "Foot" and got["description"] == "D"
    assert s["forms"][0]["fields"] == [{"tag": "input", "type": "email", "name": None, "label": "Mail", "placeholder": None, "required": True}] and s["forms"][0]["submitLabel"] == "Send"
    assert s["signals"]["product"]["price"] == "5" and s["signals"]["jsonLdTypes"] == ["Product"]


def test_discovery_follows_links_of_any_depth(spark):
    from pagewright.operators import crawl
    from pagewright.plans import queries

    url = lambda i: f"https://a.de/p{i}"
    edges = spark.createDataFrame([(url(i), url(i + 1)) for i in range(6)] + [(url(6), url(0))], "source string, target string")
    roots = spark.createDataFrame([("a.de", url(0))], "job_id string, root string")
    got = crawl.discover(edges, roots, Stages(spark, "t")).collect()
    assert sorted((r.depth, r.url) for r in got) == [(i, url(i)) for i in range(7)]
    assert len(crawl.discover(edges, roots, Stages(spark, "t"), limit=3).collect()) == 3
    assert "max_depth" not in str(queries.frontier_bfs_depth.__code__.co_consts)


def test_candidate_ranks_without_pairs(spark):
    """A pair's rank among the earlier page's candidates equals that of the list built pair by pair."""
    rng = random.Random(4)
    rows = [("j", f"f{rng.randrange(2)}", i, rng.randrange(6)) for i in rng.sample(range(300), 60)]
    df = spark.createDataFrame(rows, "job_id string, fingerprint string, ord long, bucket int")
    want = {}
    for _, f, a, x in rows:
        later = sorted((y - x, b) for _, g, b, y in rows if g == f and b > a and abs(y - x) <= 2)
        want |= {(a, b): i + 1 for i, (_, b) in enumerate(later)}
    every = [("j", a, b) for _, _, a, _ in rows for _, _, b, _ in rows if (a, b) in want]
    got = duplicates.ranked_pairs(spark.createDataFrame(every, "job_id string, a long, b long"), df)
    assert {(r.a, r.b): r.rank for r in got.collect()} == want


BRAND_CASES = [
    ('<link rel="icon" href="/f.ico"><link rel="apple-touch-icon" href="https://cdn.h.de/t.png"><img src="/l.svg" alt="Acme Logo">', ("https://cdn.h.de/t.png", "https://h.de/l.svg", 0.24, "logo/brand attribute")),
    ('<header><a href="/"><img src="/b.svg" alt="our logo"></a></header><main><div class="clients"><img src="/c.svg" alt="logo"></div></main>', (None, "https://h.de/b.svg", 0.96, "header image + linking to homepage + logo/brand attribute")),
    ('<meta name="logo" content="m.png"><header><img src="/b.svg" alt="logo"></header>', (None, "https://h.de/x/m.png", 0.82, "logo meta tag")),
    ('<link rel="shortcut icon" href="s.ico"><div class="partners"><img src="/p.svg" alt="logo"></div>', ("https://h.de/x/s.ico", "https://h.de/x/s.ico", 0.35, None)),
    ('<div class="site-header"><img data-src="/a.svg"><img data-src="/b.svg"></div>', (None, "https://h.de/a.svg", 0.38, "header image")),
    ('<div id="header"><img src="/ad.svg" alt="reklam"></div>', (None, "https://h.de/ad.svg", 0.2, "header image")),
    ("", (None, None, 0.0, None)),
    (None, (None, None, 0.0, None)),
]


def test_brand_marks(spark):
    df = spark.createDataFrame([(f"https://h.de/x/{i}", h, 1) for i, (h, _) in enumerate(BRAND_CASES)], "url string, html string, logoUrl int")
    got = {r.url: (r.faviconUrl, r.logoUrl, r.logoConfidence, r.logoEvidence) for r in brand_html.brand_pages(df).collect()}
    assert got == {f"https://h.de/x/{i}": want for i, (_, want) in enumerate(BRAND_CASES)}
    warned = {r.url[-1]: r.warnings for r in brand_html.brand_pages(df).collect()}
    assert warned["0"] == [] and warned["3"] == ["logo_candidate_uncertain"] and warned["6"] == warned["7"] == ["logo_missing"]
    assert brand_html.brand_pages(df.limit(0)).count() == 0


def test_footers_and_blank_lines(spark):
    """A line of more than eight characters that a footer of the job holds is removed, a shorter one isn't."""
    pages = frame(spark, [page(0, "a", "https://h.de/", "All rights reserved here\n\nreserved\n\nOwn text of the page", footer="(c) H. All rights reserved here.")])
    assert {r.no: r.reason for r in layout.line_reasons(pages).collect()} == {0: "footer", 1: None, 2: None, 3: None, 4: None}


def test_activity_keeps_the_latest(spark, tmp_path):
    rows = [("j", 1, "phase", "discovering", None, None), ("j", 2, "fetching", None, "u1", None), ("j", 3, "fetch-error", None, "u1", "HTTP 500"), ("j", 4, "fetching", None, "u2", None), ("j", 5, "phase", "naming", None, None), ("j", 6, "fetch-error", None, "u2", "HTTP 404"), ("k", 1, "phase", "discovering", None, None)]
    schema = "job_id string, seq long, type string, phase string, url string, message string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = state.activity(events).writeStream.outputMode("complete").format("memory").queryName("activity").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r.job_id: (r.phase, r.lastUrl, r.fetchErrors, r.lastError and tuple(r.lastError)) for r in spark.table("activity").collect()}
    assert got == {"j": ("naming", "u2", 2, ("u2", "HTTP 404")), "k": ("discovering", None, 0, None)}


class FakeHandle:
    """State and timers of one key, as the stall timer uses them."""

    def __init__(self):
        self.value, self.timers = None, set()
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.discard

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def test_stall_timer():
    handle, timer = FakeHandle(), state.StallTimer(1000)
    timer.init(handle)
    now = type("Now", (), {"at": 5, "getCurrentProcessingTimeInMs": lambda self: self.at})()
    assert next(timer.handleInputRows(("j",), iter([1, 2]), now)).values.tolist() == [["j", False]] and handle.timers == {1005}
    now.at = 900
    list(timer.handleInputRows(("j",), iter([3]), now))
    assert handle.timers == {1900}  # a new event moves the timer
    assert next(timer.handleExpiredTimer(("j",), now, None)).values.tolist() == [["j", True]] and not handle.exists()


def test_facts_of_a_page_are_not_bounded(spark):
    """More facts than a task holds at once: all come, in order, in parts, and collapse."""
    import pyarrow as pa

    n = facts.HELD + 500
    text = "; ".join(f"mail m{i}@example.com" for i in range(n)) + "; rabat 9%; tel. 600 700 800"
    batch = pa.RecordBatch.from_arrays([pa.array(["j", "j"]), pa.array([0, 1]), pa.array(["a", "b"]), pa.array(["u", "u"]), pa.array([text, None])], names=["job_id", "ord", "slug", "url", "text"])
    parts = list(facts._extract(iter([batch])))
    assert max(p.num_rows for p in parts) <= facts.HELD and [k for p in parts for k in p.column(2).to_pylist()] == list(range(n + 2))
    got = facts.extract_facts(spark.createDataFrame([("j", 0, "a", "u", text), ("j", 1, "b", "u", text)], "job_id string, ord long, slug string, url string, raw string"))
    assert got.groupBy("ord").count().orderBy("ord").collect() == [(0, n + 2), (1, n + 2)]
    kept = facts.collapse_facts(got)
    assert kept.count() == n + 2 and kept.filter("occurrences = 2 and alsoOn = array('b')").count() == n + 2


def test_claims_equal_those_of_a_plain_loop():
    """Which spans are claimed, by comparing a match with every span claimed before."""
    rng, bits = random.Random(4), ["NIP: 123-456-78-90", "konto: 12 3456 7890 1234 5678 90", "SKU: AB-12", "45,50 PLN", "3 cm", "2018", "od 2018 roku", "9%", "03.01.2011", "tel. +48 600 700 800", "ponad 500 osób", "a@b.de", "x-1234567.png", "kod: lęgi", "1 200 zł", "24 h"]
    many = 0
    for _ in range(60):
        text = rng.choice([" ", "; ", ", "]).join(rng.choices(bits, k=rng.randint(1, 400)))
        seen, claimed, want = set(), [], []
        for kind, pattern in facts.FIND.items():
            for m in pattern.finditer(text):
                start, end = m.span()
                value = m[1] if kind == "sku" else facts.squeeze(m[0])
                context = facts.squeeze(text[max(0, start - facts.AROUND) : end + facts.AROUND])
                digits = sum(c.isdigit() for c in value)
                actual = "year" if kind == "measurement" and facts.re.match(rf"(?:19|20)[0-9]{{2}}{facts.E}", value) else kind
                if any(start < b and end > a for a, b in claimed) or kind == "sku" and not digits and value != value.upper() or kind == "phone" and not 7 <= digits <= 15:
                    continue
                if facts.is_asset_noise(context, value) or kind == "phone" and not facts.PHONES.search(context) or kind == "count" and not facts.COUNTS.search(context) or (actual, value) in seen:
                    continue
                seen.add((actual, value))
                claimed.append((start, end))
                want.append((actual, value))
        assert [(f["kind"], f["value"]) for f in facts.page_facts(text)] == want
        many += len(want)
    assert many > 500
