"""Page types, structural fingerprints and template clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import LEFT, RIGHT, headings, squeeze
from pagewright.operators.layout import one_of

# Path parts by page type; words in a text; heading vocabularies; chrome headings.
PATHS = {
    "article": ["blog", "aktualnosci", "artykul", "artykuly", "news", "poradnik", "wpis", "articles?", "posts?", "aktuelles", "beitrag", "beitraege", "ratgeber"],
    "case_study": ["realizacje", "realizacja", "case-stud", "portfolio", "referencje", "referenzen", "projekte", "projects"],
    "regional_directory": ["miasta", "region", "wojewodztwa", "lokalizacje", "oddzialy", "locations", "standorte", "filialen", "branches"],
    "category": ["kategoria", "category", "categories", "kategorien?", "produkty", "produkt-category", "products?", "produkte", "collections?", "sklep", "shop", "oferta"],
    "service": ["uslugi", "services?", "oferta", "leistungen", "dienstleistungen", "angebot"],
}
OPEN_PATHS = {
    "contact": ["kontakt", "contact"],
    "utility": ["dostawa", "platnosci", "payment", "shipping", "delivery", "regulamin", "polityka", "privacy", "terms", "zwroty", "returns", "faq", "impressum", "datenschutz", "agb", "versand", "zahlung", "widerruf"],
}
CONTACT_WORDS = ["NIP", "REGON", "KRS", r"tel\.?", "telefon", "e-mail", "email"]
CATEGORY_WORDS = ["sortuj", "filtruj", "kategorie", "produkty w kategorii", "sort by", "filter by", "sortieren", "filtern"]
LAYOUT_HEADINGS = ["home", "menu", "produkty", "produkt", "products?", "produkte", "kontakt", "contact", "o nas", "about(?: us)?", "über uns", "sklep", "shop", "koszyk", "cart", "warenkorb", "konto", "account", "login", "logowanie", "anmelden", "szukaj", "search", "suche", "wyszukiwarka", "polecane produkty", "popularne", "featured products", "popular", "kategorie[n]?", "category", "categories"]
TECHNICAL = ["specyfikacja", "dane techniczne", "parametry", "wymiary", "specifications?", "technical data", "technische daten", "abmessungen"]
BUCKETS = {
    "description": ["opis", "description", "o produkcie", "beschreibung"],
    "technical": TECHNICAL,
    "contact": ["kontakt", "contact", "formularz", "adres", "address", "adresse", "anfahrt"],
    "gallery": ["realizacje", "galeria", "gallery", "galerie", "zdjęcia", "photos", "portfolio", "referenzen"],
    "article-list": ["aktualności", "blog", "poradnik", "artykuły", "news", "articles", "aktuelles", "ratgeber"],
}
LABELS = ["product", "category", "article", "service", "case_study", "contact", "regional_directory", "utility", "template"]
# Content fields that a cluster of a label should fill.
FIELDS = {
    "product": ["slug", "sourceUrl", "title", "metaDescription", "productName", "categoryPath", "sku", "images", "shortDescription", "featureBullets", "technicalData", "ctaLinks", "relatedProducts"],
    "article": ["slug", "sourceUrl", "title", "date", "author", "leadImage", "headings", "bodyContent", "internalLinks", "relatedProducts"],
    "contact": ["slug", "sourceUrl", "companyName", "address", "taxIds", "phone", "email", "bankAccount", "openingHours"],
    "category": ["slug", "sourceUrl", "title", "metaDescription", "categoryPath", "intro", "items", "filters"],
    "utility": ["slug", "sourceUrl", "title", "bodyContent", "headings", "internalLinks"],
    "": ["slug", "sourceUrl", "title", "metaDescription", "headings", "bodyContent", "internalLinks"],
}
FIELDS["case_study"] = FIELDS["article"]
SMALLEST, SMALLEST_PRODUCTS, SHAPE_HEADINGS = 4, 2, 12


def _in_path(url: Column, label: str) -> Column:
    return url.rlike(f"(?iu)/({'|'.join(PATHS[label])})/") if label in PATHS else url.rlike(f"(?iu)/({'|'.join(OPEN_PATHS[label])}){RIGHT}")


def is_product(structure: Column) -> Column:
    s = structure["signals"]
    return F.coalesce(s["product"].isNotNull(), F.lit(False)) | F.coalesce(s["ogType"] == "product", F.lit(False)) | (F.coalesce(s["hasCartButton"], F.lit(False)) & F.coalesce(s["hasPrice"], F.lit(False)))


def page_type(url: Column, title: Column, markdown: Column, structure: Column | None = None) -> Column:
    """The first type that fits, in fixed order; only the first 20,000 characters of title and text are read."""
    text = F.substring(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(markdown, F.lit(""))), 1, 20_000)
    og_article = F.lit(False) if structure is None else F.coalesce(structure["signals"]["ogType"] == "article", F.lit(False))
    out = F.when(F.lit(False) if structure is None else is_product(structure), "product")
    out = out.when(_in_path(url, "contact") | text.rlike(f"(?iu){LEFT}({'|'.join(CONTACT_WORDS)})[:\\s]"), "contact")
    out = out.when(_in_path(url, "article") | og_article, "article")
    for label in ("case_study", "regional_directory", "utility"):
        out = out.when(_in_path(url, label), label)
    out = out.when(_in_path(url, "category") | text.rlike(f"(?iu){LEFT}({'|'.join(CATEGORY_WORDS)}){RIGHT}"), "category")
    return out.when(_in_path(url, "service"), "service").otherwise("template")


def content_headings(markdown: Column, structure: Column) -> Column:
    """Headings of the cleaned text, or of the structure where that has none, without chrome headings."""
    proper = lambda h: (h["text"] != "") & ~h["text"].rlike(one_of(LAYOUT_HEADINGS))
    own = F.filter(headings(F.coalesce(markdown, F.lit(""))), proper)
    given = F.filter(F.coalesce(structure["headings"], F.expr("cast(array() as array<struct<level:int,text:string>>)")), proper)
    return F.when(F.size(own) > 0, own).otherwise(given)


def heading_bucket(text: Column) -> Column:
    plain = squeeze(F.regexp_replace(F.lower(text), "[^a-ząćęłńóśźżäöüß0-9 ]", " "))
    out = F.when(plain == "", "empty")
    for name, terms in BUCKETS.items():
        out = out.when(plain.rlike("|".join(terms)), name)
    return out.otherwise(F.array_join(F.slice(F.split(plain, " "), 1, 3), "-"))


def fingerprint(kind: Column, heads: Column, structure: Column) -> Column:
    """Heading shape, number of forms and commerce flags; the URL counts only through the page type."""
    shape = F.array_join(F.transform(F.slice(heads, 1, SHAPE_HEADINGS), lambda h: F.when(h["level"] == 1, "h1:title").otherwise(F.concat(F.lit("h"), h["level"].cast("string"), F.lit(":"), heading_bucket(h["text"])))), ",")
    s = structure["signals"]
    yes = lambda c: F.coalesce(c, F.lit(False))
    flags = F.concat(F.when(yes(s["product"].isNotNull()), "P").otherwise(""), F.when(yes(s["hasCartButton"]), "C").otherwise(""), F.when(yes(s["hasPrice"]), "$").otherwise(""), F.when(yes(s["ogType"] == "product"), "og").otherwise(""), F.when(kind != "template", F.substring(kind, 1, 3)).otherwise(""))
    return F.concat(shape, F.lit("|f"), F.coalesce(F.size(structure["forms"]), F.lit(0)).cast("string"), F.lit("|"), flags)


def with_fingerprints(pages: DataFrame) -> DataFrame:
    """Pages with pageType, heads and fingerprint."""
    s = F.col("structure")
    out = pages.withColumn("pageType", page_type(F.col("url"), F.col("title"), F.col("cleanedMarkdown"), s)).withColumn("heads", content_headings(F.col("cleanedMarkdown"), s))
    return out.withColumn("fingerprint", fingerprint(F.col("pageType"), F.col("heads"), s))


def cluster_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clusters, members): members have job_id, ord, cluster_id, null for unique pages.

    Pages come with fingerprints. Everything a cluster needs is a grouped count, so a large template is never gathered;
    its members' list is a table.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    product = F.col("structure.signals.product")
    rows = pages.select(
        "job_id", "ord", "url", "fingerprint", "pageType", is_product(F.col("structure")).alias("is_product"),
        (F.col("url").rlike(f"(?iu)/({'|'.join(PATHS['article'])})/") | yes(F.col("structure.signals.ogType") == "article")).alias("articleish"),
        F.exists("heads", lambda h: h["text"].rlike(f"(?iu){'|'.join(TECHNICAL)}")).alias("technical"),
        (F.length(F.regexp_replace(F.coalesce("cleanedMarkdown", F.lit("")), r"\s+", " ")) > 200).alias("bodied"),
        product["sku"].isNull().alias("no_sku"), (F.coalesce(F.size(product["images"]), F.lit(0)) < 1).alias("no_images"), product["category"].isNull().alias("no_category"),
        yes(F.array_contains("diagnostics.warnings", "mostly_navigation_content")).alias("mostly_nav"), F.col("diagnostics.removedLayoutArtifacts").alias("artifacts"),
    )
    key = ["job_id", "fingerprint"]
    groups = rows.groupBy(*key).agg(
        F.count("*").alias("n"), F.min("ord").alias("first_ord"), F.bool_and("is_product").alias("all_products"), F.count_if("articleish").alias("articles"), F.count_if("technical").alias("technicals"), F.count_if("bodied").alias("bodied"),
        F.bool_or("no_sku").alias("no_sku"), F.bool_or("no_images").alias("no_images"), F.bool_or("no_category").alias("no_category"), F.bool_or("mostly_nav").alias("mostly_nav"),
    )
    big = F.when(F.col("all_products"), SMALLEST_PRODUCTS).otherwise(SMALLEST)
    groups = groups.filter((F.col("n") >= big) & ~F.col("fingerprint").startswith("|"))
    groups = groups.withColumn("number", F.row_number().over(Window.partitionBy("job_id").orderBy("first_ord")))
    votes = rows.groupBy(*key, "pageType").agg(F.count("*").alias("votes"), F.min("ord").alias("seen"))
    top = votes.groupBy(*key).agg(F.min(F.struct((-F.col("votes")).alias("v"), "seen", "pageType")).alias("t")).select(*key, F.col("t.pageType").alias("top"))
    half, most = F.ceil(F.col("n") / 2), F.ceil(F.col("n") * 3 / 5)
    label = F.when((F.col("top") == "article") | (F.col("articles") >= half), "article").when(F.col("top").isin("template", "category") & (F.col("technicals") >= most), "product").otherwise(F.col("top"))
    groups = groups.join(top, key).withColumn("label", label)
    own = votes.select(*key, F.col("pageType").alias("label"), "votes")
    groups = groups.join(own, [*key, "label"], "left").withColumn("votes", F.coalesce("votes", F.lit(0)))
    score = F.least(F.lit(0.95), 0.55 + F.col("votes") / F.col("n") * 0.25 + F.col("bodied") / F.col("n") * 0.15)
    groups = groups.withColumn("confidence", F.when(F.col("label") == "product", 0.92).otherwise(F.floor(score * 100 + 0.5) / 100)).withColumn("cluster_id", F.concat_ws("-", "label", F.col("number").cast("string")))
    # Samples are the first few rows of each cluster by rank, so lists stay short.
    ranked = rows.join(groups.select(*key, "cluster_id"), key).withColumn("r", F.row_number().over(Window.partitionBy("job_id", "cluster_id").orderBy("ord")))
    samples = ranked.filter("r <= 5").groupBy("job_id", "cluster_id").agg(F.array_sort(F.collect_list(F.struct("r", "url"))).alias("s")).select("job_id", "cluster_id", F.transform("s", lambda x: x["url"]).alias("sampleUrls"))
    seen = ranked.select("job_id", "cluster_id", "r", F.posexplode("artifacts").alias("i", "artifact")).groupBy("job_id", "cluster_id", "artifact").agg(F.min(F.struct("r", "i")).alias("at"))
    seen = seen.withColumn("k", F.row_number().over(Window.partitionBy("job_id", "cluster_id").orderBy("at"))).filter("k <= 16").groupBy("job_id", "cluster_id").agg(F.array_sort(F.collect_list(F.struct("k", "artifact"))).alias("a")).select("job_id", "cluster_id", F.transform("a", lambda x: x["artifact"]).alias("ignoredLayoutArtifacts"))
    missing = F.array_compact(F.array(*[F.when(c, n) for c, n in (
        ((F.col("label") == "product") & F.col("no_sku"), "sku"), ((F.col("label") == "product") & F.col("no_images"), "images"), ((F.col("label") == "product") & F.col("no_category"), "categoryPath"),
        (F.col("label").isin("article", "case_study"), "date"), (F.col("label").isin("article", "case_study"), "author"), (F.col("mostly_nav"), "bodyContent"),
    )]))
    expected = F.array(*[F.lit(f) for f in FIELDS[""]])
    for name in [n for n in FIELDS if n]:
        expected = F.when(F.col("label") == name, F.array(*[F.lit(f) for f in FIELDS[name]])).otherwise(expected)
    clusters = groups.join(samples, ["job_id", "cluster_id"]).join(seen, ["job_id", "cluster_id"], "left").select(
        "job_id", "cluster_id", "number", "label", F.replace(F.col("label"), F.lit("_"), F.lit(" ")).alias("pageType"), "confidence", "fingerprint", "n", "sampleUrls",
        F.concat(F.lit("knowledge/data/"), F.col("cluster_id"), F.lit(".jsonl")).alias("dataSourcePath"), expected.alias("expectedCmsFields"), missing.alias("missingWeakFields"),
        F.coalesce("ignoredLayoutArtifacts", F.expr("cast(array() as array<string>)")).alias("ignoredLayoutArtifacts"),
    )
    members = pages.select("job_id", "ord", "slug", "fingerprint").join(clusters.select("job_id", "fingerprint", "cluster_id"), key, "left").select("job_id", "ord", "slug", "cluster_id")
    return clusters, members
