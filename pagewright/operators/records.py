"""One typed record per page of a template cluster, as built-in expressions over its cleaned Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import LEFT, RIGHT, let, lines, markdown_images, markdown_links, squeeze
from pagewright.functions.urls import same_origin
from pagewright.operators.clusters import TECHNICAL

# Words that open technical and related sections, attribute labels, and words of calls to action.
TECHNICAL_HEADINGS = [*TECHNICAL, "technical"]
RELATED_HEADINGS = ["polecane produkty", "related products", "zobacz również", "podobne produkty", "similar products", "you may also like", "ähnliche produkte", "zubehör"]
CALLS = ["kup", "sklep", "zamów", "zapytaj", "kontakt", "ask", "buy", "shop", "order", "enquire", "contact", "kaufen", "bestellen", "anfrage"]
ATTRIBUTES = {
    "dimensions": (["wymiary", "rozmiar", "średnica", "wysokość", "szerokość", "długość", "dimensions?", "size", "diameter", "height", "width", "length", "abmessungen", "größe", "durchmesser", "höhe", "breite", "länge"], 80),
    "material": (["materiał", "material", "werkstoff"], 80),
    "color": (["kolor", "barwa", "palette", "paleta", "colou?r", "farbe"], 80),
    "species": (["dla", "gatunek", "zwierzęta", "animals?", "tierart(?:en)?"], 100),
}
CERTIFICATES = ["certyfikat", "certyfikaty", "rekomendacja", "polecane przez", "certificates?", "certified", "recommended by", "zertifikat(?:e)?", "zertifiziert", "empfohlen von"]
HOURS = ["godziny otwarcia", "czynne", "otwarte", "opening hours", "öffnungszeiten", "geöffnet"]
LONE_LINK = r"^\[[^\]]+\]\([^)]+\)\z"


def _some(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, group)), F.lit(""))


def feature_bullets(markdown: Column) -> Column:
    items = F.filter(F.transform(F.filter(lines(markdown), lambda x: x.rlike(r"^\s*[-*]\s+(.+)\z")), lambda x: F.trim(F.regexp_extract(x, r"^\s*[-*]\s+(.+)\z", 1))), lambda x: (F.length(x) > 12) & ~x.rlike(LONE_LINK))
    return F.slice(items, 1, 20)


def _in_section(markdown: Column, deepest: int, terms: list[str]) -> Column:
    """Lines (no headings) whose last heading above names one of the terms: array of (line)."""
    head = rf"^#{{1,{deepest}}}\s+(.+)\z"
    all_lines = F.transform(lines(markdown), lambda x, i: F.struct(i.alias("no"), x.alias("line"), x.rlike(head).alias("head")))
    opened = lambda x: F.struct(x["no"].alias("no"), x["line"].rlike(f"(?iu){'|'.join(terms)}").alias("open"))

    def inside(rows: Column) -> Column:
        return let(F.transform(F.filter(rows, lambda x: x["head"]), opened), lambda heads: F.filter(rows, lambda x: F.coalesce(F.try_element_at(F.filter(heads, lambda h: h["no"] <= x["no"]), F.lit(-1))["open"], F.lit(False))))

    return F.transform(let(all_lines, inside), lambda x: F.struct(x["line"].alias("line"), x["head"].alias("head")))


def technical_data(markdown: Column) -> Column:
    """Key and value rows (tables or `key: value`) of technical sections; of equal keys the last value counts."""
    table, pair = r"^\|\s*([^|]{2,40})\s*\|\s*([^|]{1,120})\s*\|\z", r"^(?:[-*]\s*)?([^:：|]{2,40})[:：]\s*(.{1,160})\z"
    rows = F.transform(F.filter(_in_section(markdown, 3, TECHNICAL_HEADINGS), lambda x: ~x["head"]), lambda x: x["line"])
    part = lambda x, i: squeeze(F.when(x.rlike(table), F.regexp_extract(x, table, i)).otherwise(F.regexp_extract(x, pair, i)))
    found = F.transform(F.filter(rows, lambda x: x.rlike(table) | x.rlike(pair)), lambda x: F.struct(part(x, 1).alias("key"), part(x, 2).alias("value")))
    found = F.filter(found, lambda x: ~x["key"].rlike(r"^-+\z") & ~x["value"].rlike(r"^-+\z"))

    def table_of(rows: Column) -> Column:
        keys = F.array_distinct(F.transform(rows, lambda x: x["key"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.transform(F.filter(rows, lambda x: x["key"] == k), lambda x: x["value"]), -1)))

    return let(found, table_of)


def related_products(raw: Column) -> Column:
    link = r"\[([^\]]{2,80})\]\([^)]+\)"
    found = F.transform(_in_section(raw, 4, RELATED_HEADINGS), lambda x: F.regexp_extract(x["line"], link, 1))
    return F.slice(F.array_distinct(F.filter(found, lambda x: x != "")), 1, 20)


# What dates and contact fields look like.
DATE = rf"{LEFT}\d{{1,2}}[./-]\d{{1,2}}[./-](?:19|20)?\d{{2}}{RIGHT}"
YEAR = rf"{LEFT}(?:19|20)\d{{2}}{RIGHT}"
EMAIL = rf"(?i){LEFT}[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}{RIGHT}"
PHONE = r"(?i)(?:tel\.?|telefon|phone|mobile|handy)[:\s-]*(\+?\d[\d\s().-]{6,}\d)"
NIP = rf"(?i){LEFT}NIP[:\s-]*([A-Z]{{0,3}}\s?\d[\d\s-]{{6,}}\d){RIGHT}"
REGON = rf"(?i){LEFT}REGON[:\s-]*(\d[\d\s-]{{6,}}\d){RIGHT}"
BANK_ACCOUNT = rf"(?i){LEFT}(?:IBAN|konto|rachunek|nr rachunku|bank)[:\s-]*((?:[A-Z]{{2}}\d{{2}}\s*)?\d{{2}}(?:\s?\d{{4}}){{5,7}}){RIGHT}"
OPENING_HOURS = rf"(?iu){LEFT}(?:{'|'.join(HOURS)})[:\s-]+([^.\n]{{5,120}})"


def first_date(markdown: Column) -> Column:
    return F.coalesce(_found(markdown, DATE, 0), _found(markdown, YEAR, 0))


def contact_fields(markdown: Column) -> dict[str, Column]:
    text = F.regexp_replace(markdown, r"\s+", " ")
    company = _found(markdown, r"(?m)^#\s+(.+)$")
    return {
        "email": _found(text, EMAIL, 0),
        "phone": _found(text, PHONE),
        "nip": _found(text, NIP),
        "regon": _found(text, REGON),
        "bankAccount": _found(text, BANK_ACCOUNT),
        "openingHours": _found(text, OPENING_HOURS),
        "companyName": F.when(~company.rlike("(?i)kontakt|contact"), company),
    }


def records(pages: DataFrame, clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Records of cluster members and of their duplicates, absent values null. Pages come cleaned and marked for duplicates."""
    own = members.filter("cluster_id is not null").select("job_id", F.col("ord").alias("canonical_ord"), F.col("slug").alias("canonicalSlug"), "cluster_id")
    rows = pages.join(own, ["job_id", "canonical_ord"]).join(clusters.select("job_id", "cluster_id", "label", F.col("confidence").alias("templateConfidence")), ["job_id", "cluster_id"])
    md, product = F.col("cleanedMarkdown"), F.col("structure.signals.product")
    text = F.regexp_replace(md, r"\s+", " ")
    links = markdown_links(md)
    article, contact = F.col("label").isin("article", "case_study"), F.col("label") == "contact"
    heads = F.coalesce("structure.headings", F.expr("cast(array() as array<struct<level:int,text:string>>)"))
    images = F.coalesce(_some(F.transform(product["images"], lambda u: F.struct(u.alias("url"), F.lit(None).cast("string").alias("alt")))), _some(markdown_images(md)))
    described = F.coalesce(F.col("description"), product["description"])
    attributes = {k: _found(text, rf"(?iu){LEFT}(?:{'|'.join(terms)})[:\s-]+([^.;\n]{{2,{n}}})") for k, (terms, n) in ATTRIBUTES.items()}
    fields = {
        "slug": F.col("slug"), "sourceUrl": F.col("url"), "url": F.col("url"), "title": F.coalesce(F.col("title"), product["name"]), "fullTitle": F.col("fullTitle"), "contentConfidence": F.col("diagnostics.contentConfidence"),
        "templateConfidence": F.col("templateConfidence"), "isDuplicate": F.col("isDuplicate"), "canonicalSlug": F.when(F.col("isDuplicate"), F.col("canonicalSlug")), "duplicateOf": F.when(F.col("isDuplicate"), F.col("canonicalSlug")),
        "duplicateConfidence": F.when(F.col("isDuplicate"), F.col("duplicateConfidence")), "warnings": F.col("diagnostics.warnings"), "description": described, "metaDescription": F.col("description"),
        "productName": product["name"], "shortDescription": F.when(F.col("description").isNull(), product["description"]), "price": product["price"], "currency": product["currency"], "sku": product["sku"], "brand": product["brand"], "category": product["category"],
        "categoryPath": F.when(product["category"].isNotNull(), F.array(product["category"])), "sections": _some(F.slice(F.transform(F.filter(heads, lambda h: h["level"] == 2), lambda h: h["text"]), 1, 12)), "images": images,
        "featureBullets": _some(feature_bullets(md)), "technicalData": F.when(F.size(technical_data(md)) > 0, technical_data(md)), **attributes,
        "certificates": _some(F.slice(F.regexp_extract_all(text, F.lit(rf"(?iu){LEFT}(?:{'|'.join(CERTIFICATES)})[^.;\n]{{0,120}}"), 0), 1, 10)), "pdfLinks": _some(F.filter(links, lambda x: x["href"].rlike(r"(?i)\.pdf(?:\z|[?#])"))),
        "ctaLinks": _some(F.slice(F.filter(links, lambda x: x["text"].rlike(f"(?iu){'|'.join(CALLS)}")), 1, 10)), "internalLinks": _some(F.slice(F.filter(links, lambda x: same_origin(x["href"], F.col("url"))), 1, 25)), "relatedProducts": _some(related_products(F.col("raw"))),
        "leadImage": F.when(article, F.try_element_at(markdown_images(md), F.lit(1))), "headings": F.when(article, F.slice(F.transform(heads, lambda h: h["text"]), 1, 20)), "bodyContent": F.when(article, F.substring(md, 1, 12_000)), "date": F.when(article, first_date(md)),
        **{k: F.when(contact, v) for k, v in contact_fields(md).items()},
    }
    return rows.select("job_id", "cluster_id", "ord", *[v.alias(k) for k, v in fields.items()])
