"""Brand marks of HTML pages: icon, logo with its evidence, theme colour and preview image, as an Arrow function.

Defined cases: a null or empty page, or one without marks, gives nulls and confidence 0; of equally likely images the
first one counts; addresses that can't be joined to the page's are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

from pagewright.sources.html import Builder, Node

# Relations of icons by rank, words and places that speak for or against a logo, and what they weigh.
ICON_RELATIONS = ["apple-touch-icon", "icon", "shortcut icon"]
LOGO_WORDS = re.compile(r"\blogo\b|logotyp|brand|site-logo", re.I)
OTHER_WORDS = re.compile(r"client|partner|reference|realizac|portfolio|case|product|produkt|certificate|certyfikat|ads?|reklam", re.I)
OTHER_CLASSES = {"clients", "client", "references", "reference", "partners", "partner", "portfolio", "realizations", "realizacje", "case-study", "product", "products", "certificate", "certificates", "ads", "advert"}
OTHER_TAGS = {"article", "main"}
HEADER_CLASSES, HEADER_ID, HEADER_ROLE = {"header", "site-header"}, "header", "banner"
IN_HEADER, TO_HOME, NAMED, OTHER = Decimal("0.38"), Decimal("0.34"), Decimal("0.24"), Decimal("-0.35")
# Warnings of a page whose icon stands in for its logo, and of one with neither.
UNCERTAIN, MISSING = "logo_candidate_uncertain", "logo_missing"
LEAST, MOST, META, ICON_ONLY = Decimal("0.2"), Decimal("0.96"), 0.82, 0.35

SCHEMA = "url string, faviconUrl string, logoUrl string, logoConfidence double, logoEvidence string, themeColor string, ogImageUrl string, warnings array<string>"
ARROW = pa.schema([(c.split()[0], {"double": pa.float64(), "array<string>": pa.list_(pa.string())}.get(c.split()[1], pa.string())) for c in SCHEMA.split(", ")])


def absolute(href: str | None, base: str) -> str | None:
    if not href:
        return None
    try:
        joined = urljoin(base, href.strip())
        return joined if urlsplit(joined).scheme else None
    except ValueError:
        return None


def around(node: Node) -> Iterator[Node]:
    """The node and what encloses it, from the inside out."""
    while node is not None:
        yield node
        node = node.parent


def classes(node: Node) -> set[str]:
    return set(node.attrs.get("class", "").split())


def icon(root: Node, base: str) -> str | None:
    links = list(root.all("link"))
    first = (next((x for x in links if x.attrs.get("rel") == relation), None) for relation in ICON_RELATIONS)
    return next((url for x in first if x is not None and (url := absolute(x.attrs.get("href"), base))), None)


def is_home(href: str, base: str) -> bool:
    home = "{0.scheme}://{0.netloc}".format(urlsplit(base))
    return absolute(href, base) in (home, f"{home}/")


def image_logo(image: Node, base: str) -> tuple[str, Decimal, str] | None:
    """Address, score and evidence of an image that may be the logo."""
    outer = list(around(image))
    src = image.attrs.get("src") or image.attrs.get("data-src")
    url = absolute(src, base)
    if url is None or any(x.tag in OTHER_TAGS or classes(x) & OTHER_CLASSES for x in outer):
        return None
    said = " ".join(image.attrs.get(a, "") for a in ("alt", "title", "class", "id")) + f" {src}"
    link = next((x for x in outer if x.tag == "a" and "href" in x.attrs), None)
    signs = [
        (IN_HEADER, "header image", any(x.tag == "header" or x.attrs.get("role") == HEADER_ROLE or x.attrs.get("id") == HEADER_ID or classes(x) & HEADER_CLASSES for x in outer)),
        (TO_HOME, "linking to homepage", link is not None and bool(link.attrs["href"]) and is_home(link.attrs["href"], base)),
        (NAMED, "logo/brand attribute", bool(LOGO_WORDS.search(said))),
    ]
    score = sum((w for w, _, holds in signs if holds), Decimal(0)) + (OTHER if OTHER_WORDS.search(said) else 0)
    if score <= 0:
        return None
    return url, max(LEAST, min(MOST, score)).quantize(Decimal("0.01"), ROUND_HALF_UP), " + ".join(name for _, name, holds in signs if holds)


def brand_marks(html: str, url: str) -> dict:
    builder = Builder()
    builder.feed(html)
    builder.close()
    root = builder.root
    base = next((urljoin(url, b.attrs["href"]) for b in root.all("base") if b.attrs.get("href")), url)
    metas = list(root.all("meta"))
    content = lambda key, *names: next((m.attrs.get("content") for m in metas if m.attrs.get(key) in names), None)
    favicon = icon(root, base)
    named = next((m.attrs.get("content") for m in metas if m.attrs.get("property") == "og:logo" or m.attrs.get("name") == "logo"), None)
    out = {"url": url, "faviconUrl": favicon, "logoConfidence": ICON_ONLY if favicon else 0.0, "themeColor": content("name", "theme-color"), "ogImageUrl": absolute(content("property", "og:image"), base), "warnings": []}
    if logo := absolute(named, base):
        return out | {"logoUrl": logo, "logoConfidence": META, "logoEvidence": "logo meta tag"}
    found = [x for image in root.all("img") if (x := image_logo(image, base))]
    if found:
        logo, confidence, evidence = max(found, key=lambda x: x[1])  # the first of equal ones
        return out | {"logoUrl": logo, "logoConfidence": float(confidence), "logoEvidence": evidence}
    return out | {"logoUrl": favicon, "warnings": [UNCERTAIN] if favicon else [MISSING]}  # the icon stands in for a logo


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [brand_marks(html.as_py() or "", url.as_py() or "") for url, html in zip(batch.column(0), batch.column(1))]
        yield pa.RecordBatch.from_pylist(rows, ARROW)


def brand_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """One row per page (url, html) with its icon, logo (or the icon in its place), confidence and evidence, theme colour, preview image and warnings."""
    return pages.select("url", html_col).mapInArrow(_marks, SCHEMA)
