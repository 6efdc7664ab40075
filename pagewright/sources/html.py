"""HTML pages to Markdown, structure and signals: one parser pass per page, as an Arrow function.

The parser keeps a stack of open elements and tolerates unclosed ones. Markdown is taken from the page's article, if it has
one (see `article`), else from `main`, `article` or the body, in that order, without navigation, footers, forms, scripts,
hidden parts and dialogs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagewright.functions.urls import TRACKING_PARAMS
from pagewright.schemas import STRUCTURE
from pagewright.sources.article import main_content

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "div", "section", "article", "main", "header", "ul", "ol", "table", "tr", "blockquote", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "li", "dl", "dt", "dd"}
SKIPPED = {"script", "style", "noscript", "iframe", "svg", "form", "nav", "footer", "template"}
SKIPPED_CLASSES, SKIPPED_IDS, SKIPPED_ROLES = {"cookie-banner", "cookie-consent"}, {"cookie-banner"}, {"dialog", "alertdialog"}
HEADINGS, NAV_LINKS, FORMS, FORM_FIELDS, FOOTER_CHARS, PRICE_CHARS = 60, 40, 10, 25, 600, 50_000
#: Pages whose results a task holds at a time.
AT_ONCE = 64
PRICE = re.compile(r"(?:[€$£]\s?\d|\d[\d\s.,]*\s?(?:zł|pln|eur|usd|gbp|€|\$|£))", re.I)
CART = re.compile(r"add to cart|add to basket|do koszyka|in den warenkorb|kup teraz|buy now", re.I)


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag: str, attrs: dict | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.kids, self.parent = tag, attrs or {}, [], parent

    def all(self, *tags: str) -> Iterator[Node]:
        """Descendants in document order, without recursion."""
        todo = list(reversed(self.kids))
        while todo:
            x = todo.pop()
            if isinstance(x, Node):
                if not tags or x.tag in tags:
                    yield x
                todo.extend(reversed(x.kids))

    def text(self) -> str:
        out, todo = [], list(reversed(self.kids))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in ("script", "style", "template"):
                todo.extend(reversed(x.kids))
        return " ".join("".join(out).split())

    def within(self, *tags: str) -> Node | None:
        x = self.parent
        while x is not None and x.tag not in tags:
            x = x.parent
        return x


class Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document")

    def handle_starttag(self, tag, attrs):
        while (tag in BLOCKS and self.at.tag == "p") or (tag == "li" and self.at.tag == "li"):
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.kids.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        x = self.at
        while x is not None and x.tag != tag:
            x = x.parent
        if x is not None and x.parent is not None:
            self.at = x.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def clean_link(href: str, base: str) -> str:
    """Absolute and without tracking parameters."""
    try:
        parts = urlsplit(urljoin(base, href.strip()))
        pairs = parse_qsl(parts.query, keep_blank_values=True)
        kept = [(k, v) for k, v in pairs if k.lower() not in TRACKING_PARAMS]
        return urlunsplit(parts if len(kept) == len(pairs) else parts._replace(query=urlencode(kept)))
    except ValueError:
        return href


def is_noise(n: Node) -> bool:
    a = n.attrs
    return n.tag in SKIPPED or a.get("aria-hidden") == "true" or "hidden" in a or a.get("role") in SKIPPED_ROLES or (n.tag == "header" and a.get("role") == "banner") or a.get("id") in SKIPPED_IDS or bool(SKIPPED_CLASSES & set(a.get("class", "").split()))


def inline(n: Node, base: str) -> str:
    out = []
    for x in n.kids:
        if isinstance(x, str):
            out.append(re.sub(r"\s+", " ", x))
        elif not is_noise(x):
            body = inline(x, base)
            if x.tag == "br":
                out.append("\n")
            elif x.tag == "img":
                src = x.attrs.get("src") or x.attrs.get("data-src")
                out.append(f"![{re.sub(r'[\[\]]', '', x.attrs.get('alt', ''))}]({clean_link(src, base)})" if src else "")
            elif x.tag == "a" and x.attrs.get("href") and body.strip():
                out.append(f"[{body.strip()}]({clean_link(x.attrs['href'], base)})")
            elif x.tag in ("b", "strong", "em", "i", "del", "s", "strike", "code") and body.strip():
                mark = {"b": "**", "strong": "**", "em": "_", "i": "_", "code": "`"}.get(x.tag, "~~")
                out.append(f"{mark}{body.strip()}{mark}")
            else:
                out.append(body)
    return "".join(out)


def markdown(n: Node, base: str) -> list[str]:
    """Blocks of an element."""
    out, run = [], Node(n.tag)

    def flush():
        text = "\n".join(t.strip() for t in inline(run, base).split("\n")).strip()
        if text:
            out.append(text)
        run.kids = []

    for x in n.kids:
        if isinstance(x, str) or (x.tag not in BLOCKS and not any(k.tag in BLOCKS for k in x.all())):
            run.kids.append(x)
            continue
        flush()
        if is_noise(x):
            continue
        if re.fullmatch("h[1-6]", x.tag):
            text = " ".join(inline(x, base).split())
            out += [f"{'#' * int(x.tag[1])} {text}"] if text else []
        elif x.tag in ("ul", "ol"):
            items = [body for k in x.kids if isinstance(k, Node) and k.tag == "li" and (body := "\n".join(markdown(k, base)))]
            if items:
                out.append("\n".join(f"{'-' if x.tag == 'ul' else f'{i}.'} " + body.replace("\n", "\n  ") for i, body in enumerate(items, 1)))
        elif x.tag == "pre":
            code = next(x.all("code"), x)
            language = re.search(r"lang(?:uage)?-(\S+)", code.attrs.get("class", ""))
            out.append(f"```{language[1] if language else ''}\n" + "".join(t for t in _strings(code)).strip("\n") + "\n```")
        elif x.tag == "table":
            rows = [[" ".join(inline(c, base).split()).replace("|", "\\|") for c in r.kids if isinstance(c, Node) and c.tag in ("td", "th")] for r in x.all("tr")]
            rows = [r for r in rows if r]
            if rows:
                wide = max(map(len, rows))
                rows = [r + [""] * (wide - len(r)) for r in rows]
                out.append("\n".join(f"| {' | '.join(r)} |" for r in [rows[0], ["---"] * wide, *rows[1:]]))
        elif x.tag == "blockquote":
            out.append("\n".join(f"> {line}" for line in "\n\n".join(markdown(x, base)).split("\n")))
        else:
            out += markdown(x, base)
    flush()
    return out


def _strings(n: Node) -> Iterator[str]:
    for x in n.kids:
        yield from [x] if isinstance(x, str) else _strings(x)


def json_ld(root: Node) -> list[dict]:
    """JSON-LD objects, lists and @graph members followed four levels deep."""
    out: list[dict] = []

    def walk(x, depth):
        if depth > 4:
            return
        if isinstance(x, list):
            for y in x:
                walk(y, depth + 1)
        elif isinstance(x, dict):
            out.append(x)
            walk(x.get("@graph"), depth + 1)

    for s in root.all("script"):
        if s.attrs.get("type", "").lower() == "application/ld+json":
            try:
                walk(json.loads("".join(_strings(s))), 0)
            except ValueError:
                continue
    return out


def types_of(node: dict) -> list[str]:
    t = node.get("@type")
    return [x for x in (t if isinstance(t, list) else [t]) if isinstance(x, str)]


def product_of(node: dict) -> dict:
    text = lambda v: v if isinstance(v, str) and v else None
    brand, image = node.get("brand"), node.get("image")
    offers = node.get("offers")
    offers = [o for o in (offers if isinstance(offers, list) else [offers]) if isinstance(o, dict)]
    offer = next((o for o in offers if o.get("price", o.get("lowPrice")) is not None), {})
    price = offer.get("price", offer.get("lowPrice"))
    images = [i if isinstance(i, str) else i.get("url") for i in (image if isinstance(image, list) else [image]) if isinstance(i, (str, dict))]
    images = [i for i in images if isinstance(i, str)][:10]
    return {"name": text(node.get("name")), "description": (text(node.get("description")) or "")[:2000] or None, "price": None if price is None else str(price), "currency": text(offer.get("priceCurrency")), "sku": None if node.get("sku") is None else str(node["sku"]), "brand": text(brand) or (text(brand.get("name")) if isinstance(brand, dict) else None), "category": text(node.get("category")), "images": images or None}


def structure_of(root: Node) -> dict:
    """Headings, forms, navigation, footer and signals of a whole document."""
    heads = [{"level": int(h.tag[1]), "text": h.text()} for h in root.all("h1", "h2", "h3") if h.text()][:HEADINGS]
    labels = {x.attrs["for"]: x.text() for x in root.all("label") if x.attrs.get("for")}
    forms = []
    for form in list(root.all("form"))[:FORMS]:
        fields = []
        for x in form.all("input", "select", "textarea"):
            if x.attrs.get("type", "").lower() in ("hidden", "submit", "button", "image", "reset"):
                continue
            wrapped = x.within("label")
            label = labels.get(x.attrs.get("id", "")) or (wrapped.text() if wrapped is not None else None) or x.attrs.get("aria-label")
            fields.append({"tag": x.tag, "type": x.attrs.get("type") or None, "name": x.attrs.get("name") or None, "label": label or None, "placeholder": x.attrs.get("placeholder") or None, "required": True if "required" in x.attrs else None})
        submit = next((x.text() or x.attrs.get("value") for x in form.all("button", "input") if (x.tag == "button" and x.attrs.get("type", "submit") == "submit") or x.attrs.get("type") == "submit"), None)
        if fields or submit:
            forms.append({"action": form.attrs.get("action") or None, "method": form.attrs.get("method") or None, "fields": fields[:FORM_FIELDS], "submitLabel": submit or None})
    nav, seen = [], set()
    for bar in root.all("nav", "header"):
        for a in bar.all("a"):
            pair = (a.text(), a.attrs.get("href", ""))
            if pair[0] and pair[1] and not pair[1].startswith("#") and pair not in seen:
                seen.add(pair)
                nav.append({"text": pair[0], "href": pair[1]})
    footer = next((f.text()[:FOOTER_CHARS] for f in root.all("footer") if f.text()), None)
    nodes = json_ld(root)
    product = next((product_of(n) for n in nodes if "Product" in types_of(n)), None)
    body = next(root.all("body"), root)
    og = next((m.attrs.get("content") for m in root.all("meta") if m.attrs.get("property") == "og:type"), None)
    cart = any(CART.search(f"{x.text()} {x.attrs.get('value', '')} {x.attrs.get('class', '')}") for x in body.all("button", "input", "a"))
    signals = {"ogType": og, "jsonLdTypes": list(dict.fromkeys(t for n in nodes for t in types_of(n))), "product": product, "hasPrice": bool(PRICE.search(body.text()[:PRICE_CHARS])), "hasCartButton": cart}
    return {"headings": heads, "forms": forms, "nav": nav[:NAV_LINKS], "footerText": footer, "signals": signals}


def byline(root: Node) -> str | None:
    """Who wrote the page, if an element is marked so."""
    marked = (x.text() for x in root.all() if x.attrs.get("rel") == "author" or "author" in x.attrs.get("itemprop", "").split() or {"byline", "author"} & set(x.attrs.get("class", "").lower().split()))
    return next((t for t in marked if 0 < len(t) < 100), None)


def parse_page(html: str, url: str) -> dict:
    builder = Builder()
    builder.feed(html)
    builder.close()
    root = builder.root
    base = next((urljoin(url, b.attrs["href"]) for b in root.all("base") if b.attrs.get("href")), url)
    found = main_content(next(root.all("body"), root), is_noise, Node)
    main, excerpt = found or (None, None)
    main = main or next(root.all("main"), None) or next(root.all("article"), None) or next((x for x in root.all() if x.attrs.get("role") == "main"), None) or next(root.all("body"), None) or root
    meta = {m.attrs.get("name", m.attrs.get("property", "")).lower(): m.attrs.get("content") for m in root.all("meta")}
    text = re.sub(r"\n{3,}", "\n\n", "\n\n".join(markdown(main, base))).strip()
    title = next((t.text() for t in root.all("title")), None)
    out = {"markdown": f"{text}\n" if text else None, "title": title or None, "description": meta.get("description") or meta.get("og:description") or excerpt or None, "author": meta.get("author") or byline(root), "article": found is not None, "structure": structure_of(root), "error": None if text else "no content"}
    for node in list(root.all()):
        node.parent = None  # no cycles: the tree is freed at once, not when the collector runs
    return out


SCHEMA = f"url string, markdown string, title string, description string, author string, article boolean, structure {STRUCTURE}, error string"


def _parse(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(i, AT_ONCE) for batch in batches for i in range(0, batch.num_rows, AT_ONCE)):
            rows = []
            for url, html in zip(part.column(0), part.column(1)):
                url = url.as_py()
                try:
                    rows.append({"url": url, **parse_page(html.as_py() or "", url or "")})
                except (ValueError, RecursionError) as error:
                    rows.append({"url": url, "error": f"unreadable: {error}"[:200]})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def scrape_pages(pages: DataFrame, max_bytes: int | None = 10_000_000, html_col: str = "html") -> DataFrame:
    """One row per page (url, html): markdown, title, description, author, structure, or an error. Larger pages give an error."""
    html = F.col(html_col)
    fits = html if max_bytes is None else F.when(F.octet_length(html) <= max_bytes, html)
    return pages.select("url", fits.alias("html")).mapInArrow(_parse(to_arrow_schema(StructType.fromDDL(SCHEMA))), SCHEMA)
