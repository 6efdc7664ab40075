"""URL columns: parts, canonical form, kind, slug, links and origin tests, as built-in expressions.

URLs are taken apart by pattern rather than `parse_url`, which rejects characters that browsers accept. Percent-escaping
is left as written.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track visitors.
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "gclsrc", "dclid", "msclkid", "mc_cid", "mc_eid", "yclid", "_ga", "ref", "ref_src"]
# File extensions by kind, and path segments of listing pages.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "webp", "svg", "avif", "ico", "bmp", "tif", "tiff"]
DOCUMENT_EXTENSIONS = ["pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "csv", "txt", "rtf", "epub"]
ASSET_EXTENSIONS = ["css", "js", "mjs", "json", "xml", "zip", "tar", "gz", "rar", "7z", "mp3", "mp4", "webm", "avi", "mov", "woff", "woff2", "ttf", "eot", "wasm"]
LISTING_SEGMENTS = ["tag", "tags", "category", "categories", "author", "archive", "archives", "feed", "rss", "wp-json"]
KINDS = ["content", "listing", "image", "document", "asset"]

URL_PATTERN = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$"
#: Letters with a mark whose decomposition is one plain letter and marks, by rule from the Unicode tables.
MARKED = {chr(c): unicodedata.normalize("NFKD", chr(c)) for c in range(0xC0, 0x250)}
MARKED = {a: b[0] for a, b in MARKED.items() if len(b) > 1 and all(unicodedata.combining(x) for x in b[1:])}


def is_url(url: Column) -> Column:
    return url.rlike(URL_PATTERN)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL_PATTERN, 1))


def host(url: Column) -> Column:
    """Host in lower case without user and port; empty for what is no URL."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, URL_PATTERN, 2)), "^.*@", ""), ":[0-9]*$", "")


def path(url: Column) -> Column:
    found = F.regexp_extract(url, URL_PATTERN, 3)
    return F.when(found == "", F.lit("/")).otherwise(found)


def query(url: Column) -> Column:
    """Query without its question mark."""
    return F.substr(F.regexp_extract(url, URL_PATTERN, 4), F.lit(2))


def origin(url: Column) -> Column:
    """Scheme, host and port, default ports left out."""
    authority = F.regexp_replace(F.lower(F.regexp_extract(url, URL_PATTERN, 2)), "^.*@", "")
    return F.concat(scheme(url), F.lit("://"), F.when(scheme(url) == "https", F.regexp_replace(authority, ":443$", "")).when(scheme(url) == "http", F.regexp_replace(authority, ":80$", "")).otherwise(authority))


def canonicalize(url: Column, drop_params: list[str] = TRACKING_PARAMS) -> Column:
    """No fragment, host in lower case, no trailing slash, no tracking parameters; null for what is no URL."""
    authority = F.regexp_extract(url, URL_PATTERN, 2)
    user = F.regexp_extract(authority, "^(.*@)?", 1)
    cut = F.regexp_replace(path(url), "/+$", "")
    kept = F.array_join(F.filter(F.split(query(url), "&"), lambda p: ~F.lower(F.regexp_extract(p, "^[^=]*", 0)).isin(drop_params)), "&")
    whole = F.concat(scheme(url), F.lit("://"), user, F.lower(F.substr(authority, F.length(user) + 1)), F.when(cut == "", F.lit("/")).otherwise(cut), F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept)))
    return F.when(is_url(url), whole)


def source_key(url: Column) -> Column:
    """Key of a job's source: as canonical, but with all parameters."""
    return F.coalesce(canonicalize(url, []), url)


def segments(url: Column) -> Column:
    return F.filter(F.split(F.lower(path(url)), "/"), lambda s: s != "")


def kind(url: Column) -> Column:
    """content, listing, image, document or asset, by the shape of a canonical URL; content for what is no URL."""
    parts = segments(url)
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    extension = F.regexp_extract(last, r"^.+\.([^.]*)$", 1)
    paged = F.exists(F.transform(parts, lambda s, i: (s == "page") & F.coalesce(F.try_element_at(parts, (i + 2).cast("int")), F.lit("")).rlike(r"^\d+\z")), lambda b: b)
    listed = F.arrays_overlap(parts, F.array(*[F.lit(s) for s in LISTING_SEGMENTS])) | paged | F.lower(path(url)).rlike(r"^/\d{4}(/\d{1,2})?\z") | (query(url) != "")
    by_extension = F.when(extension.isin(IMAGE_EXTENSIONS), "image").when(extension.isin(DOCUMENT_EXTENSIONS), "document").when(extension.isin(ASSET_EXTENSIONS), "asset")
    return F.when(is_url(url), F.coalesce(by_extension, F.when(listed, "listing"), F.lit("content"))).otherwise("content")


def is_crawlable(url: Column) -> Column:
    return kind(url).isin("content", "listing")


def slug_part(value: Column) -> Column:
    """Lower case, marks dropped, other characters than a-z and 0-9 as hyphens."""
    plain = F.translate(value, "".join(MARKED), "".join(MARKED.values()))
    plain = F.regexp_replace(plain, r"[̀-ͯ]", "")
    return F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def base_slug(url: Column) -> Column:
    """Slug of a page before it is made unique: path parts joined by hyphens, `root` for none, `page` for no URL."""
    joined = F.array_join(F.filter(F.transform(F.filter(F.split(path(url), "/"), lambda s: s != ""), slug_part), lambda s: s != ""), "-")
    return F.when(is_url(url), F.coalesce(F.nullif(joined, F.lit("")), F.lit("root"))).otherwise("page")


def absolutize(href: Column, base: Column) -> Column:
    """An href against its page: absolute, scheme-relative, root-relative, query, fragment or relative; dot segments resolved one level each."""
    root = F.concat(F.regexp_extract(base, URL_PATTERN, 1), F.lit("://"), F.regexp_extract(base, URL_PATTERN, 2))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    relative = F.concat(folder, F.regexp_replace(href, r"^(\./)+", ""))
    up = relative
    for _ in range(4):
        up = F.regexp_replace(up, r"/[^/]+/\.\./", "/")
    out = (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, URL_PATTERN, 1), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(root, path(base), href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(F.concat(root, up))
    )
    return F.when(is_url(base) | href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), out)


def same_origin(href: Column, base: Column) -> Column:
    return F.coalesce(origin(absolutize(href, base)) == origin(base), F.lit(False))


def raw_hrefs(html: Column) -> Column:
    """href values of a page's anchors that lead to a document."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), 1)
    return F.filter(found, lambda h: (h != "") & ~h.rlike("^(#|javascript:|mailto:|tel:)"))


def links(html: Column, base: Column) -> Column:
    """Absolute targets of a page's links."""
    return F.transform(raw_hrefs(html), lambda h: absolutize(h, base))


def in_scope(url: Column, root: Column, include_subdomains: bool = False) -> Column:
    """On the root's host, or with subdomains below it."""
    exact = host(url) == host(root)
    return exact | F.endswith(host(url), F.concat(F.lit("."), host(root))) if include_subdomains else exact


def upgrade_scheme(url: Column, root: Column) -> Column:
    """http becomes https on sites whose root is https."""
    return F.when((scheme(root) == "https") & (scheme(url) == "http"), F.regexp_replace(url, "^[hH][tT][tT][pP]:", "https:")).otherwise(url)
