"""Registered queries, each over whole tables, and the SQL that states the same result where SQL can.

Pages are grouped by host, so a host plays the part of a job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import net, text, urls
from pagewright.operators import audit, brand, clusters, crawl, duplicates, facts, layout, titles
from pagewright.plans.knowledge import Stages, build_knowledge
from pagewright.sources import html as html_source
from pagewright.streaming import state

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# SQL fragments: a URL's parts, its canonical form, and text normal forms, in RE2's dialect.
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$"
PATH = f"CASE WHEN regexp_extract(url, '{PARTS}', 3) = '' THEN '/' ELSE regexp_extract(url, '{PARTS}', 3) END"
HOST = f"lower(regexp_extract(url, '{PARTS}', 2))"
URLS = f"""
SELECT page_id, url, html, {HOST} AS job_id, {PATH} AS path, lower(regexp_extract(url, '{PARTS}', 1)) AS scheme,
       array_to_string(list_filter(string_split(substr(regexp_extract(url, '{PARTS}', 4), 2), '&'),
                                   lambda x: NOT list_contains({as_list(urls.TRACKING_PARAMS)}, lower(regexp_extract(x, '^[^=]*')))), '&') AS kept
FROM pages"""
CANON = f"""
SELECT *, scheme || '://' || job_id || CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END
          || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS canonical
FROM ({URLS})"""
KIND = f"""
SELECT *, list_filter(string_split(lower(regexp_extract(canonical, '{PARTS}', 3)), '/'), lambda x: x <> '') AS segs,
       regexp_extract(coalesce(list_filter(string_split(lower(regexp_extract(canonical, '{PARTS}', 3)), '/'), lambda x: x <> '')[-1], ''), '^.+\\.([^.]*)$', 1) AS ext
FROM ({CANON})"""
KINDS = f"""
SELECT *, CASE WHEN list_contains({as_list(urls.IMAGE_EXTENSIONS)}, ext) THEN 'image' WHEN list_contains({as_list(urls.DOCUMENT_EXTENSIONS)}, ext) THEN 'document'
               WHEN list_contains({as_list(urls.ASSET_EXTENSIONS)}, ext) THEN 'asset'
               WHEN list_has_any(segs, {as_list(urls.LISTING_SEGMENTS)}) OR regexp_matches('/' || array_to_string(segs, '/') || '/', '/page/[0-9]+/')
                    OR regexp_matches(lower(regexp_extract(canonical, '{PARTS}', 3)), '^/[0-9]{{4}}(/[0-9]{{1,2}})?$') OR kept <> '' THEN 'listing' ELSE 'content' END AS kind
FROM ({KIND})"""


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def sql_body(x: str) -> str:
    x = f"regexp_replace(regexp_replace({x}, '!\\[[^\\]]*\\]\\([^)]+\\)', ' ', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g')"
    x = f"regexp_replace(regexp_replace({x}, 'https?://\\S+', ' ', 'g'), '[#*_`>|-]+', ' ', 'g')"
    return sql_squeeze(f"lower(regexp_replace({x}, '\\b(jpg|jpeg|png|webp|gif|svg|pdf)\\b', ' ', 'gi'))")


def sql_line(x: str) -> str:
    x = f"regexp_replace(regexp_replace({x}, '!\\[[^\\]]*\\]\\([^)]+\\)', '', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g')"
    return f"lower({sql_squeeze(f"regexp_replace({x}, '[#*_`>\\[\\]().,:;|]+', ' ', 'g')")})"


def host_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(urls.host(url).alias("job_id"), F.col("page_id").alias("ord"), "url", "html")


def document_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of one job per language, with bodies."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("job_id"), F.col("doc_id").alias("ord"), F.lit("f").alias("fingerprint"), F.col("text"))
    return duplicates.with_bodies(docs, "text")


# URLs and inventory


@query(f"SELECT page_id, canonical FROM ({CANON})")
def url_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.canonicalize(F.col("url")).alias("canonical"))


@query(f"SELECT kind, count(*) AS n FROM ({KINDS}) GROUP BY kind")
def url_kind_counts(spark, sf_dir):
    canonical = urls.canonicalize(F.col("url"))
    return audit.kind_counts(table(spark, sf_dir, "pages").select(urls.kind(canonical).alias("kind")))


@query(f"SELECT job_id, canonical, kind, min(page_id) AS page_id, count(*) AS n FROM ({KINDS}) GROUP BY ALL")
def page_inventory_dedup(spark, sf_dir):
    rows = host_pages(spark, sf_dir).withColumn("canonical", urls.canonicalize(F.col("url")))
    return rows.groupBy("job_id", "canonical", urls.kind(F.col("canonical")).alias("kind")).agg(F.min("ord").alias("page_id"), F.count("*").alias("n"))


SLUG = f"""
SELECT page_id, job_id, coalesce(nullif(array_to_string(list_filter(list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''),
       lambda x: regexp_replace(regexp_replace(lower(strip_accents(x)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), lambda x: x <> ''), '-'), ''), 'root') AS base FROM ({URLS})"""


@query(f"SELECT page_id, job_id, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY job_id, base ORDER BY page_id) AS k FROM ({SLUG}))")
def page_slug(spark, sf_dir):
    return crawl.unique_slugs(host_pages(spark, sf_dir).select("job_id", "ord", "url")).select(F.col("ord").alias("page_id"), "job_id", "slug")


HREF = r"""(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']"""
EDGES = f"""
SELECT page_id, job_id, url, CASE WHEN starts_with(h, '/') THEN scheme || '://' || regexp_extract(url, '{PARTS}', 2) || h WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h
       ELSE scheme || '://' || regexp_extract(url, '{PARTS}', 2) || regexp_replace(path, '[^/]*$', '') || h END AS target
FROM (SELECT *, unnest(list_filter(regexp_extract_all(html, '{HREF}', 1), lambda x: x <> '' AND NOT regexp_matches(x, '^(#|javascript:|mailto:|tel:)'))) AS h FROM ({URLS}))"""


@query(f"SELECT url, target, count(*) AS n FROM ({EDGES}) GROUP BY ALL")
def link_edges(spark, sf_dir):
    return crawl.link_edges(table(spark, sf_dir, "pages")).groupBy("url", "target").agg(F.count("*").alias("n"))


@query(f"SELECT job_id AS host, lower(regexp_extract(target, '{PARTS}', 2)) AS target_host, count(*) AS links, count(DISTINCT target) AS targets FROM ({EDGES}) GROUP BY ALL")
def link_domain_counts(spark, sf_dir):
    edges = crawl.link_edges(table(spark, sf_dir, "pages"))
    return edges.groupBy(urls.host(F.col("url")).alias("host"), urls.host(F.col("target")).alias("target_host")).agg(F.count("*").alias("links"), F.count_distinct("target").alias("targets"))


@query()
def frontier_bfs_depth(spark, sf_dir):
    """Breadth-first discovery from each host's first page."""
    save = Stages(spark, "frontier")
    edges = save("edges", crawl.link_edges(table(spark, sf_dir, "pages")).select(urls.canonicalize(F.col("url")).alias("source"), F.col("canonical").alias("target")).distinct())
    roots = host_pages(spark, sf_dir).groupBy("job_id").agg(F.min_by("url", "ord").alias("root"))
    return crawl.discover(edges, roots, save)


@query(f"SELECT job_id, len(prefix) AS depth, prefix[-1] AS segment, count(*) AS n FROM (SELECT DISTINCT job_id, list_slice(segs, 1, n) AS prefix FROM (SELECT job_id, segs, unnest(range(1, len(segs) + 1)) AS n FROM (SELECT DISTINCT job_id, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs FROM ({URLS})))) GROUP BY ALL")
def site_tree(spark, sf_dir):
    pages = host_pages(spark, sf_dir).select("job_id", urls.path(F.col("url")).alias("path"))
    return audit.site_tree(pages, most=None).groupBy("job_id", "depth", "segment").agg(F.count("*").alias("n"))


# Page structure by pattern

NAV = r"(?is)<nav[^>]*>(.*?)</nav>"
LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>"""


def sql_plain(x: str) -> str:
    return sql_squeeze(f"regexp_replace({x}, '<[^>]+>', '', 'g')")


def plain(c):
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"\s+", " "))


@query(f"SELECT page_id, {sql_plain("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")} AS title, {sql_plain("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS h1 FROM pages")
def html_title_h1(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", plain(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)).alias("title"), plain(F.regexp_extract("html", "(?is)<h1[^>]*>(.*?)</h1>", 1)).alias("h1"))


def nav_rows(spark, sf_dir) -> DataFrame:
    link = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
    rows = host_pages(spark, sf_dir).withColumn("nav", F.regexp_extract("html", NAV, 1))
    pairs = F.arrays_zip(F.regexp_extract_all("nav", F.lit(link), 1).alias("href"), F.regexp_extract_all("nav", F.lit(link), 2).alias("text"))
    return rows.select("job_id", "ord", F.explode(F.array_distinct(pairs)).alias("a")).select("job_id", "ord", "a.href", plain(F.col("a.text")).alias("text")).filter("text != '' and not startswith(href, '#')")


NAVS = f"""
SELECT job_id, page_id, href, text FROM (SELECT DISTINCT job_id, page_id, a.href AS href, {sql_plain('a.text')} AS text
  FROM (SELECT job_id, page_id, unnest(list_zip(regexp_extract_all(nav, '{LINK}', 1), regexp_extract_all(nav, '{LINK}', 2))) AS pair FROM (SELECT *, regexp_extract(html, '{NAV}', 1) AS nav FROM ({URLS})))
  , LATERAL (SELECT struct_pack(href := pair[1], text := pair[2]) AS a)) WHERE text <> '' AND NOT starts_with(href, '#')"""


@query(f"SELECT page_id, href, text FROM ({NAVS})")
def nav_links(spark, sf_dir):
    return nav_rows(spark, sf_dir).select(F.col("ord").alias("page_id"), "href", "text").distinct()


@query(f"SELECT page_id, substr({sql_plain("regexp_extract(html, '(?is)<footer[^>]*>(.*?)</footer>', 1)")}, 1, 600) AS footer FROM pages")
def footer_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.substring(plain(F.regexp_extract("html", "(?is)<footer[^>]*>(.*?)</footer>", 1)), 1, 600).alias("footer"))


@query(f"SELECT job_id, norm, pages FROM (SELECT job_id, {sql_line('text')} AS norm, count(DISTINCT page_id) AS pages FROM ({NAVS}) GROUP BY ALL) JOIN (SELECT {HOST} AS job_id, count(*) AS n FROM pages GROUP BY 1) USING (job_id) WHERE norm <> '' AND pages >= greatest(2, (2 * n + 4) // 5)")
def common_nav_lines(spark, sf_dir):
    """Navigation texts on two fifths of a host's pages, twice at least."""
    counts = nav_rows(spark, sf_dir).select("job_id", "ord", text.normalize_line(F.col("text")).alias("norm")).filter("norm != ''").distinct().groupBy("job_id", "norm").agg(F.count("*").alias("pages"))
    total = host_pages(spark, sf_dir).groupBy("job_id").agg(F.count("*").alias("n"))
    return counts.join(total, "job_id").filter("pages >= greatest(2, (2 * n + 4) div 5)").select("job_id", "norm", "pages")


@query()
def title_suffixes(spark, sf_dir):
    """Titles of all pages as one job, with and without their common suffix."""
    pages = html_title_h1(spark, sf_dir).select(F.lit("all").alias("job_id"), F.col("page_id").alias("ord"), F.col("title"))
    return titles.strip_suffixes(pages).select(F.col("ord").alias("page_id"), "title", "fullTitle")


# Documents: normal forms, lines, duplicates


@query(f"SELECT doc_id, substr(sha256({sql_body('text')}), 1, 16) AS hash, CAST(length({sql_body('text')}) AS BIGINT) AS chars FROM documents")
def body_normalised_hash(spark, sf_dir):
    body = text.normalize_body(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.short_hash(body).alias("hash"), F.length(body).cast("bigint").alias("chars"))


@query(f"SELECT norm, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, {sql_line('line')} AS norm FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT doc_id) >= 2")
def line_frequency(spark, sf_dir):
    """Normalised lines of two documents or more."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    rows = rows.select("doc_id", text.normalize_line(F.col("line")).alias("norm")).filter("norm != ''").distinct()
    return rows.groupBy("norm").agg(F.count("*").alias("docs")).filter("docs >= 2")


BODIES = f"SELECT doc_id, lang, body, length(body) AS chars, CAST(CASE WHEN length(body) > 0 THEN floor(ln(length(body)) / ln(1.1)) ELSE 0 END AS INT) AS bucket FROM (SELECT doc_id, lang, {sql_body('text')} AS body FROM documents)"


@query(f"SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, body) AS first_id FROM ({BODIES}) WHERE chars >= 50")
def exact_duplicates(spark, sf_dir):
    return duplicates.exact_duplicates(document_bodies(spark, sf_dir), Stages(spark, "exact")).select(F.col("ord").alias("doc_id"), F.col("first_ord").alias("first_id"))


@query(f"""
WITH b AS (SELECT * FROM ({BODIES}) WHERE chars >= 50), r AS (SELECT *, list_filter(string_split(body, ' '), lambda x: x <> '') AS w FROM b WHERE doc_id IN (SELECT min(doc_id) FROM b GROUP BY lang, body)),
s AS (SELECT *, list_distinct(list_transform(range(1, greatest(1, len(w) - 2) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM r)
SELECT a.doc_id AS a, z.doc_id AS b, len(list_intersect(a.s, z.s)) AS overlap, len(a.s) + len(z.s) - len(list_intersect(a.s, z.s)) AS "union"
FROM s a JOIN s z ON a.lang = z.lang AND z.doc_id > a.doc_id AND abs(a.bucket - z.bucket) <= 2 AND least(a.chars, z.chars) >= 0.82 * greatest(a.chars, z.chars)
WHERE 200 * len(list_intersect(a.s, z.s)) >= 159 * (len(a.s) + len(z.s) - len(list_intersect(a.s, z.s)))
""")
def shingle_jaccard_pairs(spark, sf_dir):
    """Pairs of different bodies of a language whose similarity rounds to 0.8 or more, blocked by length."""
    save = Stages(spark, "pairs")
    rows = save("bodies", document_bodies(spark, sf_dir).drop("text"))
    firsts = duplicates.exact_duplicates(rows, save).filter("ord = first_ord").select("job_id", "ord")
    pairs = duplicates.similar_pairs(save("sets", duplicates.shingle_sets(rows.join(firsts, ["job_id", "ord"], "left_semi"))), save, 0.8)
    return pairs.select("a", "b", F.col("overlap").cast("bigint").alias("overlap"), F.col("union").cast("bigint").alias("union"))


# Sets of shingles meet by the shingles they share. Documents that have links are taken in order; one that no earlier leader is linked to joins the leaders.
@query(f"""
WITH RECURSIVE b AS (SELECT * FROM ({BODIES}) WHERE chars >= 50), r AS (SELECT *, list_filter(string_split(body, ' '), lambda x: x <> '') AS w FROM b WHERE doc_id IN (SELECT min(doc_id) FROM b GROUP BY lang, body)),
s AS (SELECT *, list_distinct(list_transform(range(1, greatest(1, len(w) - 2) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM r),
x AS (SELECT lang, doc_id, chars, bucket, len(s) AS n, unnest(s) AS g FROM s),
alike AS (
  SELECT x.doc_id AS a, z.doc_id AS b, count(*) AS overlap, any_value(x.n) + any_value(z.n) - count(*) AS "union"
  FROM x JOIN x z ON x.lang = z.lang AND x.g = z.g AND z.doc_id > x.doc_id AND abs(x.bucket - z.bucket) <= 2 AND least(x.chars, z.chars) >= 0.82 * greatest(x.chars, z.chars)
  GROUP BY x.doc_id, z.doc_id HAVING 200 * count(*) >= 159 * (any_value(x.n) + any_value(z.n) - count(*))),
linked AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM (SELECT a AS doc_id FROM alike UNION SELECT b FROM alike)),
walk AS (
  SELECT 0::BIGINT AS i, []::BIGINT[] AS leaders
  UNION ALL
  SELECT l.i, CASE WHEN EXISTS (SELECT 1 FROM alike e WHERE e.b = l.doc_id AND list_contains(w.leaders, e.a)) THEN w.leaders ELSE list_append(w.leaders, l.doc_id) END
  FROM walk w JOIN linked l ON l.i = w.i + 1),
leaders AS (SELECT unnest(leaders) AS a FROM (SELECT leaders FROM walk ORDER BY i DESC LIMIT 1)),
led AS (SELECT b AS doc_id, min(a) AS leader FROM alike JOIN leaders USING (a) WHERE b NOT IN (SELECT a FROM leaders) GROUP BY b),
firsts AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, body) AS first_id FROM b)
SELECT d.doc_id, coalesce(l.leader, f.first_id, d.doc_id) AS leader,
       CASE WHEN f.first_id = d.doc_id AND l.leader IS NOT NULL THEN floor((e.overlap * 200 + e."union") / (e."union" * 2)) / 100.0 ELSE 1.0 END AS confidence
FROM documents d LEFT JOIN firsts f ON f.doc_id = d.doc_id LEFT JOIN led l ON l.doc_id = f.first_id LEFT JOIN alike e ON e.a = l.leader AND e.b = d.doc_id
""")
def near_document_leaders(spark, sf_dir):
    """Greedy leaders among the documents of a language, at similarities that round to 0.8 or more."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("job_id"), F.col("doc_id").alias("ord"), F.lit("f").alias("fingerprint"), F.col("text").alias("cleanedMarkdown"))
    found = duplicates.mark_duplicates(docs, Stages(spark, "documents"), 0.8)
    return found.select(F.col("ord").alias("doc_id"), F.col("canonical_ord").alias("leader"), F.col("duplicateConfidence").alias("confidence"))


@query()
def near_duplicate_leaders(spark, sf_dir):
    """Greedy leaders among pages of a host, by the whole operator."""
    pages = scraped(spark, sf_dir).withColumn("cleanedMarkdown", F.col("raw"))
    typed = Stages(spark, "typed")("pages", clusters.with_fingerprints(pages.withColumn("diagnostics", F.lit(None).cast("struct<warnings:array<string>>"))))
    return duplicates.mark_duplicates(typed, Stages(spark, "leaders"), 0.8).select("job_id", F.col("ord").alias("page_id"), "canonical_ord", "duplicateConfidence", "isDuplicate")


RAW, CLEAN = "length(raw)", "length(body)"


@query(f"""
SELECT doc_id, greatest(20, least(98, 94 - CASE WHEN c < 160 THEN 25 ELSE 0 END - CASE WHEN r > 0 AND 1 - c / r > 0.55 THEN 25 ELSE 0 END - least(12, gone))) / 100.0 AS confidence FROM (
  SELECT doc_id, length({sql_body('kept')}) AS c, length({sql_body('text')}) AS r, gone FROM (
    SELECT doc_id, text, array_to_string(list_filter(lines, lambda x: length(x) >= 40), chr(10)) AS kept, len(list_filter(lines, lambda x: length(x) < 40)) AS gone FROM (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents)))
""")
def content_confidence(spark, sf_dir):
    """Confidence of documents if lines of under 40 characters count as layout."""
    lines = F.split("text", "\n")
    kept, gone = F.array_join(F.filter(lines, lambda x: F.length(x) >= 40), "\n"), F.size(F.filter(lines, lambda x: F.length(x) < 40))
    # Bodies are measured in a step of their own, else each use of a length normalises them again.
    rows = table(spark, sf_dir, "documents").select("doc_id", F.length(text.normalize_body(kept)).alias("cleaned"), F.length(text.normalize_body(F.col("text"))).alias("raw"), gone.alias("gone"))
    return rows.select("doc_id", text.content_confidence(F.col("cleaned"), F.col("raw"), F.col("gone")).alias("confidence"))


@query("SELECT lang, count(*) AS docs, count(l.doc_id) AS labelled, sum(quality) AS good, sum(toxic) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def language_label_quality(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("hit", F.lit(1))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("docs"), F.count("hit").alias("labelled"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))


# Facts


def sql_source(x: str) -> str:
    x = f"regexp_replace(regexp_replace({x}, '!\\[[^\\]]*\\]\\([^\\n)]*\\)', ' ', 'g'), '\\[([^\\]]+)\\]\\([^\\n)]*\\)', '\\1', 'g')"
    return f"regexp_replace(regexp_replace({x}, 'https?://\\S+', ' ', 'gi'), '<[^>]+>', ' ', 'g')"


# Patterns of single kinds without look-around, which RE2 lacks; word bounds are ASCII there as in ours.
RE2 = {
    "email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "phone": r"\+?[0-9][0-9\s().-]{6,}[0-9]", "percentage": r"\b[0-9][0-9.,]*\s?%", "date": r"\b[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)?[0-9]{2}\b", "year": r"\b(?:19|20)[0-9]{2}\b",
    "count": r"\b(?:[0-9]{1,3}(?:[.,\s][0-9]{3})+|[0-9]{3,6})\b", "price": r"(?i)(?:[€$£]\s?[0-9][0-9\s.,]*[0-9]|[0-9][0-9\s.,]*[0-9]\s?(?:zł|pln|eur|usd|gbp|chf|€|\$|£))",
}


def _fact_query(kind: str):
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(facts.matches(text.fact_source(F.col("text")), kind)).alias("value"))
        return rows.groupBy("doc_id", "value").agg(F.count("*").alias("n"))

    run.__name__ = f"fact_{kind}"
    run.__doc__ = f"Spans of the {kind} pattern in documents, without claims of other kinds."
    sql = f"SELECT doc_id, value, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({sql_source('text')}, '{RE2[kind]}')) AS value FROM documents) GROUP BY ALL"
    return query(sql)(run)


for _kind in RE2:
    _fact_query(_kind)


def document_facts(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("job_id"), F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("slug"), F.lit("").alias("url"), F.col("text").alias("raw"))
    return facts.extract_facts(pages)


@query()
def fact_extract(spark, sf_dir):
    """All facts of documents, with span claiming."""
    return document_facts(spark, sf_dir).select(F.col("ord").alias("doc_id"), "n", "kind", "value", "unit", "label", "confidence", "needsReview")


@query()
def fact_collapse(spark, sf_dir):
    """Facts of each source's documents that say the same, as one row."""
    found = Stages(spark, "facts")("facts", document_facts(spark, sf_dir))  # read twice
    return facts.collapse_facts(found).select("job_id", "key", "kind", "value", "occurrences", "alsoOn")


# Page types, clusters, audit


@query(f"""
SELECT page_type, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(url, '(?i)/(kontakt|contact)\\b') THEN 'contact' WHEN regexp_matches(url, '(?i)/({'|'.join(clusters.PATHS['article'])})/') THEN 'article'
  WHEN regexp_matches(url, '(?i)/({'|'.join(clusters.PATHS['case_study'])})/') THEN 'case_study' WHEN regexp_matches(url, '(?i)/({'|'.join(clusters.PATHS['regional_directory'])})/') THEN 'regional_directory'
  WHEN regexp_matches(url, '(?i)/({'|'.join(clusters.OPEN_PATHS['utility'])})\\b') THEN 'utility' WHEN regexp_matches(url, '(?i)/({'|'.join(clusters.PATHS['category'])})/') THEN 'category'
  WHEN regexp_matches(url, '(?i)/({'|'.join(clusters.PATHS['service'])})/') THEN 'service' ELSE 'template' END AS page_type FROM pages) GROUP BY page_type
""")
def page_type_counts(spark, sf_dir):
    """Page types by URL alone."""
    return table(spark, sf_dir, "pages").groupBy(clusters.page_type(F.col("url"), F.lit(None), F.lit(None)).alias("page_type")).agg(F.count("*").alias("n"))


def scraped(spark, sf_dir) -> DataFrame:
    """Stored pages scraped to Markdown and structure, hosts as jobs."""
    keyed = host_pages(spark, sf_dir).select("job_id", "ord", "url").dropDuplicates(["url"])
    pages = html_source.scrape_pages(table(spark, sf_dir, "pages").select("url", "html").dropDuplicates(["url"])).filter("markdown is not null")
    rows = pages.join(keyed, "url").withColumnRenamed("markdown", "raw")
    return rows.select("job_id", "ord", F.concat_ws("-", urls.base_slug(F.col("url")), F.col("ord").cast("string")).alias("slug"), "url", F.lit("done").alias("status"), urls.kind(F.col("url")).alias("kind"), "raw", "title", "description", "structure")


@query()
def html_to_markdown(spark, sf_dir):
    pages = html_source.scrape_pages(table(spark, sf_dir, "pages"))
    return pages.select("url", "markdown", "title", F.to_json("structure").alias("structure"), "error")


def knowledge(spark, sf_dir, name: str) -> DataFrame:
    """One table of a build; the build makes no other."""
    save = Stages(spark, "scraped")
    return build_knowledge(save("pages", scraped(spark, sf_dir)), wanted={name})[name]


@query()
def knowledge_pages(spark, sf_dir):
    return knowledge(spark, sf_dir, "pages").select("job_id", "ord", "slug", "url", "pageType", "fingerprint", "diagnostics.contentConfidence", "diagnostics.removedLineCount", "diagnostics.normalizedBodyHash", "isDuplicate", "canonical_ord", "cluster_id")


@query()
def knowledge_clusters(spark, sf_dir):
    return knowledge(spark, sf_dir, "clusters").select("job_id", "cluster_id", "label", "confidence", "fingerprint", "n", "sampleUrls")


@query()
def knowledge_records(spark, sf_dir):
    return knowledge(spark, sf_dir, "records").select("job_id", "cluster_id", "ord", F.to_json(F.struct("slug", "title", "sections", "images", "featureBullets", "technicalData", "internalLinks", "date", "email", "phone")).alias("record"))


@query()
def knowledge_audit(spark, sf_dir):
    return knowledge(spark, sf_dir, "audit").drop("factsByKind", "suspiciousFactsByKind")


STATUS = "CASE page_id % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' WHEN 3 THEN 'skipped' ELSE 'scraping' END"


@query(f"SELECT job_id, count(*) FILTER (s = 'pending') AS pending, count(*) FILTER (s = 'scraping') AS scraping, count(*) FILTER (s = 'done') AS done, count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s = 'failed') AS failed FROM (SELECT {HOST} AS job_id, {STATUS} AS s FROM pages) GROUP BY job_id")
def status_pivot(spark, sf_dir):
    return audit.status_counts(host_pages(spark, sf_dir).withColumn("status", F.expr(STATUS.replace("page_id", "ord"))))


@query("SELECT page_id, url, length(url) AS chars FROM pages ORDER BY length(url), page_id LIMIT 20")
def top_k_pages(spark, sf_dir):
    """The 20 pages with the shortest URLs."""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.length("url").cast("bigint").alias("chars")).orderBy("chars", "page_id").limit(20)


@query("SELECT page_id, url FROM pages ORDER BY page_id DESC LIMIT 10 OFFSET 10")
def page_slice(spark, sf_dir):
    """The second page of ten of a listing by id, newest first."""
    return audit.page_slice(table(spark, sf_dir, "pages").select("page_id", "url"), [F.desc("page_id")], 2)


IP = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
OCTETS = "SELECT ip, CAST(string_split(ip, '.')[1] AS INT) AS a, CAST(string_split(ip, '.')[2] AS INT) AS b, CAST(string_split(ip, '.')[3] AS INT) AS c, CAST(string_split(ip, '.')[4] AS INT) AS d FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '" + IP + "')) AS ip FROM documents)"


@query(f"SELECT ip, greatest(a, b, c, d) <= 255 AND NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 192 AND b = 0 AND c = 0) OR (a = 198 AND b IN (18, 19))) AS public FROM ({OCTETS})")
def public_ipv4(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(IP), 0)).alias("ip")).distinct()
    return rows.select("ip", net.is_public_ipv4(F.col("ip")).alias("public"))


STYLE = "(?is)<style[^>]*>(.*?)</style>"
SHEETS = f"SELECT {HOST} AS job_id, regexp_extract(html, '{STYLE}', 1) || '--pad-' || (page_id % 7) || ':' || (page_id % 11) || 'px;a{{color:#' || substr(md5(CAST(page_id % 50 AS VARCHAR)), 1, 6) || '}}b{{color:rgb(' || (page_id % 256) || ', 20,30)}}' AS css, page_id FROM pages"


def sheets(spark, sf_dir) -> DataFrame:
    """Style blocks of pages, each with a few rules made from its id, as the stored ones hardly vary."""
    css = F.concat(F.regexp_extract("html", STYLE, 1), F.expr("concat('--pad-', ord % 7, ':', ord % 11, 'px;a{color:#', substr(md5(cast(ord % 50 as string)), 1, 6), '}b{color:rgb(', ord % 256, ', 20,30)}')"))
    return host_pages(spark, sf_dir).select("job_id", "ord", css.alias("css"))


@query(f"SELECT job_id, hex, count(*) AS n FROM (SELECT job_id, '#' || lower(unnest(regexp_extract_all(css, '#([0-9a-fA-F]{{6}})\\b', 1))) AS hex FROM ({SHEETS}) UNION ALL SELECT job_id, printf('#%02x141e', CAST(regexp_extract(css, 'rgb\\(([0-9]+)', 1) AS INT)) FROM ({SHEETS})) GROUP BY ALL")
def color_histogram(spark, sf_dir):
    return brand.color_histogram(sheets(spark, sf_dir)).select("job_id", "hex", "n")


@query(f"SELECT page_id, '--pad-' || (page_id % 7) AS name, (page_id % 11) || 'px' AS value FROM pages")
def css_vars(spark, sf_dir):
    return sheets(spark, sf_dir).select(F.col("ord").alias("page_id"), F.explode(brand.css_vars(F.col("css"))).alias("v")).select("page_id", "v.name", "v.value")


@query(f"SELECT DISTINCT job_id, '#' || lower(hex) AS hex FROM (SELECT job_id, unnest(regexp_extract_all(css, '#([0-9a-fA-F]{{6}})\\b', 1)) AS hex FROM ({SHEETS})) WHERE greatest(CAST('0x' || hex[1:2] AS INT), CAST('0x' || hex[3:4] AS INT), CAST('0x' || hex[5:6] AS INT)) - least(CAST('0x' || hex[1:2] AS INT), CAST('0x' || hex[3:4] AS INT), CAST('0x' || hex[5:6] AS INT)) < 24")
def neutral_colors(spark, sf_dir):
    rows = brand.color_histogram(sheets(spark, sf_dir)).filter("not hex rlike '^#..141e$'")
    return rows.filter(brand.is_neutral(F.col("hex"))).select("job_id", "hex")


ROBOTS = "concat('User-agent: *\nDisallow: /de/\nAllow: /de/1\nDisallow: /*page=\n', 'User-agent: pagewright\nDisallow: /fr/*2$\nSitemap: https://', job_id, '/map.xml')"


@query(f"SELECT page_id, NOT regexp_matches(path || regexp_extract(url, '{PARTS}', 4), '^/fr/.*2$') AS allowed FROM ({URLS})")
def robots_allowed(spark, sf_dir):
    """Pages that a robots.txt made for each host lets our agent read: only its own group counts."""
    pages = host_pages(spark, sf_dir).select("job_id", "ord", "url")
    robots = pages.select("job_id").distinct().withColumn("robots", F.expr(ROBOTS))
    return crawl.robots_allowed(pages, robots, "Pagewright/1.0").select(F.col("ord").alias("page_id"), "allowed")


# Streams, run to the end of the stored input


def _stream(spark, sf_dir, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parque[t]"
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(path)


@query(f"SELECT DISTINCT job_id, canonical AS url, kind FROM ({KINDS})")
def streaming_url_dedup(spark, sf_dir):
    """URLs of a page stream, each canonical form of a host once."""
    rows = _stream(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("job_id"), "url")
    save = Stages(spark, "stream-urls")
    run = state.new_urls(rows).writeStream.format("parquet").option("path", f"{save.root}/out").option("checkpointLocation", f"{save.root}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("job_id string, url string, kind string").parquet(f"{save.root}/out")


@query(f"SELECT job_id, count(*) FILTER (s = 'pending') AS pending, count(*) FILTER (s = 'scraping') AS scraping, count(*) FILTER (s = 'done') AS done, count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s = 'failed') AS failed, count(*) AS pages FROM (SELECT {HOST} AS job_id, {STATUS} AS s FROM pages) GROUP BY job_id")
def streaming_status_counts(spark, sf_dir):
    """Latest status of each page from a stream of changes, counted by host."""
    rows = _stream(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("job_id"), F.col("page_id").cast("string").alias("slug"), F.explode(F.array(F.struct(F.lit(0).alias("seq"), F.lit("pending").alias("status")), F.struct(F.lit(1).alias("seq"), F.expr(STATUS).alias("status")))).alias("c"))
    changes = rows.select("job_id", "slug", "c.*")
    save = Stages(spark, "stream-status")
    sink = lambda batch, i: batch.write.mode("overwrite").parquet(f"{save.root}/out")
    run = state.status_counts(changes).writeStream.outputMode("complete").foreachBatch(state.changed_only(sink)).option("checkpointLocation", f"{save.root}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return state.snapshot(spark.read.schema("job_id string, slug string, status string").parquet(f"{save.root}/out"))


def page_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every page with its canonical URL, kind, slug, and the first page of the host with the same content."""
    pages = host_pages(spark, sf_dir)
    rows = crawl.unique_slugs(pages.select("job_id", "ord", "url", F.sha2("html", 256).alias("h")))
    first = rows.groupBy("job_id", "h").agg(F.min("ord").alias("first_ord"))
    canonical = urls.canonicalize(F.col("url"))
    return rows.join(first, ["job_id", "h"]).select("job_id", F.col("ord").alias("page_id"), "slug", canonical.alias("canonical"), urls.kind(canonical).alias("kind"), (F.col("first_ord") != F.col("ord")).alias("is_copy"), F.col("first_ord").alias("first_page_id"))


query(f"""SELECT job_id, page_id, slug, canonical, kind, page_id <> first_page_id AS is_copy, first_page_id FROM ({KINDS}) k
JOIN (SELECT page_id, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY job_id, base ORDER BY page_id) AS k FROM ({SLUG}))) USING (page_id)
JOIN (SELECT page_id, min(page_id) OVER (PARTITION BY {HOST}, html) AS first_page_id FROM pages) USING (page_id)""")(page_inventory)
