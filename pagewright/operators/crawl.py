"""Crawl state: robots rules, sitemaps, page slugs, discovery, and status changes of pages and jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import net, urls
from pagewright.functions.text import lines
from pagewright.operators.numbering import numbered, saver

SITEMAPS, LIMIT, MAX_REDIRECTS = 50, 5000, 5
# Where sites keep their sitemaps.
SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml"]


def robots_rules(robots: DataFrame) -> DataFrame:
    """Rules of robots.txt texts (job_id, robots): job_id, agent, allow, path; a group without rules gives a row without path.

    Lines of one agent group are those between a user-agent line that follows rules and the next such line.
    """
    rows = robots.select("job_id", F.posexplode(lines(F.col("robots"))).alias("no", "line"))
    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    rows = rows.withColumn("key", F.lower(F.trim(F.regexp_extract(line, "^([^:]*):", 1)))).withColumn("value", F.trim(F.regexp_extract(line, "^[^:]*:(.*)$", 1)))
    rows = rows.filter(F.col("key").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("job_id").orderBy("no")
    is_agent = F.col("key") == "user-agent"
    starts = is_agent & ~F.coalesce(F.lag(is_agent).over(order), F.lit(False))
    rows = rows.withColumn("grp", F.sum(starts.cast("int")).over(order))
    agents = rows.filter(is_agent).select("job_id", "grp", F.lower("value").alias("agent")).distinct()
    rules = rows.filter(~is_agent & ~((F.col("key") == "disallow") & (F.col("value") == ""))).select("job_id", "grp", (F.col("key") == "allow").alias("allow"), F.col("value").alias("path"))
    return agents.join(rules, ["job_id", "grp"], "left").select("job_id", "agent", "allow", F.nullif("path", F.lit("")).alias("path"))


def robots_allowed(targets: DataFrame, robots: DataFrame, user_agent: str) -> DataFrame:
    """Targets (job_id, url) with `allowed`: the longest agent named in ours (else *), its longest matching rule, allow on ties.

    Rules join by job, so a target meets only its own site's.
    """
    rules = robots_rules(robots)
    fits = (F.col("agent") != "*") & F.contains(F.lit(user_agent.lower()), F.col("agent"))
    rank = F.when(fits, F.length("agent")).when(F.col("agent") == "*", -1)
    chosen = rules.withColumn("rank", rank).filter("rank is not null").groupBy("job_id").agg(F.max_by("agent", "rank").alias("agent"))
    rules = rules.join(chosen, ["job_id", "agent"], "left_semi").filter("path is not null").select("job_id", "allow", net.robots_pattern(F.col("path")).alias("pattern"), F.length("path").alias("len"))
    target = F.concat(urls.path(F.col("url")), F.regexp_extract("url", urls.URL_PATTERN, 4))
    rows = targets.withColumn("target", target)
    met = rows.select("job_id", "url", "target").distinct().join(rules, "job_id").filter(F.expr("target rlike pattern"))
    winner = met.groupBy("job_id", "url").agg(F.max_by("allow", F.struct("len", "allow")).alias("allow"))
    return rows.join(winner, ["job_id", "url"], "left").withColumn("allowed", F.coalesce("allow", F.lit(True))).drop("allow", "target")


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """Sitemaps that robots.txt texts name: job_id, url."""
    found = F.transform(F.filter(lines(F.col("robots")), lambda x: x.rlike(r"(?i)^\s*sitemap\s*:\s*\S+")), lambda x: F.regexp_extract(x, r"(?i)^\s*sitemap\s*:\s*(\S+)", 1))
    return robots.select("job_id", F.explode(found).alias("url")).distinct()


def sitemap_entries(documents: DataFrame, xml_col: str = "xml") -> DataFrame:
    """`<loc>` values of sitemap documents in order, with whether the document is an index of others."""
    locs = F.regexp_extract_all(F.col(xml_col), F.lit(r"(?i)<loc>\s*([^<]+?)\s*</loc>"), 1)
    return documents.select("*", F.col(xml_col).rlike(r"(?i)<sitemapindex[\s>]").alias("is_index"), F.posexplode(locs).alias("at", "loc")).withColumn("loc", net.decode_xml(F.trim("loc"))).drop(xml_col)


def crawl_sitemaps(roots: DataFrame, robots: DataFrame, documents: DataFrame, save: Callable, most: int = SITEMAPS) -> DataFrame:
    """Page URLs (job_id, url) reached from each job's sitemaps over stored documents (url, xml), breadth first.

    Each round visits one level of indexes; a job visits at most `most` documents, in the order in which they were named.
    """
    usual = roots.select("job_id", F.posexplode(F.transform(F.array(*[F.lit(p) for p in SITEMAP_PATHS]), lambda p: F.concat(urls.origin(F.col("root")), p))).alias("n", "url"))
    front = usual.unionByName(robots_sitemaps(robots).withColumn("n", F.lit(len(SITEMAP_PATHS)))).groupBy("job_id", "url").agg(F.min("n").cast("long").alias("n"))
    seen, found, level = save("sitemap-seen-0", front.select("job_id", "url", "n")), None, 0
    front = seen
    while True:
        done = seen.join(front.select("job_id", "url"), ["job_id", "url"], "left_anti").groupBy("job_id").agg(F.count("*").alias("done"))
        ranked = numbered(front, ["job_id"], ["n", "url"], "r", save, f"sitemap-rank-{level}")
        visit = ranked.join(done, "job_id", "left").filter(F.col("r") + F.coalesce("done", F.lit(0)) < most).select("job_id", "url", "n")
        entries = save(f"sitemap-entries-{level}", sitemap_entries(visit.join(documents.select("url", "xml"), "url")).select("job_id", "is_index", F.col("loc").alias("url"), (F.col("n") + 1).alias("n")))
        pages = entries.filter("not is_index").select("job_id", "url").distinct()
        found = pages if found is None else found.union(pages)
        level += 1
        front = save(f"sitemap-front-{level}", entries.filter("is_index").groupBy("job_id", "url").agg(F.min("n").cast("long").alias("n")).join(seen.select("job_id", "url"), ["job_id", "url"], "left_anti"))
        if level >= most or front.limit(1).count() == 0:
            return found.distinct()
        seen = seen.unionByName(front)


def link_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Links of stored pages: url, no, target (absolute), canonical."""
    rows = pages.select("url", F.posexplode(urls.links(F.col(html_col), F.col("url"))).alias("no", "target"))
    return rows.withColumn("canonical", urls.canonicalize(F.col("target")))


def discover(edges: DataFrame, roots: DataFrame, save: Callable, max_depth: int | None = None, limit: int = LIMIT) -> DataFrame:
    """Breadth-first discovery over stored links (source, target canonical): job_id, url, depth, up to `limit` URLs a job.

    Each round joins the frontier with the links and drops URLs already seen, until no job below its limit has new ones;
    images, documents and assets are listed but not followed.
    """
    seen = save("frontier-0", roots.select("job_id", urls.canonicalize(F.col("root")).alias("url"), F.lit(0).alias("depth")))
    front, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.filter(urls.is_crawlable(F.col("url"))).join(edges.select(F.col("source").alias("url"), "target"), "url").select("job_id", F.col("target").alias("url")).filter("url is not null").distinct()
        full = seen.groupBy("job_id").count().filter(F.col("count") >= limit)
        step = step.join(full, "job_id", "left_anti").join(seen.select("job_id", "url"), ["job_id", "url"], "left_anti")
        front = save(f"frontier-{depth}", step.withColumn("depth", F.lit(depth)))
        if front.limit(1).count() == 0:
            break
        seen = seen.unionByName(front)
    ranked = numbered(seen, ["job_id"], ["depth", "url"], "r", save, "frontier-rank")
    return ranked.filter(F.col("r") < limit).drop("r").withColumn("kind", urls.kind(F.col("url")))


def unique_slugs(pages: DataFrame, save=None) -> DataFrame:
    """Pages (job_id, ord, url) with a slug that is unique in the job: base, base-2, base-3 in page order, as if each page
    in turn took the first of these that no earlier page has. `ord` is unique in a job.

    A page's place among those of its base gives its number, unless a numbered slug is another page's base too. Those bases
    alone are settled in rounds: where pages claim one name the earliest keeps it, the others go on to their next number,
    and the pages of their base after them with them. As names prefer earlier pages and pages smaller numbers, the rounds
    end in what taking turns gives. Their number is that of the clashes one base meets in a row.
    """
    rows = pages.withColumn("base", urls.base_slug(F.col("url")))
    same = Window.partitionBy("job_id", "base")
    rows = rows.withColumn("k", F.row_number().over(same.orderBy("ord")))
    bases = rows.filter("k = 1").select("job_id", "base", F.regexp_extract("base", "^(.+)-([1-9][0-9]*)$", 1).alias("stem"))
    related = bases.filter("stem != ''").join(bases.select("job_id", F.col("base").alias("stem")), ["job_id", "stem"])
    clashing = related.select("job_id", "base").union(related.select("job_id", "stem")).distinct()
    save = saver(pages, save, "slugs")
    now = save("slugs-0", rows.join(clashing, ["job_id", "base"], "left_semi").select("job_id", "ord", "base", "k", F.col("k").alias("n")))
    name = F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string")))
    i, moving = 0, now.limit(1).count() > 0
    while moving:
        i += 1
        named = now.withColumn("name", name)
        first = named.groupBy("job_id", "name").agg(F.min("ord").alias("first"))
        tried = named.join(first, ["job_id", "name"]).withColumn("lost", F.col("ord") > F.col("first"))
        after = F.max(F.col("n") + F.col("lost").cast("int") - F.col("k")).over(same.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        now = save(f"slugs-{i}", tried.select("job_id", "ord", "base", "k", (F.col("k") + after).alias("n"), "lost"))
        moving = now.filter("lost").limit(1).count() > 0
        now = now.drop("lost")
        save.drop(f"slugs-{i - 1}")
    fixed = rows.join(now.select("job_id", "ord", "n"), ["job_id", "ord"], "left").withColumn("n", F.coalesce("n", "k"))
    return fixed.withColumn("slug", name).drop("base", "k", "n")


def redirect_chains(fetches: DataFrame, addresses: DataFrame | None = None, save=None) -> DataFrame:
    """Where each stored fetch (url, status, location) ends: url, final_url, hops, outcome.

    Up to MAX_REDIRECTS redirects are followed over the stored fetches, and every address on the way is judged before it
    counts as fetched: `blocked` for one that isn't http(s), is local, or is an address, by itself or by `addresses`
    (host, ip), that isn't public. Other outcomes are `ok`, `http <status>`, `no location`, `missing` (not stored) and
    `too many`. An end leads to itself, so five steps are one of four and one of one, and four are two doublings: three
    joins, whatever the chains and loops are. Of rows of one url the one of the least status is taken.
    """
    save = saver(fetches, save, "redirects")
    known = fetches.filter("url is not null").groupBy("url").agg(F.min(F.struct("status", "location")).alias("f")).select("url", "f.*")
    moved = net.is_redirect(F.col("status"))
    target = F.when(moved & (F.coalesce("location", F.lit("")) != ""), urls.absolutize(F.col("location"), F.col("url")))
    known = known.withColumn("target", target)
    places = known.select("url").union(known.filter("target is not null").select("target")).distinct()
    bare = F.regexp_replace(urls.host(F.col("url")), r"^\[|\]$", "")
    literal = F.when(bare.rlike(r"^[0-9.]+$"), net.is_public_ipv4(bare)).when(bare.contains(":"), net.is_public_ipv6(bare)).otherwise(~(bare.isin("", "localhost") | bare.rlike(r"\.(localhost|local|internal)$")))
    places = places.withColumn("open", urls.scheme(F.col("url")).isin("http", "https") & literal)
    if addresses is not None:
        public = F.when(F.col("ip").contains(":"), net.is_public_ipv6(F.col("ip"))).otherwise(net.is_public_ipv4(F.col("ip")))
        hosts = addresses.groupBy(F.lower("host").alias("host")).agg(F.bool_and(public).alias("public"))
        places = places.withColumn("host", urls.host(F.col("url"))).join(hosts, "host", "left").withColumn("open", F.col("open") & F.coalesce("public", F.lit(True))).drop("host", "public")
    outcome = (
        F.when(~F.coalesce("open", F.lit(False)), "blocked").when(F.col("status").isNull(), "missing").when(F.col("target").isNotNull(), F.lit(None)).when(moved, "no location")
        .when(F.col("status").between(200, 299), "ok").otherwise(F.concat_ws(" ", F.lit("http"), F.col("status").cast("string")))
    )
    step = places.join(known, "url", "left").withColumn("outcome", outcome)
    step = save("step-1", step.select("url", F.when(F.col("outcome").isNull(), F.col("target")).otherwise(F.col("url")).alias("to"), F.col("outcome").isNull().cast("int").alias("hops"), "outcome"))

    def then(first: DataFrame, second: DataFrame) -> DataFrame:
        onward = second.select(F.col("url").alias("to"), F.col("to").alias("end"), F.col("hops").alias("more"), F.col("outcome").alias("last"))
        return first.drop("outcome").join(onward, "to").select("url", F.col("end").alias("to"), (F.col("hops") + F.col("more")).alias("hops"), F.col("last").alias("outcome"))

    two = save("step-2", then(step, step))
    five = then(save("step-4", then(two, two)), step)
    # After the fifth step the outcome is that of the place before it; the place reached must be an end itself.
    ended = five.drop("outcome").join(step.select(F.col("url").alias("to"), "outcome"), "to")
    return ended.join(known.select("url"), "url", "left_semi").select("url", F.col("to").alias("final_url"), "hops", F.coalesce("outcome", F.lit("too many")).alias("outcome"))


def append_pages(stored: DataFrame, new: DataFrame, save: Callable | None = None) -> DataFrame:
    """Stored pages and those new URLs that the job has not, pending, in arrival order; known pages keep their state.

    Of rows of one new URL the first to arrive counts.
    """
    first = new.groupBy("job_id", "url").agg(F.min("ord").alias("ord"), F.min_by("kind", "ord").alias("kind"))
    fresh = first.join(stored.select("job_id", "url"), ["job_id", "url"], "left_anti")
    last = stored.groupBy("job_id").agg(F.max("ord").alias("last"))
    fresh = numbered(fresh, ["job_id"], ["ord", "url"], "place", save, "appended").join(last, "job_id", "left").withColumn("ord", F.coalesce(F.col("last") + 1, F.lit(0)) + F.col("place"))
    fresh = fresh.select("job_id", "ord", "url", F.coalesce("kind", urls.kind(F.col("url"))).alias("kind"), F.lit("pending").alias("status"))
    return stored.unionByName(fresh, allowMissingColumns=True)


def patch_pages(stored: DataFrame, patches: DataFrame, clears: tuple[str, ...] = ("error",)) -> DataFrame:
    """Pages with the patches' non-null columns by slug; columns in `clears` take the patch's value even if it is null."""
    cols = [c for c in patches.columns if c not in ("job_id", "slug")]
    met = stored.alias("s").join(patches.withColumn("_hit", F.lit(True)).alias("p"), ["job_id", "slug"], "left")
    value = lambda c: F.when(F.col("_hit"), F.col(f"p.{c}")).otherwise(F.col(f"s.{c}")) if c in clears else F.coalesce(F.col(f"p.{c}"), F.col(f"s.{c}"))
    return met.select(*[value(c).alias(c) if c in cols else F.col(c if c in ("job_id", "slug") else f"s.{c}") for c in stored.columns])


def unknown_slugs(requested: DataFrame, stored: DataFrame) -> DataFrame:
    return requested.distinct().join(stored, ["job_id", "slug"], "left_anti")


def busy_slugs(requested: DataFrame, stored: DataFrame) -> DataFrame:
    return requested.distinct().join(stored.filter("status = 'scraping'"), ["job_id", "slug"], "left_semi")


def recover_stale(stored: DataFrame, active: DataFrame) -> DataFrame:
    """Pages left in `scraping` that no worker has become failed."""
    held = active.select("job_id", "slug").distinct().withColumn("_held", F.lit(True))
    stale = (F.col("status") == "scraping") & F.col("_held").isNull()
    out = stored.join(held, ["job_id", "slug"], "left").withColumn("error", F.when(stale, F.lit("interrupted before completion")).otherwise(F.col("error")))
    return out.withColumn("status", F.when(stale, "failed").otherwise(F.col("status"))).drop("_held")


def finalize_mapping(jobs: DataFrame, status: str, at: str, error: str | None = None) -> DataFrame:
    """Mapping blocks still running get a final status; one that has a final status keeps it."""
    m = F.col("mapping")
    done = m.withField("status", F.lit(status)).withField("finishedAt", F.lit(at)).withField("error", F.lit(error).cast("string"))
    return jobs.withColumn("mapping", F.when(m["status"] == "mapping", done).otherwise(m))


def reopen_mapping(jobs: DataFrame, at: str) -> DataFrame:
    """A finished mapping starts again; a running one is left alone."""
    m = F.col("mapping")
    fresh = m.withField("status", F.lit("mapping")).withField("startedAt", F.lit(at)).withField("finishedAt", F.lit(None).cast("string")).withField("error", F.lit(None).cast("string"))
    return jobs.withColumn("mapping", F.when(m["status"] == "mapping", m).otherwise(fresh))


def scrape_outcomes(requested: DataFrame, scraped: DataFrame, at: str) -> DataFrame:
    """Patches for requested pages (job_id, slug, contentHash): done, skipped when the content is unchanged, failed with the message."""
    rows = requested.join(scraped.select("job_id", "slug", "markdown", F.col("error").alias("message")), ["job_id", "slug"], "left")
    h = F.sha2("markdown", 256)
    ok = F.col("markdown").isNotNull()
    status = F.when(~ok, "failed").when(F.coalesce(h == F.col("contentHash"), F.lit(False)), "skipped").otherwise("done")
    return rows.select("job_id", "slug", status.alias("status"), h.alias("contentHash"), F.when(ok, F.lit(at)).alias("scrapedAt"), F.when(~ok, F.coalesce("message", F.lit("no content"))).alias("error"))


def is_terminal(mapping_status, scraping_pages):
    """A status stream ends when nothing maps and no page is being scraped."""
    return (mapping_status != "mapping") & (scraping_pages == 0)


def error_status(pages: DataFrame) -> DataFrame:
    """HTTP status in the error message of failed pages."""
    found = F.nullif(F.regexp_extract("error", r"HTTP (\d{3})", 1), F.lit("")).cast("int")
    return pages.withColumn("httpStatus", F.when(F.col("status") == "failed", found))


def filter_pages(pages: DataFrame, text: str = "", kinds: list[str] | None = None) -> DataFrame:
    """Pages whose URL holds a text, of the given kinds; a missing kind counts as content."""
    out = pages.filter(F.contains(F.lower("url"), F.lit(text.strip().lower())))
    return out if kinds is None else out.filter(F.coalesce("kind", F.lit("content")).isin(kinds))


def partition_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Finished pages (done or skipped) and the others."""
    finished = F.coalesce(F.col("status").isin("done", "skipped"), F.lit(False))
    return pages.filter(finished), pages.filter(~finished)
