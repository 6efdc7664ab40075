"""Layout noise: an index of repeated lines, navigation texts and footers per job, and the cleaning of pages by it.

Thresholds are per job. Lines are rows, so a job's pages spread over tasks; the three index tables join to them by
(job, normalised line). Only section skipping, which depends on the order of headings, is a fold, over the few headings
of a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import content_confidence, headings, lines, normalize_body, normalize_line, normalize_markdown, short_hash, squeeze

# Whole lines that are site chrome, lines that are widgets, and headings of layout sections.
LAYOUT_WORDS = ["home", "menu", "produkty", "produkt", "products?", "produkte", "kontakt", "contact", "o nas", "about(?: us)?", "über uns", "impressum", "sklep", "shop", "koszyk", "cart", "warenkorb", "konto", "account", "login", "logowanie", "anmelden", "szukaj", "search", "suche", "wyszukiwarka", "categories", "category", "kategorien?"]
LAYOUT_WIDGETS = ["zaloguj", "konto", "koszyk", "cart", "search", "szukaj", "suche", "newsletter", "cookies?", "akceptuj", "accept", "akzeptieren", "czytaj więcej", "read more", "weiterlesen", "mehr erfahren", "learn more"]
LAYOUT_SECTIONS = ["menu", "kategorie[n]?", "polecane produkty", "popularne produkty", "related products", "featured products", "popular products", "you may also like", "ähnliche produkte", "beliebte produkte", "zubehör", "zobacz również", "see also", "newsletter", "koszyk", "cart", "warenkorb", "konto", "account", "login", "wyszukiwarka", "search", "suche", "social media", "follow us", "folgen sie uns"]
BREADCRUMB_WORDS = ["home", "strona główna", "start", "startseite"]
SHARE, LEAST, LONGEST_LINE, SHORT_FOOTER = (2, 5), 2, 120, 8
BULLET_LINK = r"^[-*]\s+\[[^\]]+\]\([^)]+\)\z"


def one_of(terms: list[str]) -> str:
    return f"(?iu)^({'|'.join(terms)})\\z"


def layout_text(line: Column) -> Column:
    """A line without its bullet and, if it is a lone link, without the target."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(line), r"^[-*]\s+", ""), r"^\[([^\]]+)\]\([^)]+\)\z", "$1"))


def is_layout_line(line: Column, in_nav: Column) -> Column:
    text = layout_text(line)
    lone = F.trim(line).rlike(r"^\[[^\]]{1,40}\]\([^)]+\)\z") & (F.length(text) <= 40)
    return in_nav | text.rlike(one_of(LAYOUT_WORDS)) | text.rlike(one_of(LAYOUT_WIDGETS)) | lone


def is_breadcrumb(line: Column) -> Column:
    return line.rlike("[›»>/]") & ((F.regexp_count(line, F.lit(r"\[[^\]]+\]\([^)]+\)")) >= 2) | line.rlike(f"(?iu){'|'.join(BREADCRUMB_WORDS)}"))


def page_lines(pages: DataFrame) -> DataFrame:
    """job_id, ord, no, line and its normal form."""
    rows = pages.select("job_id", "ord", F.posexplode(lines(F.col("raw"))).alias("no", "line"))
    return rows.withColumn("norm", normalize_line(F.col("line")))


def with_marks(rows: DataFrame) -> DataFrame:
    """Lines with the normal form of their text alone, and whether they are layout wherever they stand."""
    return rows.withColumn("text_norm", normalize_line(layout_text(F.col("line")))).withColumn("chrome", is_layout_line(F.col("line"), F.lit(False)))


def nav_texts(pages: DataFrame) -> DataFrame:
    """Navigation texts of a job with the first page that has each."""
    rows = pages.select("job_id", "ord", F.explode("structure.nav").alias("link"))
    return rows.select("job_id", normalize_line(F.col("link.text")).alias("norm"), "ord").filter("norm != ''").groupBy("job_id", "norm").agg(F.min("ord").alias("first_ord"))


def _grams(text: str) -> Column:
    """Distinct runs of SHORT_FOOTER + 1 characters of a column that has as many or more."""
    width = SHORT_FOOTER + 1
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - SHORT_FOOTER), lambda i: F.substr(text, i, F.lit(width))))


def footer_candidates(pages: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What lines are compared with: (lines with one footer each, grams of footers, footers).

    A line can stand in a footer only if all of its grams stand in footers of its job, so it is looked up by its first one,
    and what is left by all; one that no footer has drops the line. The rarest of them, by the number of footers that hold
    it, then says which footers to try, however many lines and footers begin alike; the first of these is tried alone.
    """
    foot = pages.select("job_id", F.col("structure.footerText").alias("footer")).filter(F.length("footer") > SHORT_FOOTER).distinct().withColumn("of", F.xxhash64("footer"))
    grams = foot.select("job_id", "of", F.explode(_grams("footer")).alias("gram"))
    counts = grams.groupBy("job_id", "gram").agg(F.count("*").alias("footers"), F.min("of").alias("of"))
    texts = rows.select("job_id", F.trim("line").alias("trimmed")).filter(F.length("trimmed") > SHORT_FOOTER).distinct()
    begun = texts.withColumn("gram", F.substring("trimmed", 1, SHORT_FOOTER + 1)).join(counts, ["job_id", "gram"], "left_semi")
    each = begun.select("job_id", "trimmed", F.explode(_grams("trimmed")).alias("gram")).join(counts, ["job_id", "gram"], "left")
    rarest = each.groupBy("job_id", "trimmed").agg(F.min(F.struct("footers", "gram", "of")).alias("r"), F.bool_and(F.col("footers").isNotNull()).alias("all")).filter("all")
    return rarest.select("job_id", "trimmed", "r.gram", "r.of"), grams, foot


def footer_lines(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """Distinct (job_id, trimmed) lines of more than SHORT_FOOTER characters that stand in a footer of the job."""
    lines_, grams, foot = footer_candidates(pages, rows)
    tried = lines_.join(foot, ["job_id", "of"]).groupBy("job_id", "trimmed", "gram").agg(F.bool_or(F.contains("footer", F.col("trimmed"))).alias("found"))
    others = tried.filter("not found").join(grams, ["job_id", "gram"]).join(foot, ["job_id", "of"]).filter(F.contains("footer", F.col("trimmed")))
    return tried.filter("found").select("job_id", "trimmed").union(others.select("job_id", "trimmed").distinct())


def common_lines(pages: DataFrame, rows: DataFrame | None = None, nav: DataFrame | None = None) -> DataFrame:
    """Lines that look like layout (by the navigation seen up to their page) on two fifths of a job's pages, twice at least."""
    rows = page_lines(pages) if rows is None else rows
    nav = nav_texts(pages) if nav is None else nav
    rows = rows if "chrome" in rows.columns else with_marks(rows)
    short = rows.filter("norm != ''").filter(F.length("norm") <= LONGEST_LINE)
    seen = nav.select("job_id", F.col("norm").alias("text_norm"), "first_ord")
    met = short.join(seen, ["job_id", "text_norm"], "left").withColumn("in_nav", F.coalesce(F.col("first_ord") <= F.col("ord"), F.lit(False)))
    met = met.filter(F.col("in_nav") | F.col("chrome") | F.trim("line").rlike(BULLET_LINK))
    counts = met.select("job_id", "ord", "norm").distinct().groupBy("job_id", "norm").agg(F.count("*").alias("pages"))
    total = pages.groupBy("job_id").agg(F.count("*").alias("n"))
    return counts.join(total, "job_id").filter(F.col("pages") >= F.greatest(F.lit(LEAST), F.ceil(F.col("n") * SHARE[0] / SHARE[1]))).select("job_id", "norm", "pages")


def skipped_sections(raw: Column) -> Column:
    """For each heading of a page (no, skip, starts): whether its section is skipped, and whether it is itself a layout heading.

    A layout heading opens a skipped section, also inside another one, whose level it then replaces; a heading that is no
    deeper than the level in force closes it.
    """
    pattern = r"^(#{1,6})\s+(.+)\z"
    all_lines = F.transform(lines(raw), lambda x, i: F.struct(i.alias("no"), F.trim(x).alias("t")))
    heads = F.filter(all_lines, lambda x: x["t"].rlike(pattern))
    heads = F.transform(heads, lambda x: F.struct(x["no"].alias("no"), F.length(F.regexp_extract(x["t"], pattern, 1)).alias("level"), squeeze(F.regexp_extract(x["t"], pattern, 2)).alias("text")))
    heads = F.transform(heads, lambda x: F.struct(x["no"].alias("no"), x["level"].alias("level"), x["text"].rlike(one_of(LAYOUT_SECTIONS)).alias("starts"), x["text"].alias("text")))
    empty = F.expr("cast(array() as array<struct<no:int,skip:boolean,starts:boolean,text:string>>)")

    def step(state, x):
        closed = F.when(state["level"].isNotNull() & (x["level"] <= state["level"]), F.lit(None).cast("int")).otherwise(state["level"])
        level = F.when(x["starts"], x["level"]).otherwise(closed)
        return F.struct(level.alias("level"), F.concat(state["out"], F.array(F.struct(x["no"].alias("no"), level.isNotNull().alias("skip"), x["starts"].alias("starts"), x["text"].alias("text")))).alias("out"))

    return F.aggregate(heads, F.struct(F.lit(None).cast("int").alias("level"), empty.alias("out")), step, lambda s: s["out"])


def line_reasons(pages: DataFrame, save=None) -> DataFrame:
    """Every line with why it is removed: job_id, ord, no, line, reason (null: kept).

    With `save(name, df)` the lines and their normal forms, which four joins read, are made and written once.
    """
    heads = pages.withColumn("heads", skipped_sections(F.col("raw"))).select("job_id", "ord", "heads", F.posexplode(lines(F.col("raw"))).alias("no", "line"))
    at = F.try_element_at(F.filter("heads", lambda h: h["no"] <= F.col("no")), F.lit(-1))
    every = with_marks(heads.withColumn("at", at).withColumn("trimmed", F.trim("line")).drop("heads").withColumn("norm", normalize_line(F.col("line"))))
    every = every if save is None else save("lines", every)
    nav, common = nav_texts(pages), common_lines(pages, every)
    # Blank lines, of which a job has many, meet no index.
    blank = every.filter("trimmed = ''")
    rows = every.filter("trimmed != ''")
    rows = rows.join(common.select("job_id", "norm", F.lit(True).alias("is_common")), ["job_id", "norm"], "left")
    rows = rows.join(nav.select("job_id", "norm", F.lit(True).alias("is_nav")), ["job_id", "norm"], "left")
    rows = rows.join(nav.select("job_id", F.col("norm").alias("text_norm"), F.lit(True).alias("text_nav")), ["job_id", "text_norm"], "left")
    rows = rows.join(footer_lines(pages, every).withColumn("in_footer", F.lit(True)), ["job_id", "trimmed"], "left").unionByName(blank, allowMissingColumns=True)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    by_line = (
        F.when(F.col("trimmed") == "", F.lit(None))
        .when(F.col("trimmed").rlike(r"^!\[[^\]]*\]\([^)]+\)\z"), "image_only")
        .when(flag("is_common"), F.concat(F.lit("repeated:"), F.substring("trimmed", 1, 80)))
        .when(flag("is_nav"), F.concat(F.lit("navigation:"), F.col("trimmed")))
        .when(is_breadcrumb(F.col("trimmed")), "breadcrumbs")
        .when(flag("text_nav") | F.col("chrome"), F.concat(F.lit("layout:"), F.substring("trimmed", 1, 80)))
        .when(flag("in_footer"), "footer")
    )
    opens = F.coalesce(F.col("at.starts") & (F.col("at.no") == F.col("no")), F.lit(False))
    reason = F.when(opens, F.concat(F.lit("section:"), F.col("at.text"))).when(F.coalesce(F.col("at.skip"), F.lit(False)), "").otherwise(by_line)
    return rows.select("job_id", "ord", "no", "line", reason.alias("reason"))


def clean_pages(pages: DataFrame, save=None) -> DataFrame:
    """Pages with cleanedMarkdown, diagnostics, and headings taken from the cleaned text.

    Lines of skipped sections count as removed; only the heading that opens a section leaves an artifact.
    """
    body = F.array_sort(F.collect_list(F.when(F.col("reason").isNull(), F.struct("no", "line"))))
    gone = F.array_sort(F.collect_list(F.when(F.col("reason") != "", F.struct("no", "reason"))))
    per_page = line_reasons(pages, save).groupBy("job_id", "ord").agg(body.alias("body"), gone.alias("gone"), F.count_if(F.col("reason").isNotNull()).alias("removed"))
    out = pages.join(per_page, ["job_id", "ord"]).withColumn("cleanedMarkdown", normalize_markdown(F.array_join(F.transform("body", lambda x: x["line"]), "\n")))
    cleaned, before = normalize_body(F.col("cleanedMarkdown")), F.length(normalize_body(F.col("raw")))
    out = out.withColumn("normalized", cleaned).withColumn("cleanedText", F.length("normalized")).withColumn("rawText", before)
    mostly = (F.col("rawText") > 0) & (1 - F.col("cleanedText") / F.col("rawText") > 0.55)
    warnings = F.array_compact(F.array(F.when(F.col("cleanedText") < 160, "empty_or_short_body"), F.when(mostly, "mostly_navigation_content")))
    diagnostics = F.struct(
        content_confidence(F.col("cleanedText"), F.col("rawText"), F.col("removed")).alias("contentConfidence"), warnings.alias("warnings"),
        F.slice(F.array_distinct(F.transform("gone", lambda x: x["reason"])), 1, 40).alias("removedLayoutArtifacts"), F.col("removed").alias("removedLineCount"),
        F.length("raw").alias("rawChars"), F.length("cleanedMarkdown").alias("cleanedChars"), short_hash(F.col("normalized")).alias("normalizedBodyHash"),
    )
    structure = F.when(F.col("structure").isNotNull(), F.col("structure").withField("headings", headings(F.col("cleanedMarkdown"))))
    return out.withColumn("diagnostics", diagnostics).withColumn("structure", structure).drop("body", "gone", "removed", "cleanedText", "rawText")
