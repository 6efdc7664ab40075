"""Brand data from style sheets: colours by frequency, custom properties and fonts, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import let

COLORS, VARS, FONTS = 8, 40, 6
# Channel differences and levels at which a colour counts as grey, white or black.
GREY, WHITE, BLACK = 24, 243, 13
# Property names that say something about a brand, and values that are colours.
BRAND_NAMES = r"(?i)(color|primary|secondary|accent|brand|background|bg(?![A-Za-z0-9_])|foreground|surface|text|font|radius|ring|border|muted|shadow|spacing)"
COLOR_VALUES = r"(?i)#[0-9a-f]{3,8}(?![0-9a-z_])|(?<![0-9a-z_])(rgb|rgba|hsl|hsla|oklch|oklab)\("


def hex_color(digits: Column) -> Column:
    """#rrggbb of 3, 6 or 8 hexadecimal digits."""
    d = F.lower(digits)
    doubled = F.regexp_replace(d, "(.)", "$1$1")
    return F.concat(F.lit("#"), F.when(F.length(d) == 3, doubled).otherwise(F.substring(d, 1, 6)))


def rgb_color(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb of three numbers; null if one is above 255."""
    parts = [c.try_cast("int") for c in (r, g, b)]
    known = F.greatest(*parts) <= 255
    return F.when(known, F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(p), 2, "0") for p in parts])))


def is_neutral(color: Column) -> Column:
    """Nearly grey, nearly white or nearly black."""
    parts = [F.conv(F.substring(color, i, 2), 16, 10).cast("int") for i in (2, 4, 6)]
    high, low = F.greatest(*parts), F.least(*parts)
    return (high - low < GREY) | (low > WHITE) | (high < BLACK)


def colors(css: Column) -> Column:
    """All colours of a style sheet: hexadecimal ones, then rgb() and rgba() ones, each in order."""
    hexes = F.transform(F.regexp_extract_all(css, F.lit(r"#([0-9a-fA-F]{8}|[0-9a-fA-F]{6}|[0-9a-fA-F]{3})(?![0-9A-Za-z_])"), 1), hex_color)
    pattern = r"rgba?\(\s*(\d+)\s*[,\s]\s*(\d+)\s*[,\s]\s*(\d+)"
    rgbs = F.transform(F.arrays_zip(*[F.regexp_extract_all(css, F.lit(pattern), i).alias(n) for i, n in ((1, "r"), (2, "g"), (3, "b"))]), lambda x: rgb_color(x["r"], x["g"], x["b"]))
    return F.array_compact(F.concat(hexes, rgbs))


def color_histogram(sheets: DataFrame, css_col: str = "css") -> DataFrame:
    """job_id, hex, n, neutral, first_pos; a theme colour in `themeColor` counts once as well."""
    every = colors(F.col(css_col))
    if "themeColor" in sheets.columns:
        every = F.concat(F.coalesce(colors(F.col("themeColor")), F.expr("cast(array() as array<string>)")), every)
    rows = sheets.select("job_id", F.posexplode(every).alias("pos", "hex"))
    return rows.groupBy("job_id", "hex").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos")).withColumn("neutral", is_neutral(F.col("hex")))


def brand_colors(sheets: DataFrame, css_col: str = "css", most: int = COLORS) -> DataFrame:
    """The most frequent colours of each job, accents before neutral ones: job_id, rank, hex, n."""
    order = Window.partitionBy("job_id").orderBy("neutral", F.desc("n"), "first_pos")
    return color_histogram(sheets, css_col).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("job_id", "rank", "hex", "n")


def css_vars(css: Column) -> Column:
    """Custom properties, the first value of each name: array of (name, value) in order."""
    pattern = r"(--[a-zA-Z0-9_-]+)\s*:\s*([^;}\n]+)"
    found = F.arrays_zip(F.regexp_extract_all(css, F.lit(pattern), 1).alias("name"), F.regexp_extract_all(css, F.lit(pattern), 2).alias("value"))
    names = F.array_distinct(F.transform(found, lambda x: x["name"]))
    first = lambda rows: F.transform(names, lambda n: F.struct(n.alias("name"), F.trim(F.element_at(F.transform(F.filter(rows, lambda x: x["name"] == n), lambda x: x["value"]), 1)).alias("value")))
    return let(found, first)


def relevant_css_vars(css: Column, most: int = VARS) -> Column:
    return F.slice(F.filter(css_vars(css), lambda x: x["name"].rlike(BRAND_NAMES) | x["value"].rlike(COLOR_VALUES)), 1, most)


def fonts(css: Column, most: int = FONTS) -> Column:
    """First families of font-family declarations, in order, keywords left out."""
    first = F.transform(F.regexp_extract_all(css, F.lit(r"(?i)font-family\s*:\s*([^;}\n]+)"), 1), lambda x: F.regexp_replace(F.trim(F.element_at(F.split(x, ","), 1)), "^[\"']|[\"']$", ""))
    return F.slice(F.array_distinct(F.filter(first, lambda x: (x != "") & ~x.rlike(r"(?i)^(inherit|initial|unset|var\()"))), 1, most)
