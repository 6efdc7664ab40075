"""Text columns: normal forms of Markdown lines and bodies, hashes, shingles, and Markdown parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE = r"!\[[^\]]*\]\([^)]+\)"
LINK = r"\[([^\]]+)\]\([^)]+\)"
#: White space as browsers see it: ASCII white space, no-break space and the Unicode spaces.
SPACE = r"[\s   -     　﻿]"
#: Characters that are no white space, as two ranges that most text is of.
PLAIN = "[!-~À-ɏ]"
#: Word boundaries that count ASCII letters, digits and underscore as word characters.
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
# Image and document extensions that aren't body text.
FILE_WORDS = ["jpg", "jpeg", "png", "webp", "gif", "svg", "pdf"]


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, where the body uses it inside a lambda that runs for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squeeze(text: Column) -> Column:
    """White space as single spaces, none at the ends.

    A run is matched if it isn't a single space already; letters and marks are ruled out by a range before the class is tried.
    """
    return F.trim(F.regexp_replace(text, f" (?!{PLAIN}){SPACE}+|(?![ {PLAIN[1:]}){SPACE}+", " "))


def lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def normalize_line(line: Column) -> Column:
    """A line's words in lower case: no images, link texts without targets, marks and punctuation as spaces."""
    plain = F.regexp_replace(F.regexp_replace(line, IMAGE, ""), LINK, "$1")
    return F.lower(squeeze(F.regexp_replace(plain, r"[#*_`>\[\]().,:;|]+", " ")))


def normalize_body(markdown: Column) -> Column:
    """Plain lower-case text of Markdown, for comparing bodies."""
    text = F.regexp_replace(F.regexp_replace(markdown, IMAGE, " "), LINK, "$1")
    text = F.regexp_replace(F.regexp_replace(text, r"https?://\S+", " "), r"[#*_`>|-]+", " ")
    return squeeze(F.lower(F.regexp_replace(text, f"(?i)(?=[gjpsw]){LEFT}({'|'.join(FILE_WORDS)}){RIGHT}", " ")))


def normalize_markdown(markdown: Column) -> Column:
    """Lines without trailing blanks, at most one empty line between others, one line end at the end."""
    text = F.regexp_replace(F.regexp_replace(markdown, r"\r\n", "\n"), r"(?m)[ \t]+$", "")
    return F.concat(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), f"^{SPACE}+|{SPACE}+\\z", ""), F.lit("\n"))


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct runs of n words; a shorter text gives one run of all its words."""
    runs = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (n - 1))), lambda i: F.array_join(F.slice(w, i, n), " ")))
    return let(words(text), runs)


def hashed_shingles(text: Column, n: int = 3) -> Column:
    """Distinct hashes of the runs that `shingles` gives, for a text of single spaces; no run is built as a string."""
    run = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - n)), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)]))
    return F.array_distinct(let(F.split(text, " "), run))


def jaccard_hundredths(overlap: Column, union: Column) -> Column:
    """overlap/union in hundredths, rounded half up in whole numbers."""
    return F.floor((overlap * 200 + union) / (union * 2)).cast("long")


def length_bucket(n: Column) -> Column:
    return F.when(n > 0, F.floor(F.log(n.cast("double")) / F.log(F.lit(1.1)))).otherwise(0).cast("int")


def headings(markdown: Column, deepest: int = 3) -> Column:
    """Markdown headings: array of (level, text)."""
    pattern = rf"^(#{{1,{deepest}}})\s+(.+)\z"
    found = F.filter(lines(markdown), lambda x: x.rlike(pattern))
    return F.transform(found, lambda x: F.struct(F.length(F.regexp_extract(x, pattern, 1)).alias("level"), squeeze(F.regexp_extract(x, pattern, 2)).alias("text")))


def fact_source(markdown: Column) -> Column:
    """Markdown without images, link targets, bare URLs and tags."""
    text = F.regexp_replace(F.regexp_replace(markdown, r"!\[[^\]]*\]\([^\n)]*\)", " "), r"\[([^\]]+)\]\([^\n)]*\)", "$1")
    return F.regexp_replace(F.regexp_replace(text, r"(?i)https?://\S+", " "), r"<[^>]+>", " ")


def markdown_images(markdown: Column, most: int = 20) -> Column:
    pattern = r"!\[([^\]]*)\]\(([^)]+)\)"
    found = F.arrays_zip(F.regexp_extract_all(markdown, F.lit(pattern), 2).alias("url"), F.regexp_extract_all(markdown, F.lit(pattern), 1).alias("alt"))
    return F.slice(F.transform(found, lambda x: F.struct(x["url"].alias("url"), F.nullif(x["alt"], F.lit("")).alias("alt"))), 1, most)


def markdown_links(markdown: Column) -> Column:
    """Links, and like them the alternative text of images."""
    pattern = r"\[([^\]]+)\]\(([^)]+)\)"
    found = F.arrays_zip(F.regexp_extract_all(markdown, F.lit(pattern), 1).alias("text"), F.regexp_extract_all(markdown, F.lit(pattern), 2).alias("href"))
    return F.transform(found, lambda x: F.struct(squeeze(x["text"]).alias("text"), x["href"].alias("href")))


def content_confidence(cleaned_chars: Column, raw_chars: Column, removed_lines: Column) -> Column:
    """0.94, less for short bodies, for much removed text and for removed lines; between 0.2 and 0.98, in hundredths."""
    removed = F.when(raw_chars > 0, 1 - cleaned_chars / raw_chars).otherwise(0.0)
    hundredths = F.lit(94) - F.when(cleaned_chars < 160, 25).otherwise(0) - F.when(removed > 0.55, 25).otherwise(0) - F.least(F.lit(12), removed_lines)
    return F.greatest(F.lit(20), F.least(F.lit(98), hundredths)) / 100.0
