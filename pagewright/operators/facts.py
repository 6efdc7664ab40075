"""Numeric and contact facts of pages: extraction with span claiming, and collapsing of facts that pages share.

Extraction is sequential within a page, as an earlier kind claims its spans, so it runs as one Arrow function; patterns
are matched on the text that built-in expressions have prepared. Collapsing is a grouped aggregation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import fact_source

AROUND = 80
#: Pages whose facts, and how many facts, a task holds at a time.
AT_ONCE, HELD = 256, 4096
W, E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
LOWER = "a-ząćęłńóśźżäöüß"
# What facts of each kind look like, units, labels and words of context.
CURRENCIES = ["zł", "pln", "eur", "usd", "gbp", "chf", "€", r"\$", "£"]
UNITS = ["mm", "cm", "dm", "m", "km", "ml", "l", "g", "kg", "mg", r"szt\.?", r"stk\.?", r"pcs\.?", "cala?", "inch(?:es)?", '"', "dni", "dzie[nń]", "day(?:s)?", "tag(?:e|en)?", "tygodni?e?", "week(?:s)?", "woche(?:n)?", "miesi[ąę]c[ey]?", "month(?:s)?", "monat(?:e|en)?", "lat[a]?", "rok[u]?", "year(?:s)?", "jahr(?:e|en)?", r"godz\.?", "hour(?:s)?", "stunde(?:n)?", r"min\.?", "h"]
TAX_LABELS = ["NIP", "REGON", "KRS", r"USt[-.\s]?IdNr\.?", "Steuernummer", r"VAT(?:\s+ID)?", r"Company (?:No|Number)\.?"]
BANK_LABELS = ["IBAN", "konto", "rachunek", "nr rachunku", "bank", "account number", "kontonummer"]
SKU_LABELS = ["SKU", "kod", "indeks", "nr katalogowy", "numer katalogowy", r"art\.?\s?nr\.?", r"artikel(?:nummer|[-\s]?nr\.?)", "bestellnummer", r"item no\.?", "product code", r"catalog(?:ue)? no\.?"]
COUNT_WORDS = ["ponad", "około", r"ok\.", "minimum", "maksimum", "liczba", "ilość", "sztuk", r"szt\.", "projektów", "realizacji", "klientów", "produktów", "zamówień", "lat doświadczenia", "pracowników", "egzemplarzy", "over", "more than", "about", r"approx\.?", "number of", "clients", "customers", "projects", "products", "orders", "employees", "years of experience", "über", "mehr als", "etwa", r"ca\.", "anzahl", "kunden", "projekte", "produkte", "bestellungen", "mitarbeiter", "jahre erfahrung"]
PHONE_WORDS = [r"tel\.?", "telefon", "phone", "mobile", "handy", "rufnummer", "kontakt", "contact", r"kom\.?", "fax", r"\+"]
YEAR_WORDS = ["od", "rok", "roku", "lat", "założ", "powsta", "data", "since", "founded", "established", "year", "seit", "gegründet", "jahr", "copyright", "©"]
FILES = ["jpg", "jpeg", "png", "webp", "gif", "svg", "pdf"]
ASSET_WORDS = ["src", "href", "image", "img", "thumbnail", "thumb", "attachment", "uploads?", "wp-content", "cdn", "static", "assets?", *FILES]
PLAIN_LABELS = ["NIP", "REGON", "KRS", "SKU", "kod", "cena", "wymiar", "średnica", "wysokość", "szerokość", "długość", "telefon", r"tel\.?", "konto", "rachunek"]
LABELLED_SKU = ["SKU", "kod", "indeks", "nr katalogowy", "numer katalogowy", "artikelnummer", "bestellnummer", r"item no\.?", "product code"]
LABEL_LETTERS = "A-ZÄÖÜĄĆĘŁŃÓŚŹŻa-zäöüßąćęłńóśźż"

alt = "|".join
PATTERNS = {
    "email": rf"{W}[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}{E}",
    "bank_account": rf"{W}(?:{alt(BANK_LABELS)})[:\s-]*(?:[A-Z]{{2}}[0-9]{{2}}\s?)?[0-9](?:[\s-]?[0-9]){{14,30}}{E}",
    "tax_id": rf"{W}(?:{alt(TAX_LABELS)})[:\s-]*[A-Z]{{0,3}}\s?[0-9][0-9\s-]{{6,}}[0-9]{E}",
    "sku": rf"{W}(?:{alt(SKU_LABELS)})[:\s-]+([A-Z0-9][A-Z0-9._/-]{{2,}}){E}",
    "price": rf"(?:[€$£]\s?[0-9][0-9\s.,]*[0-9]|[0-9][0-9\s.,]*[0-9]\s?(?:{alt(CURRENCIES)}))",
    "measurement": rf"{W}[0-9][0-9.,]*\s?(?:{alt(UNITS)})(?![{LOWER}])",
    "percentage": rf"{W}[0-9][0-9.,]*\s?%",
    "date": rf"{W}[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-](?:19|20)?[0-9]{{2}}{E}",
    "year": rf"{W}(?:19|20)[0-9]{{2}}{E}",
    "phone": r"\+?[0-9][0-9\s().-]{6,}[0-9]",
    "count": rf"{W}(?:[0-9]{{1,3}}(?:[.,\s][0-9]{{3}})+|[0-9]{{3,6}}){E}",
}  # in the order in which kinds claim their spans
FIND = {k: re.compile(p, re.I) for k, p in PATTERNS.items()}
COUNTS, PHONES, YEARS = (re.compile(alt(x), re.I) for x in (COUNT_WORDS, PHONE_WORDS, YEAR_WORDS))
ASSETS = re.compile(rf"!\[[^\]]*\]\([^)]+\)|{W}(?:{alt(ASSET_WORDS)}){E}|[-_/][a-f0-9]{{6,}}{E}|\.(?:{alt(FILES)}){E}", re.I)
PLAIN = re.compile(rf"{W}(?:{alt(PLAIN_LABELS)}){E}", re.I)
FILE_END = re.compile(rf"\.(?:{alt(FILES)})(?:\)|\s|$)", re.I)
LABEL = re.compile(rf"([{LABEL_LETTERS} ]{{3,32}})[:：-]\s*$")
MARKS = re.compile(r"[#*_`\[\]()]")


def squeeze(text: str) -> str:
    return " ".join(text.replace("\x1c", " ").split())


def is_asset_noise(context: str, value: str) -> bool:
    """A number from a file name or address rather than the text, unless a label stands by it."""
    if not ASSETS.search(context) or PLAIN.search(context):
        return False
    return sum(c in "0123456789" for c in value) >= 3 or bool(FILE_END.search(context))


def label_of(context: str, value: str, kind: str) -> str | None:
    """A label left of the value, else one that the kind implies."""
    at = context.lower().find(value.lower())
    left = context[max(0, at - 48) : at] if at >= 0 else context[:48]
    found = LABEL.search(squeeze(MARKS.sub(" ", left)))
    if found and found[1].strip():
        return found[1].strip()
    if kind == "price":
        return "Cena" if re.search("cena|price|preis", context, re.I) else None
    if kind == "tax_id":
        found = re.search(rf"{W}({alt(TAX_LABELS[:-1])}){E}", context, re.I)
        return found[1].upper() if found else None
    if kind == "sku":
        found = re.search(rf"{W}({alt(LABELLED_SKU)}){E}", context, re.I)
        return found[1] if found else None
    return {"phone": "Telefon", "email": "Email", "bank_account": "Rachunek bankowy"}.get(kind)


def unit_of(kind: str, value: str) -> str | None:
    found = {"price": re.compile(alt(c for c in CURRENCIES if c != "chf"), re.I), "measurement": re.compile(rf'[{LOWER}."]+$', re.I)}.get(kind)
    return "%" if kind == "percentage" else (m[0] if found and (m := found.search(value)) else None)


def page_facts(text: str) -> Iterator[dict]:
    """All facts of one prepared text, in claiming order. A repeated kind and value is passed over without claiming its span.

    Claimed spans don't overlap and are kept in order, as are the matches of a kind, so one walk over both tells what is claimed.
    """
    seen: set[tuple[str, str]] = set()
    claimed: list[tuple[int, int]] = []
    for kind, pattern in FIND.items():
        at, own = 0, []
        for m in pattern.finditer(text):
            start, end = m.span()
            while at < len(claimed) and claimed[at][1] <= start:
                at += 1
            if at < len(claimed) and claimed[at][0] < end:
                continue
            value = m[1] if kind == "sku" else squeeze(m[0])
            if kind == "sku" and not any(c.isdigit() for c in value) and value != value.upper():
                continue
            digits = sum(c in "0123456789" for c in value)
            if kind == "phone" and not 7 <= digits <= 15:
                continue
            context = squeeze(text[max(0, start - AROUND) : end + AROUND])
            if is_asset_noise(context, value) or (kind == "phone" and not PHONES.search(context)) or (kind == "count" and not COUNTS.search(context)):
                continue
            actual = "year" if kind == "measurement" and re.match(rf"(?:19|20)[0-9]{{2}}{E}", value) else kind
            if (actual, value) in seen:
                continue
            seen.add((actual, value))
            own.append((start, end))
            weak = actual == "year" and not YEARS.search(context)
            yield {"kind": actual, "value": value, "unit": unit_of(actual, value), "label": label_of(context, value, actual), "context": context, "confidence": 0.55 if weak else 0.9, "needsReview": weak}
        claimed = sorted(claimed + own)


FACT = pa.struct([("kind", pa.string()), ("value", pa.string()), ("unit", pa.string()), ("label", pa.string()), ("context", pa.string()), ("confidence", pa.float64()), ("needsReview", pa.bool_())])
SCHEMA = "job_id string, ord long, n int, slug string, url string, fact struct<kind:string,value:string,unit:string,label:string,context:string,confidence:double,needsReview:boolean>"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each fact; a page of many facts comes back in parts."""
    for part in (batch.slice(i, AT_ONCE) for batch in batches for i in range(0, batch.num_rows, AT_ONCE)):
        page, n, found = [], [], []

        def rows() -> pa.RecordBatch:
            job_id, ord_, slug, url = (c.take(pa.array(page, pa.int32())) for c in part.columns[:4])
            return pa.RecordBatch.from_arrays([job_id, ord_, pa.array(n, pa.int32()), slug, url, pa.array(found, FACT)], names=["job_id", "ord", "n", "slug", "url", "fact"])

        for i, text in enumerate(part.column(4)):
            for k, fact in enumerate(page_facts(text.as_py() or "")):
                page.append(i), n.append(k), found.append(fact)
                if len(found) >= HELD:
                    yield rows()
                    page, n, found = [], [], []
        if found:
            yield rows()


def extract_facts(pages: DataFrame, text_col: str = "raw") -> DataFrame:
    """One row per fact: job_id, ord, n (its place in the page), slug, url and the fact's columns. All pages count, duplicates too."""
    rows = pages.select("job_id", "ord", "slug", "url", fact_source(F.col(text_col)).alias("text"))
    return rows.mapInArrow(_extract, SCHEMA).select("job_id", "ord", "n", "slug", "url", "fact.*")


def semantic_key(kind: Column, value: Column, label: Column, context: Column) -> Column:
    """Facts that say the same: kind, value, and the label or the context with the value (its first mention) as #."""
    about = F.lower(F.coalesce(label, context))
    place = F.call_function("instr", about, F.lower(value))
    swapped = F.when(place > 0, F.concat(F.substr(about, F.lit(1), place - 1), F.lit("#"), F.substr(about, place + F.length(value)))).otherwise(about)
    plain = F.regexp_replace(F.regexp_replace(swapped, r"https?://\S+", " "), "[^a-z0-9ąćęłńóśźżäöüß#%]+", " ")
    return F.concat_ws(":", kind, F.lower(value), F.trim(plain))


def collapse_facts(facts: DataFrame) -> DataFrame:
    """One row per job and semantic key: the first clean fact, or the first of all, with occurrences and up to ten other pages.

    The list leaves out the page of the fact that is kept, also when a clean fact takes the place of an earlier one.
    """
    keyed = facts.withColumn("key", semantic_key(F.col("kind"), F.col("value"), F.col("label"), F.col("context")))
    cols = [c for c in facts.columns if c != "job_id"]
    best = keyed.groupBy("job_id", "key").agg(F.min_by(F.struct(*cols), F.struct("needsReview", "ord", "n")).alias("f"), F.count("*").alias("occurrences"))
    # Each page once, ranked by its first mention; only the first eleven can be listed.
    pages = keyed.groupBy("job_id", "key", "slug").agg(F.min(F.struct("ord", "n")).alias("at"))
    ranked = pages.withColumn("r", F.row_number().over(Window.partitionBy("job_id", "key").orderBy("at"))).filter("r <= 11")
    others = ranked.groupBy("job_id", "key").agg(F.array_sort(F.collect_list(F.struct("r", "slug"))).alias("pages"))
    out = best.join(others, ["job_id", "key"])
    also = F.slice(F.filter(F.transform("pages", lambda x: x["slug"]), lambda s: s != F.col("f.slug")), 1, 10)
    return out.select("job_id", "key", "f.*", "occurrences", also.alias("alsoOn"))


def matches(text: Column, kind: str) -> Column:
    """All matches of one kind's pattern alone, for counting and profiling without claims."""
    return F.regexp_extract_all(text, F.lit(f"(?iu){PATTERNS[kind]}"), 0)
