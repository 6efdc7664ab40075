"""Predicates on addresses, HTTP answers and robots rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_public_ipv4(ip: Column) -> Column:
    """Four numbers of 0 to 255 outside the reserved ranges."""
    parts = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("double"))
    a, b, c = (F.try_element_at(parts, F.lit(i)) for i in (1, 2, 3))
    well = (F.size(parts) == 4) & F.forall(parts, lambda n: F.coalesce((n >= 0) & (n <= 255), F.lit(False)))
    reserved = a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127)) | ((a == 192) & (b == 0) & (c == 0)) | ((a == 198) & b.isin(18, 19))
    return F.coalesce(well & ~reserved, F.lit(False))


def is_public_ipv6(ip: Column) -> Column:
    """Outside the loopback, link-local, unique-local and multicast ranges; an IPv4 tail decides if there is one."""
    address = F.regexp_extract(F.lower(ip), "^[^%]*", 0)
    tail = F.regexp_extract(address, r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\z", 1)
    return F.when(address.isin("::", "::1"), False).when(tail != "", is_public_ipv4(tail)).otherwise(~address.rlike("^(fe80|fc|fd|ff)"))


def is_html(content_type: Column) -> Column:
    lowered = F.lower(F.coalesce(content_type, F.lit("")))
    return lowered.contains("text/html") | lowered.contains("application/xhtml+xml")


def is_redirect(status: Column) -> Column:
    return F.coalesce(status.isin(301, 302, 303, 307, 308), F.lit(False))


def robots_pattern(rule: Column) -> Column:
    """A robots path as a regular expression: `*` for anything, a final `$` for the end."""
    body = F.regexp_replace(rule, r"\$$", "")
    quoted = F.regexp_replace(F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1"), r"\*", ".*")
    return F.concat(F.lit("^"), quoted, F.when(rule.endswith("$"), F.lit(r"\z")).otherwise(F.lit("")))


def decode_xml(text: Column) -> Column:
    """The five XML entities, the ampersand first."""
    for entity, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text
