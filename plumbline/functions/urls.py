"""Addresses: parts, keys, dates in them, candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def cache_key(url: Column, longest: int = 200) -> Column:
    """File name for an address: its path with other signs than letters, digits, dots and dashes as underscores."""
    return F.substring(F.regexp_replace(path_of(url), r"[^A-Za-z0-9_.-]+", "_"), 1, longest)


def day_in(url: Column) -> Column:
    """The first YYYYMMDD of this century in an address; null without one."""
    return F.nullif(F.regexp_extract(url, r"(20\d{6})", 1), F.lit(""))


def candidates(base: str, patterns: tuple[str, ...], day: Column) -> Column:
    """Addresses to try for a day, in order; ``{day}`` stands for it."""
    return F.array(*[F.replace(F.lit(base + p), F.lit("{day}"), day) for p in patterns])


def ends_with_any(host: Column, suffixes: tuple[str, ...], parts: tuple[str, ...] = ()) -> Column:
    """Whether a host ends in one of the suffixes or holds one of the parts, letter case aside."""
    low = F.lower(F.coalesce(host, F.lit("")))
    out = F.lit(False)
    for s in suffixes:
        out = out | low.endswith(s)
    for p in parts:
        out = out | F.contains(low, F.lit(p))
    return out


def published_day(value: Column) -> Column:
    """Day of a time written as ISO with zone, compact ISO, ISO day, or month name, day, year (a clock time and zone after it is dropped)."""
    from .dates import readable_day

    text = F.trim(value)
    clock = F.regexp_replace(text, r"(?i)\s+\d{1,2}:\d{2}[ap]m\s+[A-Z]{2,4}$", "")
    return F.coalesce(readable_day(F.regexp_extract(text, r"^(\d{4}-?\d{2}-?\d{2})(?:T[\d:.]+(?:Z|[+-]\d{2}:?\d{2})?)?$", 1)), readable_day(clock))


#: Forms of the addresses of a meeting's documents and of the yearly listings, in the order they are tried.
DOCUMENT_FORMS = {
    "statement": ("/newsevents/pressreleases/monetary{day}a.htm", "/newsevents/pressreleases/monetary{day}b.htm"),
    "minutes": ("/monetarypolicy/fomcminutes{day}.htm", "/monetarypolicy/files/fomcminutes{day}.pdf"),
    "press_conf": ("/mediacenter/files/FOMCpresconf{day}.pdf", "/mediacenter/files/FOMCpresconf{day}.pdf?stream=top"),
    "speech_list": ("/newsevents/speech/{year}-speeches.htm",), "testimony_list": ("/newsevents/testimony/{year}-testimony.htm",),
}


def document_addresses(base: str, day: Column) -> Column:
    """Map of document kind to the addresses to try for a day written as YYYYMMDD."""
    year = F.substring(day, 1, 4)
    filled = lambda form: F.replace(F.replace(F.lit(base + form), F.lit("{day}"), day), F.lit("{year}"), year)
    return F.create_map(*[x for kind, forms in DOCUMENT_FORMS.items() for x in (F.lit(kind), F.array(*map(filled, forms)))])
