"""Day and site expressions over text columns (Catalyst only, ANSI-safe)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_NAMES = (
    "january|february|march|april|may|june|july|august|september|october|november|december"
    "|jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec"
)


def readable_day(value: Column) -> Column:
    """Date of a day written as YYYYMMDD (also with ``.0``), ISO, month/day/year or month name, day, year; else null."""
    text = F.lower(F.trim(value))
    digits = r"^(\d{4})(\d{2})(\d{2})(?:\.0)?$"
    iso = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    us = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    named = rf"^({_NAMES})\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})$"

    def parts(pattern: str, year: int, month: int, day: int) -> Column:
        return F.concat_ws(
            "-",
            F.regexp_extract(text, pattern, year),
            F.lpad(F.regexp_extract(text, pattern, month), 2, "0"),
            F.lpad(F.regexp_extract(text, pattern, day), 2, "0"),
        )

    ordinal = (F.instr(F.lit(_MONTHS), F.substring(text, 1, 3)) + F.lit(2)) / 3
    month = F.lpad(ordinal.cast("int").cast("string"), 2, "0")
    by_name = F.concat_ws(
        "-", F.regexp_extract(text, named, 3), month, F.lpad(F.regexp_extract(text, named, 2), 2, "0")
    )
    shaped = (
        F.when(text.rlike(digits), parts(digits, 1, 2, 3))
        .when(text.rlike(iso), parts(iso, 1, 2, 3))
        .when(text.rlike(us), parts(us, 3, 1, 2))
        .when(text.rlike(named), by_name)
    )
    return F.try_to_date(shaped, "yyyy-MM-dd")


def day_number(value: Column) -> Column:
    """Days since 1970-01-01 of ``readable_day``."""
    return F.unix_date(readable_day(value))


def site_of(url: Column, domain: Column | None = None) -> Column:
    """Host in ``domain``, or that of ``url`` where it is null, lower-cased, without a leading www., m. or amp."""
    host = F.nullif(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/:?#\s]+)", 1), F.lit(""))
    if domain is not None:
        host = F.coalesce(domain, host)
    return F.nullif(F.regexp_replace(F.lower(F.trim(host)), r"^(?:www|m|amp)\.", ""), F.lit(""))
