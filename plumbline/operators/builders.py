"""Corpus builders over landed pages: choice of addresses, listings, speech records of several sources, meeting documents, supplements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.dates import readable_day

from .corpus import ranked_merge

#: Words below which a body is short, and characters a speech page must have.
SHORT_WORDS, LEAST_CHARACTERS, SUPPLEMENT_WORDS = 120, 40, 80
#: Names whose mention makes a supplement one of the institution.
INSTITUTIONS = r"(?i)Board of Governors of the Federal Reserve System|Federal Open Market Committee"


def _flags(**held: Column) -> Column:
    """Array of the names whose condition holds, in order."""
    listed = F.array(*[F.when(c, F.lit(n)) for n, c in held.items()])
    return F.filter(listed, lambda x: x.isNotNull())


def first_acceptable(tries: DataFrame, keys: list[str], rank: str, url: str, text: str, document: Column | None = None, min_words: int = SHORT_WORDS) -> DataFrame:
    """(keys, text, source_url, flags): per key the first address by ``rank`` whose text has ``min_words`` words.

    Else the first with any text, flagged short_body; else an empty text at the first address, flagged http_error where an
    address gave nothing (null text), pdf_unreadable where a document in ``document`` (default: an address in .pdf) gave an
    empty text, and no_text. Null addresses count like others.
    """
    is_document = document if document is not None else F.coalesce(F.lower(F.col(url)).endswith(".pdf"), F.lit(False))
    body = F.coalesce(F.col(text), F.lit(""))
    words = T.word_count(body)
    row = F.struct(body.alias("text"), F.col(url).alias("url"))
    order = F.struct(F.col(rank), F.coalesce(F.col(url), F.lit("")))
    best = tries.groupBy(*keys).agg(
        F.min_by(row, F.when(words >= min_words, order)).alias("good"), F.min_by(row, F.when(F.length(body) > 0, order)).alias("some"), F.min_by(F.col(url), order).alias("first"),
        F.max((F.col(text).isNull() | ((F.length(body) == 0) & ~is_document))).alias("failed"), F.max(F.col(text).isNotNull() & (F.length(body) == 0) & is_document).alias("unreadable"),
    )
    none = F.col("some").isNull()
    chosen = F.coalesce("good", "some")
    return best.select(
        *keys, F.coalesce(chosen["text"], F.lit("")).alias("text"), F.when(none, F.col("first")).otherwise(chosen["url"]).alias("source_url"),
        _flags(short_body=F.col("good").isNull() & ~none, http_error=none & F.col("failed"), pdf_unreadable=none & F.col("unreadable"), no_text=none).alias("flags"),
    )


def discovered(listings: DataFrame, html: str, base: str, kinds: tuple[str, ...] = ("speech", "testimony"), prefix: str = "/newsevents") -> DataFrame:
    """(url, kind): the distinct addresses of the kinds that listing pages link to."""
    pattern = rf'(?i)href="({prefix}/(?:{"|".join(kinds)})/[a-z0-9]+\.htm)"'
    links = listings.select(F.explode(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pattern), F.lit(1))).alias("link")).distinct()
    return links.select(F.concat(F.lit(base), "link").alias("url"), F.lower(F.regexp_extract("link", rf"{prefix}/([A-Za-z]+)/", 1)).alias("kind"))


def speech_records(pages: DataFrame) -> DataFrame:
    """Speech records from parsed pages (url, day, participant, title, body, fallback_participant, fallback_title).

    The day is the page's, else the first in its address; a record needs a participant, a day and ``LEAST_CHARACTERS``
    characters; fewer than ``SHORT_WORDS`` words are flagged short_body.
    """
    filled = lambda a, b: F.when(F.length(F.trim(F.coalesce(a, F.lit("")))) > 0, F.col(a)).otherwise(F.coalesce(b, F.lit("")))
    title = filled("title", "fallback_title")
    body = F.coalesce("body", F.lit(""))
    document = F.when(title != "", T.strip(F.concat(title, F.lit(". "), body))).otherwise(body)
    slug = F.regexp_extract("url", r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)
    day = F.coalesce(F.date_format(readable_day(F.col("day")), "yyyyMMdd"), F.nullif(F.regexp_extract(slug, r"(\d{8})", 1), F.lit("")))
    out = pages.select(slug.alias("slug"), "url", day.alias("date"), filled("participant", "fallback_participant").alias("participant"), document.alias("text_content"))
    kept = out.where((F.col("participant") != "") & F.col("date").isNotNull() & (F.length("text_content") >= LEAST_CHARACTERS))
    return kept.withColumn("quality_flags", _flags(short_body=T.word_count(F.col("text_content")) < SHORT_WORDS))


def speech_corpus(sources: list[DataFrame], first_day: str, last_day: str) -> DataFrame:
    """Speech records of several sources in order of trust, the first source's of each slug, within the days."""
    bounded = [s.where(F.col("date").between(first_day, last_day)) for s in sources]
    return ranked_merge(bounded, ["slug"], "url")


def meeting_documents(meetings: DataFrame, documents: DataFrame, types: tuple[str, ...] = ("statement", "minutes", "press_conf")) -> DataFrame:
    """(site, day, document_type, text, source_url, flags, decision, high, low): one row a meeting and type, labels carried forward.

    ``documents`` holds the chosen document of each (site, day, document_type) with the labels its statement gave, if any.
    A meeting without labels has those of the site's last meeting that had some, before the first maintain, 0 and 0; a
    missing document is an empty text flagged no_text.
    """
    window = Window.partitionBy("site").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    stated = documents.where(F.col("document_type") == "statement").select("site", "day", F.when(F.col("decision").isNotNull(), F.struct("decision", "high", "low")).alias("own"))
    labelled = meetings.select("site", "day").distinct().join(stated, ["site", "day"], "left").withColumn("label", F.last("own", True).over(window)).drop("own")
    wanted = labelled.withColumn("document_type", F.explode(F.array(*[F.lit(t) for t in types])))
    out = wanted.join(documents.select("site", "day", "document_type", "text", "source_url", "flags"), ["site", "day", "document_type"], "left")
    return out.select(
        "site", "day", "document_type", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source_url", F.lit("")).alias("source_url"),
        F.when(F.col("text").isNull(), F.array(F.lit("no_text"))).otherwise(F.coalesce("flags", F.array().cast("array<string>"))).alias("flags"),
        *[F.coalesce(F.col(f"label.{c}"), F.lit(v)).alias(c) for c, v in (("decision", "maintain"), ("high", "0"), ("low", "0"))],
    )


def mentions_institution(*texts: Column, pattern: str = INSTITUTIONS) -> Column:
    """Whether any of the texts, joined by blanks, mentions the institution; nulls count as empty."""
    return F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts]).rlike(pattern)


def supplements(landed: DataFrame, domain: str, first_day: str = "20200101", pattern: str = INSTITUTIONS, min_words: int = SUPPLEMENT_WORDS) -> DataFrame:
    """(date, domain, participant, text_content) from a landed archive (date, author, title, description, text).

    Rows that mention the institution, have a readable day from ``first_day`` on, an author and a text, and at least
    ``min_words`` words; the title leads the text.
    """
    day = F.date_format(F.coalesce(readable_day(F.col("date")), readable_day(F.substring(F.trim("date"), 1, 10))), "yyyyMMdd")
    document = T.strip(F.concat(T.strip(F.coalesce("title", F.lit(""))), F.lit(". "), T.strip(F.coalesce("text", F.lit("")))))
    named = landed.where(mentions_institution(F.col("description"), F.col("text"), F.col("title"), pattern=pattern) & F.col("author").isNotNull() & F.col("text").isNotNull())
    out = named.select(day.alias("date"), F.lit(domain).alias("domain"), T.strip(F.col("author")).alias("participant"), document.alias("text_content"))
    return out.where((F.col("date") >= first_day) & (T.word_count(F.col("text_content")) >= min_words))
