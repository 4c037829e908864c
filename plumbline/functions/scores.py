"""Scores and numeric expressions over corpus columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from . import text as T


def quality_score(count: Column, flags: Column) -> Column:
    """1 less the fixed deductions for flags and for fewer than 120 words, kept in 0..1, in whole tenths."""
    held = F.coalesce(flags, F.array().cast("array<string>"))
    has = lambda *names: F.arrays_overlap(held, F.array(*[F.lit(n) for n in names])).cast("int")
    short = (F.coalesce(count, F.lit(0)) < 120).cast("int")
    tenths = 10 - 4 * has("no_text") - 2 * has("pdf_unreadable") - 2 * has("html_structure_unknown") - has("http_error", "http_404") - short
    return F.least(F.greatest(tenths, F.lit(0)), F.lit(10)) / 10.0


def direction(value: Column) -> Column:
    """Synonyms of a decision as lower, maintain or raise; anything else as it stands, trimmed in lower case."""
    raw = F.lower(F.trim(value))
    known = F.create_map(*[x for k, v in L.DIRECTION_OF.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(known, raw), raw)


def bounds(high: Column, low: Column) -> tuple[Column, Column]:
    """Lower and upper bound of a range whose two fields may be in either order; unreadable fields count as 0."""
    a, b = (F.coalesce(c.try_cast("double"), F.lit(0.0)) for c in (high, low))
    return F.least(a, b), F.greatest(a, b)


def rate_value(token: Column) -> Column:
    """Number of a rate written as 5, 5.25, 1/4 or 5-1/4; null for anything else."""
    raw = F.trim(token)
    mixed, plain = r"^(\d+)-(\d+)/(\d+)$", r"^(\d+)/(\d+)$"
    part = lambda p, g: F.regexp_extract(raw, p, g).try_cast("double")
    ratio = lambda p, a, b: F.try_divide(part(p, a), part(p, b))
    return F.when(raw.rlike(mixed), part(mixed, 1) + ratio(mixed, 2, 3)).when(raw.rlike(plain), ratio(plain, 1, 2)).otherwise(raw.try_cast("double"))


def rate_text(value: Column) -> Column:
    """A rate with up to six decimals and no zeros at its end."""
    return F.regexp_replace(F.regexp_replace(value.cast("decimal(18,6)").cast("string"), "0+$", ""), r"\.$", "")


def policy_score(text: Column) -> Column:
    return T.weighted_score(text, L.POLICY_WEIGHTS)


def rate_relevant(score: Column, count: Column, always: Column) -> Column:
    """Relevance by score: 10 or more, or 5 or more and 2 or more per thousand words; ``always`` overrides."""
    return always | (score >= 10) | ((score >= 5) & (score * 1000 >= 2 * F.greatest(count, F.lit(1))))


def cue_word_percent(text: Column) -> Column:
    """Where the first explicit cue begins, in percent of the words (1..100, one decimal); null without a cue."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    first = F.array_min(F.filter(F.array(*[F.instr(lower, c) for c in L.EXPLICIT_CUES]), lambda at: at > 0))
    before = T.word_count(F.substr(lower, F.lit(1), first - 1))
    share = F.bround(100.0 * before / F.greatest(T.word_count(lower), F.lit(1)), 1)
    return F.when(first.isNotNull(), F.least(F.greatest(share, F.lit(1.0)), F.lit(100.0)))


def lexicon_score(positive: Column, negative: Column, other: Column | None = None) -> Column:
    """(positive - negative) / all hits; 0 where there are none."""
    hits = positive + negative + (other if other is not None else F.lit(0))
    return F.when(hits == 0, F.lit(0.0)).otherwise((positive - negative) / hits)
