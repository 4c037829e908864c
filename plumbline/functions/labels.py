"""Labels and bands from numbers and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONFIDENCE = ((0.75, "High"), (0.55, "Moderate"))
RELEVANCE = ((0.75, "strong"), (0.5, "moderate"), (0.3, "weak"))
PRESENCE = ((8, "dominant"), (4, "moderate"))
INTENSITY = ((8, "high"), (4, "moderate"))


def band(value: Column, steps: tuple[tuple[float, str], ...], below: str) -> Column:
    """The label of the highest step the value reaches; ``below`` for less and for null."""
    out = None
    for least, name in steps:
        out = F.when(value >= least, name) if out is None else out.when(value >= least, name)
    return out.otherwise(below)


def office(name: Column) -> Column:
    """Office a name is written with, most senior first; 'other' where it has none."""
    low = F.lower(F.coalesce(name, F.lit("")))
    ordered = (("vice chair", r"\bvice chair|\bv\. chair|\bvc\b"), ("chair", r"\bchair|\bchr\."), ("governor", r"\bgov(?:ernor)?\b"), ("president", r"\bpres(?:ident)?\b"), ("member", r"\bmember\b"))
    out = None
    for label, pattern in ordered:
        out = F.when(low.rlike(pattern), label) if out is None else out.when(low.rlike(pattern), label)
    return out.otherwise("other")


def weight_of(office_name: Column) -> Column:
    """Attention weight of an office, as a small model feature."""
    known = {"chair": 3.0, "vice chair": 2.0, "governor": 1.5, "president": 1.0, "member": 0.75}
    out = None
    for k, v in known.items():
        out = F.when(office_name == k, v) if out is None else out.when(office_name == k, v)
    return out.otherwise(0.25)


SURENESS = ((0.75, "High"), (0.55, "Medium"))


def tone_label(score: Column, hawkish: Column, dovish: Column) -> Column:
    """Hawkish, Dovish or Neutral from a tone score and the hits of both lists; null counts as 0."""
    score, spread = F.coalesce(score, F.lit(0.0)), F.coalesce(hawkish, F.lit(0)) - F.coalesce(dovish, F.lit(0))
    return F.when((spread >= 2) | (score >= 0.25), "Hawkish").when((spread <= -2) | (score <= -0.25), "Dovish").otherwise("Neutral")


def classification(score: Column, hawkish: Column, dovish: Column) -> Column:
    """Struct (label, confidence, sentence) without a model: the label of ``tone_label`` and how sure the hits and the score make it."""
    label = tone_label(score, hawkish, dovish)
    sure = F.least(F.lit(0.95), 0.5 + F.abs(hawkish - dovish) * 0.08 + F.abs(F.coalesce(score, F.lit(0.0))) * 0.35)
    bias = F.when(label == "Hawkish", "hawkish").when(label == "Dovish", "dovish").otherwise("balanced")
    sentence = F.concat(F.lit("Read as "), F.lower(label), F.lit(": the mix of terms is "), bias, F.lit(", with "), hawkish.cast("string"), F.lit(" hawkish and "), dovish.cast("string"), F.lit(" dovish terms."))
    return F.struct(label.alias("label"), band(sure, SURENESS, "Low").alias("confidence"), sentence.alias("sentence"))


def step_words(words: Column) -> Column:
    """Words between two scored points of a text: a twenty-fourth of it, at least 80."""
    return F.greatest(F.lit(80), F.floor(words / 24).cast("int"))
