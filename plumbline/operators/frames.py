"""The modelling frame: both corpora with policy context, scores, weak labels, and the dense feature block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import labels
from plumbline.functions import lexicons as L
from plumbline.functions import scores as S
from plumbline.functions import text as T
from plumbline.functions.dates import readable_day

from .corpus import usable_for_models
from .store import latest_by

#: Words that count as yes, and spellings of an absent rule.
YES = ("1", "true", "yes", "y")
NO_RULE = ("", "nan", "none")
#: Days to the reference meeting that count as before it, and the farthest distance that is told apart.
PRE_MEETING_DAYS, FARTHEST_DAYS = 10, 180
#: Rate level from which low and high are measured.
NEUTRAL_RATE = 2.5
#: Patterns of the topic rates among the features.
TOPIC_PATTERNS = {
    "inflation": r"\binflation\b|\bprices?\b|\bcpi\b",
    "labor": r"\blabor market\b|\bunemployment\b|\bemployment\b|\bpayrolls?\b",
    "growth": r"\bgrowth\b|\bdemand\b|\bspending\b|\brecession\b|\bslowdown\b",
}
STRUCTURED = (
    "target_lower", "target_upper", "target_mid", "target_spread", "alignment_days", "alignment_pre_meeting", "alignment_abs_days",
    "rule_blackout_pre", "rule_post_meeting", "rule_no_prior_meeting", "quality_feature", "derived_labels_feature",
)
#: Externally computed features a document may have, by its hash.
EXTERNAL = ("ext_relevance", "ext_lower", "ext_maintain", "ext_raise", "ext_confidence", "ext_hawkish", "ext_dovish", "ext_explicit")


def number(value: Column, default: float) -> Column:
    """A value as a number; ``default`` for null, NaN and what is no number."""
    read = value.try_cast("double")
    return F.when(F.isnan(read), F.lit(default)).otherwise(F.coalesce(read, F.lit(default)))


def truthy(value: Column) -> Column:
    """Whether a flag of any type says yes; null says no."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(*YES), F.lit(False))


def document_key(source: Column, day: Column, speaker: Column, domain: Column, document: Column) -> Column:
    """SHA-256 over source, day, speaker, domain and text, one a line; nulls count as empty."""
    parts = (source, F.substring(day.cast("string"), 1, 10), speaker, domain, document)
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def policy_context(df: DataFrame) -> DataFrame:
    """``df`` with the ``STRUCTURED`` columns from high, low, event_date, fomc_ref_date, alignment_rule, quality_score, labels_from_fred.

    Bounds may be in either order; unreadable ones are 0. A missing reference counts as 0 days away. Where no rule is
    stored, one is inferred from the days to the reference. Columns that are absent count as null.
    """
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    lower, upper = S.bounds(have("high"), have("low"))
    days = F.coalesce(F.datediff(readable_day(have("fomc_ref_date")), F.col("event_date")), F.lit(0)).cast("double")
    pre = days.between(0, PRE_MEETING_DAYS)
    rule = F.coalesce(F.lower(have("alignment_rule")), F.lit(""))
    missing = rule.isin(*NO_RULE)
    one = lambda c: c.cast("double")
    values = (
        lower, upper, (lower + upper) / 2, upper - lower, days, one(pre), F.least(F.abs(days), F.lit(float(FARTHEST_DAYS))),
        one((rule == "blackout_pre") | (missing & pre)), one((rule == "post_meeting") | (missing & (days < 0))), one(rule == "no_prior_meeting"),
        F.least(F.greatest(number(have("quality_score"), 1.0), F.lit(0.0)), F.lit(1.0)), one(truthy(have("labels_from_fred"))),
    )
    return df.withColumns(dict(zip(STRUCTURED, values)))


def attach_external(df: DataFrame, features: DataFrame, key: str = "doc_hash", order: list[Column] | None = None) -> DataFrame:
    """Left join of the ``EXTERNAL`` features by document hash, the last of each hash by ``order``; absent ones 0, kept in 0..1."""
    kept = latest_by(features, [key], order or [F.desc(c) for c in EXTERNAL]).select(key, *EXTERNAL)
    joined = df.drop(*EXTERNAL).join(kept, key, "left")
    return joined.withColumns({c: F.least(F.greatest(number(F.col(c), 0.0), F.lit(0.0)), F.lit(1.0)) for c in EXTERNAL})


def _half(df: DataFrame, source: str, key: str) -> DataFrame:
    meeting = source == "fomc"
    return df.select(
        F.lit(source).alias("source"), F.col(key).alias("id"), readable_day(F.col("date")).alias("event_date"),
        F.coalesce("speaker" if meeting else "participant", F.lit("")).alias("speaker"), F.coalesce("document_type" if meeting else "domain", F.lit("")).alias("domain"),
        F.coalesce("text_content", F.lit("")).alias("document"), S.direction(F.col("decision")).alias("direction"), "high", "low",
        (F.col("date") if meeting else F.col("fomc_ref_date")).alias("fomc_ref_date"), "quality_score", "quality_flags",
        *([F.col("labels_from_fred")] if meeting else [F.col("alignment_rule")]),
    )


def modelling_frame(fomc: DataFrame, speaker: DataFrame, min_words: int = 80, fomc_key: str = "fomc_id", speaker_key: str = "speech_id") -> DataFrame:
    """Usable documents of both corpora with context, scores, tier, weak relevance, action label and cue position.

    Meeting documents are always relevant; a speech is by its policy score. What is not relevant has the action
    no_rate_signal. Null ids and repeated rows stay as they are; empty tables give an empty frame.
    """
    both = _half(fomc, "fomc", fomc_key).unionByName(_half(speaker, "speaker", speaker_key), allowMissingColumns=True)
    both = both.withColumn("word_count", T.word_count(F.col("document")))
    kept = policy_context(usable_for_models(both, min_words))
    text = F.col("document")
    scored = kept.withColumns(
        {
            "doc_hash": document_key(F.col("source"), F.col("event_date"), F.col("speaker"), F.col("domain"), text), "policy_score": S.policy_score(text),
            "hawkish_hits": T.sum_substring_hits(text, L.HAWKISH), "dovish_hits": T.sum_substring_hits(text, L.DOVISH),
            "hold_hits": T.sum_substring_hits(text, L.HOLD), "uncertainty_hits": T.sum_substring_hits(text, L.UNCERTAIN),
            "speaker_tier": F.when(F.col("source") == "fomc", 3.0).otherwise(labels.weight_of(labels.office(F.concat_ws(" ", "speaker", "domain")))),
            "cue_percent": S.cue_word_percent(text),
        }
    )
    relevant = S.rate_relevant(F.col("policy_score"), F.col("word_count"), F.col("source") == "fomc")
    scored = scored.withColumns({"policy_score_per_1k": F.col("policy_score") * 1000.0 / F.greatest("word_count", F.lit(1)), "rate_relevant": relevant})
    return scored.withColumn("action_label", action_label(F.col("rate_relevant"), F.col("direction")))


def action_label(relevant: Column, direction: Column) -> Column:
    return F.when(relevant, direction).otherwise("no_rate_signal")


def dense_features(df: DataFrame, text: str, fraction: Column, keep: list[str]) -> DataFrame:
    """(keep, the 37 numeric features of a text or prefix): counts and rates of the term lists, alone and times the context at hand.

    Context columns of ``df`` (``STRUCTURED``, the macro context, ``EXTERNAL``) that are absent or null count as 0. The
    counts are taken once and combined in a second projection.
    """
    t = F.col(text)
    at = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    lists = {"hawk": L.HAWKISH, "dove": L.DOVISH, "hold": L.HOLD, "unsure": L.UNCERTAIN, "direct": L.EXPLICIT_CUES}
    lower = F.lower(F.coalesce(t, F.lit("")))
    counts = {f"_{n}": T.sum_substring_hits(t, terms).cast("double") for n, terms in lists.items()}
    counts |= {f"_{n}": F.regexp_count(lower, F.lit(p)).cast("double") for n, p in TOPIC_PATTERNS.items()}
    counts |= {"_words": F.greatest(T.word_count(t), F.lit(1)).cast("double"), "_score": S.policy_score(t), "_fraction": fraction.cast("double")}
    c = {n[1:]: F.col(n) for n in counts}
    per = lambda n: c[n] / (c["words"] / 1000.0)
    nonzero = lambda a, b: F.when(a != 0, a).otherwise(b)
    level = nonzero(at("target_mid"), nonzero(at("funds_rate"), at("context_target_mid")))
    pressure = F.abs(nonzero(at("target_mid_180d"), at("funds_rate_180d")))
    features = {
        "fraction": c["fraction"], "log_words": F.log1p(c["words"]), "policy_score": c["score"], "policy_score_per_1k": per("score"), "hawkish_hits": c["hawk"], "dovish_hits": c["dove"],
        "tone": c["hawk"] - c["dove"],
        "hawkish_per_1k": per("hawk"), "dovish_per_1k": per("dove"), "hold_per_1k": per("hold"), "uncertain_per_1k": per("unsure"), "direct_cues": c["direct"],
        "inflation_per_1k": per("inflation"), "labor_per_1k": per("labor"), "growth_per_1k": per("growth"), "tone_balance": (c["hawk"] - c["dove"]) / F.sqrt(c["words"]),
        "log_policy_per_1k": F.log1p(F.greatest(per("score"), F.lit(0.0))), "level_hawkish": level * per("hawk"), "level_dovish": level * per("dove"),
        "high_dovish": F.greatest(level - NEUTRAL_RATE, F.lit(0.0)) * per("dove"), "low_hawkish": F.greatest(NEUTRAL_RATE - level, F.lit(0.0)) * per("hawk"),
        "change_hold": pressure * per("hold"), "unemployment_dovish": at("unemployment_90d") * per("dove"), "prices_hawkish": at("prices_365d") * per("hawk"),
        "spread": at("target_spread"), "pre_meeting": at("alignment_pre_meeting"),
        "blackout_pre": at("rule_blackout_pre"), "post_meeting": at("rule_post_meeting"), "no_prior_meeting": at("rule_no_prior_meeting"),
        "log_days": F.log1p(at("alignment_abs_days")), "quality": at("quality_feature"), "derived_labels": at("derived_labels_feature"),
        "external_policy": at("ext_relevance") * c["score"] / (c["words"] / 1000.0), "external_direction": at("ext_lower") - at("ext_raise"),
        "external_hold": at("ext_maintain") * per("hold"), "external_hawkish": at("ext_hawkish") * per("hawk"), "external_dovish": at("ext_dovish") * per("dove"),
    }
    return df.withColumns(counts).select(*keep, *[f.alias(n) for n, f in features.items()])


def timeline(df: DataFrame, text: str, points: Column, keep: list[str]) -> DataFrame:
    """(keep, prefix_words, fraction, text): one row a document and point, its first so many words; the text is split once."""
    split = df.select(*keep, T.words(F.col(text)).alias("_words"), points.alias("_points"))
    spread = split.select(*keep, "_words", F.explode("_points").alias("prefix_words"))
    share = F.col("prefix_words") / F.greatest(F.size("_words"), F.lit(1))
    return spread.select(*keep, "prefix_words", share.alias("fraction"), F.array_join(F.slice("_words", F.lit(1), F.col("prefix_words")), " ").alias(text))
