"""Corpus frames: canonical columns, merges, gap filling, search, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import lexicons as L
from plumbline.functions import scores as S
from plumbline.functions import text as T
from plumbline.functions.dates import readable_day

from .store import latest_by
from .temporal import band_anti_join, nearest_meeting


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, or an error naming the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Add the columns that are absent; leave those there are."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def flags_of(value: Column) -> Column:
    """List of flags from a JSON list or a bare string; null and blank give no flags."""
    parsed = F.from_json(value, "array<string>")
    return F.when(value.isNull() | (F.trim(value) == ""), F.array().cast("array<string>")).otherwise(
        F.when(F.trim(value).startswith("[") & parsed.isNotNull(), parsed).otherwise(F.array(value))
    )


def day_text(value: Column) -> Column:
    """A readable day as YYYYMMDD; anything else as it stands."""
    return F.coalesce(F.date_format(readable_day(value), "yyyyMMdd"), value)


def year_of(value: Column) -> Column:
    """Year from the first four characters; 0 where they are no number."""
    return F.coalesce(F.substring(value, 1, 4).try_cast("int"), F.lit(0))


def canonical(df: DataFrame, kind: str) -> DataFrame:
    """Canonical meeting ('fomc') or speech ('speaker') rows: day, year, hash, score and flags derived anew."""
    base = with_defaults(
        df,
        {
            "document_type": F.lit("statement"), "speaker": F.lit(None).cast("string"), "participant": F.lit(""), "domain": F.lit(""),
            "decision": F.lit("maintain"), "high": F.lit("0"), "low": F.lit("0"), "source_url": F.lit(""), "quality_flags": F.array().cast("array<string>"),
            "parser_version": F.lit(""), "labels_from_fred": F.lit(False), "fomc_ref_date": F.lit(""), "alignment_rule": F.lit(""),
            "ingested_at": F.current_timestamp(),
        },
    )
    text = F.coalesce("text_content", F.lit(""))
    out = base.withColumns({"date": day_text(F.col("date")), "text_content": text, "quality_flags": F.coalesce("quality_flags", F.array().cast("array<string>"))})
    out = out.withColumns(
        {
            "year": year_of(F.col("date")),
            "content_hash": T.content_hash(F.col("text_content")),
            "quality_score": S.quality_score(T.word_count(F.col("text_content")), F.col("quality_flags")),
            "labels_from_fred": F.coalesce("labels_from_fred", F.lit(False)),
        }
    )
    return out.withColumn("document_type", F.lit("speech")) if kind == "speaker" else out


def combined(fomc: DataFrame, speaker: DataFrame) -> DataFrame:
    """Both corpora as (corpus, date, text, word_count, decision, type)."""
    def part(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("corpus"), "date", F.col("text_content").alias("text"), T.word_count(F.col("text_content")).alias("word_count"), "decision", F.col("document_type").alias("type"))

    return part(fomc, "fomc").unionByName(part(speaker, "speaker"))


def ranked_merge(sources: list[DataFrame], keys: list[str], tie: str) -> DataFrame:
    """Union of sources in order of trust; of rows with equal keys the first source's, then the least ``tie``, stays."""
    both = None
    for rank, df in enumerate(sources):
        part = df.withColumn("_source", F.lit(rank))
        both = part if both is None else both.unionByName(part, allowMissingColumns=True)
    return latest_by(both, keys, [F.asc("_source"), F.asc(tie)]).drop("_source")


def fill_gaps(candidates: DataFrame, official: DataFrame, meetings: DataFrame, name: str, day: str, meeting_day: str, band: int = 3) -> DataFrame:
    """Candidates of known people without an official speech within ``band`` days, each with its nearest meeting."""
    key = "_person"
    ours = candidates.withColumn(key, T.person_key(F.col(name)))
    theirs = official.select(T.person_key(F.col(name)).alias(key), F.col(day))
    kept = band_anti_join(ours, theirs, key, day, band).drop(key)
    return nearest_meeting(kept, meetings, day, meeting_day)


def search(df: DataFrame, needle: str, text: str, keep: list[str], before: int = 80, after: int = 160) -> DataFrame:
    """Rows that hold a literal, letter case aside, with its surroundings."""
    return df.where(F.contains(F.lower(text), F.lit(needle.lower()))).select(*keep, T.snippet(F.col(text), needle, before, after).alias("snippet"))


def news_page(news: DataFrame, source: str | None = None, topic: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """News of a source (equality) and on a topic (in its query or title, letter case aside), newest first, the greater id first of equal times."""
    out = news if source is None else news.where(F.col("source") == source)
    if topic is not None:
        held = F.lit(False)
        for c in ("topic_query", "title"):
            held = held | F.coalesce(F.contains(F.lower(c), F.lit(topic.lower())), F.lit(False))
        out = out.where(held)
    return out.orderBy(F.desc_nulls_last("published_at"), F.desc("id")).offset(offset).limit(limit)


def usable_for_models(df: DataFrame, min_words: int = 80) -> DataFrame:
    """Rows of at least ``min_words`` words, acceptable quality, no blocking flag, a known direction and a readable day."""
    quality = F.coalesce("quality_score", F.lit(1.0))
    blocked = F.exists(F.coalesce("quality_flags", F.array().cast("array<string>")), lambda f: F.lower(f).isin(*L.BLOCKING_FLAGS))
    return df.where(
        (quality >= 0.4) & ~(F.coalesce("labels_from_fred", F.lit(False)) & (quality < 0.7)) & ~blocked & (F.col("word_count") >= min_words)
        & F.col("direction").isin(*L.DIRECTIONS) & F.col("event_date").isNotNull()
    )


def coverage(documents: DataFrame, types: list[str], site: str, day: str) -> DataFrame:
    """Per site and meeting day: whether the best document of each type (most words, then least hash) has text and no blocking flag."""
    flags = F.coalesce("quality_flags", F.array().cast("array<string>"))
    counted = documents.where(F.col("document_type").isin(*types)).withColumn("_words", T.word_count(F.col("text_content")))
    best = counted.groupBy(site, day, "document_type").agg(
        F.max_by(
            F.struct((F.col("_words") > 0).alias("text"), F.exists(flags, lambda f: f.isin(*L.BLOCKING_FLAGS)).alias("blocked"), F.array_sort(flags).alias("flags")),
            F.struct("_words", F.col("content_hash"), F.array_sort(flags)),
        ).alias("top")
    )
    wide = best.groupBy(site, day).pivot("document_type", types).agg(F.first("top"))
    ok = {t: F.coalesce(F.col(f"`{t}`.text") & ~F.col(f"`{t}`.blocked"), F.lit(False)) for t in types}
    every = None
    for c in ok.values():
        every = c if every is None else every & c
    held = F.array_sort(F.array_distinct(F.concat(*[F.coalesce(F.col(f"`{t}`.flags"), F.array().cast("array<string>")) for t in types])))
    return wide.select(site, day, *[c.alias(t) for t, c in ok.items()], every.alias("complete"), held.alias("flags"))


#: Forms of placeholder texts.
NARRATIVE = r"(?i)^FOMC (?:statement|placeholder) for \d{8}:"
DERIVED, FORWARDED = r"(?i)labels from FRED", r"(?i)forward-filled"
FAILED = r"(?i)text unavailable or unparseable|parse error|HTML unavailable after URL"


def placeholder_masks(text: Column, kind: Column) -> dict[str, Column]:
    """The six masks of placeholder rows; a null text has none of the forms."""
    body, statement = F.coalesce(text, F.lit("")), F.coalesce(kind == "statement", F.lit(False))
    narrative = body.rlike(NARRATIVE)
    return {
        "statement": statement, "narrative": narrative, "derived_labels": body.rlike(DERIVED), "forward_filled": body.rlike(FORWARDED), "parse_error": body.rlike(FAILED),
        "true_stub": statement & narrative,
    }


def all_complete(report: DataFrame, column: str = "complete") -> DataFrame:
    """One row: whether every row of a coverage report is complete; false for an empty report."""
    return report.agg(F.coalesce(F.bool_and(F.coalesce(column, F.lit(False))), F.lit(False)).alias("all_complete"), F.count("*").alias("rows"))


def counts_since(df: DataFrame, value: Column, day: Column, since: str, most: int) -> DataFrame:
    """(value, rows, rows_since): the ``most`` frequent values (a top-k report) with their counts overall and from a day on."""
    counted = df.groupBy(F.coalesce(value.cast("string"), F.lit("None")).alias("value")).agg(F.count("*").alias("rows"), F.count_if(F.coalesce(day >= F.lit(since), F.lit(False))).alias("rows_since"))
    return counted.orderBy(F.desc("rows"), "value").limit(most)
