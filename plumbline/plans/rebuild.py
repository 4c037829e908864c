"""The corpus build as one lazy plan: canonical rows, alignment, gap filling, merge; only the writes act."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.dates import readable_day, site_of
from plumbline.operators import corpus, store, temporal


@dataclass(frozen=True)
class Rebuild:
    """Where the build reads and writes, and what it covers."""

    meetings_path: str
    speeches_path: str
    years: tuple[int, int] | None = None
    fill_gaps: bool = True
    by_site: bool = True


def aligned_speeches(speeches: DataFrame, meetings: DataFrame, by_site: bool = True) -> DataFrame:
    """Speeches with reference meeting, decision, range and rule of their alignment; undated speeches are left out."""
    entity = "site" if by_site else None
    carried = ["decision", "high", "low"]
    held = meetings.withColumns({"site": site_of(F.col("source_url")), "held": readable_day(F.col("date"))}).select("site", "held", *carried)
    ours = speeches.drop("decision", "high", "low", "fomc_ref_date", "alignment_rule", "site").withColumns(
        {"site": site_of(F.col("source_url"), F.col("domain")), "_day": readable_day(F.col("date"))}
    )
    out = temporal.align_to_meetings(ours, held, "_day", "held", carried, entity=entity)
    return out.select(
        *[c for c in ours.columns if c not in ("_day", "site")],
        F.coalesce(F.date_format("meeting_day", "yyyyMMdd"), F.lit("")).alias("fomc_ref_date"),
        F.coalesce("meeting_decision", F.lit("maintain")).alias("decision"),
        F.coalesce("meeting_high", F.lit("0")).alias("high"),
        F.coalesce("meeting_low", F.lit("0")).alias("low"),
        F.col("rule").alias("alignment_rule"),
    )


def filled_speeches(candidates: DataFrame, official: DataFrame, meetings: DataFrame) -> DataFrame:
    """Supplements (``builders.supplements``) that no official speech covers, with the labels of their nearest meeting."""
    held = meetings.withColumn("held", readable_day(F.col("date"))).where("held is not null")
    labels = held.groupBy("held").agg(F.min(F.struct("decision", "high", "low")).alias("label"))
    dated = candidates.withColumn("_day", readable_day(F.col("date")))
    known = official.select("participant", readable_day(F.col("date")).alias("_day"))
    kept = corpus.fill_gaps(dated, known, held.select("held"), "participant", "_day", "held")
    out = kept.join(labels, kept["meeting_day"] == labels["held"], "left")
    day = F.coalesce(F.date_format("meeting_day", "yyyyMMdd"), F.lit(""))
    chosen = {c: F.coalesce(F.col(f"label.{c}"), F.lit(v)) for c, v in (("decision", "maintain"), ("high", "0"), ("low", "0"))}
    return out.select(*candidates.columns, day.alias("fomc_ref_date"), *[v.alias(c) for c, v in chosen.items()], F.lit("nearest").alias("alignment_rule"))


def build(spark: SparkSession, meetings: DataFrame, speeches: DataFrame, plan: Rebuild, supplements: DataFrame | None = None) -> tuple[int, int]:
    """Write both corpora; returns the rows given to each store. Supplements fill the gaps of the speeches where the plan says so."""
    own = corpus.canonical(meetings, "fomc")
    if plan.years:
        own = own.where(F.col("year").between(*plan.years))
    aligned = aligned_speeches(speeches, own, plan.by_site)
    if plan.fill_gaps and supplements is not None:
        aligned = aligned.unionByName(filled_speeches(supplements, speeches, own), allowMissingColumns=True)
    aligned = corpus.canonical(aligned, "speaker")
    if plan.years:
        aligned = aligned.where(F.col("year").between(*plan.years))
    first = store.merge_and_write(spark, plan.meetings_path, own, store.MEETING_SCHEMA, store.MEETING_KEY)
    return first, store.merge_and_write(spark, plan.speeches_path, aligned, store.SPEECH_SCHEMA, store.SPEECH_KEY)
