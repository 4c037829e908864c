"""Readers of landed files: macro series, speech indexes, pages, lexicons, seeds, news."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.dates import readable_day
from plumbline.operators.store import exists


def series_csv(spark: SparkSession, path: str, series_id: str) -> DataFrame:
    """A two-column CSV of day and value; '.', blanks and other non-numbers are left out."""
    raw = spark.read.option("header", True).schema("obs_date string, value string").csv(path)
    value = F.col("value").try_cast("double")
    day = F.to_date(readable_day(F.col("obs_date")))
    return raw.select(F.lit(series_id).alias("series_id"), F.date_format(day, "yyyy-MM-dd").alias("obs_date"), value.alias("value")).where("obs_date is not null and value is not null")


def series_json(spark: SparkSession, path: str, series_id: str) -> DataFrame:
    """A service's JSON answer with a list of observations of date and value."""
    raw = spark.read.option("multiLine", True).schema("observations array<struct<date:string,value:string>>").json(path)
    items = raw.select(F.explode("observations").alias("o"))
    return items.select(F.lit(series_id).alias("series_id"), F.col("o.date").alias("obs_date"), F.col("o.value").try_cast("double").alias("value")).where("value is not null")


def speech_index(spark: SparkSession, path: str) -> DataFrame:
    """A JSON index of speeches (d, t, s, l: when, title, who, link), its byte order mark ignored, with slug and day."""
    raw = spark.read.option("wholetext", True).text(path)
    items = F.from_json(F.regexp_replace("value", "^﻿", ""), "array<struct<d:string,t:string,s:string,l:string>>")
    rows = raw.select(F.explode(items).alias("i")).select("i.*")
    day = readable_day(F.split("d", " ")[0])
    return rows.select(F.regexp_extract("l", r"([^/]+?)(?:\.\w+)?$", 1).alias("slug"), F.date_format(day, "yyyyMMdd").alias("date"), F.col("s").alias("participant"), F.col("t").alias("title"), F.col("l").alias("link"))


def speech_speakers(index: DataFrame, prefix: str = "/newsevents/speech/") -> DataFrame:
    """(slug, participant) of an index's speeches whose link is under ``prefix``, the greatest name of each slug."""
    return index.where(F.col("link").startswith(prefix)).groupBy("slug").agg(F.max(F.trim(F.coalesce("participant", F.lit("")))).alias("participant"))


def archives(spark: SparkSession, path: str, columns: tuple[str, ...] = ("date", "author", "title", "description", "text")) -> DataFrame:
    """Rows of the first CSV in each landed zip archive, as strings; archives without one give none, absent columns are null."""
    names = list(columns)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as held:
                    first = next((n for n in held.namelist() if n.endswith(".csv")), None)
                    if first is None:
                        continue
                    with held.open(first) as file:
                        for part in pd.read_csv(file, dtype=str, keep_default_na=False, na_values=[""], chunksize=10_000):
                            yield part.reindex(columns=names).astype(object).where(lambda x: x.notna(), None)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, ", ".join(f"{n} string" for n in names))


def cached(spark: SparkSession, cache: str, seed: str, schema: str, refresh: bool = False) -> DataFrame:
    """The Parquet table at ``cache``; written from the seed file (Parquet) where it is absent or ``refresh`` is set."""
    if refresh or not exists(spark, cache):
        spark.read.schema(schema).parquet(seed).write.mode("overwrite").parquet(cache)
    return spark.read.schema(schema).parquet(cache)


def cached_pages(wanted: DataFrame, pages: DataFrame, key: str = "day") -> DataFrame:
    """(key, html): per wanted day the landed statement page with the exact name, else the least name that starts alike; null if none.

    ``pages`` holds (url, html) with names like ``...monetary<day>a.htm.html``.
    """
    named = pages.select(F.regexp_extract("url", r"monetary(\d{8})", 1).alias(key), "url", F.col("html"))
    exact = F.col("url").rlike(r"monetary\d{8}a\.htm\.html$")
    best = named.where(F.col(key) != "").groupBy(key).agg(F.min_by("html", F.struct(~exact, "url")).alias("html"))
    return wanted.select(key).distinct().join(best, key, "left")


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of a landing folder; the file name stands for the address."""
    return spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("url"), F.col("value").alias("html"))


def lexicon(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """(word, category) of a wide word list whose category columns hold 1 or TRUE."""
    raw = spark.read.option("header", True).option("sep", separator).csv(path)
    categories = [c for c in ("Positive", "Negative", "Uncertainty", "Litigious", "Strong_Modal", "Weak_Modal") if c in raw.columns]
    marked = raw.select(F.lower("Word").alias("word"), *[F.trim(c).alias(c.lower()) for c in categories])
    long = marked.unpivot("word", [c.lower() for c in categories], "category", "mark")
    return long.where(F.col("mark").isin("1", "1.0", "TRUE", "True")).select("word", "category")


def seed_urls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("sep", "\t").csv(path)


def news_json(spark: SparkSession, path: str) -> DataFrame:
    """Articles of a landed feed, one JSON object a line; those without an address or removed ones are left out."""
    schema = "source string, title string, url string, published_at string, summary string, sentiment_score double, sentiment_label string, topic_query string"
    rows = spark.read.schema(schema).json(path)
    return rows.where(F.col("url").isNotNull() & (F.trim("url") != "") & ~F.coalesce(F.contains(F.lower("url"), F.lit("removed.com")), F.lit(False)))


def all_news(feeds: list[DataFrame]) -> DataFrame:
    """Articles of every topic and source in one frame, columns by name; no feed is an error."""
    out = feeds[0]
    for feed in feeds[1:]:
        out = out.unionByName(feed, allowMissingColumns=True)
    return out
