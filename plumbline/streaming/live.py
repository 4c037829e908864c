"""Live operators on Structured Streaming: news without repeats, changed feeds, series upserts, growing speeches.

The polling jobs of a batch system become streams with a trigger; event-time handling is this library's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.functions import lexicons as L
from plumbline.functions import text as T
from plumbline.operators import macro, reports, store


def files(spark: SparkSession, path: str, schema: str, kind: str = "json", per_trigger: int = 64) -> DataFrame:
    """A landing folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)


def new_articles(articles: DataFrame, time: str, late: str = "4 hours") -> DataFrame:
    """Articles whose address was not seen within the watermark; state is bounded by ``late``."""
    held = articles.where(F.col("url").isNotNull() & (F.trim("url") != ""))
    return held.withWatermark(time, late).dropDuplicatesWithinWatermark(["url"])


def counts_by_window(articles: DataFrame, time: str, width: str = "1 day", late: str = "4 hours") -> DataFrame:
    """Articles a source and window, closed once the watermark has passed."""
    return articles.withWatermark(time, late).groupBy(F.window(time, width), "source").agg(F.count("*").alias("articles"))


def upsert_series(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch of observations into a Parquet table, the latest fetched of a series and day winning.

    Whole batches are written to numbered folders, so a batch that is repeated after a failure replaces
    itself; ``current_series`` reads the table.
    """

    def write(batch: DataFrame, number: int) -> None:
        macro.revised(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 hour")).start()


def current_series(spark: SparkSession, path: str) -> DataFrame:
    return macro.revised(spark.read.parquet(path).drop("batch"))


def changed_feeds(previous: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose fingerprint differs from the one stored, or is new."""
    now = reports.fingerprint(current, key, F.col(value))
    then = previous.select(F.col(key), F.col("hash").alias("_before"))
    return now.join(then, key, "left").where(F.col("_before").isNull() | (F.col("_before") != F.col("hash"))).drop("_before")


_TERMS = {"hawkish": L.HAWKISH, "dovish": L.DOVISH}


def live_signals(chunks: DataFrame, step_words: int = 100) -> DataFrame:
    """Running hits of a speech that arrives in chunks (speech_id, text, optional seq): one row whenever ``step_words`` more words came.

    Chunks of one trigger are taken in the order of ``seq`` where there is one. State per speech is counts and a tail as long as the longest term, never the text.
    """
    tail = max(len(t) for terms in _TERMS.values() for t in terms)

    def grow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        words, told, hawkish, dovish, end = state.get if state.exists else (0, 0, 0, 0, "")
        chunks = pd.concat(list(batches), ignore_index=True)
        if "seq" in chunks:
            chunks = chunks.sort_values("seq", kind="stable")
        for text in chunks["text"].fillna(""):
            lower = text.lower()
            joined = f"{end} {lower}" if end else lower
            for name, terms in _TERMS.items():
                found = sum(joined.count(t) - end.count(t) for t in terms)
                hawkish, dovish = (hawkish + found, dovish) if name == "hawkish" else (hawkish, dovish + found)
            words += len(lower.split())
            end = joined[-(tail - 1) :]
        out = []
        if words - told >= step_words:
            told = words
            out.append((key[0], words, hawkish, dovish))
        state.update((words, told, hawkish, dovish, end))
        yield pd.DataFrame(out, columns=["speech_id", "words", "hawkish", "dovish"])

    return chunks.groupBy("speech_id").applyInPandasWithState(
        grow, "speech_id long, words long, hawkish long, dovish long", "words long, told long, hawkish long, dovish long, tail string", "append", GroupStateTimeout.NoTimeout
    )


def ingest_meetings(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Canonical meeting documents into the year-partitioned store, batch by batch."""

    def write(batch: DataFrame, number: int) -> None:
        from plumbline.operators.corpus import canonical

        store.merge_and_write(batch.sparkSession, path, canonical(batch, "fomc"), store.MEETING_SCHEMA, store.MEETING_KEY)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def words_a_minute(chunks: DataFrame, time: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Words spoken a window and speech."""
    return chunks.withWatermark(time, late).groupBy(F.window(time, width), "speech_id").agg(F.sum(T.word_count(F.col("text"))).alias("words"))
