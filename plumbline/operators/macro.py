"""Macro series: latest values, wide context with fills and lag changes, policy steps, attachment to documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import lexicons as L

from .store import exists, latest_by
from .temporal import fits_broadcast, forward_fill, lag_change

#: Changes of the context: column, source column, days.
CHANGES = (
    ("funds_rate_90d", "funds_rate", 90), ("funds_rate_180d", "funds_rate", 180), ("target_mid_90d", "target_mid", 90), ("target_mid_180d", "target_mid", 180),
    ("curve_90d", "curve", 90), ("unemployment_90d", "unemployment", 90), ("prices_365d", "prices", 365),
)


def revised(series: DataFrame) -> DataFrame:
    """One row a series and day: the latest fetched, the greatest value of equally late ones."""
    return latest_by(series, ["series_id", "obs_date"], [F.desc("fetched_at"), F.desc_nulls_last("value")])


def cached_series(spark: SparkSession, path: str, series_id: str, first_day: str, last_day: str, fetch: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """(series_id, obs_date, value) of a series from the table at ``path`` where it holds any of the days, else fetched, stored and read back.

    ``fetch`` gives (series_id, obs_date, value, fetched_at); ``force`` fetches in any case.
    """
    def stored() -> DataFrame:
        rows = spark.read.parquet(path).where((F.col("series_id") == series_id) & F.col("obs_date").between(first_day, last_day))
        return revised(rows).where("value is not null").select("series_id", "obs_date", "value")

    held = exists(spark, path)
    if force or not held or stored().isEmpty():
        fetch().write.mode("append").parquet(path)
    return stored()


def available(context: DataFrame, columns: tuple[str, ...] = ("funds_rate", "curve", "unemployment", "target_mid")) -> DataFrame:
    """``context`` with ``context_available``: 1 where any of the columns is known."""
    known = F.lit(False)
    for c in columns:
        known = known | F.col(c).isNotNull()
    return context.withColumn("context_available", known.cast("double"))


def last_observations(series: DataFrame, count: int) -> DataFrame:
    """The last ``count`` observations of each series, oldest first in each."""
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("obs_date")))
    return series.withColumn("rank", rank).where(F.col("rank") <= count)


def wide_context(series: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """Day-indexed context: one column a series, target mid averaged before filling forward, then lag changes.

    There is one row a calendar day with an observation, however many series there are, so the single
    partition of the keyless windows holds at most some tens of thousands of short rows.
    """
    columns = columns or L.MACRO_SERIES
    day = F.to_date("obs_date")
    wide = series.where(F.col("series_id").isin(*columns)).groupBy(day.alias("day")).pivot("series_id", list(columns)).agg(F.max_by("value", "obs_date"))
    wide = wide.where("day is not null").select("day", *[F.col(k).alias(v) for k, v in columns.items()])
    if {"target_lower", "target_upper"} <= set(columns.values()):
        a, b = F.col("target_lower"), F.col("target_upper")
        wide = wide.withColumn("target_mid", (F.coalesce(a, b) + F.coalesce(b, a)) / 2)
    names = [c for c in wide.columns if c != "day"]
    filled = forward_fill(wide.withColumns({"_all": F.lit(0), "_n": F.unix_date("day")}), ["_all"], "day", names)
    changes = {name: lag_change(source, ["_all"], "_n", days) for name, source, days in CHANGES if source in names}
    return filled.withColumns(changes).drop("_all", "_n")


def daily(context: DataFrame, columns: list[str]) -> DataFrame:
    """The context on every calendar day from its first to its last, each day as of the latest row not after it."""
    ends = context.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = ends.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    filled = days.join(context.select("day", *columns, F.struct(*columns).alias("_row")), "day", "left").withColumn("_all", F.lit(0))
    return forward_fill(filled, ["_all"], "day", ["_row"]).select("day", F.col("_row.*"))


def attach_context(documents: DataFrame, context: DataFrame, day: str, columns: list[str]) -> DataFrame:
    """Context of the latest day not after each document's, 0 where there is none or the day is null.

    The context is spread over calendar days, so documents meet it by equality of days. It is broadcast
    when its counted days fit, which leaves the documents where they are.
    """
    spread = daily(context, columns).select(F.col("day").alias("_day"), *[F.col(c).alias(f"asof_{c}") for c in columns])
    last = context.agg(F.max("day").alias("d")).first()["d"]
    side = F.broadcast(spread) if fits_broadcast(spread, 16 * (len(columns) + 1)) else spread
    keyed = documents.withColumn("_day", F.least(F.col(day), F.lit(last).cast("date")) if last else F.lit(None).cast("date"))
    keyed = keyed.withColumn("_day", F.when(F.col(day).isNotNull(), F.col("_day")))
    return keyed.join(side, "_day", "left").drop("_day").withColumns({f"asof_{c}": F.coalesce(f"asof_{c}", F.lit(0.0)) for c in columns})


def policy_steps(bounds: DataFrame, key: str, order: str, lower: str, upper: str) -> DataFrame:
    """Direction of each step from the row before: raise or lower only if both bounds moved that way, else maintain."""
    window = Window.partitionBy(key).orderBy(order)
    down, up = F.col(lower) - F.lag(lower).over(window), F.col(upper) - F.lag(upper).over(window)
    step = F.when((down > 1e-6) & (up > 1e-6), "raise").when((down < -1e-6) & (up < -1e-6), "lower").otherwise("maintain")
    return bounds.withColumn("step", step)
