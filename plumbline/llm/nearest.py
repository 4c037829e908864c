"""Nearest record in time of the same entity within a tolerance, through a learned index.

The right side is sharded by entity and by spans of ``SHARD_DAYS`` days whose edges overlap by the
tolerance. Each shard holds its distinct days as one sorted array, at most ``SHARD_DAYS`` plus twice the
tolerance long, and a piecewise-linear model fitted over it whose predicted positions are wrong by at
most ``ERROR`` places. A left record computes its shard, evaluates the segment its day falls into and
searches the few array places around the prediction, so the neighbour found is exact. The index is broadcast when
its measured bytes fit; beyond that left rows of one entity spread over its spans and over ``SALTS`` copies of each
shard, so no entity is one task.

Defined results: rows of either side with a null entity or day match nothing; of two equally near days
the earlier is taken; repeated left rows each get their match; repeated right days count once; an empty
side gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.runtime import BROADCAST_BYTES, cut, ship

SHARD_DAYS = 1024
ERROR = 3
SALTS = 8


def fit_segments(days: list[int], error: int = ERROR) -> list[tuple[int, float, int]]:
    """(first day, slope, first position) of segments predicting positions of sorted ``days`` within ``error``."""
    out: list[tuple[int, float, int]] = []
    start, low, high = 0, 0.0, float("inf")
    for i, d in enumerate(days):
        if i == start:
            low, high = 0.0, float("inf")
            continue
        run = d - days[start]
        lo, hi = (i - start - error) / run, (i - start + error) / run
        if max(low, lo) > min(high, hi):
            out.append((int(days[start]), (low + high) / 2 if high < float("inf") else 0.0, start))
            start, low, high = i, 0.0, float("inf")
        else:
            low, high = max(low, lo), min(high, hi)
    if len(days):
        out.append((int(days[start]), (low + high) / 2 if high < float("inf") else 0.0, start))
    return out


def learned_index(right: DataFrame, entity: str, day: str, tolerance: int) -> DataFrame:
    """(entity, shard, keys, segments): the sorted distinct days of each shard and the model over them."""
    span = F.sequence(F.floor((F.col("day") - tolerance) / SHARD_DAYS), F.floor((F.col("day") + tolerance) / SHARD_DAYS))
    shards = (
        right.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
        .select(F.col(entity).alias("entity"), F.col(day).cast("int").alias("day"))
        .distinct()
        .withColumn("shard", F.explode(span))
        .groupBy("entity", "shard")
        .agg(F.sort_array(F.collect_set("day")).alias("keys"))
    )

    @F.pandas_udf("array<struct<first:int,slope:double,position:int>>")
    def fit(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: [{"first": a, "slope": b, "position": c} for a, b, c in fit_segments(list(k))])

    return shards.withColumn("segments", fit("keys"))


def _search(keys: Column, segments: Column, day: Column, tolerance: int) -> Column:
    """Nearest of ``keys`` to ``day`` within ``tolerance``, looking only near the predicted position."""
    inside = F.filter(segments, lambda s: s["first"] <= day)
    segment = F.coalesce(F.try_element_at(inside, F.lit(-1)), F.try_element_at(segments, F.lit(1)))
    at = F.round(segment["position"] + segment["slope"] * (day - segment["first"])).cast("int")
    following = F.try_element_at(F.filter(segments, lambda s: s["first"] > day), F.lit(1))["position"]
    last = F.coalesce(following, F.size(keys))
    at = F.least(F.greatest(at, F.lit(0)), last)
    near = F.slice(keys, F.greatest(at - (ERROR + 1), F.lit(0)) + 1, F.lit(2 * ERROR + 4))
    best = F.array_min(F.transform(near, lambda k: F.struct(F.abs(k - day).alias("gap"), k.alias("key"))))
    return F.when(best["gap"] <= tolerance, best["key"])


def nearest_in_time(
    left: DataFrame, right: DataFrame, id_col: str, left_entity: str, left_day: str, right_entity: str, right_day: str, tolerance: int
) -> DataFrame:
    """(id, day): each left row with the nearest day of ``right`` of its entity; rows without one are left out. Days are day numbers."""
    ship(left.sparkSession)
    index = cut(learned_index(right, right_entity, right_day, tolerance))
    size = index.agg(F.sum(64 + 4 * F.size("keys") + 20 * F.size("segments"))).first()[0] or 0
    small = size <= BROADCAST_BYTES
    shards = F.broadcast(index) if small else index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    probes = left.where(F.col(left_entity).isNotNull() & F.col(left_day).isNotNull()).select(
        F.col(id_col).alias("id"),
        F.col(left_entity).alias("entity"),
        F.col(left_day).cast("int").alias("at"),
        F.floor(F.col(left_day) / SHARD_DAYS).alias("shard"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int").alias("salt"),
    )
    return (
        probes.join(shards, ["entity", "shard"] if small else ["entity", "shard", "salt"])
        .select(F.col("id").alias(id_col), _search(F.col("keys"), F.col("segments"), F.col("at"), tolerance).alias("day"))
        .where(F.col("day").isNotNull())
    )
