"""Joins and windows in time: alignment to meetings, as-of, lags, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.runtime import BROADCAST_BYTES

BLACKOUT_BEFORE, BLACKOUT_AFTER = 12, 1
_DAY_BYTES = 192


def _by_day(left: DataFrame, meetings: DataFrame, left_day: str, meeting_day: str, entity: str | None, item: Column, ends: dict[str, tuple]) -> DataFrame:
    """Left rows with, per name in ``ends``, an aggregate of the meetings around their day.

    What a meeting means to a row depends on the row's entity and day only. The distinct days of both sides
    make one small table an entity, on which range windows compute each aggregate once a day; the rows then
    meet it by equality of entity and day. The table is broadcast when its counted rows fit.
    """
    keys = [entity] if entity else []
    number = F.unix_date(F.col(left_day))
    held = meetings.where(F.col(meeting_day).isNotNull()).select(*keys, F.unix_date(F.col(meeting_day)).alias("_day"), item.alias("_item"))
    asked = left.where(F.col(left_day).isNotNull()).select(*keys, number.alias("_day")).distinct()
    both = asked.withColumn("_item", F.lit(None).cast(held.schema["_item"].dataType)).unionByName(held)
    days = both.groupBy(*keys, "_day").agg(F.min("_item").alias("_least"), F.max("_item").alias("_most"))
    # without an entity there is one row a calendar day in all, so that one task holds them
    window = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_day")
    table = days.withColumns({n: f(c).over(window.rangeBetween(low, high)) for n, (f, c, low, high) in ends.items()}).drop("_least", "_most")
    table = table.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_day").alias("_key_day"), *ends)
    same = number == F.col("_key_day")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_key_{k}"))
    side = F.broadcast(table) if fits_broadcast(table) else table
    return left.where(F.col(left_day).isNotNull()).join(side, same, "left").drop("_key_day", *[f"_key_{k}" for k in keys])


def align_to_meetings(
    left: DataFrame, meetings: DataFrame, left_day: str, meeting_day: str, carried: list[str],
    before: int = BLACKOUT_BEFORE, after: int = BLACKOUT_AFTER, entity: str | None = None,
) -> DataFrame:
    """Each left row with its meeting and the rule that chose it.

    blackout_pre: the first meeting with ``before`` days ahead to ``after`` days behind around the day;
    post_meeting: else the latest one not later; no_prior_meeting: else the first of all. Of meetings on one
    day the least ``carried`` values count as the first and the greatest as the latest. Left rows with a null
    day are left out, as are null meeting days; without any meeting, and for a null entity, the columns are
    null and the rule is no_prior_meeting.
    """
    item = F.struct(F.col(meeting_day).alias("day"), *[F.col(c) for c in carried])
    far = Window.unboundedPreceding, Window.unboundedFollowing
    ends = {"_inside": (F.min, "_least", -after, before), "_earlier": (F.max, "_most", far[0], 0), "_first": (F.min, "_least", *far)}
    joined = _by_day(left, meetings, left_day, meeting_day, entity, item, ends)
    rule = F.when(F.col("_inside").isNotNull(), "blackout_pre").when(F.col("_earlier").isNotNull(), "post_meeting").otherwise("no_prior_meeting")
    chosen = joined.withColumn("_meeting", F.coalesce("_inside", "_earlier", "_first")).withColumn("rule", rule)
    out = [F.col("_meeting.day").alias("meeting_day"), *[F.col(f"_meeting.{c}").alias(f"meeting_{c}") for c in carried]]
    return chosen.select(*[F.col(c) for c in left.columns], *out, "rule")


def nearest_meeting(left: DataFrame, meetings: DataFrame, left_day: str, meeting_day: str, entity: str | None = None) -> DataFrame:
    """Each left row with the meeting nearest in time, the earlier of two equally near ones."""
    ends = {"_earlier": (F.max, "_most", Window.unboundedPreceding, 0), "_later": (F.min, "_least", 0, Window.unboundedFollowing)}
    joined = _by_day(left, meetings, left_day, meeting_day, entity, F.col(meeting_day), ends)
    sooner = F.col("_earlier").isNotNull() & (F.col("_later").isNull() | (F.datediff(left_day, "_earlier") <= F.datediff("_later", left_day)))
    return joined.withColumn("meeting_day", F.when(sooner, F.col("_earlier")).otherwise(F.col("_later"))).drop("_earlier", "_later")


def as_of(
    left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, carried: list[str], allow_equal: bool = True, span_s: int | None = None
) -> DataFrame:
    """Latest right row not later than each left row, per key: one union and one shuffle.

    With ``span_s`` (seconds; times are then timestamps) a key's rows are split into spans of that length
    and only the last right row of each span is carried on, so that a key with most of the rows is many
    tasks. Of right rows with equal times the greatest carried values win. Left rows with a null time keep
    null values; right rows with a null time are left out; the left columns stay as they are.
    """
    packed = F.struct(*[F.col(c) for c in carried])
    right_type = right.select(packed.alias("p")).schema["p"].dataType
    left_type = left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType
    ours = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1 if allow_equal else -1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right_type).alias("_right"))
    theirs = right.where(F.col(right_time).isNotNull()).select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left_type).alias("_left"), packed.alias("_right"))
    both = ours.unionByName(theirs).withColumn("_order", F.struct("_t", "_side", "_right")).withColumn("_seen", F.col("_right"))
    if span_s:
        both = both.withColumn("_span", F.floor(F.unix_seconds(F.col("_t").cast("timestamp")) / span_s))
    filled = forward_fill(both, keys, "_order", ["_seen"], "_span" if span_s else None).where(F.col("_left").isNotNull())
    return filled.select("_left.*", *[F.when(F.col("_t").isNotNull(), F.col(f"_seen.{c}")).alias(f"asof_{c}") for c in carried])


def forward_fill(df: DataFrame, keys: list[str], order: str, columns: list[str], span: str | None = None) -> DataFrame:
    """Last non-null value so far, per key in ``order``.

    ``span`` names a column that grows with ``order``: the fill then runs within each key and span, and
    what the spans before hold comes from one row a span, so that no key is one task.
    """
    if span is None:
        window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.last(c, True).over(window) for c in columns})
    window = Window.partitionBy(*keys, span).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = df.groupBy(*keys, span).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_end_{c}") for c in columns])
    earlier = Window.partitionBy(*keys).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col(span).alias("_key_span"), *[F.last(f"_end_{c}", True).over(earlier).alias(f"_in_{c}") for c in columns])
    within = df.withColumns({c: F.last(c, True).over(window) for c in columns})
    same = F.col(span).eqNullSafe(F.col("_key_span"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    out = within.join(carried, same, "left").withColumns({c: F.coalesce(c, f"_in_{c}") for c in columns})
    return out.select(*df.columns)


def lag_change(column: str, keys: list[str], day_number: str, days: int) -> Column:
    """Value less the latest value at least ``days`` days before, as a range window (no self-join)."""
    window = Window.partitionBy(*keys).orderBy(day_number).rangeBetween(Window.unboundedPreceding, -days)
    return F.col(column) - F.last(column).over(window)


def band_anti_join(candidates: DataFrame, official: DataFrame, key: str, day: str, band: int) -> DataFrame:
    """Candidates of known keys without an official row of that key within ``band`` days.

    The band is cut into spans of ``2 * band + 1`` days: official days are spread to their neighbouring
    spans and both sides meet by equality on key and span, so a frequent key does not pair all its rows.
    """
    width = 2 * band + 1
    span = F.floor(F.unix_date(F.col(day)) / width)
    known = candidates.join(official.select(key).distinct(), key, "left_semi")
    days = official.where(F.col(day).isNotNull()).select(F.col(key), F.col(day).alias("_day")).distinct()
    spread = days.withColumn("_span", F.explode(F.array(*[F.floor(F.unix_date(F.col("_day")) / width) + i for i in (-1, 0, 1)])))
    ours = known.withColumn("_span", span)
    near = (ours[key] == spread[key]) & (ours["_span"] == spread["_span"]) & (F.abs(F.datediff(ours[day], spread["_day"])) <= band)
    return ours.join(spread, near, "left_anti").drop("_span")


def fits_broadcast(df: DataFrame, row_bytes: int = _DAY_BYTES) -> bool:
    """Whether the counted rows of ``df`` are within the broadcast bound."""
    return df.count() * row_bytes <= BROADCAST_BYTES
