import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.operators import macro, signals, temporal

D = dt.date


def _align(spark, speeches, meetings):
    s = spark.createDataFrame([(i, d) for i, d in enumerate(speeches)], "i int, day date")
    m = spark.createDataFrame([(d,) for d in meetings], "held date")
    return {r["i"]: (r["meeting_day"], r["rule"]) for r in temporal.align_to_meetings(s, m, "day", "held", []).collect()}


def test_blackout_windows_and_their_edges(spark):
    m = [D(2023, 3, 22), D(2023, 5, 3)]
    got = _align(spark, [D(2023, 3, 10), D(2023, 3, 9), D(2023, 3, 23), D(2023, 3, 24), D(2022, 1, 1), None], m)
    assert got == {
        0: (m[0], "blackout_pre"), 1: (m[0], "no_prior_meeting"), 2: (m[0], "blackout_pre"), 3: (m[0], "post_meeting"), 4: (m[0], "no_prior_meeting"),
    }


def test_overlapping_windows_take_the_earlier_meeting(spark):
    m = [D(2020, 3, 3), D(2020, 3, 15), None]
    assert _align(spark, [D(2020, 3, 4), D(2020, 3, 5)], m) == {0: (m[0], "blackout_pre"), 1: (m[1], "blackout_pre")}
    assert _align(spark, [D(2020, 3, 4)], []) == {0: (None, "no_prior_meeting")}
    assert _align(spark, [], m) == {}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 120), max_size=12), st.lists(st.integers(0, 120), max_size=8))
def test_alignment_equals_brute_force(spark, speeches, meetings):
    day = lambda n: D(2020, 1, 1) + dt.timedelta(n)
    got = _align(spark, [day(n) for n in speeches], [day(n) for n in meetings])
    ms = sorted(set(meetings))
    for i, s in enumerate(speeches):
        inside, earlier = [m for m in ms if m - 12 <= s <= m + 1], [m for m in ms if m <= s]
        want = (inside[0], "blackout_pre") if inside else (earlier[-1], "post_meeting") if earlier else (ms[0] if ms else None, "no_prior_meeting")
        assert got[i] == (day(want[0]) if want[0] is not None else None, want[1])


def test_nearest_takes_the_earlier_of_two(spark):
    s = spark.createDataFrame([(1, D(2020, 1, 5)), (2, None)], "i int, day date")
    m = spark.createDataFrame([(D(2020, 1, 3),), (D(2020, 1, 7),)], "held date")
    assert [(r["i"], r["meeting_day"]) for r in temporal.nearest_meeting(s, m, "day", "held").collect()] == [(1, D(2020, 1, 3))]


def test_as_of_never_looks_ahead_and_keeps_extra_columns(spark):
    left = spark.createDataFrame([("a", 5, "x"), ("a", 1, "y"), ("b", 9, "z"), ("a", None, "w")], "k string, t int, value string")
    right = spark.createDataFrame([("a", 2, 1.0), ("a", 5, 2.0), ("a", 6, 3.0), ("b", None, 4.0)], "k string, t int, v double")
    got = {r["value"]: r["asof_v"] for r in temporal.as_of(left, right, ["k"], "t", "t", ["v"]).collect()}
    assert got == {"x": 2.0, "y": None, "z": None, "w": None}
    strict = {r["value"]: r["asof_v"] for r in temporal.as_of(left, right, ["k"], "t", "t", ["v"], allow_equal=False).collect()}
    assert strict["x"] == 1.0


def test_spans_change_nothing(spark):
    rows = [("a" if i % 3 else "b", i * 7919 % 101, None if i % 4 else float(i)) for i in range(120)] + [("a", None, 5.0)]
    df = spark.createDataFrame(rows, "k string, t int, v double").withColumns({"n": F.monotonically_increasing_id(), "s": F.floor(F.col("t") / 10)})
    df = df.withColumn("o", F.struct("t", "n")).cache()
    plain, spans = (temporal.forward_fill(df, ["k"], "o", ["v"], s) for s in (None, "s"))
    assert sorted(map(str, plain.collect())) == sorted(map(str, spans.collect()))


def test_band_anti_join(spark):
    c = spark.createDataFrame([(1, "a", D(2020, 1, 10)), (2, "a", D(2020, 1, 11)), (3, "q", D(2020, 1, 1)), (4, "a", None)], "i int, name string, day date")
    o = spark.createDataFrame([("a", D(2020, 1, 7)), ("a", D(2020, 1, 7)), (None, D(2020, 1, 1))], "name string, day date")
    assert sorted(r["i"] for r in temporal.band_anti_join(c, o, "name", "day", 3).collect()) == [2, 4]


def test_context_fills_and_lags(spark):
    rows = [("DFEDTARL", "2020-01-01", 1.0), ("DFEDTARU", "2020-01-02", 2.0), ("FEDFUNDS", "2020-01-01", 1.5), ("FEDFUNDS", "2020-04-15", 2.5), ("UNRATE", "2020-01-01", None)]
    wide = macro.wide_context(spark.createDataFrame(rows, "series_id string, obs_date string, value double"))
    got = {r["day"]: r for r in wide.collect()}
    assert got[D(2020, 1, 2)]["target_mid"] == 2.0 and got[D(2020, 1, 1)]["target_mid"] == 1.0
    assert got[D(2020, 4, 15)]["funds_rate_90d"] == 1.0 and got[D(2020, 1, 2)]["funds_rate"] == 1.5 and got[D(2020, 4, 15)]["unemployment"] is None
    docs = spark.createDataFrame([(1, D(2019, 1, 1)), (2, D(2020, 3, 1)), (3, D(2021, 1, 1)), (4, None)], "i int, d date")
    out = {r["i"]: r["asof_funds_rate"] for r in macro.attach_context(docs, wide, "d", ["funds_rate"]).collect()}
    assert out == {1: 0.0, 2: 1.5, 3: 2.5, 4: 0.0}


def test_policy_steps(spark):
    b = spark.createDataFrame([("s", 1, 1.0, 2.0), ("s", 2, 1.25, 2.25), ("s", 3, 1.5, 2.0), ("s", 4, 1.0, 1.5)], "k string, t int, lo double, hi double")
    assert [r["step"] for r in macro.policy_steps(b, "k", "t", "lo", "hi").orderBy("t").collect()] == ["maintain", "raise", "maintain", "lower"]


def test_stable_runs_and_points(spark):
    rows = [("d", i, p) for i, p in enumerate(["a", "b", "b", "u", "u", "b"])] + [("e", 0, "a")]
    df = spark.createDataFrame(rows, "k string, t int, p string")
    assert [tuple(r) for r in signals.first_stable(df, ["k"], "t", "p", 2).collect()] == [("d", 1, "b")]
    assert [tuple(r) for r in signals.first_stable(df, ["k"], "t", "p", 2, wanted=F.lit("u")).collect()] == [("d", 3, "u")]
    totals = spark.createDataFrame([(0,), (10,), (160,), (10000,)], "n int")
    got = {r["n"]: r["p"] for r in totals.select("n", signals.timeline_points(F.col("n"), 60, 100, 35).alias("p")).collect()}
    assert got[0] == [] and got[10] == [10] and got[160] == [60, 160] and len(got[10000]) <= 36 and got[10000][-1] == 10000
