import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from plumbline.functions import scores as S
from plumbline.functions import text as T
from plumbline.functions.dates import readable_day, site_of


def one(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["r"] for r in df.select("i", column(F.col("v")).alias("r")).orderBy("i").collect()]


def test_hash_ignores_outer_white_space(spark):
    got = one(spark, ["  hello world \n", "hello world", " hello world ", None, ""], T.content_hash)
    want = hashlib.sha256(b"hello world").hexdigest()
    assert got[:3] == [want] * 3 and got[3] == got[4] == hashlib.sha256(b"").hexdigest()


def test_plain_words_and_counts(spark):
    assert one(spark, ["Hello!!!   World??", " café - olé "], T.plain_words) == ["Hello World", "café olé"]
    assert one(spark, ["a b c\n\nd", "", "  ", None], T.word_count) == [4, 0, 0, 0]


def test_extractions(spark):
    t = "On March 3, 2020 and 2021-05-06, up 2.5 % or 25 basis points; April 4 2019."
    assert one(spark, [t], T.dates_in) == [["March 3, 2020", "April 4 2019", "2021-05-06"]]
    assert one(spark, [t], T.percentages_in) == [["2.5 %"]]
    assert one(spark, [t], T.basis_points_in) == [["25 basis points"]]


def test_two_kinds_of_hits(spark):
    t = "Interest rates and the interest rate; disinflation, inflation."
    assert one(spark, [t, None], lambda c: T.substring_hits(c, "inflation")) == [2, 0]
    assert one(spark, [t, None], lambda c: T.bounded_hits(c, "inflation")) == [1, 0]
    assert one(spark, [t], S.policy_score) == [3.0 * 2 + 3.0 + 2.0 * 2]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("20240229", dt.date(2024, 2, 29)), ("20240229.0", dt.date(2024, 2, 29)), ("2024-02-29", dt.date(2024, 2, 29)), ("2/9/2024", dt.date(2024, 2, 9)),
     ("March 3, 2020", dt.date(2020, 3, 3)), ("20230229", None), ("2024", None), ("undated", None), ("", None), (None, None), ("13/40/2024", None)],
)
def test_readable_days(spark, raw, want):
    assert one(spark, [raw], readable_day) == [want]


def test_sites(spark):
    df = spark.createDataFrame([("WWW.A-Bank.example", None), (None, "https://m.b.test/x?y"), (None, None), (None, "amp.c.test/x")], "d string, u string")
    assert [r[0] for r in df.select(site_of(F.col("u"), F.col("d"))).collect()] == ["a-bank.example", "b.test", None, None]


def test_quality_score_and_rates(spark):
    df = spark.createDataFrame([(800, []), (10, ["no_text", "pdf_unreadable", "html_structure_unknown", "http_404"]), (None, None)], "n int, f array<string>")
    assert [r[0] for r in df.select(S.quality_score(F.col("n"), F.col("f"))).collect()] == [1.0, 0.0, 0.9]
    assert one(spark, ["5-1/4", "1/2", "4.75", "x", None, "1/0"], S.rate_value) == [5.25, 0.5, 4.75, None, None, None]
    assert one(spark, [5.25, 5.0, 0.125], S.rate_text, "double") == ["5.25", "5", "0.125"]


def test_prefix_and_cue(spark):
    assert one(spark, ["a b c d e", "", None], lambda c: T.prefix(c, F.lit(50))) == ["a b c", "", ""]
    text = "one two three four we decided to maintain the target range"
    assert one(spark, [text, "none here"], S.cue_word_percent) == [pytest.approx(100 * 5 / 11, abs=0.051), None]


def test_names_as_keys(spark):
    assert one(spark, ["Vice Chair for Supervision Ann O'Neil", "Governor  Ann  O'Neil", None], T.person_key) == ["ann o neil", "ann o neil", ""]
