
import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import corpus, reports, store
from plumbline.plans import guard, rebuild


def _docs(spark, rows):
    return spark.createDataFrame(rows, "date string, document_type string, text_content string, quality_flags array<string>, source_url string, decision string")


def test_write_twice_is_one_write(spark, tmp_path):
    path = str(tmp_path / "fomc")
    docs = corpus.canonical(_docs(spark, [("20230322", "statement", "a " * 200, [], "u1", "raise"), ("20230503", "minutes", "", ["no_text", "pdf_unreadable"], "u2", "raise")]), "fomc")
    for _ in range(2):
        assert store.merge_and_write(spark, path, docs, store.MEETING_SCHEMA, store.MEETING_KEY) == 2
    back = store.read_corpus(spark, path, store.MEETING_SCHEMA)
    assert back.count() == 2 and {r["year"] for r in back.collect()} == {2023}
    more = corpus.canonical(_docs(spark, [("20240101", "statement", "b", None, "u3", "raise")]), "fomc")
    store.merge_and_write(spark, path, more, store.MEETING_SCHEMA, store.MEETING_KEY)
    assert store.read_corpus(spark, path, store.MEETING_SCHEMA, (2024, 2024)).collect()[0]["quality_flags"] == []
    assert store.read_corpus(spark, path, store.MEETING_SCHEMA).count() == 3
    assert "PartitionFilters: [isnotnull(year" in store.read_corpus(spark, path, store.MEETING_SCHEMA, (2024, 2024))._jdf.queryExecution().toString()


def test_absent_store_is_empty(spark, tmp_path):
    assert store.read_corpus(spark, str(tmp_path / "none"), store.SPEECH_SCHEMA).count() == 0


def test_upsert_and_ignore(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    new = spark.createDataFrame([(2, "z"), (2, "a"), (3, "q")], "k int, v string")
    assert {tuple(r) for r in store.upsert(old, new, ["k"], [F.desc("v")]).collect()} == {(1, "x"), (2, "z"), (3, "q")}
    urls = spark.createDataFrame([("u", 1), ("u", 2), ("w", 3), (None, 4), (" ", 5)], "url string, n int")
    stored = spark.createDataFrame([("w",)], "url string")
    assert [r["n"] for r in store.insert_ignore(stored, urls, "url", [F.asc("n")]).collect()] == [1]


def test_flags(spark):
    df = spark.createDataFrame([('["a", "b"]',), ("bare",), ("",), (None,), ("[broken",)], "f string")
    assert [r[0] for r in df.select(corpus.flags_of(F.col("f"))).collect()] == [["a", "b"], ["bare"], [], [], ["[broken"]]


def test_coverage(spark):
    rows = [
        ("s", "20230322", "statement", "one two three", "h1", []), ("s", "20230322", "statement", "one", "h2", ["no_text"]),
        ("s", "20230322", "minutes", "text", "h3", ["pdf_unreadable"]), ("s", "20230503", "statement", None, "h4", None),
    ]
    df = spark.createDataFrame(rows, "site string, day string, document_type string, text_content string, content_hash string, quality_flags array<string>")
    got = {r["day"]: r for r in corpus.coverage(df, ["statement", "minutes"], "site", "day").collect()}
    assert got["20230322"]["statement"] and not got["20230322"]["minutes"] and not got["20230322"]["complete"] and got["20230322"]["flags"] == ["pdf_unreadable"]
    assert not got["20230503"]["statement"]


def test_build_aligns_every_dated_speech_once(spark, tmp_path):
    meetings = _docs(spark, [("20230322", "statement", "m", [], "https://a.test/1", "raise")]).withColumns({"high": F.lit("4.75"), "low": F.lit("5")})
    speeches = spark.createDataFrame(
        [("20230320", "P Q", "a.test", "t1", "https://a.test/2"), ("20230410", "P Q", "a.test", "t2", "https://a.test/3"), ("nan", "P Q", "a.test", "t3", "https://a.test/4")],
        "date string, participant string, domain string, text_content string, source_url string",
    )
    plan = rebuild.Rebuild(str(tmp_path / "m"), str(tmp_path / "s"))
    assert rebuild.build(spark, meetings, speeches, plan) == (1, 2)
    got = {r["date"]: (r["alignment_rule"], r["fomc_ref_date"], r["decision"]) for r in store.read_corpus(spark, plan.speeches_path, store.SPEECH_SCHEMA).collect()}
    assert got == {"20230320": ("blackout_pre", "20230322", "raise"), "20230410": ("post_meeting", "20230322", "raise")}


def test_guard(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "set int, t string").createOrReplaceTempView("guarded_one")
    good = [
        "select 1 as a union all select 2", "with x as (select 'drop table; now' as t) select replace(t, 'drop', '') from x", "select set from guarded_one where t in (select t from guarded_one)",
        "select a.set, (select max(set) from guarded_one) as m from guarded_one a join range(3) r on true", "with y as (select * from guarded_one) select count(*) from y where exists (select 1 from y)",
    ]
    for sql in good:
        assert guard.run(spark, sql, 1).count() == 1, sql
    spark.range(3).write.parquet(str(tmp_path / "secret"))
    place = f"parquet.`{tmp_path}/secret`"
    bad = [
        "drop table x", "select 1; select 2", "with x as (select 1) insert into t select * from x", "", "explain select 1", "select * from nowhere_else",
        f"select * from {place}", f"select (select max(id) from {place})", f"select 1 where exists (select 1 from {place})", f"with x as (select * from {place}) select * from x",
        f"select 1 where 1 in (select id from {place})", f"select 1 from guarded_one where t = (select max(t) from (select * from {place}))", f"select * from guarded_one, lateral (select * from {place})",
        "select java_method('java.lang.System', 'getProperty', 'user.home')", "select reflect('java.lang.System', 'getProperty', 'user.home')", "select upper(try_reflect('java.lang.System', 'getProperty', 'user.home'))",
        "select * from spark_catalog.default.guarded_one", "select not a statement from",
    ]
    for sql in bad:
        with pytest.raises(ValueError):
            guard.check(spark, sql)
    with pytest.raises(ValueError):
        guard.check(spark, "select * from guarded_one", views=["other"])
    assert json.loads(guard.as_json(spark, "select set from guarded_one")) == {"rows": [{"set": 1}], "count": 1}
    assert "error" in json.loads(guard.as_json(spark, bad[6])) and "error" in json.loads(guard.as_json(spark, "select nope from guarded_one"))

def test_reports(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "t string, g string")
    assert reports.f1_by(df.withColumn("k", F.lit(1)), ["k"], "t", "g").collect()[0]["f1"] == pytest.approx((0.5 + 2 / 3 + 0) / 3)
    assert {r["value"]: r["share"] for r in reports.distribution(df, F.col("t")).collect()}["a"] == 0.5
    cross = {r["row"]: (r["a"], r["b"]) for r in reports.crosstab(df, "t", "g", ["a", "z"], ["a", "b"]).collect()}
    assert cross == {"a": (1, 1), "z": (0, 0)}
    same = reports.fingerprint(df, "t", F.col("g")).collect()
    assert {r["t"]: r["hash"] for r in same} == {r["t"]: r["hash"] for r in reports.fingerprint(df.orderBy(F.desc("g")), "t", F.col("g")).collect()}


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="b, c"):
        corpus.require(spark.createDataFrame([(1,)], "a int"), ["a", "b", "c"])


def test_workers_can_import_the_package(spark):
    from plumbline.runtime import ship

    ship(spark)
    ship(spark)
    assert spark.sparkContext.parallelize([0], 1).map(lambda _: __import__("plumbline").__version__).first()
