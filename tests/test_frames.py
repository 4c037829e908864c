import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators import builders, corpus, frames, macro, models, reports, signals, store, temporal
from plumbline.plans import rebuild

CONTEXT = "id int, event_date date, high string, low string, fomc_ref_date string, alignment_rule string, quality_score double, labels_from_fred boolean"


def test_policy_context(spark):
    day = dt.date(2023, 3, 15)
    rows = [
        (1, day, "5", "4.75", "20230322", "blackout_pre", 0.5, True), (2, day, "x", None, "", None, None, None), (3, day, "1", "1", "20220101", "nan", 9.0, False),
        (4, day, "1", "2", "20230301", "none", -1.0, None), (5, day, "1", "2", "20230320", "", float("nan"), None),
    ]
    df = spark.createDataFrame(rows, CONTEXT).withColumn("target_mid", F.lit("clash"))
    got = {r["id"]: r for r in frames.policy_context(df).collect()}
    assert (got[1]["target_lower"], got[1]["target_mid"], got[1]["target_spread"], got[1]["alignment_days"]) == (4.75, 4.875, 0.25, 7.0) and got[1]["derived_labels_feature"] == 1.0
    assert (got[2]["target_mid"], got[2]["alignment_days"], got[2]["rule_blackout_pre"], got[2]["quality_feature"]) == (0.0, 0.0, 1.0, 1.0)
    assert (got[3]["alignment_abs_days"], got[3]["rule_post_meeting"], got[3]["quality_feature"]) == (180.0, 1.0, 1.0) and got[4]["rule_post_meeting"] == 1.0 and got[4]["quality_feature"] == 0.0
    assert got[5]["rule_blackout_pre"] == 1.0 and got[5]["quality_feature"] == 1.0
    assert frames.policy_context(df.where("false").drop("alignment_rule", "high")).count() == 0
    flags = spark.createDataFrame([("Yes",), ("0",), (None,), ("TRUE",), ("y ",)], "f string")
    assert [r[0] for r in flags.select(frames.truthy(F.col("f"))).collect()] == [True, False, False, True, True]


def test_external_features_last_one_wins(spark):
    df = spark.createDataFrame([("a",), ("b",)], "doc_hash string")
    cache = spark.createDataFrame([("a", 1, *[0.2] * 8), ("a", 2, *[7.0] * 8)], "doc_hash string, at int, " + ", ".join(f"{c} double" for c in frames.EXTERNAL))
    got = {r["doc_hash"]: r["ext_hawkish"] for r in frames.attach_external(df, cache, order=[F.desc("at")]).collect()}
    assert got == {"a": 1.0, "b": 0.0}


def test_features_use_the_context(spark):
    df = spark.createDataFrame([("restrictive " * 3 + "recession", 5.0, 0.5), (None, None, None)], "t string, target_mid double, ext_hawkish double")
    a, b = frames.dense_features(df, "t", F.lit(1.0), ["t"]).collect()
    assert len(a) == 38 and a["hawkish_hits"] == 3 and a["level_hawkish"] == pytest.approx(5 * 750) and a["high_dovish"] == pytest.approx(2.5 * 250) and a["external_hawkish"] == pytest.approx(375)
    assert b["hawkish_hits"] == 0 and b["low_hawkish"] == 0


def test_first_acceptable(spark):
    long, short = "word " * 120, "few words"
    rows = [
        ("a", 1, "u1", short), ("a", 2, "u2", long), ("a", 3, "u3", long), ("b", 1, "u1", None), ("b", 2, "u2", short), ("b", 3, "u3", short + " more"),
        ("c", 1, "u1.pdf", ""), ("c", 2, "u2", None), ("d", 1, "u1.pdf", None), ("e", 1, None, "x"),
    ]
    got = {r["k"]: (r["source_url"], r["flags"]) for r in builders.first_acceptable(spark.createDataFrame(rows, "k string, n int, url string, t string"), ["k"], "n", "url", "t").collect()}
    assert got == {
        "a": ("u2", []), "b": ("u2", ["short_body"]), "c": ("u1.pdf", ["http_error", "pdf_unreadable", "no_text"]), "d": ("u1.pdf", ["http_error", "no_text"]), "e": (None, ["short_body"]),
    }


def test_speech_records_of_several_sources(spark):
    schema = "url string, day string, participant string, title string, body string, fallback_participant string, fallback_title string"
    rows = [
        ("https://a.test/s/name20200305a.htm", None, "", "T", "b" * 50, "Jo", ""), ("https://a.test/s/x.htm", "3/5/2020", "Al", None, "b" * 39, "", None),
        ("https://a.test/s/y.htm", None, "Al", None, "b" * 50, "", ""), ("https://a.test/s/z20200306b.htm", "", None, "", "w " * 130, None, None),
    ]
    got = builders.speech_records(spark.createDataFrame(rows, schema)).collect()
    assert [(r["slug"], r["date"], r["participant"], r["quality_flags"]) for r in got] == [("name20200305a", "20200305", "Jo", ["short_body"])] and got[0]["text_content"].startswith("T. b")
    a = spark.createDataFrame([("s1", "20200101", "first", "u"), ("s2", "20190101", "old", "u")], "slug string, date string, text_content string, url string")
    b = spark.createDataFrame([("s1", "20200102", "second", "u"), ("s3", "20200103", "third", "u")], "slug string, date string, text_content string, url string")
    assert sorted(r["text_content"] for r in builders.speech_corpus([a, b], "20200101", "20201231").collect()) == ["first", "third"]


def test_meeting_documents_carry_labels(spark):
    meetings = spark.createDataFrame([("s", dt.date(2020, m, 1)) for m in (1, 2, 3)], "site string, day date")
    docs = spark.createDataFrame(
        [("s", dt.date(2020, 2, 1), "statement", "t", "u", None, "raise", "1", "2"), ("s", dt.date(2020, 3, 1), "minutes", "m", "u", ["short_body"], "lower", "0", "0")],
        "site string, day date, document_type string, text string, source_url string, flags array<string>, decision string, high string, low string",
    )
    got = {(r["day"].month, r["document_type"]): (r["decision"], r["flags"]) for r in builders.meeting_documents(meetings, docs).collect()}
    assert len(got) == 9 and got[1, "statement"] == ("maintain", ["no_text"]) and got[2, "statement"] == ("raise", []) and got[3, "minutes"] == ("raise", ["short_body"])


def test_evaluation_and_speed(spark):
    p = spark.createDataFrame([("raise", "raise"), ("raise", "lower"), ("maintain", "uncertain_rate_signal"), ("maintain", None)], "t string, g string")
    r = reports.evaluation(p, "t", "g").first()
    assert (r["rows"], r["accuracy"], r["labels"], r["uncertain_share"]) == (4, 0.25, "maintain,raise", 0.25) and r["f1_present"] == pytest.approx(1 / 3) and r["f1_all"] == pytest.approx(1 / 6)
    empty = reports.evaluation(p.where("false"), "t", "g").first()
    assert empty["rows"] == 0 and empty["accuracy"] is None and empty["f1_all"] is None
    lines = spark.createDataFrame([("a", 10, "x"), ("a", 20, "y"), ("a", 30, "y"), ("b", 10, "y"), ("b", 20, None)], "k string, pct int, g string")
    docs = spark.createDataFrame([("a", "y", 25.0), ("b", "y", None), ("c", "y", 1.0)], "k string, truth string, cue double")
    got = {r["k"]: (r["first_stable_correct"], r["early"], r["before_cue"], r["final_correct"]) for r in reports.speed(lines, docs, "k", "pct", "g").collect()}
    assert got == {"a": (20, True, True, True), "b": (None, False, False, False), "c": (None, False, False, False)}


def test_action_override(spark):
    df = spark.createDataFrame([(0.9, 0.4, 0.45, 0.15), (0.9, 0.5, 0.3, 0.2), (0.2, 1.0, 0.0, 0.0), (0.4, 1.0, 0.0, 0.0), (0.9, 0.34, 0.33, 0.33), (0.9, 0.5, 0.5, 0.0)], "p double, l double, m double, r double")
    out = df.select(signals.action(F.col("p"), F.col("l"), F.col("m"), F.col("r"), lower_from=0.4, lower_gap=0.1).alias("x"), signals.action(*map(F.col, "plmr")).alias("y")).collect()
    assert [r["x"]["action"] for r in out] == ["lower", "lower", "no_rate_signal", "uncertain_rate_signal", "uncertain_rate_signal", "lower"]
    assert [r["y"]["state"] for r in out][1:2] == ["rate_relevant_directional"] and out[5]["y"]["action"] == "uncertain_rate_signal"


def test_store_writes_many_files_a_year_and_logs(spark, tmp_path):
    rows = [("20200101", 2020, f"h{i}") for i in range(40)] + [("x", None, "h")]
    df = spark.createDataFrame(rows, "date string, year int, content_hash string")
    for c in store.MEETING_SCHEMA:
        if c.name not in df.columns:
            df = df.withColumn(c.name, F.lit(None).cast(c.dataType))
    path = str(tmp_path / "m")
    for _ in range(2):
        assert store.merge_and_write(spark, path, df, store.MEETING_SCHEMA, store.MEETING_KEY, file_rows=10) == 41
    assert store.read_corpus(spark, path, store.MEETING_SCHEMA).count() == 41 and len(list((tmp_path / "m" / "year=2020").glob("*.parquet"))) > 2
    store.snapshot(spark, path, str(tmp_path / "copy"))
    store.merge_and_write(spark, path, df.withColumn("content_hash", F.lit("new")).limit(1), store.MEETING_SCHEMA, store.MEETING_KEY)
    store.restore(spark, str(tmp_path / "copy"), path)
    assert store.read_corpus(spark, path, store.MEETING_SCHEMA).count() == 41
    assert store.load_corpus(spark, path, store.MEETING_SCHEMA, ["date", "decision"], (2020, 2020)).count() == 40
    assert "year=2020" in str(store.read_corpus(spark, path, store.MEETING_SCHEMA, (2020, 2020)).inputFiles()) and store.read_corpus(spark, path, store.MEETING_SCHEMA, (1990, 1999)).count() == 0
    plan = store.read_corpus(spark, path, store.MEETING_SCHEMA, (2020, 2020))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    for wrong, columns in ((str(tmp_path / "absent"), ["date"]), (path, ["nothing"])):
        with pytest.raises((FileNotFoundError, ValueError)):
            store.load_corpus(spark, wrong, store.MEETING_SCHEMA, columns)
    with pytest.raises(ValueError):
        store.load_corpus(spark, path, store.MEETING_SCHEMA, ["date"], (1990, 1999))
    failures = spark.createDataFrame([("r", "u", 404, 'a "b"\nc', "now"), ("r", "v", None, None, None)], "run_id string, url string, http_status int, message string, occurred_at string")
    store.write_errors(failures, str(tmp_path / "e"))
    store.write_errors(failures, str(tmp_path / "e"))
    back = spark.read.option("header", True).csv(str(tmp_path / "e")).collect()
    assert len(back) == 4 and {r["message"] for r in back} == {"a 'b' c", None}
    audit = spark.createDataFrame([("h", "d", "statement", "u", 0, 1.0, "1"), ("h", "d", "minutes", "u", 0, 1.0, "1"), ("h", "d", "minutes", "w", 0, 1.0, "2")], "content_hash string, date string, document_type string, source_url string, word_count int, quality_score double, ingested_at string")
    state = store.record_audit(spark, str(tmp_path / "a"), audit, "run").collect()
    assert {(r["document_type"], r["source_url"]) for r in state} == {("statement", "u"), ("minutes", "w")}
    news = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id int, url string")
    assert store.insert_new(spark, str(tmp_path / "n"), news, "url", [F.asc("id")]) == 2
    assert store.insert_new(spark, str(tmp_path / "n"), news.union(spark.createDataFrame([(5, "c")], news.schema)), "url", [F.asc("id")]) == 1


def test_series_cache_comes_first(spark, tmp_path):
    calls = []

    def fetch():
        calls.append(1)
        return spark.createDataFrame([("X", "2020-01-01", float(len(calls)), f"2020-02-0{len(calls)}")], "series_id string, obs_date string, value double, fetched_at string")

    path = str(tmp_path / "c")
    get = lambda **k: [r["value"] for r in macro.cached_series(spark, path, "X", "2020-01-01", "2020-12-31", fetch, **k).collect()]
    assert get() == [1.0] and get() == [1.0] and len(calls) == 1 and get(force=True) == [2.0] and len(calls) == 2
    known = spark.createDataFrame([(1.0, None, None, None), (None, None, None, None)], "funds_rate double, curve double, unemployment double, target_mid double")
    assert sorted(r["context_available"] for r in macro.available(known).collect()) == [0.0, 1.0]


def test_rebuild_fills_gaps(spark, tmp_path):
    meetings = spark.createDataFrame([("20230322", "statement", "word " * 200, "raise", "4.75", "5", "https://a.test/x")], "date string, document_type string, text_content string, decision string, high string, low string, source_url string")
    speeches = spark.createDataFrame([("20230320", "Governor A. Name", "a.test", "word " * 150, "https://a.test/y")], "date string, participant string, domain string, text_content string, source_url string")
    landed = spark.createDataFrame(
        [("2023-03-22", "A. Name", "T", None, "Federal Open Market Committee " * 30), ("2023-04-10", "a name", "T", "", "Federal Open Market Committee " * 30), ("2023-05-10", "B. Other", "T", "", "Federal Open Market Committee " * 30),
         ("2023-06-10", "A. Name", "T", "", "nothing " * 100), ("2019-06-10", "A. Name", "T", "", "Federal Open Market Committee " * 30), ("2023-07-10", "A. Name", "Federal open market committee", "", "short")],
        "date string, author string, title string, description string, text string",
    )
    extra = builders.supplements(landed, "archive.test")
    assert extra.count() == 3
    plan = rebuild.Rebuild(str(tmp_path / "m"), str(tmp_path / "s"))
    assert rebuild.build(spark, meetings, speeches, plan, extra) == (1, 2)
    got = {r["date"]: (r["domain"], r["alignment_rule"], r["decision"]) for r in store.read_corpus(spark, plan.speeches_path, store.SPEECH_SCHEMA).collect()}
    assert got == {"20230320": ("a.test", "blackout_pre", "raise"), "20230410": ("archive.test", "nearest", "raise")}
    off = rebuild.Rebuild(str(tmp_path / "m2"), str(tmp_path / "s2"), fill_gaps=False)
    assert rebuild.build(spark, meetings, speeches, off, extra) == (1, 1)


def test_models_are_scored_explained_and_saved(spark, tmp_path):
    rows = [(i, ("rates rise strongly now", "raise") if i % 2 else ("rates fall slowly now", "lower")) for i in range(40)]
    df = spark.createDataFrame([(i, t, d, "yes" if i % 2 else "no", dt.date(2020, 1, 1) + dt.timedelta(i)) for i, (t, d) in rows], "id int, text string, direction string, relevant string, day date")
    weighted = models.with_class_weights(df, "direction")
    model = models.direction_pipeline().fit(weighted)
    assert models.score(model, df, ["id", "direction"]).where("guess <> direction").count() == 0
    top = {(r["id"], r["rank"]): (r["term"], r["contribution"]) for r in models.contributions(model, df.where("id < 2"), "id", "text", 3).collect()}
    assert len(top) == 6 and top[1, 1][1] > 0 and top[1, 1][0] in ("rise", "strongly", "rates rise", "rise strongly", "strongly now") and "now" not in {t for t, _ in top.values()}
    models.save(model, str(tmp_path / "model"), rows=40)
    back, about = models.load(str(tmp_path / "model"))
    assert about == {"rows": 40, "version": models.VERSION} and models.score(back, df, ["id"]).count() == 40
    relevance = models.direction_pipeline(label="relevant").fit(models.with_class_weights(df, "relevant"))
    line = models.score_timeline(relevance, model, df.where("id < 2"), "id", "text", F.array(F.lit(2), F.lit(4))).orderBy("id", "prefix_words").collect()
    assert [(r["id"], r["prefix_words"], r["prefix_percent"]) for r in line] == [(0, 2, 50.0), (0, 4, 100.0), (1, 2, 50.0), (1, 4, 100.0)] and line[3]["prediction"] == "raise" and line[0]["p_maintain"] == 0.0
    parts = {r["part"]: r["count"] for r in models.chronological_parts(df, "day").groupBy("part").count().collect()}
    assert sum(parts.values()) == 40 and parts["train"] >= 26 and parts["test"] >= 7
    runs = spark.createDataFrame([("a", 0.5), ("b", None), ("c", 0.9)], "run string, f1 double")
    assert [r["run"] for r in models.leaderboard(runs, "f1", 2).collect()] == ["c", "a"]


def test_joins_beyond_the_broadcast_bound_agree(spark, monkeypatch):
    left = spark.createDataFrame([(i, "ab"[i % 2] if i % 7 else None, dt.date(2020, 1, 1) + dt.timedelta(i * 3) if i % 5 else None) for i in range(60)], "id int, s string, day date")
    right = spark.createDataFrame([("a", dt.date(2020, 2, 1), "x"), ("a", dt.date(2020, 2, 1), "y"), ("b", dt.date(2020, 5, 1), "z"), ("b", None, "n")], "s string, held date, label string")
    context = spark.createDataFrame([(dt.date(2020, 1, 5), 1.0), (dt.date(2020, 3, 5), 2.0)], "day date, funds_rate double")

    def run():
        return (
            sorted(map(str, temporal.align_to_meetings(left, right, "day", "held", ["label"], entity="s").collect())), sorted(map(str, temporal.nearest_meeting(left, right, "day", "held").collect())),
            sorted(map(str, macro.attach_context(left, context, "day", ["funds_rate"]).collect())),
        )

    small = run()
    for module in (temporal,):
        monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    assert run() == small and len(small[0]) == 48 and corpus is not None


def test_word_weights_move_no_table_of_all_terms(spark, monkeypatch):
    texts = ["a rates rose again", "Rates fell; rates rose", None, "", "the rates fell", "rose again"]
    df = spark.createDataFrame([(i if i != 4 else None, t) for i, t in enumerate(texts)], "id long, text string").withColumn("n", F.lit("clash"))
    found = signals.word_weights(df, "id", "text")
    want = {(0, "rates", 1, 3), (0, "rose", 1, 3), (0, "again", 1, 2), (0, "rates rose", 1, 2), (0, "rose again", 1, 2), (1, "rates", 2, 3), (1, "fell", 1, 2), (1, "rose", 1, 3), (1, "rates fell", 1, 2), (1, "rates rose", 1, 2)}
    want |= {(None, "rates", 1, 3), (None, "fell", 1, 2), (None, "rates fell", 1, 2), (5, "rose", 1, 3), (5, "again", 1, 2), (5, "rose again", 1, 2)}
    rows = found.collect()
    assert {(r["id"], r["term"], r["tf"], r["df"]) for r in rows} == want and len(rows) == len(want)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(signals, "BLOCK_CHARACTERS", 20)
    assert {tuple(r) for r in signals.word_weights(df, "id", "text").collect()} == {tuple(r) for r in rows}
    assert signals.word_weights(df, "id", "text", min_documents=9).count() == signals.word_weights(df.where("false"), "id", "text").count() == 0
