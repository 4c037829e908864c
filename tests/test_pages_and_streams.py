import json
import zipfile

from pyspark.sql import functions as F

from plumbline.operators import pages, summary
from plumbline.sources import readers
from plumbline.streaming import live

BODY = " ".join(["The committee reviewed conditions."] * 60)


def test_article_block_wins_over_body_and_navigation():
    page = f"<html><head><title>T &amp; U</title></head><body><nav>Menu</nav><div>side</div><div id='article'><p>{BODY}</p><script>x()</script></div></body></html>"
    title, text, flags, words = pages.parse(page)
    assert title == "T & U" and text == BODY and flags == [] and words == 240


def test_other_layouts_and_short_and_missing_pages():
    assert pages.parse(f"<body><div class='col-xs-12 col-sm-8 col-md-8'><p>{BODY}</p></div></body>")[1] == BODY
    assert pages.parse("<body><p>short</p></body>")[2] == ["html_structure_unknown", "short_body"]
    assert pages.parse("<body></body>")[1:] == ("", ["html_structure_unknown", "no_text"], 0)
    assert pages.parse(None)[1:] == ("", ["no_text"], 0)


def test_parse_in_spark_and_longest_variant(spark):
    df = spark.createDataFrame([(1, "<body><p>one two</p></body>"), (1, "<body><p>one two three</p></body>"), (2, None)], "k int, html string")
    parsed = pages.parse_pages(df).select("k", "parsed.text", "parsed.words", F.monotonically_increasing_id().alias("at"))
    best = {r["k"]: r["text"] for r in pages.best_variant(parsed, ["k"], "words", "at").collect()}
    assert best == {1: "one two three", 2: ""}


def test_statement_range(spark):
    text = "The Committee decided to raise the target range for the federal funds rate to 4-3/4 to 5 percent."
    df = spark.createDataFrame([(text,), ("nothing",)], "t string")
    rows = df.select(*[c.alias(n) for n, c in pages.statement_policy(F.col("t")).items()]).collect()
    assert tuple(rows[0]) == ("raise", "4.75", "5", None) and rows[1]["decision"] == "maintain" and rows[1]["range_from"] is None and rows[1]["error"] == "no federal funds rate mention"
    odd = spark.createDataFrame([("",), ("The federal funds rate was discussed.",)], "t string")
    assert [r["error"] for r in odd.select(pages.statement_policy(F.col("t"))["error"].alias("error")).collect()] == ["no article body", "no target range"]


def test_event_pages(spark):
    page = "<body><div id='article'><p>March 3, 2020</p><h3>The Title</h3><p>{}</p><p>At the Forum</p><p>Share</p><p>12</p><p>Body one.</p><p>two</p></div></body>"
    assert pages.board_page(page.format("Governor A. Name")) == pages.board_page(page.format("Governor A. Name").replace("March 3, 2020", "3/3/2020")) == ("20200303", "The Title", "Governor A. Name", "Body one. two")
    assert pages.board_page(page.format("A. Guest"))[2] == "A. Guest" and pages.board_page(None) == pages.board_page("<p></p>") == (None, "", "", "")
    df = spark.createDataFrame([(1, page.format("Member B")), (2, None)], "k int, html string")
    assert {r["k"]: r["participant"] for r in pages.board_pages(df).collect()} == {1: "Member B", 2: ""}
    got = df.select(pages.plain_text(F.lit("a &amp; b<!-- x --><script>y()</script><b>c</b>\u2014d\x07")).alias("t")).first()["t"]
    assert got == "a & b c -d"


def test_long_texts_are_ranked_whole(monkeypatch):
    import random

    rng = random.Random(1)
    text = " ".join(" ".join(rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(rng.randint(1, 15))) + "." for _ in range(500))
    whole = summary.summarize(text)
    monkeypatch.setattr(summary, "MATRIX", 10_000)
    assert summary.summarize(text) == whole


def test_summary_is_extractive_and_bounded():
    text = " ".join(f"Sentence number {i} speaks about prices and growth." for i in range(1000))
    got = summary.summarize(text)
    assert got is not None and got.count("Sentence") == 3 and all(s in text for s in got.split(". "))
    assert summary.summarize("short") is None and summary.summarize(None) is None


def test_readers(spark, tmp_path):
    (tmp_path / "s.csv").write_text("DATE,V\n2020-01-01,1.5\n2020-01-02,.\n,2\n")
    assert [tuple(r) for r in readers.series_csv(spark, str(tmp_path / "s.csv"), "X").collect()] == [("X", "2020-01-01", 1.5)]
    (tmp_path / "s.json").write_text(json.dumps({"observations": [{"date": "2020-01-01", "value": "2"}, {"date": "2020-01-02", "value": "."}]}))
    assert readers.series_json(spark, str(tmp_path / "s.json"), "X").count() == 1
    (tmp_path / "i.json").write_text("﻿" + json.dumps([{"d": "3/5/2020 10:00:00 AM", "t": "T", "s": "S", "l": "/newsevents/speech/abc20200305a.htm"}]), encoding="utf-8")
    assert tuple(readers.speech_index(spark, str(tmp_path / "i.json")).collect()[0])[:2] == ("abc20200305a", "20200305")
    (tmp_path / "lex.tsv").write_text("Word\tPositive\tNegative\nGOOD\t1\t0\nBAD\t0\tTRUE\n")
    index = spark.createDataFrame([("a", "A", "/newsevents/speech/a.htm"), ("b", "B", "/other/b.htm")], "slug string, participant string, link string")
    assert [tuple(r) for r in readers.speech_speakers(index).collect()] == [("a", "A")]
    for name, inner in (("y1", "x.csv"), ("y2", "readme.txt")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as out:
            out.writestr(inner, "date,author,text\n2020-03-01,Jo,\"a, b\"\n2021-01-01,,c\n")
    assert [tuple(r) for r in readers.archives(spark, str(tmp_path / "*.zip")).collect()] == [("2020-03-01", "Jo", None, None, "a, b"), ("2021-01-01", None, None, None, "c")]
    landed = spark.createDataFrame([("x_monetary20200101b.htm.html", "B"), ("x_monetary20200101a.htm.html", "A"), ("x_monetary20200202c.html", "C"), ("other", "O")], "url string, html string")
    wanted = spark.createDataFrame([("20200101",), ("20200202",), ("20200303",)], "day string")
    assert {tuple(r) for r in readers.cached_pages(wanted, landed).collect()} == {("20200101", "A"), ("20200202", "C"), ("20200303", None)}
    wanted.write.parquet(str(tmp_path / "seed"))
    assert readers.cached(spark, str(tmp_path / "kept"), str(tmp_path / "seed"), "day string").count() == readers.cached(spark, str(tmp_path / "kept"), "absent", "day string").count() == 3
    assert {tuple(r) for r in readers.lexicon(spark, str(tmp_path / "lex.tsv")).collect()} == {("good", "positive"), ("bad", "negative")}


def _drain(query):
    query.processAllAvailable()
    query.stop()


def test_streams(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    rows = [{"url": "u1", "source": "s", "at": "2024-01-01T00:00:00"}, {"url": "u1", "source": "s", "at": "2024-01-01T00:10:00"}, {"url": "u2", "source": "s", "at": "2024-01-01T00:20:00"}]
    (land / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = live.files(spark, str(land), "url string, source string, at timestamp")
    _drain(live.new_articles(stream, "at").writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "c1")).start())
    assert sorted(r["url"] for r in spark.sql("select url from fresh").collect()) == ["u1", "u2"]


def test_live_signals_count_across_chunks(spark, tmp_path):
    land = tmp_path / "chunks"
    land.mkdir()
    (land / "a.json").write_text(json.dumps({"speech_id": 1, "text": "inflation remains " + "word " * 60 + "we may raise"}))
    stream = live.files(spark, str(land), "speech_id long, text string, seq int", per_trigger=1)
    query = live.live_signals(stream).writeStream.format("memory").queryName("grown").option("checkpointLocation", str(tmp_path / "c2")).outputMode("append").start()
    query.processAllAvailable()
    (land / "b.json").write_text(json.dumps({"speech_id": 1, "text": "rates soon " + "word " * 60 + "recession"}))
    _drain(query)
    assert [tuple(r) for r in spark.sql("select * from grown").collect()] == [(1, 128, 1, 1)]


def test_series_stream_and_changed_feeds(spark, tmp_path):
    land, out = tmp_path / "obs", str(tmp_path / "table")
    land.mkdir()
    obs = [{"series_id": "X", "obs_date": "2020-01-01", "value": v, "fetched_at": f} for v, f in ((1.0, "2020-02-01"), (2.0, "2020-03-01"))]
    (land / "a.json").write_text("\n".join(map(json.dumps, obs)))
    stream = live.files(spark, str(land), "series_id string, obs_date string, value double, fetched_at string")
    live.upsert_series(stream, out, str(tmp_path / "c3")).awaitTermination()
    assert [r["value"] for r in live.current_series(spark, out).collect()] == [2.0]
    a = spark.createDataFrame([("s", "u1")], "source string, url string")
    b = spark.createDataFrame([("s", "u1"), ("s", "u2"), ("t", "u9")], "source string, url string")
    before = __import__("plumbline.operators.reports", fromlist=["fingerprint"]).fingerprint(a, "source", F.col("url"))
    assert {r["source"] for r in live.changed_feeds(before, b, "source", "url").collect()} == {"s", "t"}
    assert live.changed_feeds(before, a, "source", "url").count() == 0
