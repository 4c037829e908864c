"""Operators across records: nearest in time, names, repeated lines, page templates."""

import random
from itertools import combinations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plumbline.llm import lines, names, nearest, template

from ..conftest import SMALL


def _nearest(spark, left, right, tolerance=10):
    a = spark.createDataFrame(left, "id long, site string, day int").withColumn("keys", F.lit("clash"))
    b = spark.createDataFrame(right, "site string, day int")
    return {r["id"]: r["found"] for r in nearest.nearest_in_time(a, b, "id", "site", "day", "site", "day", tolerance).withColumnRenamed("day", "found").collect()}


def test_nearest_edges_ties_and_nulls(spark):
    right = [("s", 100), ("s", 110), ("s", 110), ("s", 1023), ("s", 1025), (None, 100), ("t", None)]
    left = [(1, "s", 105), (2, "s", 90), (3, "s", 89), (4, "s", 1024), (5, None, 100), (6, "s", None), (7, "t", 100), (8, "s", 1035)]
    assert _nearest(spark, left, right) == {1: 100, 2: 100, 4: 1023, 8: 1025}
    assert _nearest(spark, [], right) == {} and _nearest(spark, left, []) == {}


def test_nearest_beyond_the_broadcast_bound_agrees(spark, monkeypatch):
    left, right = [(i, "ab"[i % 2], i * 7 % 400) for i in range(80)], [("a", i * 37 % 400) for i in range(20)] + [("b", 5)]
    small = _nearest(spark, left, right)
    monkeypatch.setattr(nearest, "BROADCAST_BYTES", 0)
    assert _nearest(spark, left, right) == small and small


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-3000, 3000), max_size=200, unique=True), st.integers(0, 2**30))
def test_nearest_equals_brute_force(spark, days, seed):
    rng = random.Random(seed)
    probes = [rng.randint(-3050, 3050) for _ in range(60)]
    got = _nearest(spark, [(i, "s", p) for i, p in enumerate(probes)], [("s", d) for d in days])
    for i, p in enumerate(probes):
        near = sorted((abs(d - p), d) for d in days if abs(d - p) <= 10)
        assert got.get(i) == (near[0][1] if near else None)


@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=300, unique=True))
def test_learned_positions_are_within_the_bound(days):
    days = sorted(days)
    segments = nearest.fit_segments(days)
    for i, d in enumerate(days):
        first, slope, at = [s for s in segments if s[0] <= d][-1]
        assert abs(at + slope * (d - first) - i) <= nearest.ERROR + 1e-6


PEOPLE = {
    "andrew": ["Andrew Kordra", "ANDREW KORDRA", "Kordra, Andrew", "Kordra Andrew", "Andy Kordra", "Andrew \"Drew\" Kordra", "A. Kordra", "President Kordra", "Dr. Andrew G. Kordra", "Andrew Kordra, Ph.D.", "And. Kordra, President", "Andrew  Kördra", "Andrew Korrdra"],
    "lawrence": ["Lawrence Dovvo", "Larry Dovvo", "L. Dovvo", "Dovvo, Lawrence", "Vice Chair, Supervision Lawrence B. Dovvo"],
    "theodore": ["Theodore Dovvo", "Gov T. Dovvo", "Dovvo, Theo", "Theodore L. Dovvo"],
    "bank": ["Bank of Pelsk", "Bk. of Pelsk", "The Bank of Pelsk", "Pelsk, Bank of", "Pelsk Bank", "Bnak of Pelsk", "BANK OF PELSK"],
    "institute": ["Institute for Falth Studies", "Inst. for Falth Studies", "Falth Studies Institute", "Inst Falth Studies"],
    "committee": ["Hesnd Monetary Committee", "Hesnd Mon. Comm.", "Monetary Committee (Hesnd)", "Hesnd Monetary Cttee"],
}


def test_variants_of_one_name_are_linked_and_others_are_not(spark):
    rows = [(n,) for v in PEOPLE.values() for n in v] + [("nan",), ("",), (None,), (" ",), ("Andrew Kordra",)]
    df = spark.createDataFrame(rows, "participant string").withColumns({"entity": F.lit("clash"), "form": F.lit("clash")})
    got = {(r["name_a"], r["name_b"]) for r in names.name_pairs(df).collect()}
    assert got == {tuple(sorted(p)) for v in PEOPLE.values() for p in combinations(v, 2)}
    assert names.name_pairs(df.where("false")).count() == 0


def test_a_misspelt_name_keeps_its_links_however_many_spellings_it_has(spark):
    styles = ("Andrew {}", "ANDREW {}", "{}, Andrew", "{} Andrew", "Dr. Andrew {}", "Andy {}", "President Andrew {}")
    for k in (2, 3, 7):
        spellings = [s.format(family) for family in ("Kordra", "Korrdra") for s in styles[:k]]
        df = spark.createDataFrame([(n,) for n in spellings], "participant string")
        assert {tuple(r) for r in names.name_pairs(df).collect()} == {tuple(sorted(p)) for p in combinations(spellings, 2)}


def _pages(rng):
    words = [f"word{i}" for i in range(400)]
    rows = []
    for site, furniture in (("a.test", ["Menu of A", "Subscribe to A letter 12", "Terms of A"]), ("b.test", ["Home of B", "Photo: B archive", "Legal B"]), ("c.test", [])):
        for i in range(40):
            body = [" ".join(rng.choice(words) for _ in range(30)) + "." for _ in range(4)] + (["Thank you."] if i % 9 == 0 else [])
            kept = [f.replace("12", str(rng.randint(1, 99))) for f in furniture if rng.random() < 0.8]
            rows.append((len(rows), site, "\r\n".join([*kept[:1], *body, *kept[1:]]), len(kept[:1]), len(body)))
    return rows


def test_template_lines_are_found_and_the_body_is_not(spark):
    rows = _pages(random.Random(5))
    df = spark.createDataFrame([r[:3] for r in rows] + [(900, "a.test", None), (901, None, " \n "), (902, None, "Alone.")], "id long, site string, text string").withColumn("token", F.lit("clash"))
    got = {(r["id"], r["line_no"]) for r in template.furniture_lines(df, F.col("site"), "id", "text").collect()}
    want = {(i, n) for i, _, text, top, body in rows for n in range(1, text.count("\n") + 2) if not top < n <= top + body}
    assert got == want
    assert template.furniture_lines(df.where("false"), F.col("site"), "id", "text").count() == 0


def test_large_templates_and_line_tables_are_joined_instead_of_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([r[:3] for r in _pages(random.Random(5))], "id long, site string, text string")
    results = []
    for bound in (template.BROADCAST_BYTES, 0):
        monkeypatch.setattr(template, "BROADCAST_BYTES", bound)
        monkeypatch.setattr(lines, "BROADCAST_BYTES", bound)
        furniture = {tuple(r) for r in template.furniture_lines(df, F.col("site"), "id", "text").collect()}
        repeated = {tuple(r) for r in lines.repeated_lines(df, F.col("site"), "id", "text").collect()}
        sequences = lines.frequent_sequences(df, F.col("site"), "id", "text").count()
        results.append((furniture, repeated, sequences))
    assert results[0] == results[1] and results[0][0] and results[0][1]


def test_furniture_forms():
    body = "The committee judged that risks had become more even, although it remained too early to say whether the pause would last at all."
    text = f"Published: 12 Mar 2010\nSpeech by A. Day at the Kelvast Forum\nHome > News > 2024 > Wages\nThe pause and the outlook\n{body}\nRead more: A note on wages\nHome and abroad: wages\n{body}\nWe use cookies for statistics. OK, got it\nThank you."
    assert template.furniture_of(text, set()) == [1, 2, 3, 9]
    assert template.furniture_of(text, set(), {template._key("read more\u0002")}) == [1, 2, 3, 6, 9]


def _rare_notices(rng):
    """A large site where each notice, with a varying middle, is on one page in a hundred, and sidebars of titles whose heading is on few pages."""
    words = [f"{a}{b}{c}u" for a in "bdfgklmprst" for b in "aeio" for c in "lmnrst"]
    notices = [f"Desk {c}x of {{}} {{}} is open on {c}day" for c in "abcdefghij"]
    rows = []
    for i in range(1600):
        body = [" ".join(rng.choice(words) for _ in range(30)) + "." for _ in range(3)]
        side = []
        if i % 160 == 0:
            side = ["Seen elsewhere", *(" ".join(rng.choice(words) for _ in range(6)) for _ in range(2))]
        notice = [notices[i % 10].format(rng.choice(words), rng.choice(words))] if i % 10 == i // 80 else []
        rows.append((i, "big.test" if i < 800 else "other.test", "\n".join([*body, *notice, *side, body[0]]), len(notice) + len(side)))
    return rows


def test_classes_and_slots_decide(spark, monkeypatch):
    rows = _rare_notices(random.Random(8))
    df = spark.createDataFrame([r[:3] for r in rows], "id long, site string, text string")
    want = {(i, n) for i, _, _, held in rows for n in range(4, 4 + held)}

    def recall():
        got = {(r["id"], r["line_no"]) for r in template.furniture_lines(df, F.col("site"), "id", "text").collect()}
        assert got <= want
        return len(got) / len(want)

    assert recall() > 0.9
    monkeypatch.setattr(template, "CLASS_TOKENS", 10**6)
    assert recall() < 0.7
    monkeypatch.setattr(template, "OPEN_COUNT", 10**6)
    assert recall() < 0.5


def test_repeated_lines_equal_brute_force(spark):
    rng = random.Random(2)
    pool = ["Share  this", "SHARE this", "Call 12", "call 345", "One", "Two", "", "  "]
    rows = [(i, rng.choice(["s", "t", None]), rng.choice([None, " ", "\n".join(rng.choice(pool) + rng.choice(["", "\r"]) for _ in range(6))])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, site string, text string").withColumn("line", F.lit("clash"))
    got = {(r["id"], r["line_no"]) for r in lines.repeated_lines(df, F.col("site"), "id", "text", 10, 0.45).collect()}
    import re

    norm = lambda x: re.sub("[0-9]+", "#", re.sub(r"\s+", " ", x).strip().lower())
    want = set()
    for site in ("s", "t"):
        docs = {i: [norm(x) for x in t.split("\n")] for i, s, t in rows if s == site and t and t.strip()}
        for key in {k for ks in docs.values() for k in ks if k}:
            support = sum(key in ks for ks in docs.values())
            if support >= 10 and support >= 0.45 * len(docs):
                want |= {(i, n) for i, ks in docs.items() for n, k in enumerate(ks, 1) if k == key}
    assert got == want and want
    deeper = {(r["id"], r["line_no"]) for r in lines.repeated_lines(df, F.col("site"), "id", "text", 10, 0.45, max_length=None).collect()}
    assert deeper == got


def test_frequent_sequences_and_cleaning(spark):
    rows = [(i, "s", f"Intro {i} text\nShare this\nFollow us\nBody number {i * 7919 % 97} of it") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, site string, text string")
    got = sorted((r["length"], r["support"]) for r in lines.frequent_sequences(df, F.col("site"), "id", "text").collect())
    assert got == [(1, 30), (1, 30), (1, 30), (1, 30), (2, 30), (2, 30), (2, 30), (3, 30), (3, 30), (4, 30)]
    cleaned = lines.without_repeated(df, F.col("site"), "id", "text", min_documents=31)
    assert cleaned.where("id = 3").collect()[0]["text"] == rows[3][2]
    assert lines.frequent_sequences(df.where("false"), F.col("site"), "id", "text").count() == 0


def test_registered_queries_have_their_columns(spark):
    want = {
        "p1_found": ["fomc_id"], "p2_found": ["speech_id", "fomc_date"], "p3_found": ["name_a", "name_b"], "p4_found": ["speech_id", "line_no"], "p5_found": ["fomc_id"],
        "p6_found": ["fomc_id", "turn_no", "who"], "p7_found": ["speech_id", "line_no"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"],
    }
    for name, columns in want.items():
        df = entry.queries()[name](spark, SMALL)
        assert df.columns == columns, name
        if name != "p8_ids":
            assert df.count() == df.distinct().count(), name


def test_long_sequences_are_grown_whole_and_with_gaps(spark):
    footer = ["Terms", "Privacy", "Contact", "Press", "Jobs", "Archive"]
    words = ["alpha", "beta", "gamma"]
    rows = [(i, "s", "\n".join(x for f in footer for x in (f, *(["note " + words[i % 3] * (i + 1)] if f == "Press" else [])))) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, site string, text string")
    runs = [r["length"] for r in lines.frequent_sequences(df, F.col("site"), "id", "text").collect()]
    assert sorted(runs) == [1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 4]
    whole = spark.createDataFrame([(i, "s", "\n".join(footer)) for i in range(12)], "id long, site string, text string")
    assert max(r["length"] for r in lines.frequent_sequences(whole, F.col("site"), "id", "text").collect()) == 6
    got = [(r["length"], r["support"]) for r in lines.frequent_sequences(df, F.col("site"), "id", "text", gaps=True).collect()]
    assert sorted(got) == sorted((n, 30) for n in range(1, 7) for _ in combinations(footer, n))


def test_sequences_with_gaps_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("st"), "\n".join(rng.choice("abcde") for _ in range(6))) for i in range(80)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "id long, site string, text string")
    got = {(r["site"], r["length"], tuple(r["lines"])): r["support"] for r in lines.frequent_sequences(df, F.col("site"), "id", "text", 10, 0.25, gaps=True).collect()}
    names = {r["h"]: r["x"] for r in spark.createDataFrame([(x,) for x in "abcde"], "x string").select("x", F.xxhash64("x").alias("h")).collect()}
    want = {}
    for site in "st":
        docs = [t.split("\n") for _, s, t in rows if s == site]
        held = [{c for n in range(1, 7) for c in combinations(d, n)} for d in docs]
        for c in set().union(*held):
            support = sum(c in h for h in held)
            if support >= 10 and support >= 0.25 * len(docs):
                want[site, len(c), c] = support
    assert {(s, n, tuple(names[x] for x in c)): k for (s, n, c), k in got.items()} == want and max(n for _, n, _ in want) >= 3
