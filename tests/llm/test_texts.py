"""Operators on single texts: statistics, residue, turns, spam, encoding."""

import base64
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import mixing, quality, residue, spam, tokens, turns

PROSE = "The committee judged that risks had become more even, although it remained too early to say whether the pause would last. "
KINDS = [
    (1, PROSE * 3), (2, "Item;Q1 2003;Q2 2020\nTrade balance;127.63;51\nWages;3.7;47\nJobs;12;9.5"), (3, "- Wages, quenby\n- Prices, ashmoor\n- Rates, talmere\n- Jobs, kelvast"),
    (4, PROSE + "\nItem | A | B\n" + "\n".join(f"Row {i} | {i}.5 | {i * 3}" for i in range(40))), (5, None), (6, " \n "), (7, "New orders beat forecasts. Wages fell 3.5 percent. Output slowed again."),
    (8, "Name: ____\nDate: ____\nVote: n/a\nRoom: 12\nDesk: ......."), (9, "easing pause easing pause easing pause easing pause"), (10, PROSE.upper() * 2), (10, PROSE.upper() * 2),
    (11, "q8 z!k9 =_x ^h4 2p~ l8: 7n =f 6y5 d4! a1e w"),
]


def frame(spark, rows, schema="id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_statistics_tell_prose_from_the_rest(spark):
    df = frame(spark, KINDS).withColumns({"kind": F.lit("clash"), "n_words": F.lit(-1)})
    got = {r["id"]: r for r in quality.quality_statistics(df.withColumn("score", F.when(F.col("id") > 2, 0.5).otherwise(90.0)), "id", "text", "score").collect()}
    assert got[1]["stored_score"] is None and got[3]["stored_score"] == 0.5
    assert {i for i, r in got.items() if r["kind"] == "prose"} == {1, 7, 10} and got[5]["kind"] == got[6]["kind"] == "empty"
    assert got[2]["kind"] == "table" and got[3]["kind"] == "list" and got[5]["mean_word_length"] is None
    assert sorted(r["id"] for r in quality.not_prose(df, "id", "text").collect()) == [2, 3, 4, 8, 9, 11]
    assert quality.not_prose(df.where("false"), "id", "text").count() == 0


RESIDUE = [
    (1, PROSE * 5), (2, PROSE * 4 + "It was {{rate_low}} in the end."), (3, "404 Not Found. The page you requested does not exist. Return to the home page."), (4, "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor."),
    (5, "Please enable JavaScript to view this page.\n" + PROSE * 6), (6, None), (7, ""), (8, PROSE * 3 + "The path {t+1} to {t+4} and see notes [[3]] and $ {4.2} billion <<continued>>."),
    (9, PROSE * 3 + "[INSERT MEETING DATE]"), (10, "Statement of ${title}"), (11, PROSE * 3 + "The answer was \"page not found\" for the March minutes."), (12, PROSE * 3 + "Growth of 1 %% was a misprint; CPI_XX was dropped [see note 3]."),
]


def test_residue_is_found_and_mentions_are_not(spark):
    df = frame(spark, RESIDUE + [(100 + i, PROSE * 6) for i in range(40)]).withColumn("residue", F.lit("clash"))
    assert sorted(r["id"] for r in residue.residue_records(df, "id", "text").collect()) == [2, 3, 4, 9, 10]
    assert residue.residue_records(df.where("false"), "id", "text").count() == 0


#: Wordings that neither the seeds nor the tables hold.
UNSEEN = [
    "The web address you entered is not a functioning page on our site. Please return to the home page.", "This content is currently unavailable. Please try again in a few minutes.",
    "We could not find the page you were looking for. It may have been moved or removed.", "HTTP Error 404. The requested resource is not found.",
    "Our servers are undergoing scheduled maintenance. We will be back soon.", "You do not have the permission required to view this document. Please log in.",
    "Please turn on JavaScript in your browser settings and reload this page.", "Scripts are disabled in your browser. Enable scripts to continue.",
    "The service is temporarily unavailable due to maintenance. Please try again later.", "Your session has timed out. Please log in again to continue.",
    "An internal server error occurred while processing the request.", "Access to this resource is forbidden on this server.",
    "Lorem ipsum dolor sit amet, sed do tempor labore. Ut enim nostrud laboris ex commodo consequat.", "Insert your text here. Insert your text here.",
    "This is placeholder text. Replace this text with your own text.", "The connection to the server timed out. Please reload the page.",
]


def test_unseen_wordings_of_residue_are_found():
    rng = random.Random(4)
    nouns, verbs = ["Prices", "Wages", "Exports", "Orders", "Loans", "Rents"], ["rose again", "fell back", "were little changed", "moved lower", "held up well"]
    prose = [" ".join(f"{rng.choice(nouns)} {rng.choice(verbs)} in the {rng.choice(['first', 'second'])} quarter, and {PROSE.lower()}" for _ in range(4)) for _ in range(200)]
    models = residue.Models(prose)
    found = residue.judge(models, UNSEEN)["residue"]
    assert found.mean() >= 0.85, [t for t, f in zip(UNSEEN, found) if not f]
    assert not residue.judge(models, prose + [f"{PROSE * 3}{t}" for t in UNSEEN])["residue"].any()


def test_residue_scores_long_texts_whole():
    models = residue.Models([PROSE * 4] * 50)
    long = PROSE * 20_000 + "{{title}}"
    assert residue.judge(models, [long])["placeholder"][0] and not residue.judge(models, [long[:-9]])["residue"][0]


TALK = """Transcript of the press conference
[00:00:30] Q: Why not more? (laughter)
[00:00:10] MODERATOR: Um, the next question.
[00:00:20] CHAIR OSGAR: We will see.
[00:00:25] The Chair: And more of it.
[00:00:28] MODERATOR: Uh, um... [pause]
[00:00:40] Ann Reporter (Wire): And then?"""


def test_turns_follow_stamps_and_merge_one_person():
    got = turns.turns_of(TALK, "Chair B. Osgar")
    assert [(n, who) for n, who, _, _ in got] == [(1, "moderator"), (2, "osgar"), (3, "question"), (4, "reporter")]
    assert got[1][3] == "We will see. And more of it." and got[0][3] == "the next question."


@pytest.mark.parametrize(
    ("text", "speaker", "want"),
    [
        ("GOVERNOR: Hello there.\nQ: Why?\nMore of the same.\nGov. Day: Because.", None, ["day", "question", "day"]),
        ("PRESIDENT: Hello there.\nQ: Why?", None, ["president", "question"]),
        ("A. Day — Hello.\nMODERATOR — Thanks.", "Day, A.", ["day", "moderator"]),
        ("CHAIR DAY.— Hello.\nQ.— Why?", None, ["day", "question"]),
        ("Chair Day [00:00:05]\nHello.\nQ [00:00:09]\nWhy?", None, ["day", "question"]),
        ("00:00:03 --> 00:00:09\nMod.: Start.\n00:00:10 --> 00:00:12\nChair Day: Go.", None, ["moderator", "day"]),
        ("Seat: 12\nDate: ____\nVote: n/a", None, []), ("Plain prose: nothing else here.", None, []), (None, None, []), ("", "x", []), ("Q: uh, um\nQ: [music]", None, []),
    ],
)
def test_turn_forms(text, speaker, want):
    assert [who for _, who, _, _ in turns.turns_of(text, speaker)] == want


def test_rolling_captions_are_cut(spark):
    text = "CHAIR DAY: one two three four five six\nCHAIR DAY: three four five six seven\nQ: Why?"
    df = frame(spark, [(1, text, None), (2, None, None)], "id long, text string, speaker string").withColumn("who", F.lit("clash"))
    rows = turns.speaker_turns(df, "id", "text", "speaker").orderBy("turn_no").collect()
    assert [(r["turn_no"], r["who"], r["text"]) for r in rows] == [(1, "day", "one two three four five six seven"), (2, "question", "Why?")]


ROLLING = """00:00:08,000 --> 00:00:11,000
Q: on rates and prices then may I ask
00:00:11,000 --> 00:00:14,000
then may I ask about jobs
00:00:01,000 --> 00:00:04,000
CHAIR DAY: we had a long talk on rates and prices
00:00:04,000 --> 00:00:07,500
long talk on rates and prices today and more
00:00:14,500 --> 00:00:18,000
CHAIR DAY: jobs are fine
00:00:40,000 --> 00:00:44,000
after this silence I go on"""


def test_segments_are_swept_unrolled_and_split_at_long_silences():
    whole = ["we had a long talk on rates and prices today and more", "on rates and prices then may I ask about jobs", "jobs are fine"]
    got = turns.turns_of(ROLLING, None, pauses=True)
    assert [(who, said) for _, who, _, said in got] == [("day", whole[0]), ("question", whole[1]), ("day", whole[2]), ("day", "after this silence I go on")]
    assert [said for *_, said in turns.turns_of(ROLLING, None)] == [*whole[:2], whole[2] + " after this silence I go on"]
    steady = "\n".join(f"00:00:{2 * i:02},000 --> 00:00:{2 * i + 1:02},000\nCHAIR DAY: word number {i} is here" for i in range(20))
    assert len(turns.turns_of(steady, None, pauses=True)) == 1


@given(st.lists(st.sampled_from("ab"), max_size=30), st.lists(st.sampled_from("ab"), max_size=30))
def test_overlap_equals_brute_force(before, after):
    assert turns.overlap(before, after) == max(n for n in range(min(len(before), len(after)) + 1) if n == 0 or before[-n:] == after[:n])


def test_captions_roll_over_across_speakers_and_any_length():
    said = " ".join(f"w{i}" for i in range(200))
    text = f"CHAIR DAY: {said}\nCHAIR DAY: {said} end\nQ: w198 w199 end of it\nQ: w199 end of it now"
    assert [t for *_, t in turns.turns_of(text, None)] == [f"{said} end", "w198 w199 end of it now"]


def test_spam_by_language_and_direction(spark, monkeypatch):
    rng = random.Random(3)
    nouns = ["prices", "wages", "output", "credit", "orders", "jobs"]
    rows = [(i, "".join(f"The committee judged that {rng.choice(nouns)} had moved {rng.choice(['up', 'down'])} by {rng.randint(1, 9)} percent in {rng.choice(['May', 'June'])}. " for _ in range(12)), "en") for i in range(80)]
    bad = [
        (900, ", ".join(rng.choice(["cheap loans", "gold price", "stock tips"]) + rng.choice(["", " online", " 2023"]) for _ in range(80)), "en"),
        (901, "\n".join(f"* [{rng.choice(nouns)}](https://x{i}.test/p/{i})" for i in range(40)), "EN"), (902, " ".join(["#GoldPrice", "#StockTips", "#CheapLoans"] * 20), None),
        (903, "\n".join(f"New Coin tray {i} g - {i}.50 - in stock" for i in range(5, 40)), "en-XX"),
    ]
    good = [
        (800, "Item;Q1;Q2\n" + "\n".join(f"Wages {i};{i}.5;{i * 3}" for i in range(20)), "en"), (801, None, "en"), (802, "", None), (803, " \n", "xx"), (804, "Title only here", "en"),
        (805, rows[0][1] + "\nReferences\n" + "\n".join(f"Day, A. ({1990 + i}). Notes on wages. https://a.test/{i}" for i in range(8)), "en"),
    ]
    df = frame(spark, rows + bad + good, "id long, text string, lang string").withColumn("spam", F.lit("clash"))
    assert sorted(r["id"] for r in spam.spam_documents(df, "id", "text", "lang").collect()) == [900, 901, 902, 903]
    assert spam.spam_documents(df.where("false"), "id", "text", "lang").count() == 0
    scores = {r["id"]: r for r in spam.spam_scores(df, "id", "text", "lang").collect()}
    assert scores[901]["direction"] == "links" and scores[801]["distance2"] is None and len(scores) == len(rows + bad + good)
    monkeypatch.setattr(spam, "COSINE", -1.0)  # without direction, titles and tables are outliers too
    assert {r["id"] for r in spam.spam_documents(df, "id", "text", "lang").collect()} > {900, 901, 902, 903}
    monkeypatch.setattr(spam, "DISTANCE2", 1e9)
    assert spam.spam_documents(df, "id", "text", "lang").count() == 0


@pytest.fixture(scope="module")
def reference_encoding():
    with open(tokens.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", None, " ", "a", "  two  blanks\n\n\ttab ", "don't I'll we've", "été naïve Ångström", "日本語のテキスト。中文", "🙂👩‍👩‍👧 emoji", "x" * 300, "~" * 90, "1234567 3.14159", "<|endoftext|>", "zqxjkvbpw" * 9, "a b c\u0085d"]


def test_encoding_equals_the_library_and_decodes_back(spark, reference_encoding):
    df = frame(spark, list(enumerate(ODD)) + [(2, ODD[2])]).withColumn("ids", F.lit("clash"))
    out = tokens.encode(df, "id", "text")
    for r in out.collect():
        assert list(r["ids"]) == reference_encoding.encode_ordinary(ODD[r["id"]] or ""), ODD[r["id"]]
    assert {r["id"]: r["text"] for r in tokens.decode(out, "id").collect()} == {i: t or "" for i, t in enumerate(ODD)}
    assert tokens.encode(df.where("false"), "id", "text").count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs", "Cn")), max_size=40), min_size=1, max_size=12))
def test_encoding_round_trip(spark, texts):
    out = tokens.encode(frame(spark, list(enumerate(texts))), "id", "text")
    assert {r["id"]: r["text"] for r in tokens.decode(out, "id").collect()} == dict(enumerate(texts))


def test_mixture_meets_shares_and_caps(spark):
    rng = random.Random(1)
    docs = [(i, "abcd"[i % 4], " ".join(rng.choice(["rate", "price", "wage"]) for _ in range(rng.randint(5, 60)))) for i in range(600)]
    docs += [(1000, "a", None), (1001, "a", ""), (1002, None, "rate"), (1003, "unlisted", "rate")]
    goals = [("a", 0.5, 2), ("b", 0.2, 1), ("c", 0.2, 1), ("d", 0.0, 1), ("none", 0.1, 3), ("a", 0.4, 1)]
    df = frame(spark, docs, "id long, source string, text string").withColumn("copies", F.lit("clash"))
    chosen, shares = mixing.mixture(df, spark.createDataFrame(goals, "source string, target_share double, max_repeats int"), "id")
    rows, by = chosen.collect(), {r["source"]: r for r in shares.collect()}
    assert by["a"]["goal_share"] == pytest.approx(0.5, abs=0.01) and by["b"]["goal_share"] == pytest.approx(0.2, abs=0.01)
    assert sum(r["actual_share"] for r in by.values()) == pytest.approx(1.0) and by["a"]["actual_share"] > by["a"]["goal_share"]
    assert by["none"]["falls_short"] and by["none"]["tokens"] == 0 and by["d"]["tokens"] == 0 and not by["d"]["falls_short"]
    assert max(r["copies"] for r in rows if r["source"] == "b") == 1 and max(r["copies"] for r in rows) <= 2 and not {1000, 1001, 1002, 1003} & {r["id"] for r in rows}
    lacking = [("a", 1.0, 1), ("b", 0.0, 1), ("c", 0.0, 1)]
    chosen, shares = mixing.mixture(df, spark.createDataFrame(lacking, "source string, target_share double, max_repeats int"), "id")
    short = {r["source"]: r for r in shares.collect()}["a"]
    assert short["falls_short"] and 0.5 < short["goal_share"] < 0.8 and short["actual_share"] == 1.0 and chosen.count() == 150
    empty, none = mixing.mixture(df.where("false"), spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int"), "id")
    assert empty.count() == 0 and none.collect()[0]["falls_short"] and np.isfinite(none.collect()[0]["actual_share"])


STATISTICS = [x.split()[0] for x in quality.FIELDS.split(", ")]
LEAD = "The committee judged that risks had become more even, although it was too early to say whether the pause would last at all. "
TABULAR = [
    LEAD * 2 + "\nItem | A | B\n" + "\n".join(f"Row {i} | {i}.5 | {i * 3}" for i in range(9)) + "\n" + LEAD, LEAD * 2 + "\n" + "\n".join(f"Item {i}, {i}.5, {i * 3}" for i in range(12)),
    LEAD * 2 + "\n" + "\n".join(f"- Point {i} of May" for i in range(12)), LEAD * 2 + "\n" + "\n".join(f"{'  ' * (i % 2)}Desk {'of the bank' * (i % 2)}" for i in range(12)),
]
WRAPPED = "The bank, the board, and\nthe staff, in May, and\nin June, as before, and\nin July, at last, were\nof one mind on rates.\n"


@pytest.mark.parametrize("text", TABULAR)
def test_lead_sentences_do_not_make_rows_prose(text):
    found = dict(zip(STATISTICS, quality.describe(text)))
    assert found["sentence_share"] >= quality.PROSE_SHARE and found["kind"] != "prose" and found["row_share"] >= 0.5


def test_layout_decides(monkeypatch):
    monkeypatch.setattr(quality, "_rows", lambda lines: set())
    assert sum(quality.describe(t)[-1] != "prose" for t in TABULAR) <= 2


@pytest.mark.parametrize("text", [WRAPPED * 3, (WRAPPED * 3).upper(), LEAD * 8 + "\nItem | A | B\nRow | 1 | 2\nRow | 3 | 4", "\n".join(f"- {LEAD}" for _ in range(5))])
def test_rows_among_prose_leave_it_prose(text):
    assert quality.describe(text)[-1] == "prose"


def test_residue_models_are_fitted_on_all_texts(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(6)) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=12)) + "." for _ in range(4000)] + [t for t in UNSEEN for _ in range(3)] + [PROSE * 10_000]
    df = frame(spark, [(i, t) for i, t in enumerate(texts)] + [(9001, None), (9002, " ")])
    want = residue.Models(texts)
    for parts in (1, 7):
        got = residue.fit_models(df.repartition(parts), "id", "text")
        assert np.array_equal(got.pairs, want.pairs) and np.array_equal(got.filler_leads, want.filler_leads)
    assert residue.fit_models(df.where("false"), "id", "text").score([b"x"])[0][0] == 0


def test_long_texts_count_for_what_is_not_prose(spark):
    table = "- Service unavailable\n- Server error\n- Requested resource not found\n- Bad gateway\n"
    subject = "The panel on markets spoke of service unavailable, server error, requested resource not found, bad gateway again. " * 15_000
    df = frame(spark, [(1, table), (2, subject), (3, None)] + [(100 + i, PROSE * 4) for i in range(40)])
    assert [r["id"] for r in quality.not_prose(df, "id", "text").collect()] == [1]
    assert quality.not_prose(df.where("id <> 2"), "id", "text").count() == 0


def test_rows_that_a_sample_leaves_out_count_for_what_is_not_prose(spark):
    table = "- Service unavailable\n- Server error\n- Requested resource not found\n- Bad gateway\n"
    subject = "The panel on markets spoke of service unavailable, server error, requested resource not found, bad gateway again. " * 4
    ids = spark.range(2, 4002).orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 40)))  # a sample of 1,500 rows by their hash takes the first of these
    rows = [(r["id"], PROSE * 4 if i < 2000 else subject) for i, r in enumerate(ids.collect())]
    df = frame(spark, [(1, table), *rows])
    for parts in (1, 5):
        assert [r["id"] for r in quality.not_prose(df.repartition(parts), "id", "text").collect()] == [1]
    assert quality.not_prose(df.where(F.col("text") != subject), "id", "text").count() == 0
