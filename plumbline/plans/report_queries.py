"""Queries of reports, masks, lexicons and labels, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import labels, urls
from plumbline.functions import lexicons as L
from plumbline.functions import text as T
from plumbline.functions.dates import readable_day
from plumbline.operators import corpus, signals
from plumbline.runtime import table

from . import oracle as O
from .queries import MEETING, SPEECH, QUERIES, ORACLES, _meetings, _speeches, query

_T = "coalesce(text_content, '')"


@query(f"""SELECT fomc_id, coalesce(document_type = 'statement', false) AS statement, regexp_matches({_T}, '{corpus.NARRATIVE}') AS narrative, regexp_matches({_T}, '{corpus.DERIVED}') AS derived_labels,
  regexp_matches({_T}, '{corpus.FORWARDED}') AS forward_filled, regexp_matches({_T}, '{corpus.FAILED}') AS parse_error,
  coalesce(document_type = 'statement', false) AND regexp_matches({_T}, '{corpus.NARRATIVE}') AS true_stub FROM fomc""")
def quality_masks(spark, d):
    df = table(spark, d, "fomc", "fomc_id", "document_type", "text_content")
    return df.select("fomc_id", *[c.alias(n) for n, c in corpus.placeholder_masks(F.col("text_content"), F.col("document_type")).items()])


@query(f"""SELECT count(*)::BIGINT AS rows, count(*) FILTER ({O.words('text_content')} >= 80)::BIGINT AS substantial, count(*) FILTER (coalesce(labels_from_fred, false))::BIGINT AS derived,
  count(*) FILTER (d >= DATE '2020-01-01')::BIGINT AS rows_since, count(*) FILTER (d IS NULL)::BIGINT AS undated FROM ({MEETING})""")
def corpus_summary(spark, d):
    m = _meetings(spark, d, "text_content", "labels_from_fred")
    return m.agg(
        F.count("*").alias("rows"), F.count_if(T.word_count(F.col("text_content")) >= 80).alias("substantial"), F.count_if(F.coalesce("labels_from_fred", F.lit(False))).alias("derived"),
        F.count_if(F.coalesce(F.col("day") >= "2020-01-01", F.lit(False))).alias("rows_since"), F.count_if(F.col("day").isNull()).alias("undated"),
    )


@query(f"""SELECT coalesce(domain, 'None') AS value, count(*)::BIGINT AS rows, count(*) FILTER (d >= DATE '2020-01-01')::BIGINT AS rows_since FROM ({SPEECH}) GROUP BY 1
ORDER BY rows DESC, value LIMIT 12""")
def leading_domains(spark, d):
    """The twelve domains with most speeches, overall and since 2020."""
    return corpus.counts_since(_speeches(spark, d), F.col("domain"), F.col("day"), "2020-01-01", 12)


@query(f"""SELECT coalesce(bool_and(complete), false) AS all_complete, count(*)::BIGINT AS rows FROM ({ORACLES['completeness']})""")
def completeness_met(spark, d):
    return corpus.all_complete(QUERIES["completeness"](spark, d))


_LEXICON = """(SELECT word, category FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(title, '')), '[a-z]{4,}')) AS word FROM news) w,
  (VALUES ('positive', 0), ('negative', 1), ('uncertainty', 2), ('litigious', 3), ('strong_modal', 4), ('weak_modal', 5)) v(category, k) WHERE length(word) % 6 = k OR (length(word) + 3) % 7 = k)"""
_CATS = signals.CATEGORIES


@query(f"""WITH lex AS {_LEXICON}, h AS (SELECT fomc_id, unnest(regexp_extract_all(lower(coalesce(text_content, '')), '[\\p{{L}}\\p{{N}}]+')) AS word FROM fomc),
n AS (SELECT f.fomc_id, {', '.join(f"coalesce(x.{c}, 0)::BIGINT AS {c}" for c in _CATS)} FROM fomc f LEFT JOIN (
  SELECT fomc_id, {', '.join(f"count(*) FILTER (category = '{c}') AS {c}" for c in _CATS)} FROM h JOIN lex USING (word) GROUP BY fomc_id) x ON x.fomc_id = f.fomc_id)
SELECT *, CASE WHEN positive + negative + uncertainty = 0 THEN 0 ELSE (positive - negative) / (positive + negative + uncertainty) END::DOUBLE AS score FROM n""")
def lexicon_categories(spark, d):
    """All six categories of a word list of hundreds of words, some in two categories."""
    words = table(spark, d, "news", "title").select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0))).alias("word")).distinct()
    k = F.posexplode(F.array(*map(F.lit, _CATS)))
    lexicon = words.select("word", k.alias("k", "category")).where((F.length("word") % 6 == F.col("k")) | ((F.length("word") + 3) % 7 == F.col("k"))).drop("k")
    return signals.lexicon_hits(table(spark, d, "fomc", "fomc_id", "text_content"), "fomc_id", "text_content", lexicon, _CATS)


_H, _D = (O.sum_hits("text_content", t) for t in (("rose", "picked up", "firmed", "advanced"), ("fell", "eased", "softened", "declined")))


@query(f"""WITH t AS (SELECT speech_id, {_H}::INT AS h, {_D}::INT AS e FROM speaker), s AS (SELECT *, CASE WHEN h + e = 0 THEN 0 ELSE (h - e) / (h + e) END::DOUBLE AS score FROM t),
l AS (SELECT *, CASE WHEN h - e >= 2 OR score >= 0.25 THEN 'Hawkish' WHEN h - e <= -2 OR score <= -0.25 THEN 'Dovish' ELSE 'Neutral' END AS label, least(0.95, 0.5 + abs(h - e) * 0.08 + abs(score) * 0.35) AS sure FROM s)
SELECT speech_id, label, CASE WHEN sure >= 0.75 THEN 'High' WHEN sure >= 0.55 THEN 'Medium' ELSE 'Low' END AS confidence,
  'Read as ' || lower(label) || ': the mix of terms is ' || CASE label WHEN 'Hawkish' THEN 'hawkish' WHEN 'Dovish' THEN 'dovish' ELSE 'balanced' END || ', with ' || h || ' hawkish and ' || e || ' dovish terms.' AS sentence FROM l""")
def classifications(spark, d):
    """Label, confidence and sentence of every speech from its rising and falling terms."""
    t = F.col("text_content")
    h, e = T.sum_substring_hits(t, ("rose", "picked up", "firmed", "advanced")), T.sum_substring_hits(t, ("fell", "eased", "softened", "declined"))
    hits = table(spark, d, "speaker", "speech_id", "text_content").select("speech_id", h.alias("h"), e.alias("e"))
    score = F.when(F.col("h") + F.col("e") == 0, 0.0).otherwise((F.col("h") - F.col("e")) / (F.col("h") + F.col("e")))
    return hits.select("speech_id", labels.classification(score, F.col("h"), F.col("e")).alias("x")).select("speech_id", "x.*")


@query(f"""WITH r AS (SELECT speech_id, d, ((speech_id * 17) % 90 + 1)::DOUBLE AS a, ((speech_id * 29) % 90 + 1)::DOUBLE AS b, ((speech_id * 43) % 90 + 1)::DOUBLE AS c, ((speech_id * 37) % 100) / 100.0::DOUBLE AS p
  FROM ({SPEECH}) WHERE d IS NOT NULL ORDER BY d DESC, speech_id DESC LIMIT 60),
m AS (SELECT count(*)::BIGINT AS documents, avg(a / (a + b + c)) AS mean_lower, avg(b / (a + b + c)) AS mean_maintain, avg(c / (a + b + c)) AS mean_raise, avg(p) AS mean_relevance FROM r)
SELECT *, CASE WHEN mean_lower >= mean_maintain AND mean_lower >= mean_raise THEN 'lower' WHEN mean_maintain >= mean_raise THEN 'maintain' ELSE 'raise' END AS leading FROM m""")
def direction_forecast(spark, d):
    """Mean class probabilities of the sixty newest speeches and the leading direction."""
    n = F.col("speech_id")
    a, b, c = (((n * k) % 90 + 1).cast("double") for k in (17, 29, 43))
    s = _speeches(spark, d).select("speech_id", "day", (a / (a + b + c)).alias("l"), (b / (a + b + c)).alias("m"), (c / (a + b + c)).alias("r"), (((n * 37) % 100) / 100.0).alias("p"))
    return signals.forecast(s, "day", "speech_id", dict(zip(L.DIRECTIONS, "lmr")), "p")


_FORMS = ", ".join("[" + ", ".join("replace(replace('https://a.test" + f + "', '{day}', day), '{year}', substr(day, 1, 4))" for f in forms) + f"] AS {kind}" for kind, forms in urls.DOCUMENT_FORMS.items())


@query(f"SELECT day, {_FORMS} FROM (SELECT DISTINCT strftime(d, '%Y%m%d') AS day FROM ({MEETING}) WHERE d IS NOT NULL)")
def document_addresses(spark, d):
    day = F.date_format(readable_day(F.col("date")), "yyyyMMdd").alias("day")
    days = table(spark, d, "fomc", "date").select(day).where("day is not null").distinct()
    held = urls.document_addresses("https://a.test", F.col("day"))
    return days.select("day", held.alias("x")).select("day", *[F.col("x")[kind].alias(kind) for kind in urls.DOCUMENT_FORMS])


@query(f"SELECT speech_id, greatest(80, {O.words('text_content')} // 24)::INT AS step FROM speaker")
def timeline_steps(spark, d):
    return table(spark, d, "speaker", "speech_id", "text_content").select("speech_id", labels.step_words(T.word_count(F.col("text_content"))).alias("step"))


@query(f"""SELECT speech_id, strftime(d, '%Y-%m-%d') || ' | ' || coalesce(nullif(trim(participant), ''), 'unknown') || ' | ' || coalesce(site, 'unknown') AS label FROM ({SPEECH})
WHERE d IS NOT NULL ORDER BY d DESC, speech_id DESC LIMIT 250""")
def recent_labels(spark, d):
    """The 250 newest speeches as one line each."""
    s = _speeches(spark, d, "participant").where("day is not null").orderBy(F.desc("day"), F.desc("speech_id")).limit(250)
    who, where = F.coalesce(F.nullif(F.trim("participant"), F.lit("")), F.lit("unknown")), F.coalesce("site", F.lit("unknown"))
    return s.select("speech_id", F.concat_ws(" | ", F.date_format("day", "yyyy-MM-dd"), who, where).alias("label"))


_PTS = "list_distinct(list_concat(range(least(60, n), n + 1, 40), [n]))"


@query(f"""WITH p AS (SELECT speech_id, list_sort({_PTS}) AS pts, n FROM (SELECT speech_id, {O.words('text_content')} AS n FROM speaker) WHERE n > 0),
t AS (SELECT speech_id, CASE WHEN len(pts) > 6 THEN list_transform(list_distinct(list_transform(range(6), lambda i: round_even(i * (len(pts) - 1) / 5, 0)::INT)), lambda i: pts[i + 1]) ELSE pts END AS pts FROM p)
SELECT speech_id, unnest(pts)::INT AS prefix_words FROM t""")
def thinned_points(spark, d):
    """Scored points of every speech, at most about six of them."""
    s = table(spark, d, "speaker", "speech_id", "text_content").select("speech_id", T.word_count(F.col("text_content")).alias("total"))
    return s.select("speech_id", F.explode(signals.timeline_points(F.col("total"), 60, 40, 6)).alias("prefix_words"))
