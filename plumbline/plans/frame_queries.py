"""Queries of the modelling frame, its features and evaluation, and of the corpus builders, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import lexicons as L
from plumbline.functions import text as T
from plumbline.functions.dates import readable_day
from plumbline.operators import builders, corpus, frames, reports, signals
from plumbline.runtime import table

from . import oracle as O
from .queries import _NAME, MEETING, SPEECH, _meetings, _speeches, query

_W = O.words("text_content")
_NUM = "coalesce(TRY_CAST({c} AS DOUBLE), 0)"
_DIRECTION = "CASE lower(trim(decision)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.DIRECTION_OF.items()) + " ELSE lower(trim(decision)) END"


def _context_sql(rows: str) -> str:
    """The structured context columns of ``rows`` (d, high, low, fomc_ref_date, alignment_rule, quality_score, labels_from_fred)."""
    lo, hi = (f"{f}({_NUM.format(c='high')}, {_NUM.format(c='low')})" for f in ("least", "greatest"))
    rule = "lower(coalesce(alignment_rule, ''))"
    return f"""SELECT *, {lo} AS target_lower, {hi} AS target_upper, ({lo} + {hi}) / 2 AS target_mid, {hi} - {lo} AS target_spread, days AS alignment_days,
    (days BETWEEN 0 AND 10)::INT::DOUBLE AS alignment_pre_meeting, least(abs(days), 180) AS alignment_abs_days,
    ({rule} = 'blackout_pre' OR ({rule} IN ('', 'nan', 'none') AND days BETWEEN 0 AND 10))::INT::DOUBLE AS rule_blackout_pre,
    ({rule} = 'post_meeting' OR ({rule} IN ('', 'nan', 'none') AND days < 0))::INT::DOUBLE AS rule_post_meeting, ({rule} = 'no_prior_meeting')::INT::DOUBLE AS rule_no_prior_meeting,
    least(greatest(coalesce(quality_score, 1), 0), 1) AS quality_feature, coalesce(labels_from_fred, false)::INT::DOUBLE AS derived_labels_feature
  FROM (SELECT *, coalesce({O.day("fomc_ref_date")} - d, 0)::DOUBLE AS days FROM ({rows}))"""


_DATED_SPEECHES = f"SELECT *, false AS labels_from_fred FROM ({SPEECH}) WHERE d IS NOT NULL"
_STRUCTURED = ", ".join(frames.STRUCTURED)


def _contexts(spark, d, *more):
    s = _speeches(spark, d, "high", "low", "fomc_ref_date", "alignment_rule", "quality_score", *more).withColumn("event_date", F.col("day"))
    return frames.policy_context(s.where("event_date is not null"))


@query(f"SELECT speech_id, {_STRUCTURED} FROM ({_context_sql(_DATED_SPEECHES)})")
def policy_contexts(spark, d):
    return _contexts(spark, d).select("speech_id", *frames.STRUCTURED)


_OFFICE_WEIGHT = """CASE WHEN regexp_matches({c}, '\\bvice chair|\\bv\\. chair|\\bvc\\b') THEN 2.0 WHEN regexp_matches({c}, '\\bchair|\\bchr\\.') THEN 3.0
  WHEN regexp_matches({c}, '\\bgov(?:ernor)?\\b') THEN 1.5 WHEN regexp_matches({c}, '\\bpres(?:ident)?\\b') THEN 1.0 WHEN regexp_matches({c}, '\\bmember\\b') THEN 0.75 ELSE 0.25 END"""
_SCORE = O.weighted("text_content", L.POLICY_WEIGHTS)


@query(f"""WITH b AS (
  SELECT 'fomc' AS source, fomc_id AS id, d, coalesce(speaker, '') AS who, coalesce(document_type, '') AS domain, text_content, decision, high, low, date AS fomc_ref_date, NULL AS alignment_rule,
    quality_score, quality_flags, labels_from_fred FROM ({MEETING})
  UNION ALL SELECT 'speaker', speech_id, d, coalesce(participant, ''), coalesce(domain, ''), text_content, decision, high, low, fomc_ref_date, alignment_rule,
    quality_score, quality_flags, NULL FROM ({SPEECH})),
u AS (SELECT * FROM b WHERE d IS NOT NULL AND {_W} >= 80 AND {_DIRECTION} IN ('lower', 'maintain', 'raise') AND coalesce(quality_score, 1) >= 0.4
  AND NOT (coalesce(labels_from_fred, false) AND coalesce(quality_score, 1) < 0.7)
  AND NOT list_has_any(list_transform(coalesce(quality_flags, []), lambda x: lower(x)), ['no_text', 'pdf_unreadable', 'stub'])),
c AS (SELECT *, {_SCORE}::DOUBLE AS policy_score, {_W} AS n FROM ({_context_sql('SELECT * FROM u')})),
r AS (SELECT *, source = 'fomc' OR policy_score >= 10 OR (policy_score >= 5 AND policy_score * 1000 >= 2 * greatest(n, 1)) AS rate_relevant FROM c)
SELECT source, id, d AS event_date, n::INT AS word_count, policy_score, policy_score * 1000 / greatest(n, 1) AS policy_score_per_1k, rate_relevant, CASE WHEN rate_relevant THEN {_DIRECTION} ELSE 'no_rate_signal' END AS action_label,
  (CASE WHEN source = 'fomc' THEN 3.0 ELSE {_OFFICE_WEIGHT.format(c="lower(who || ' ' || domain)")} END)::DOUBLE AS speaker_tier,
  sha256(concat_ws(chr(10), source, d::VARCHAR, who, domain, coalesce(text_content, ''))) AS doc_hash, {_STRUCTURED} FROM r""")
def modelling_frame(spark, d):
    """Both corpora as model rows: context, score, tier, relevance and action label."""
    meetings = table(spark, d, "fomc", "fomc_id", "date", "document_type", "speaker", "text_content", "decision", "high", "low", "quality_score", "quality_flags", "labels_from_fred")
    speeches = table(spark, d, "speaker", "speech_id", "date", "participant", "domain", "text_content", "decision", "high", "low", "fomc_ref_date", "alignment_rule", "quality_score", "quality_flags")
    out = frames.modelling_frame(meetings, speeches)
    return out.select("source", "id", "event_date", "word_count", "policy_score", "policy_score_per_1k", "rate_relevant", "action_label", "speaker_tier", "doc_hash", *frames.STRUCTURED)


def _pattern_hits(pattern: str) -> str:
    return f"len(regexp_extract_all(lower(coalesce(text_content, '')), '{pattern}'))::DOUBLE"


_LISTS = {"hawk": L.HAWKISH, "dove": L.DOVISH, "hold": L.HOLD, "unsure": L.UNCERTAIN, "direct": L.EXPLICIT_CUES}


@query(f"""WITH c AS (SELECT *, {', '.join(f"{O.sum_hits('text_content', t)}::DOUBLE AS {n}" for n, t in _LISTS.items())}, {', '.join(f"{_pattern_hits(p)} AS {n}" for n, p in frames.TOPIC_PATTERNS.items())},
  greatest({_W}, 1)::DOUBLE AS words, {_SCORE}::DOUBLE AS score FROM ({_context_sql(_DATED_SPEECHES)})),
p AS (SELECT *, words / 1000 AS k, target_mid AS level FROM c)
SELECT speech_id, 1.0::DOUBLE AS fraction, ln(1 + words) AS log_words, score AS policy_score, score / k AS policy_score_per_1k, hawk AS hawkish_hits, dove AS dovish_hits, hawk - dove AS tone,
  hawk / k AS hawkish_per_1k, dove / k AS dovish_per_1k, hold / k AS hold_per_1k, unsure / k AS uncertain_per_1k, direct AS direct_cues,
  inflation / k AS inflation_per_1k, labor / k AS labor_per_1k, growth / k AS growth_per_1k, (hawk - dove) / sqrt(words) AS tone_balance, ln(1 + greatest(score / k, 0)) AS log_policy_per_1k,
  level * hawk / k AS level_hawkish, level * dove / k AS level_dovish, greatest(level - 2.5, 0) * dove / k AS high_dovish, greatest(2.5 - level, 0) * hawk / k AS low_hawkish,
  0.0::DOUBLE AS change_hold, 0.0::DOUBLE AS unemployment_dovish, 0.0::DOUBLE AS prices_hawkish, target_spread AS spread, alignment_pre_meeting AS pre_meeting,
  rule_blackout_pre AS blackout_pre, rule_post_meeting AS post_meeting, rule_no_prior_meeting AS no_prior_meeting, ln(1 + alignment_abs_days) AS log_days, quality_feature AS quality,
  derived_labels_feature AS derived_labels, 0.0::DOUBLE AS external_policy, 0.0::DOUBLE AS external_direction, 0.0::DOUBLE AS external_hold, 0.0::DOUBLE AS external_hawkish, 0.0::DOUBLE AS external_dovish FROM p""")
def feature_block(spark, d):
    """The 37 features of every dated speech with its policy context."""
    return frames.dense_features(_contexts(spark, d, "text_content"), "text_content", F.lit(1.0), ["speech_id"])


_ODDS = """SELECT event_id, ((event_id * 37) % 100) / 100.0::DOUBLE AS p, a / (a + b + c) AS l, b / (a + b + c) AS m, c / (a + b + c) AS r
  FROM (SELECT event_id, ((event_id * 17) % 90 + 1)::DOUBLE AS a, ((event_id * 29) % 90 + 1)::DOUBLE AS b, ((event_id * 43) % 90 + 1)::DOUBLE AS c FROM events)"""


@query(f"""WITH s AS (SELECT *, list_reverse_sort([l, m, r]) AS k FROM ({_ODDS})),
x AS (SELECT *, CASE WHEN p <= 0.35 THEN 'no_rate_signal' WHEN p < 0.5 THEN 'uncertain' WHEN l >= 0.3 AND m - l <= 0.1 THEN 'rate_relevant_lower_override'
  WHEN k[1] < 0.45 OR k[1] - k[2] < 0.05 THEN 'rate_relevant_uncertain_direction' ELSE 'rate_relevant_directional' END AS state FROM s)
SELECT event_id, state, CASE state WHEN 'no_rate_signal' THEN state WHEN 'rate_relevant_lower_override' THEN 'lower' WHEN 'rate_relevant_directional' THEN CASE k[1] WHEN l THEN 'lower' WHEN m THEN 'maintain' ELSE 'raise' END
  ELSE 'uncertain_rate_signal' END AS action, CASE state WHEN 'no_rate_signal' THEN 1 - p WHEN 'uncertain' THEN p WHEN 'rate_relevant_lower_override' THEN l ELSE k[1] END AS confidence, k[1] - k[2] AS margin FROM x""")
def action_states(spark, d):
    """Actions with the override for lower, their states, confidence and margin."""
    e = F.col("event_id")
    a, b, c = (((e * k) % 90 + 1).cast("double") for k in (17, 29, 43))
    found = signals.action(((e * 37) % 100) / 100.0, a / (a + b + c), b / (a + b + c), c / (a + b + c), lower_from=0.3, lower_gap=0.1)
    return table(spark, d, "events", "event_id").select("event_id", found.alias("x")).select("event_id", "x.action", "x.state", "x.confidence", "x.margin")


_GUESS = "CASE fomc_id % 5 WHEN 0 THEN 'raise' WHEN 1 THEN 'lower' WHEN 2 THEN 'uncertain_rate_signal' WHEN 3 THEN 'no_rate_signal' ELSE 'maintain' END"


@query(f"""WITH p AS (SELECT {_DIRECTION} AS truth, {_GUESS} AS guess FROM fomc WHERE decision IS NOT NULL),
f AS (SELECT label, count(*) FILTER (truth = label) > 0 AS present, coalesce(2.0 * count(*) FILTER (truth = label AND guess = label) / nullif(count(*) FILTER (truth = label) + count(*) FILTER (guess = label), 0), 0) AS f1
  FROM p, (VALUES ('no_rate_signal'), ('lower'), ('maintain'), ('raise')) v(label) GROUP BY label)
SELECT (SELECT count(*) FROM p)::BIGINT AS rows, (SELECT avg((truth = guess)::INT) FROM p)::DOUBLE AS accuracy, avg(f1) FILTER (present)::DOUBLE AS f1_present, avg(f1)::DOUBLE AS f1_all,
  string_agg(label, ',' ORDER BY CASE label WHEN 'no_rate_signal' THEN 0 WHEN 'lower' THEN 1 WHEN 'maintain' THEN 2 ELSE 3 END) FILTER (present) AS labels, (SELECT avg((guess = 'uncertain_rate_signal')::INT) FROM p)::DOUBLE AS uncertain_share FROM f""")
def evaluation_summary(spark, d):
    from plumbline.functions import scores as S

    k = F.col("fomc_id") % 5
    guess = F.when(k == 0, "raise").when(k == 1, "lower").when(k == 2, "uncertain_rate_signal").when(k == 3, "no_rate_signal").otherwise("maintain")
    p = table(spark, d, "fomc", "fomc_id", "decision").where("decision is not null").select(S.direction(F.col("decision")).alias("truth"), guess.alias("guess"))
    return reports.evaluation(p, "truth", "guess")


@query(f"""WITH t AS (SELECT speech_id, pct, CASE WHEN (speech_id * 7 + pct) % 4 = 0 THEN 'lower' WHEN pct >= (speech_id % 11) * 10 THEN 'maintain' ELSE 'raise' END AS guess
  FROM speaker, (SELECT unnest(range(10, 101, 10)) AS pct)),
w AS (SELECT *, lead(guess) OVER (PARTITION BY speech_id ORDER BY pct) AS nx FROM t),
f AS (SELECT speech_id, min(pct) FILTER (guess = 'maintain' AND nx = 'maintain') AS first_stable_correct, max_by(guess, pct) AS final FROM w GROUP BY speech_id)
SELECT speech_id, first_stable_correct, coalesce(first_stable_correct <= 50, false) AS early, coalesce(first_stable_correct < speech_id % 100, false) AS before_cue, final, final = 'maintain' AS final_correct FROM f""")
def online_speed(spark, d):
    """How soon ten-percent timelines are right to stay."""
    s = table(spark, d, "speaker", "speech_id")
    pct = F.col("pct")
    guess = F.when((F.col("speech_id") * 7 + pct) % 4 == 0, "lower").when(pct >= (F.col("speech_id") % 11) * 10, "maintain").otherwise("raise")
    lines = s.withColumn("pct", F.explode(F.sequence(F.lit(10).cast("long"), F.lit(100).cast("long"), F.lit(10).cast("long")))).withColumn("guess", guess)
    documents = s.select("speech_id", F.lit("maintain").alias("truth"), (F.col("speech_id") % 100).alias("cue"))
    out = reports.speed(lines, documents, "speech_id", "pct", "guess")
    return out.select("speech_id", "first_stable_correct", "early", "before_cue", "final", "final_correct")


# ---- corpus builders -----------------------------------------------------------------------------------------------


@query(f"""WITH t AS (SELECT site, date, fomc_id, source_url || '/' || fomc_id || CASE WHEN fomc_id % 4 = 0 THEN '.pdf' ELSE '' END AS url, text_content AS t, {_W} AS n,
    fomc_id % 4 = 0 AS pdf FROM ({MEETING}) WHERE source_url IS NOT NULL),
g AS (SELECT site, date, min(fomc_id) FILTER (n >= 120) AS good, min(fomc_id) FILTER (length(coalesce(t, '')) > 0) AS any_one, min(fomc_id) AS first,
  bool_or(t IS NULL OR (t = '' AND NOT pdf)) AS failed, bool_or(t = '' AND pdf) AS unreadable FROM t GROUP BY site, date)
SELECT g.site, g.date, coalesce(sha256(x.t), sha256('')) AS body, coalesce(x.url, y.url) AS source_url,
  list_filter([CASE WHEN good IS NULL AND any_one IS NOT NULL THEN 'short_body' END, CASE WHEN any_one IS NULL AND failed THEN 'http_error' END,
    CASE WHEN any_one IS NULL AND coalesce(unreadable, false) THEN 'pdf_unreadable' END, CASE WHEN any_one IS NULL THEN 'no_text' END], lambda v: v IS NOT NULL) AS flags
FROM g LEFT JOIN t x ON x.fomc_id = coalesce(good, any_one) LEFT JOIN t y ON y.fomc_id = first""")
def acceptable_pages(spark, d):
    """Of the records of a site and written date, tried in order of their ids, the first acceptable one."""
    m = _meetings(spark, d, "text_content").where("source_url is not null")
    url = F.concat("source_url", F.lit("/"), F.col("fomc_id").cast("string"), F.when(F.col("fomc_id") % 4 == 0, ".pdf").otherwise(""))
    out = builders.first_acceptable(m.withColumn("url", url), ["site", "date"], "fomc_id", "url", "text_content")
    return out.select("site", "date", F.sha2("text", 256).alias("body"), "source_url", "flags")


@query("""SELECT DISTINCT 'https://a.test/newsevents/' || k || '/s' || (speech_id % 500) || '.htm' AS url, k AS kind
FROM (SELECT speech_id, CASE speech_id % 3 WHEN 0 THEN 'speech' WHEN 1 THEN 'testimony' ELSE 'other' END AS k FROM speaker) WHERE k <> 'other'""")
def discovered_links(spark, d):
    n = F.col("speech_id")
    kind = F.when(n % 3 == 0, "speech").when(n % 3 == 1, "testimony").otherwise("other")
    html = F.concat(F.lit('<li><a class="x" href="/newsevents/'), kind, F.lit("/s"), (n % 500).cast("string"), F.lit('.htm">A speech</a></li>'))
    return builders.discovered(table(spark, d, "speaker", "speech_id").select(html.alias("html")), "html", "https://a.test")


_SLUG = "regexp_extract(source_url, '([^/]+?)([.][A-Za-z0-9]+)?$', 1)"
_DAY_OF = f"coalesce(strftime({O.day('date')}, '%Y%m%d'), nullif(regexp_extract({_SLUG}, '([0-9]{{8}})', 1), ''))"


@query(f"""WITH r AS (SELECT speech_id, source_url AS url, {_SLUG} AS slug, {_DAY_OF} AS date, participant, coalesce(text_content, '') AS text_content FROM speaker WHERE source_url IS NOT NULL),
k AS (SELECT * FROM r WHERE trim(coalesce(participant, '')) <> '' AND date BETWEEN '20150101' AND '20251231' AND length(text_content) >= 40)
SELECT slug, date, participant, {_W} < 120 AS short FROM k QUALIFY row_number() OVER (PARTITION BY slug ORDER BY speech_id % 3, url, date, participant, text_content) = 1""")
def speech_sources(spark, d):
    """Speech records of three sources by slug, the first source's of each."""
    s = table(spark, d, "speaker", "speech_id", "date", "participant", "text_content", "source_url").where("source_url is not null")
    pages = s.select("speech_id", F.col("source_url").alias("url"), F.col("date").alias("day"), "participant", F.lit(None).cast("string").alias("title"), F.col("text_content").alias("body"), F.lit("").alias("fallback_participant"), F.lit("").alias("fallback_title"))
    parts = [builders.speech_records(pages.where(F.col("speech_id") % 3 == k).drop("speech_id")) for k in range(3)]
    ordered = [p.withColumn("url", F.struct("url", "date", "participant", "text_content")) for p in parts]
    out = builders.speech_corpus(ordered, "20150101", "20251231")
    return out.select("slug", "date", "participant", F.array_contains("quality_flags", "short_body").alias("short"))


@query(f"""WITH m AS (SELECT site, d AS day, document_type, fomc_id, text_content, source_url, quality_flags, decision, high, low FROM ({MEETING}) WHERE d IS NOT NULL AND site IS NOT NULL),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY site, day, document_type ORDER BY fomc_id) = 1),
s AS (SELECT x.site, x.day, CASE WHEN b.decision IS NOT NULL THEN struct_pack(decision := b.decision, high := b.high, low := b.low) END AS own
  FROM (SELECT DISTINCT site, day FROM m) x LEFT JOIN b ON b.site = x.site AND b.day = x.day AND b.document_type = 'statement'),
c AS (SELECT site, day, last_value(own IGNORE NULLS) OVER (PARTITION BY site ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label FROM s)
SELECT c.site, c.day, t.document_type, length(coalesce(b.text_content, ''))::INT AS size, CASE WHEN b.text_content IS NULL THEN ['no_text'] ELSE coalesce(b.quality_flags, []) END AS flags,
  coalesce(label.decision, 'maintain') AS decision, coalesce(label.high, '0') AS high, coalesce(label.low, '0') AS low
FROM c CROSS JOIN (VALUES ('statement'), ('minutes'), ('press_conf')) t(document_type) LEFT JOIN b ON b.site = c.site AND b.day = c.day AND b.document_type = t.document_type""")
def meeting_documents(spark, d):
    """One row a meeting and document type with the labels carried forward."""
    from plumbline.operators.store import latest_by

    m = _meetings(spark, d, "document_type", "text_content", "quality_flags", "decision", "high", "low").where("day is not null and site is not null")
    best = latest_by(m, ["site", "day", "document_type"], [F.asc("fomc_id")]).withColumnsRenamed({"text_content": "text", "quality_flags": "flags"})
    out = builders.meeting_documents(m, best)
    return out.select("site", "day", "document_type", F.length("text").alias("size"), "flags", "decision", "high", "low")


@query(rf"""SELECT speech_id, strftime(d, '%Y%m%d') AS date, trim(participant) AS participant FROM ({SPEECH})
WHERE regexp_matches(coalesce(text_content, ''), '(?i)price stability|balance sheet') AND participant IS NOT NULL AND text_content IS NOT NULL AND d >= DATE '2020-01-01'
  AND {O.words("concat(participant, '. ', " + O.strip('text_content') + ")")} >= 80""")
def supplement_rows(spark, d):
    """Rows of a landed archive that mention the institution (here two terms) and are long enough."""
    landed = table(spark, d, "speaker", "speech_id", "date", "participant", "text_content").select(
        "speech_id", "date", F.col("participant").alias("author"), F.col("participant").alias("title"), F.lit(None).cast("string").alias("description"), F.col("text_content").alias("text")
    )
    found = builders.supplements(landed.withColumn("author", F.struct("author", "speech_id")).withColumn("author", F.when(F.col("author.author").isNotNull(), F.concat(F.col("author.speech_id").cast("string"), F.lit("|"), "author.author"))), "archive.test", pattern=r"(?i)price stability|balance sheet")
    return found.select(F.substring_index("participant", "|", 1).cast("long").alias("speech_id"), "date", F.trim(F.regexp_replace("participant", r"^\d+\|", "")).alias("participant"))


_KNOWN = _NAME.format(c="participant")


@query(f"""WITH s AS (SELECT *, {_KNOWN} AS person FROM ({SPEECH})), o AS (SELECT * FROM s WHERE speech_id % 3 = 0), c AS (SELECT * FROM s WHERE speech_id % 3 <> 0 AND d IS NOT NULL),
k AS (SELECT * FROM c WHERE person IN (SELECT person FROM o) AND NOT EXISTS (SELECT 1 FROM o WHERE o.person = c.person AND abs(o.d - c.d) <= 3)), m AS (SELECT DISTINCT d AS m FROM ({MEETING}) WHERE d IS NOT NULL)
SELECT speech_id, m AS meeting_day FROM k, m QUALIFY row_number() OVER (PARTITION BY speech_id ORDER BY abs(m - d), m) = 1""")
def filled_gaps(spark, d):
    """Supplements of known people without an official speech near, with the nearest meeting."""
    s = _speeches(spark, d, "participant").select("speech_id", "day", "participant")
    m = _meetings(spark, d).select(F.col("day").alias("held"))
    out = corpus.fill_gaps(s.where("speech_id % 3 <> 0"), s.where("speech_id % 3 = 0"), m, "participant", "day", "held")
    return out.select("speech_id", "meeting_day")


@query("""SELECT id, published_at, title FROM news WHERE source = (SELECT min(source) FROM news) AND (topic_query ILIKE '%rate%' OR title ILIKE '%rate%')
ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 20 OFFSET 5""")
def news_page(spark, d):
    """A page of one source's news on a topic, newest first."""
    news = table(spark, d, "news", "id", "source", "title", "topic_query", "published_at")
    source = news.agg(F.min("source")).first()[0]
    return corpus.news_page(news, source, "rate", limit=20, offset=5).select("id", "published_at", "title")


@query(f"""SELECT speech_id, d AS day, trim(substr(text_content, greatest(instr(lower(text_content), 'price stability') - 180, 1),
  instr(lower(text_content), 'price stability') + 520 - greatest(instr(lower(text_content), 'price stability') - 180, 1)), ' ') AS snippet
FROM ({SPEECH}) WHERE contains(lower(text_content), 'price stability') AND d IS NOT NULL ORDER BY d DESC, speech_id DESC LIMIT 20""")
def search_newest(spark, d):
    """The newest speeches that hold a phrase, with long surroundings."""
    s = _speeches(spark, d, "text_content").where("day is not null")
    found = corpus.search(s, "price stability", "text_content", ["speech_id", "day"], 180, 520)
    return found.orderBy(F.desc("day"), F.desc("speech_id")).limit(20)


@query(f"""WITH p AS (SELECT speech_id, unnest(list_distinct(list_concat(range(least(60, {_W}), {_W} + 1, 400), [{_W}])))::INT AS prefix_words, {_W} AS total,
    list_filter(string_split_regex(coalesce(text_content, ''), '{O._WS}+'), lambda x: x <> '') AS w FROM speaker WHERE {_W} > 0)
SELECT speech_id, prefix_words, prefix_words / total AS fraction, {O.sum_hits("array_to_string(list_slice(w, 1, prefix_words), ' ')", ('inflation', 'prices', 'outlook'))}::INT AS hits FROM p""")
def timeline_hits(spark, d):
    """Term hits along the growing prefixes of every speech."""
    s = table(spark, d, "speaker", "speech_id", "text_content")
    count = T.word_count(F.col("text_content"))
    rows = frames.timeline(s, "text_content", signals.timeline_points(count, 60, 400, 1000), ["speech_id"])
    return rows.select("speech_id", "prefix_words", "fraction", T.sum_substring_hits(F.col("text_content"), ("inflation", "prices", "outlook")).alias("hits"))


@query(r"""SELECT fomc_id, readable AS day FROM (SELECT fomc_id, """ + O.day("fomc_ref") + r""" AS readable FROM (SELECT fomc_id, date AS fomc_ref FROM fomc)) WHERE readable IS NOT NULL""")
def readable_days(spark, d):
    return table(spark, d, "fomc", "fomc_id", "date").select("fomc_id", readable_day(F.col("date")).alias("day")).where("day is not null")
