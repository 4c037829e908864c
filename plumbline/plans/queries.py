"""The core library's queries over the corpus, series, news and log tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from plumbline.functions import lexicons as L
from plumbline.functions import scores as S
from plumbline.functions import text as T
from plumbline.functions.dates import readable_day, site_of
from plumbline.operators import corpus, macro, reports, signals, store, temporal
from plumbline.runtime import table

from . import guard
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _speeches(spark: SparkSession, d: str, *more: str) -> DataFrame:
    base = table(spark, d, "speaker", *dict.fromkeys(("speech_id", "date", "domain", "source_url", *more)))
    return base.withColumns({"site": site_of(F.col("source_url"), F.col("domain")), "day": readable_day(F.col("date"))})


def _meetings(spark: SparkSession, d: str, *more: str) -> DataFrame:
    base = table(spark, d, "fomc", *dict.fromkeys(("fomc_id", "date", "source_url", *more)))
    return base.withColumns({"site": site_of(F.col("source_url")), "day": readable_day(F.col("date"))})


SPEECH = f"SELECT *, {O.site(True)} AS site, {O.day('date')} AS d FROM speaker"
MEETING = f"SELECT *, {O.site(False)} AS site, {O.day('date')} AS d FROM fomc"


# ---- scans ---------------------------------------------------------------------------------------------------------


@query("SELECT fomc_id, year::INT AS year, document_type, coalesce(len(quality_flags), 0)::INT AS flags FROM fomc WHERE year BETWEEN 2023 AND 2025")
def year_range_scan(spark, d):
    df = table(spark, d, "fomc", "fomc_id", "year", "document_type", "quality_flags").where(F.col("year").between(2023, 2025))
    return df.select("fomc_id", "year", "document_type", F.size(F.coalesce("quality_flags", F.array().cast("array<string>"))).alias("flags"))


@query("""SELECT series_id, obs_date, value FROM fred_cache WHERE value IS NOT NULL AND obs_date BETWEEN '2020-01-01' AND '2024-12-31'
QUALIFY row_number() OVER (PARTITION BY series_id, obs_date ORDER BY fetched_at DESC, value DESC NULLS LAST) = 1""")
def series_range(spark, d):
    df = table(spark, d, "fred_cache").where(F.col("obs_date").between("2020-01-01", "2024-12-31") & F.col("value").isNotNull())
    return macro.revised(df).select("series_id", "obs_date", "value")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY series_id, obs_date ORDER BY fetched_at DESC, value DESC NULLS LAST) AS k FROM fred_cache),
s AS (SELECT series_id, obs_date, value, row_number() OVER (PARTITION BY series_id ORDER BY obs_date DESC) AS rank FROM r WHERE k = 1)
SELECT series_id, obs_date, value, rank::INT AS rank FROM s WHERE rank <= 12""")
def last_observations(spark, d):
    return macro.last_observations(macro.revised(table(spark, d, "fred_cache")), 12).select("series_id", "obs_date", "value", "rank")


@query("SELECT series_id, count(value)::BIGINT AS values, min(obs_date) AS first_day, max(obs_date) AS last_day FROM fred_cache GROUP BY series_id")
def series_inventory(spark, d):
    df = table(spark, d, "fred_cache", "series_id", "obs_date", "value")
    return df.groupBy("series_id").agg(F.count("value").alias("values"), F.min("obs_date").alias("first_day"), F.max("obs_date").alias("last_day"))


# ---- writes --------------------------------------------------------------------------------------------------------


@query("""SELECT fomc_id, date, document_type, content_hash FROM fomc
QUALIFY row_number() OVER (PARTITION BY date, document_type, content_hash ORDER BY (fomc_id % 2 = 0) DESC, ingested_at DESC, fomc_id DESC) = 1""")
def upsert_latest(spark, d):
    df = table(spark, d, "fomc", "fomc_id", "date", "document_type", "content_hash", "ingested_at")
    stored, fresh = df.where("fomc_id % 2 <> 0"), df.where("fomc_id % 2 = 0")
    out = store.upsert(stored, fresh, store.MEETING_KEY, [F.desc("ingested_at"), F.desc("fomc_id")])
    return out.select("fomc_id", "date", "document_type", "content_hash")


@query("""WITH n AS (SELECT * FROM news WHERE url IS NOT NULL AND trim(url) <> '')
SELECT id, url FROM n WHERE id % 3 <> 0 AND url NOT IN (SELECT url FROM n WHERE id % 3 = 0)
QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at, id) = 1""")
def insert_ignore(spark, d):
    df = table(spark, d, "news", "id", "url", "fetched_at")
    stored = df.where("id % 3 = 0 and url is not null")
    return store.insert_ignore(stored, df.where("id % 3 <> 0"), "url", [F.asc_nulls_last("fetched_at"), F.asc("id")]).select("id", "url")


@query(f"""SELECT content_hash, count(*)::BIGINT AS records, epoch_us(max(ingested_at))::BIGINT AS latest_us, max_by(fomc_id, (ingested_at, fomc_id)) AS fomc_id
FROM fomc WHERE content_hash IS NOT NULL GROUP BY content_hash""")
def audit_latest(spark, d):
    df = table(spark, d, "fomc", "fomc_id", "content_hash", "ingested_at").where("content_hash is not null")
    return df.groupBy("content_hash").agg(
        F.count("*").alias("records"), F.unix_micros(F.max("ingested_at")).alias("latest_us"), F.max_by("fomc_id", F.struct("ingested_at", "fomc_id")).alias("fomc_id")
    )


@query("""SELECT run_id, started_at, finished_at, (rows_fomc + rows_speaker)::BIGINT AS rows_total, finished_at IS NOT NULL AS finished FROM ingestion_log""")
def run_states(spark, d):
    df = table(spark, d, "ingestion_log", "run_id", "started_at", "finished_at", "rows_fomc", "rows_speaker")
    return df.select("run_id", "started_at", "finished_at", (F.col("rows_fomc").cast("long") + F.col("rows_speaker")).alias("rows_total"), F.col("finished_at").isNotNull().alias("finished"))


# ---- normalisation and text ----------------------------------------------------------------------------------------


@query(f"""SELECT fomc_id, coalesce(strftime({O.day('date')}, '%Y%m%d'), date) AS date,
  coalesce(TRY_CAST(substr(coalesce(strftime({O.day('date')}, '%Y%m%d'), date), 1, 4) AS INT), 0) AS year, sha256({O.strip("coalesce(text_content, '')")}) AS content_hash FROM fomc""")
def canonical_meetings(spark, d):
    df = table(spark, d, "fomc")
    return corpus.canonical(df, "fomc").select("fomc_id", "date", "year", "content_hash")


@query(f"""SELECT speech_id, coalesce(strftime({O.day('date')}, '%Y%m%d'), date) AS date, 'speech' AS document_type, {O.words('text_content')}::INT AS word_count FROM speaker""")
def canonical_speeches(spark, d):
    df = table(spark, d, "speaker", "speech_id", "date", "text_content")
    return df.select("speech_id", corpus.day_text(F.col("date")).alias("date"), F.lit("speech").alias("document_type"), T.word_count(F.col("text_content")).alias("word_count"))


_FLAGGED = "(list_has_any(coalesce(quality_flags, []), [{}]))::INT"


@query(f"""SELECT fomc_id, greatest(0, 10 - 4 * {_FLAGGED.format("'no_text'")} - 2 * {_FLAGGED.format("'pdf_unreadable'")} - 2 * {_FLAGGED.format("'html_structure_unknown'")}
  - {_FLAGGED.format("'http_error', 'http_404'")} - ({O.words('text_content')} < 120)::INT) / 10.0::DOUBLE AS score FROM fomc""")
def quality_scores(spark, d):
    df = table(spark, d, "fomc", "fomc_id", "text_content", "quality_flags")
    return df.select("fomc_id", S.quality_score(T.word_count(F.col("text_content")), F.col("quality_flags")).alias("score"))


@query(r"""SELECT fomc_id, len(regexp_extract_all(text_content, '\b[0-9]+(?:[.][0-9]+)?[\t\n\x0b\f\r ]*%'))::INT AS percentages,
  len(regexp_extract_all(text_content, '(?i)\b[0-9]+[\t\n\x0b\f\r ]*basis[\t\n\x0b\f\r ]+points?\b'))::INT AS basis_points FROM fomc""")
def figures_in_text(spark, d):
    df = table(spark, d, "fomc", "fomc_id", "text_content")
    return df.select("fomc_id", F.nullif(F.size(T.percentages_in(F.col("text_content"))), F.lit(-1)).alias("percentages"), F.nullif(F.size(T.basis_points_in(F.col("text_content"))), F.lit(-1)).alias("basis_points"))


@query(f"SELECT speech_id, {', '.join(f'{O.hits('text_content', k)}::INT AS {k.replace(' ', '_')}' for k in L.KEYWORDS)} FROM speaker")
def keyword_hits(spark, d):
    df = table(spark, d, "speaker", "speech_id", "text_content")
    return df.select("speech_id", *[T.substring_hits(F.col("text_content"), k).alias(k.replace(" ", "_")) for k in L.KEYWORDS])


@query("SELECT fomc_id, " + ", ".join(f"({' + '.join(O.bounded('text_content', t) for t in ts)})::INT AS {n}" for n, ts in L.MACRO_TOPICS.items()) + " FROM fomc")
def topic_hits(spark, d):
    df = table(spark, d, "fomc", "fomc_id", "text_content")
    return df.select("fomc_id", *[T.sum_bounded_hits(F.col("text_content"), ts).alias(n) for n, ts in L.MACRO_TOPICS.items()])


@query(f"""SELECT speech_id, {O.weighted('text_content', L.POLICY_WEIGHTS)}::DOUBLE AS score, {O.sum_hits('text_content', L.HAWKISH)}::INT AS hawkish,
  {O.sum_hits('text_content', L.DOVISH)}::INT AS dovish, {O.sum_hits('text_content', L.UNCERTAIN)}::INT AS uncertain FROM speaker""")
def policy_scores(spark, d):
    df = table(spark, d, "speaker", "speech_id", "text_content")
    t = F.col("text_content")
    return df.select("speech_id", S.policy_score(t).alias("score"), T.sum_substring_hits(t, L.HAWKISH).alias("hawkish"), T.sum_substring_hits(t, L.DOVISH).alias("dovish"), T.sum_substring_hits(t, L.UNCERTAIN).alias("uncertain"))


_W = O.words("text_content")
_P = O.weighted("text_content", L.POLICY_WEIGHTS)


@query(f"""SELECT speech_id, ({_P} >= 10 OR ({_P} >= 5 AND {_P} * 1000 >= 2 * greatest({_W}, 1))) AS relevant FROM speaker""")
def weak_relevance(spark, d):
    df = table(spark, d, "speaker", "speech_id", "text_content").withColumns({"score": S.policy_score(F.col("text_content")), "n": T.word_count(F.col("text_content"))})
    return df.select("speech_id", S.rate_relevant(F.col("score"), F.col("n"), F.lit(False)).alias("relevant"))


@query(f"""SELECT fomc_id, len(list_filter(string_split_regex(coalesce(text_content, ''), '[.!?]+'), lambda x: {O.strip('x')} <> ''))::INT AS raw,
  greatest(1, len(list_filter(string_split_regex(coalesce(text_content, ''), '[.!?]+'), lambda x: {O.strip('x')} <> '')))::INT AS sentences FROM fomc""")
def sentence_counts(spark, d):
    df = table(spark, d, "fomc", "fomc_id", "text_content")
    raw = F.size(F.filter(F.split(F.coalesce("text_content", F.lit("")), "[.!?]+"), lambda s: F.length(T.strip(s)) > 0))
    return df.select("fomc_id", raw.alias("raw"), T.sentence_count(F.col("text_content")).alias("sentences"))


_NAME = "trim(regexp_replace(regexp_replace(lower(regexp_replace(trim(coalesce({c}, '')), '(?i)^\\s*(?:(?:vice\\s+)?chair(?:man|woman)?(?:\\s+for\\s+supervision)?|governor|president)\\s+', '')), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT DISTINCT {_NAME.format(c='participant')} AS person FROM speaker")
def person_keys(spark, d):
    return table(spark, d, "speaker", "participant").select(T.person_key(F.col("participant")).alias("person")).distinct()


@query("""SELECT * FROM (VALUES ('5', 5.0, '5'), ('5-1/4', 5.25, '5.25'), ('1/2', 0.5, '0.5'), ('4.75', 4.75, '4.75'), ('x', NULL, NULL), ('10-1/8', 10.125, '10.125'))
v(token, value, text)""")
def rate_tokens(spark, d):
    df = spark.createDataFrame([(t,) for t in ("5", "5-1/4", "1/2", "4.75", "x", "10-1/8")], "token string")
    return df.select("token", S.rate_value(F.col("token")).alias("value"), S.rate_text(S.rate_value(F.col("token"))).alias("text"))


@query("""SELECT fomc_id, CASE lower(trim(decision)) WHEN 'fall' THEN 'lower' WHEN 'cut' THEN 'lower' WHEN 'decrease' THEN 'lower' WHEN 'hold' THEN 'maintain'
  WHEN 'unchanged' THEN 'maintain' WHEN 'rise' THEN 'raise' WHEN 'increase' THEN 'raise' WHEN 'hike' THEN 'raise' ELSE lower(trim(decision)) END AS direction,
  least(coalesce(TRY_CAST(high AS DOUBLE), 0), coalesce(TRY_CAST(low AS DOUBLE), 0)) AS target_lower,
  greatest(coalesce(TRY_CAST(high AS DOUBLE), 0), coalesce(TRY_CAST(low AS DOUBLE), 0)) AS target_upper FROM fomc""")
def policy_bounds(spark, d):
    df = table(spark, d, "fomc", "fomc_id", "decision", "high", "low")
    lower, upper = S.bounds(F.col("high"), F.col("low"))
    return df.select("fomc_id", S.direction(F.col("decision")).alias("direction"), lower.alias("target_lower"), upper.alias("target_upper"))


# ---- joins in time -------------------------------------------------------------------------------------------------


@query(f"""WITH s AS ({SPEECH}), m AS (SELECT DISTINCT site, d AS m FROM ({MEETING}) WHERE d IS NOT NULL),
a AS (SELECT speech_id, any_value(s.d) AS d, min(m) FILTER (m - 12 <= d AND d <= m + 1) AS inside, max(m) FILTER (m <= d) AS earlier, min(m) AS first
  FROM s LEFT JOIN m USING (site) WHERE d IS NOT NULL GROUP BY speech_id)
SELECT speech_id, coalesce(inside, earlier, first) AS meeting_day,
  CASE WHEN inside IS NOT NULL THEN 'blackout_pre' WHEN earlier IS NOT NULL THEN 'post_meeting' ELSE 'no_prior_meeting' END AS rule FROM a""")
def blackout_align(spark, d):
    out = temporal.align_to_meetings(_speeches(spark, d).select("speech_id", "site", "day"), _meetings(spark, d).select("site", F.col("day").alias("held")), "day", "held", [], entity="site")
    return out.select("speech_id", "meeting_day", "rule")


@query(f"""WITH s AS ({SPEECH}), m AS (SELECT DISTINCT d AS m FROM ({MEETING}) WHERE d IS NOT NULL),
a AS (SELECT speech_id, any_value(s.d) AS d, min(m) FILTER (m - 12 <= d AND d <= m + 1) AS inside, max(m) FILTER (m <= d) AS earlier
  FROM s, m WHERE d IS NOT NULL GROUP BY speech_id)
SELECT strftime(d, '%Y-%m') AS month, CASE WHEN inside IS NOT NULL THEN 'blackout_pre' WHEN earlier IS NOT NULL THEN 'post_meeting' ELSE 'no_prior_meeting' END AS rule,
  count(*)::BIGINT AS speeches FROM a GROUP BY ALL""")
def month_by_rule(spark, d):
    out = temporal.align_to_meetings(_speeches(spark, d).select("speech_id", "day"), _meetings(spark, d).select(F.col("day").alias("held")), "day", "held", [])
    return out.groupBy(F.date_format("day", "yyyy-MM").alias("month"), "rule").agg(F.count("*").alias("speeches"))


@query(f"""WITH s AS ({SPEECH}), m AS (SELECT DISTINCT site, d AS m FROM ({MEETING}) WHERE d IS NOT NULL)
SELECT speech_id, m AS meeting_day FROM s LEFT JOIN m USING (site) WHERE d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY speech_id ORDER BY abs(m - d), m) = 1""")
def nearest_label(spark, d):
    out = temporal.nearest_meeting(_speeches(spark, d).select("speech_id", "site", "day"), _meetings(spark, d).select("site", F.col("day").alias("held")), "day", "held", "site")
    return out.select("speech_id", "meeting_day")


@query("""SELECT v.event_id, p.value AS last_value, p.ts AS last_ts FROM (SELECT * FROM events WHERE event_type = 'view') v
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON v.user_id = p.user_id AND v.ts >= p.ts""")
def asof_purchase(spark, d):
    ev = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")
    views = ev.where("event_type = 'view'").select("event_id", "user_id", "ts")
    bought = ev.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"), "value")
    out = temporal.as_of(views, bought, ["user_id"], "ts", "bought", ["value", "bought"], span_s=86_400)
    return out.select("event_id", F.col("asof_value").alias("last_value"), F.col("asof_bought").alias("last_ts"))


#: Families of the synthetic series ids and the series of the context they stand for; of one family's values a day the greatest counts.
_FAMILY = {"FEDX": "FEDFUNDS", "YLD": "T10Y2Y", "UNR": "UNRATE", "CPX": "CPIAUCSL", "TGT": "DFEDTARL", "TGU": "DFEDTARU"}


def _context(spark, d) -> DataFrame:
    series = macro.revised(table(spark, d, "fred_cache"))
    known = F.create_map(*[x for k, v in _FAMILY.items() for x in (F.lit(k), F.lit(v))])
    named = series.withColumn("series_id", known[F.regexp_extract("series_id", "^[A-Z]+", 0)]).where("series_id is not null")
    return macro.wide_context(named.groupBy("series_id", "obs_date").agg(F.max("value").alias("value")))


_REV = "SELECT regexp_extract(series_id, '^[A-Z]+') AS family, obs_date, value FROM fred_cache QUALIFY row_number() OVER (PARTITION BY series_id, obs_date ORDER BY fetched_at DESC, value DESC NULLS LAST) = 1"
_WIDE = f"""w AS (SELECT CAST(obs_date AS DATE) AS day, {', '.join(f"max(value) FILTER (family = '{k}') AS {L.MACRO_SERIES[v]}" for k, v in _FAMILY.items())}
  FROM ({_REV}) WHERE family IN ({', '.join(f"'{k}'" for k in _FAMILY)}) GROUP BY 1),
m AS (SELECT *, (coalesce(target_lower, target_upper) + coalesce(target_upper, target_lower)) / 2 AS target_mid FROM w),
f AS (SELECT day, {', '.join(f"last_value({c} IGNORE NULLS) OVER (ORDER BY day) AS {c}" for c in [*L.MACRO_SERIES.values(), 'target_mid'])} FROM m)"""
_COLS = [*L.MACRO_SERIES.values(), "target_mid"]
_LAGS = ", ".join(
    f"{c} - last_value({c}) OVER (ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL {n} DAYS PRECEDING) AS {name}" for name, c, n in macro.CHANGES
)


@query(f"WITH {_WIDE} SELECT day, {', '.join(_COLS)}, {_LAGS} FROM f")
def macro_context(spark, d):
    return _context(spark, d)


@query(f"""WITH {_WIDE}, s AS (SELECT speech_id, {O.day('date')} AS d FROM speaker)
SELECT speech_id, coalesce(funds_rate, 0) AS funds_rate, coalesce(curve, 0) AS curve, coalesce(target_mid, 0) AS target_mid FROM s ASOF LEFT JOIN f ON s.d >= f.day""")
def macro_at_speech(spark, d):
    context = _context(spark, d)
    docs = table(spark, d, "speaker", "speech_id", "date").select("speech_id", readable_day(F.col("date")).alias("day_of"))
    out = macro.attach_context(docs, context, "day_of", ["funds_rate", "curve", "target_mid"])
    return out.select("speech_id", *[F.col(f"asof_{c}").alias(c) for c in ("funds_rate", "curve", "target_mid")])


@query(f"""WITH b AS (SELECT site, d, min(least(TRY_CAST(high AS DOUBLE), TRY_CAST(low AS DOUBLE))) AS lo, max(greatest(TRY_CAST(high AS DOUBLE), TRY_CAST(low AS DOUBLE))) AS hi
  FROM ({MEETING}) WHERE d IS NOT NULL AND site IS NOT NULL GROUP BY ALL),
c AS (SELECT *, lo - lag(lo) OVER (PARTITION BY site ORDER BY d) AS dl, hi - lag(hi) OVER (PARTITION BY site ORDER BY d) AS dh FROM b)
SELECT site, d AS day, CASE WHEN dl > 1e-6 AND dh > 1e-6 THEN 'raise' WHEN dl < -1e-6 AND dh < -1e-6 THEN 'lower' ELSE 'maintain' END AS step FROM c""")
def policy_step(spark, d):
    m = _meetings(spark, d, "high", "low").where("day is not null and site is not null")
    high, low = F.col("high").try_cast("double"), F.col("low").try_cast("double")
    b = m.groupBy("site", "day").agg(F.min(F.least(high, low)).alias("lo"), F.max(F.greatest(high, low)).alias("hi"))
    return macro.policy_steps(b, "site", "day", "lo", "hi").select("site", "day", "step")


_PERSON = _NAME.format(c="participant")


@query(f"""WITH s AS (SELECT *, {_PERSON} AS person FROM ({SPEECH})), o AS (SELECT * FROM s WHERE speech_id % 3 = 0), c AS (SELECT * FROM s WHERE speech_id % 3 <> 0)
SELECT speech_id FROM c WHERE person IN (SELECT person FROM o) AND NOT EXISTS (SELECT 1 FROM o WHERE o.person = c.person AND abs(o.d - c.d) <= 3)""")
def gap_fill(spark, d):
    s = _speeches(spark, d, "participant").select("speech_id", "day", T.person_key(F.col("participant")).alias("person"))
    return temporal.band_anti_join(s.where("speech_id % 3 <> 0"), s.where("speech_id % 3 = 0"), "person", "day", 3).select("speech_id")


@query(f"""WITH m AS ({MEETING}) SELECT site, d AS day, last_value(CASE WHEN document_type = 'statement' THEN decision END IGNORE NULLS)
  OVER (PARTITION BY site ORDER BY d, fomc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried, fomc_id FROM m WHERE d IS NOT NULL AND site IS NOT NULL""")
def carried_labels(spark, d):
    m = _meetings(spark, d, "document_type", "decision").where("day is not null and site is not null")
    m = m.withColumns({"carried": F.when(F.col("document_type") == "statement", F.col("decision")), "order": F.struct("day", "fomc_id"), "month": F.trunc("day", "month")})
    return temporal.forward_fill(m, ["site"], "order", ["carried"], "month").select("site", "day", "carried", "fomc_id")


# ---- merges, filters, search ---------------------------------------------------------------------------------------


@query("""SELECT speech_id, date, participant FROM speaker
QUALIFY row_number() OVER (PARTITION BY date, participant, domain, content_hash ORDER BY (speech_id % 5 <> 0)::INT, speech_id) = 1""")
def ranked_merge(spark, d):
    s = table(spark, d, "speaker", "speech_id", "date", "participant", "domain", "content_hash")
    return corpus.ranked_merge([s.where("speech_id % 5 = 0"), s.where("speech_id % 5 <> 0")], store.SPEECH_KEY, "speech_id").select("speech_id", "date", "participant")


@query(f"""SELECT 'fomc' AS corpus, date, {O.words('text_content')}::INT AS word_count, decision, document_type AS type FROM fomc
UNION ALL SELECT 'speaker', date, {O.words('text_content')}::INT, decision, document_type FROM speaker""")
def combined_corpus(spark, d):
    cols = ("date", "text_content", "decision", "document_type")
    return corpus.combined(table(spark, d, "fomc", *cols), table(spark, d, "speaker", *cols)).drop("text")


@query("SELECT DISTINCT source_url FROM fomc WHERE list_has_any(quality_flags, ['no_text', 'pdf_unreadable', 'http_404']) AND source_url <> ''")
def stub_urls(spark, d):
    df = table(spark, d, "fomc", "source_url", "quality_flags")
    wanted = F.array(*[F.lit(x) for x in ("no_text", "pdf_unreadable", "http_404")])
    return df.where(F.arrays_overlap("quality_flags", wanted) & (F.col("source_url") != "")).select("source_url").distinct()


@query("""SELECT speech_id, date, trim(substr(text_content, greatest(instr(lower(text_content), 'price stability') - 80, 1),
  instr(lower(text_content), 'price stability') + 160 - greatest(instr(lower(text_content), 'price stability') - 80, 1)), ' ') AS snippet
FROM speaker WHERE contains(lower(text_content), 'price stability')""")
def search_snippets(spark, d):
    return corpus.search(table(spark, d, "speaker", "speech_id", "date", "text_content"), "price stability", "text_content", ["speech_id", "date"])


@query("""SELECT id, source, title FROM news WHERE source ILIKE '%a%' AND (topic_query ILIKE '%rate%' OR title ILIKE '%rate%')""")
def news_filter(spark, d):
    df = table(spark, d, "news", "id", "source", "title", "topic_query")
    return df.where(F.col("source").ilike("%a%") & (F.coalesce(F.col("topic_query").ilike("%rate%"), F.lit(False)) | F.coalesce(F.col("title").ilike("%rate%"), F.lit(False)))).select("id", "source", "title")


@query("SELECT id, CASE WHEN sentiment_score IS NULL THEN NULL WHEN sentiment_score >= 0.35 THEN 'positive' WHEN sentiment_score <= -0.35 THEN 'negative' ELSE 'neutral' END AS label FROM news")
def news_labels(spark, d):
    s = F.col("sentiment_score")
    return table(spark, d, "news", "id", "sentiment_score").select("id", F.when(s.isNull(), None).when(s >= 0.35, "positive").when(s <= -0.35, "negative").otherwise("neutral").alias("label"))


@query(f"""SELECT speech_id, d AS day, participant FROM ({SPEECH}) WHERE d IS NOT NULL ORDER BY d DESC, speech_id DESC LIMIT 100""")
def newest_speeches(spark, d):
    s = _speeches(spark, d, "participant").where("day is not null")
    return s.orderBy(F.desc("day"), F.desc("speech_id")).limit(100).select("speech_id", "day", "participant")


@query(f"""SELECT fomc_id, {_W}::INT AS word_count FROM ({MEETING}) WHERE d IS NOT NULL AND {_W} >= 80 AND lower(trim(decision)) IN ('lower', 'maintain', 'raise', 'cut', 'hold', 'hike')
  AND coalesce(quality_score, 1) >= 0.4 AND NOT (coalesce(labels_from_fred, false) AND coalesce(quality_score, 1) < 0.7)
  AND NOT list_has_any(list_transform(coalesce(quality_flags, []), lambda x: lower(x)), ['no_text', 'pdf_unreadable', 'stub'])""")
def modelling_rows(spark, d):
    m = _meetings(spark, d, "text_content", "decision", "quality_score", "quality_flags", "labels_from_fred")
    m = m.withColumns({"event_date": F.col("day"), "word_count": T.word_count(F.col("text_content")), "direction": S.direction(F.col("decision"))})
    return corpus.usable_for_models(m).select("fomc_id", "word_count")


@query("""SELECT kind, count(*)::BIGINT AS speeches FROM (SELECT CASE WHEN year BETWEEN 2022 AND 2024 THEN 'inside' ELSE 'outside' END AS kind FROM speaker) GROUP BY kind""")
def guarded_sql(spark, d):
    table(spark, d, "speaker", "year").createOrReplaceTempView("plumbline_speeches")
    return guard.run(spark, "SELECT kind, count(*) AS speeches FROM (SELECT CASE WHEN year BETWEEN 2022 AND 2024 THEN 'inside' ELSE 'outside' END AS kind FROM plumbline_speeches) GROUP BY kind")


# ---- aggregations and reports --------------------------------------------------------------------------------------


@query(f"""SELECT last_day(d) AS month, count(*) FILTER (decision = 'lower')::BIGINT AS lower, count(*) FILTER (decision = 'maintain')::BIGINT AS maintain,
  count(*) FILTER (decision = 'raise')::BIGINT AS raise FROM ({MEETING}) WHERE d IS NOT NULL GROUP BY 1""")
def month_by_decision(spark, d):
    m = _meetings(spark, d, "decision").where("day is not null")
    return m.groupBy(F.last_day("day").alias("month")).pivot("decision", ["lower", "maintain", "raise"]).count().na.fill(0)


@query("SELECT coalesce(document_type, 'None') AS value, count(*)::BIGINT AS count, count(*) / sum(count(*)) OVER () AS share FROM fomc GROUP BY 1")
def type_distribution(spark, d):
    return reports.distribution(table(spark, d, "fomc", "document_type"), F.col("document_type"))


@query("SELECT flag, count(*)::BIGINT AS records FROM (SELECT unnest(quality_flags) AS flag FROM fomc) GROUP BY flag ORDER BY records DESC, flag LIMIT 10")
def flag_frequency(spark, d):
    flags = table(spark, d, "fomc", "quality_flags").select(F.explode("quality_flags").alias("flag"))
    return flags.groupBy("flag").agg(F.count("*").alias("records")).orderBy(F.desc("records"), "flag").limit(10)


@query(f"""SELECT {O.site(True)} AS site, count(*)::BIGINT AS speeches, count(DISTINCT participant)::BIGINT AS participants, min(year)::INT AS first_year, max(year)::INT AS last_year
FROM speaker GROUP BY 1""")
def site_statistics(spark, d):
    s = table(spark, d, "speaker", "source_url", "domain", "participant", "year").withColumn("site", site_of(F.col("source_url"), F.col("domain")))
    return s.groupBy("site").agg(F.count("*").alias("speeches"), F.count_distinct("participant").alias("participants"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@query("SELECT source, count(*)::BIGINT AS articles, count(DISTINCT url)::BIGINT AS urls FROM news GROUP BY source")
def news_by_source(spark, d):
    return table(spark, d, "news", "source", "url").groupBy("source").agg(F.count("*").alias("articles"), F.count_distinct("url").alias("urls"))


@query("""SELECT run_id, coalesce(http_status, 0)::INT AS http_status, count(*)::BIGINT AS errors, max(occurred_at) AS latest, started_at
FROM fetch_errors LEFT JOIN ingestion_log USING (run_id) GROUP BY ALL""")
def errors_by_run(spark, d):
    e = table(spark, d, "fetch_errors", "run_id", "http_status", "occurred_at").groupBy("run_id", F.coalesce("http_status", F.lit(0)).alias("http_status")).agg(F.count("*").alias("errors"), F.max("occurred_at").alias("latest"))
    return e.join(table(spark, d, "ingestion_log", "run_id", "started_at"), "run_id", "left")


_COVER = "coalesce(max_by({x}, (words, content_hash, list_sort(coalesce(quality_flags, [])))) FILTER (document_type = '{t}'), {n})"
_TYPES = ("statement", "minutes", "press_conf")


@query(f"""WITH m AS (SELECT site, d, document_type, content_hash, quality_flags, {_W} AS words,
    {_W} > 0 AND NOT list_has_any(coalesce(quality_flags, []), ['no_text', 'pdf_unreadable', 'stub']) AS ok FROM ({MEETING}) WHERE d IS NOT NULL),
c AS (SELECT site, d AS day, {', '.join(f"{_COVER.format(x='ok', t=t, n='false')} AS {t}" for t in _TYPES)},
  list_sort(list_distinct(list_concat({', '.join(_COVER.format(x="coalesce(quality_flags, [])", t=t, n='[]') for t in _TYPES)}))) AS flags
  FROM m WHERE document_type IN ('statement', 'minutes', 'press_conf') GROUP BY ALL)
SELECT site, day, statement, minutes, press_conf, statement AND minutes AND press_conf AS complete, flags FROM c""")
def completeness(spark, d):
    m = _meetings(spark, d, "document_type", "text_content", "content_hash", "quality_flags").where("day is not null")
    return corpus.coverage(m, list(_TYPES), "site", "day")


_TRUTH = "replace(replace(replace(lower(trim(decision)), 'hold', 'maintain'), 'cut', 'lower'), 'hike', 'raise')"


@query(f"""WITH p AS (SELECT year, {_TRUTH} AS truth, CASE fomc_id % 4 WHEN 0 THEN 'raise' WHEN 1 THEN 'lower' ELSE 'maintain' END AS guess FROM fomc WHERE decision IS NOT NULL),
l AS (SELECT DISTINCT year, truth AS label FROM p),
f AS (SELECT l.year, label, 2.0 * count(*) FILTER (truth = label AND guess = label) / (count(*) FILTER (truth = label) + count(*) FILTER (guess = label)) AS f1 FROM l JOIN p ON l.year = p.year GROUP BY ALL)
SELECT year::INT AS year, avg(f1) AS f1, count(*)::BIGINT AS labels FROM f GROUP BY year""")
def yearly_f1(spark, d):
    m = table(spark, d, "fomc", "fomc_id", "year", "decision").where("decision is not null")
    guess = F.when(F.col("fomc_id") % 4 == 0, "raise").when(F.col("fomc_id") % 4 == 1, "lower").otherwise("maintain")
    return reports.f1_by(m.select("year", S.direction(F.col("decision")).alias("truth"), guess.alias("guess")), ["year"], "truth", "guess")


@query("""SELECT r.row, count(*) FILTER (document_type = 'minutes')::BIGINT AS minutes, count(*) FILTER (document_type = 'statement')::BIGINT AS statement
FROM (VALUES ('lower'), ('maintain'), ('raise'), ('absent')) r(row) LEFT JOIN fomc ON decision = r.row GROUP BY r.row""")
def decision_crosstab(spark, d):
    return reports.crosstab(table(spark, d, "fomc", "decision", "document_type"), "decision", "document_type", ["lower", "maintain", "raise", "absent"], ["minutes", "statement"])


@query("SELECT decision, count(*)::BIGINT AS count, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM fomc GROUP BY decision")
def class_weights(spark, d):
    return reports.balanced_weights(table(spark, d, "fomc", "decision"), "decision")


@query("""WITH i AS (SELECT DISTINCT source, url FROM news WHERE url IS NOT NULL),
b AS (SELECT source, substr(sha256(url), 1, 2) AS bucket, count(*) AS n, sha256(string_agg(url, chr(10) ORDER BY url)) AS digest FROM i GROUP BY ALL)
SELECT source, sum(n)::BIGINT AS items, sha256(string_agg(bucket || digest, chr(10) ORDER BY bucket || digest)) AS hash FROM b GROUP BY source""")
def feed_fingerprints(spark, d):
    return reports.fingerprint(table(spark, d, "news", "source", "url").where("url is not null"), "source", F.col("url"))


# ---- signals -------------------------------------------------------------------------------------------------------

_PCTS = (20, 50, 100)
_WORDS = f"list_filter(string_split_regex(coalesce(text_content, ''), '{O._WS}+'), lambda x: x <> '')"
_PREFIX = f"array_to_string(list_slice({_WORDS}, 1, greatest(ceil(len({_WORDS}) * percent / 100.0), 1)::INT), ' ')"


@query(f"""SELECT fomc_id, percent::INT AS percent, {O.sum_hits(_PREFIX, ('inflation', 'prices', 'outlook'))}::INT AS hits
FROM fomc, (VALUES (20), (50), (100)) p(percent)""")
def prefix_hits(spark, d):
    df = signals.expand_prefixes(table(spark, d, "fomc", "fomc_id", "text_content"), "text_content", list(_PCTS))
    return df.select("fomc_id", "percent", T.sum_substring_hits(F.col("text_content"), ("inflation", "prices", "outlook")).alias("hits"))


@query("""WITH v AS (SELECT user_id, ts, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS nx FROM events)
SELECT user_id, min(ts) AS ts, min_by(event_type, ts) AS event_type FROM v WHERE event_type = nx AND event_type <> 'error' GROUP BY user_id""")
def stable_run(spark, d):
    ev = table(spark, d, "events", "user_id", "ts", "event_type")
    return signals.first_stable(ev, ["user_id"], "ts", "event_type", 2, barred="error").select("user_id", "ts", "event_type")


@query("""WITH e AS (SELECT event_id, ((event_id * 37) % 100) / 100.0::DOUBLE AS p, ((event_id * 17) % 90 + 1)::DOUBLE AS a, ((event_id * 29) % 90 + 1)::DOUBLE AS b, ((event_id * 43) % 90 + 1)::DOUBLE AS c FROM events),
n AS (SELECT event_id, p, a / (a + b + c) AS l, b / (a + b + c) AS m, c / (a + b + c) AS r FROM e),
s AS (SELECT event_id, p, list_reverse_sort([{p: l, n: 'lower'}, {p: m, n: 'maintain'}, {p: r, n: 'raise'}]) AS k FROM n)
SELECT event_id, CASE WHEN p <= 0.35 THEN 'no_rate_signal' WHEN p < 0.5 OR k[1].p < 0.45 OR k[1].p - k[2].p < 0.05 THEN 'uncertain_rate_signal' ELSE k[1].n END AS action FROM s""")
def action_rule(spark, d):
    e = F.col("event_id")
    ev = table(spark, d, "events", "event_id")
    a, b, c = (((e * k) % 90 + 1).cast("double") for k in (17, 29, 43))
    return ev.select("event_id", signals.action(((e * 37) % 100) / 100.0, a / (a + b + c), b / (a + b + c), c / (a + b + c))["action"].alias("action"))


TERM_WEIGHTS = """WITH l AS (SELECT fomc_id, regexp_extract_all(lower(coalesce(text_content, '')), '[\\p{L}\\p{N}_]{2,}') AS t FROM fomc),
t AS (SELECT fomc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM l),
c AS (SELECT fomc_id, term, count(*) AS tf FROM t GROUP BY ALL),
g AS (SELECT term, count(*) AS df FROM c GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT count(*) FROM fomc)),
w AS (SELECT fomc_id, term, tf, df, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM fomc)) / (1 + df)) + 1) AS raw FROM c JOIN g USING (term))"""


@query(f"""{TERM_WEIGHTS} SELECT fomc_id, count(*)::BIGINT AS terms, sum(tf)::BIGINT AS tokens, sum(df)::BIGINT AS spread FROM w GROUP BY fomc_id""")
def word_weight_totals(spark, d):
    w = signals.word_weights(table(spark, d, "fomc", "fomc_id", "text_content"), "fomc_id", "text_content")
    return w.groupBy("fomc_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens"), F.sum("df").alias("spread"))


_LEX = [("rose", "positive"), ("improvement", "positive"), ("recovery", "positive"), ("welcome", "positive"), ("fell", "negative"), ("deterioration", "negative"), ("weaker", "negative"), ("risks", "uncertainty"), ("tentative", "uncertainty")]


@query(f"""WITH lex AS (SELECT * FROM (VALUES {', '.join(f"('{w}', '{c}')" for w, c in _LEX)}) v(word, category)),
h AS (SELECT fomc_id, unnest(regexp_extract_all(lower(coalesce(text_content, '')), '[\\p{{L}}\\p{{N}}]+')) AS word FROM fomc),
n AS (SELECT f.fomc_id, count(*) FILTER (category = 'positive') AS positive, count(*) FILTER (category = 'negative') AS negative, count(*) FILTER (category = 'uncertainty') AS uncertainty
  FROM fomc f LEFT JOIN h ON f.fomc_id = h.fomc_id LEFT JOIN lex ON h.word = lex.word GROUP BY f.fomc_id)
SELECT fomc_id, positive::BIGINT AS positive, negative::BIGINT AS negative, uncertainty::BIGINT AS uncertainty,
  CASE WHEN positive + negative + uncertainty = 0 THEN 0 ELSE (positive - negative) / (positive + negative + uncertainty) END::DOUBLE AS score FROM n""")
def lexicon_scores(spark, d):
    lexicon = spark.createDataFrame(_LEX, "word string, category string")
    return signals.lexicon_hits(table(spark, d, "fomc", "fomc_id", "text_content"), "fomc_id", "text_content", F.broadcast(lexicon))


_SPACE = r"[\t\n\x0b\f\r ]"
_EXCERPT = ("inflation", "prices", "outlook", "price stability")
_MATCHED = " + ".join(f"(len(regexp_extract_all(lower(sentence), '\\b{t}\\b')) > 0)::INT" for t in _EXCERPT)


@query(f"""WITH s AS (SELECT fomc_id, unnest(x) AS sentence, unnest(range(len(x))) AS place FROM (
  SELECT fomc_id, string_split(regexp_replace(coalesce(text_content, ''), '([.!?]){_SPACE}+', '\\1' || chr(1), 'g'), chr(1)) AS x FROM fomc)),
m AS (SELECT fomc_id, sentence, {_MATCHED} AS matched, min(place) AS place FROM s GROUP BY ALL)
SELECT fomc_id, row_number() OVER (PARTITION BY fomc_id ORDER BY matched DESC, place)::INT AS rank, matched::INT AS matched, sentence FROM m WHERE matched > 0 QUALIFY rank <= 3""")
def signal_excerpts(spark, d):
    return signals.excerpts(table(spark, d, "fomc", "fomc_id", "text_content"), "fomc_id", "text_content", _EXCERPT)


_LOW = "lower(coalesce(text_content, ''))"
_FIRST = "list_min(list_filter([" + ", ".join(f"instr({_LOW}, '{c}')" for c in L.EXPLICIT_CUES) + "], lambda x: x > 0))"


@query(f"""WITH c AS (SELECT fomc_id, {_LOW} AS low, {_FIRST} AS first FROM fomc)
SELECT fomc_id, CASE WHEN first IS NOT NULL THEN least(greatest(round_even(100.0::DOUBLE * {O.words('substr(low, 1, first::INT - 1)')} / greatest({O.words('low')}, 1), 1), 1), 100) END::DOUBLE AS cue_percent FROM c""")
def cue_positions(spark, d):
    return table(spark, d, "fomc", "fomc_id", "text_content").select("fomc_id", S.cue_word_percent(F.col("text_content")).alias("cue_percent"))


# ---- pages, summaries, models (no SQL expresses them) ----------------------------------------------------------------


@query()
def page_texts(spark, d):
    """Speech pages wrapped as HTML and parsed back."""
    from plumbline.operators import pages

    df = table(spark, d, "speaker", "speech_id", "text_content")
    page = F.concat(F.lit("<html><head><title>Speech</title></head><body><nav>menu</nav><div id='article'><p>"), F.replace(F.coalesce("text_content", F.lit("")), F.lit("\n"), F.lit("</p><p>")), F.lit("</p></div></body></html>"))
    return pages.parse_pages(df.select("speech_id", page.alias("html"))).select("speech_id", "parsed.words", F.size("parsed.flags").alias("flags"))


@query()
def summaries(spark, d):
    from plumbline.operators.summary import summary

    return table(spark, d, "fomc", "fomc_id", "text_content").select("fomc_id", summary(F.col("text_content")).alias("summary"))


@query()
def direction_model(spark, d):
    """Held-out F1 of a balanced direction classifier, trained on the earlier days."""
    from plumbline.operators import models

    m = _meetings(spark, d, "text_content", "decision", "quality_score", "quality_flags", "labels_from_fred")
    m = m.withColumns({"event_date": F.col("day"), "word_count": T.word_count(F.col("text_content")), "direction": S.direction(F.col("decision"))})
    rows = corpus.usable_for_models(m).select("fomc_id", "event_date", "direction", F.col("text_content").alias("text"))
    train, test = models.chronological_split(rows, "event_date", "fomc_id")
    model = models.direction_pipeline().fit(models.with_class_weights(train, "direction"))
    scored = models.score(model, test, ["fomc_id", "direction"]).withColumn("part", F.lit("test"))
    return reports.f1_by(scored, ["part"], "direction", "guess")
