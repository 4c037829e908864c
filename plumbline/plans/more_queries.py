"""Further queries of the core library: labels, addresses, features on hand, evaluation tables, document analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import labels, urls
from plumbline.functions import lexicons as L
from plumbline.functions import scores as S
from plumbline.functions import text as T
from plumbline.functions.dates import readable_day, site_of
from plumbline.operators import reports, signals, store
from plumbline.runtime import table

from . import oracle as O
from .queries import MEETING, SPEECH, TERM_WEIGHTS, query

_HOST = "lower(coalesce(domain, ''))"


@query(f"""SELECT speech_id, ends_with({_HOST}, '-bank.example') OR ends_with({_HOST}, '-reserve.test') OR contains({_HOST}, 'board') AS official FROM speaker""")
def official_hosts(spark, d):
    return table(spark, d, "speaker", "speech_id", "domain").select("speech_id", urls.ends_with_any(F.col("domain"), ("-bank.example", "-reserve.test"), ("board",)).alias("official"))


@query(r"""SELECT fomc_id, substr(regexp_replace(regexp_extract(source_url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '[^A-Za-z0-9_.-]+', '_', 'g'), 1, 200) AS cache_key,
  nullif(regexp_extract(source_url, '(20[0-9]{6})', 1), '') AS day_in_url FROM fomc""")
def address_keys(spark, d):
    df = table(spark, d, "fomc", "fomc_id", "source_url")
    return df.select("fomc_id", urls.cache_key(F.col("source_url")).alias("cache_key"), urls.day_in(F.col("source_url")).alias("day_in_url"))


@query("""SELECT DISTINCT regexp_extract(source_url, '(20[0-9]{6})', 1) AS day FROM fomc
WHERE regexp_extract(source_url, '(20[0-9]{6})', 1) BETWEEN '20200101' AND '20251231'""")
def calendar_days(spark, d):
    day = urls.day_in(F.col("source_url")).alias("day")
    return table(spark, d, "fomc", "source_url").select(day).where(F.col("day").between("20200101", "20251231")).distinct()


@query(f"""SELECT DISTINCT strftime(d, '%Y%m%d') AS day, ['https://a.test/statement' || strftime(d, '%Y%m%d') || 'a.htm', 'https://a.test/statement' || strftime(d, '%Y%m%d') || 'b.htm'] AS tries
FROM ({MEETING}) WHERE d IS NOT NULL""")
def candidate_addresses(spark, d):
    day = F.date_format(readable_day(F.col("date")), "yyyyMMdd")
    days = table(spark, d, "fomc", "date").select(day.alias("day")).where("day is not null").distinct()
    return days.select("day", urls.candidates("https://a.test", ("/statement{day}a.htm", "/statement{day}b.htm"), F.col("day")).alias("tries"))


@query("""SELECT id, CASE WHEN regexp_full_match(published_at, '[0-9]{8}T[0-9]{6}') THEN strptime(substr(published_at, 1, 8), '%Y%m%d')
  WHEN published_at IS NOT NULL THEN strptime(substr(published_at, 1, 10), '%Y-%m-%d') END::DATE AS day FROM news""")
def published_days(spark, d):
    return table(spark, d, "news", "id", "published_at").select("id", urls.published_day(F.col("published_at")).alias("day"))


@query(f"""WITH m AS (SELECT DISTINCT site, d FROM ({MEETING}) WHERE d IS NOT NULL AND site IS NOT NULL)
SELECT site, min(d) FILTER (d > DATE '2024-06-30') AS next_day, max(d) FILTER (d <= DATE '2024-06-30') AS last_day,
  (min(d) FILTER (d > DATE '2024-06-30') - DATE '2024-06-30')::INT AS days_ahead FROM m GROUP BY site""")
def next_meetings(spark, d):
    m = table(spark, d, "fomc", "date", "source_url").select(site_of(F.col("source_url")).alias("site"), readable_day(F.col("date")).alias("day")).where("site is not null and day is not null")
    now = F.lit("2024-06-30").cast("date")
    ahead = F.min(F.when(F.col("day") > now, F.col("day")))
    return m.groupBy("site").agg(ahead.alias("next_day"), F.max(F.when(F.col("day") <= now, F.col("day"))).alias("last_day"), F.datediff(ahead, now).alias("days_ahead"))


_OFFICE = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(coalesce(participant, '')), '{p}') THEN '{n}'"
    for n, p in (("vice chair", r"\bvice chair|\bv\. chair|\bvc\b"), ("chair", r"\bchair|\bchr\."), ("governor", r"\bgov(?:ernor)?\b"), ("president", r"\bpres(?:ident)?\b"), ("member", r"\bmember\b"))
) + " ELSE 'other' END"


@query(f"SELECT speech_id, {_OFFICE} AS office, CASE {_OFFICE} WHEN 'chair' THEN 3.0 WHEN 'vice chair' THEN 2.0 WHEN 'governor' THEN 1.5 WHEN 'president' THEN 1.0 WHEN 'member' THEN 0.75 ELSE 0.25 END::DOUBLE AS weight FROM speaker")
def speaker_offices(spark, d):
    df = table(spark, d, "speaker", "speech_id", "participant").withColumn("office", labels.office(F.col("participant")))
    return df.select("speech_id", "office", labels.weight_of(F.col("office")).alias("weight"))


@query("""SELECT fomc_id, CASE WHEN quality_score >= 0.75 THEN 'High' WHEN quality_score >= 0.55 THEN 'Moderate' ELSE 'Low' END AS confidence,
  CASE WHEN quality_score >= 0.75 THEN 'strong' WHEN quality_score >= 0.5 THEN 'moderate' WHEN quality_score >= 0.3 THEN 'weak' ELSE 'none' END AS relevance FROM fomc""")
def quality_bands(spark, d):
    q = F.col("quality_score")
    return table(spark, d, "fomc", "fomc_id", "quality_score").select("fomc_id", labels.band(q, labels.CONFIDENCE, "Low").alias("confidence"), labels.band(q, labels.RELEVANCE, "none").alias("relevance"))


@query("""SELECT fomc_id, regexp_matches(text_content, '(?i)^(?:statement|placeholder) (?:of|for) ') AS placeholder_head, regexp_matches(text_content, '(?i)coming soon|text to follow') AS pending,
  regexp_matches(text_content, '(?i)not found|unavailable|parse error') AS failed, coalesce(labels_from_fred, false) AS derived_label FROM fomc""")
def placeholder_masks(spark, d):
    t = F.col("text_content")
    return table(spark, d, "fomc", "fomc_id", "text_content", "labels_from_fred").select(
        "fomc_id", t.rlike("(?i)^(?:statement|placeholder) (?:of|for) ").alias("placeholder_head"), t.rlike("(?i)coming soon|text to follow").alias("pending"),
        t.rlike("(?i)not found|unavailable|parse error").alias("failed"), F.coalesce("labels_from_fred", F.lit(False)).alias("derived_label"),
    )


_KEEP = "length(x) >= 4 AND NOT regexp_full_match(x, '[A-Z0-9 :,.!-]+') AND NOT starts_with(x, 'Watch') AND NOT starts_with(x, 'Read more') AND NOT regexp_matches(x, '\\((?:Photo|Wire|Post)\\)')"


@query(f"""SELECT speech_id, len(list_filter(list_transform(string_split(coalesce(text_content, ''), chr(10)), lambda l: trim(regexp_replace(l, '{O._WS}+', ' ', 'g'))), lambda x: {_KEEP}))::INT AS kept FROM speaker""")
def article_lines(spark, d):
    kept = F.filter(
        F.transform(F.split(F.coalesce("text_content", F.lit("")), "\n"), T.collapse),
        lambda x: (F.length(x) >= 4) & ~x.rlike(r"^[A-Z0-9 :,.!-]+$") & ~x.startswith("Watch") & ~x.startswith("Read more") & ~x.rlike(r"\((?:Photo|Wire|Post)\)"),
    )
    return table(spark, d, "speaker", "speech_id", "text_content").select("speech_id", F.size(kept).alias("kept"))


_HASH = "sha256(concat_ws(chr(10), 'news', coalesce(substr(published_at, 1, 10), ''), coalesce(source, ''), coalesce(title, '')))"


@query(f"""WITH n AS (SELECT id, fetched_at, sentiment_score, {_HASH} AS doc_hash FROM news),
k AS (SELECT doc_hash, sentiment_score AS cached FROM n WHERE id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY doc_hash ORDER BY fetched_at DESC, id DESC) = 1)
SELECT id, least(greatest(coalesce(cached, 0), 0), 1)::DOUBLE AS feature FROM n LEFT JOIN k USING (doc_hash)""")
def cached_features(spark, d):
    """Left join of externally computed features on a document hash, last one winning, absent ones 0, kept in 0..1."""
    parts = [F.lit("news"), F.coalesce(F.substring("published_at", 1, 10), F.lit("")), F.coalesce("source", F.lit("")), F.coalesce("title", F.lit(""))]
    n = table(spark, d, "news", "id", "published_at", "source", "title", "fetched_at", "sentiment_score").withColumn("doc_hash", F.sha2(F.concat_ws("\n", *parts), 256))
    cache = store.latest_by(n.where("id % 2 = 0"), ["doc_hash"], [F.desc_nulls_last("fetched_at"), F.desc("id")]).select("doc_hash", F.col("sentiment_score").alias("cached"))
    return n.join(cache, "doc_hash", "left").select("id", F.least(F.greatest(F.coalesce("cached", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("feature"))


@query("""WITH c AS (SELECT lower(term) AS term FROM (SELECT unnest(regexp_extract_all(coalesce(text_content, ''), '[A-Za-z]{4,}')) AS term FROM fomc))
SELECT term, count(*)::BIGINT AS uses FROM c GROUP BY term ORDER BY uses DESC, term LIMIT 200""")
def frequent_words(spark, d):
    words = table(spark, d, "fomc", "text_content").select(F.explode(F.regexp_extract_all(F.coalesce("text_content", F.lit("")), F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("term"))
    return words.groupBy(F.lower("term").alias("term")).agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), "term").limit(200)


def _predictions(spark, d) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "value", "ts")
    return e.select(
        "event_id", "user_id", F.col("event_type").alias("truth"), F.when(F.col("event_id") % 3 == 0, "view").otherwise(F.col("event_type")).alias("guess"),
        F.when(F.col("event_id") % 5 == 0, None).otherwise(F.col("event_id") % 100).alias("cue"), F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("event_id") * 13 % 100).alias("stable"),
    )


_PRED = """(SELECT event_id, user_id, event_type AS truth, CASE WHEN event_id % 3 = 0 THEN 'view' ELSE event_type END AS guess,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 100 END AS cue, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id * 13 % 100 END AS stable FROM events)"""


@query(f"""SELECT count(*)::BIGINT AS rows, count(*) FILTER (truth = guess)::BIGINT AS right_ones, count(*) FILTER (stable <= 50)::BIGINT AS early,
  count(*) FILTER (cue IS NOT NULL AND stable < cue)::BIGINT AS before_cue, count(cue)::BIGINT AS with_cue, median(stable)::DOUBLE AS median_stable FROM {_PRED}""")
def speed_summary(spark, d):
    p = _predictions(spark, d)
    return p.agg(
        F.count("*").alias("rows"), F.count_if(F.col("truth") == F.col("guess")).alias("right_ones"), F.count_if(F.col("stable") <= 50).alias("early"),
        F.count_if(F.col("cue").isNotNull() & (F.col("stable") < F.col("cue"))).alias("before_cue"), F.count("cue").alias("with_cue"), F.median("stable").alias("median_stable"),
    )


@query(f"SELECT truth, guess, count(*)::BIGINT AS rows FROM {_PRED} GROUP BY truth, guess")
def confusion_counts(spark, d):
    return _predictions(spark, d).groupBy("truth", "guess").agg(F.count("*").alias("rows"))


@query(f"SELECT user_id, count(*)::BIGINT AS rows, (count(*) FILTER (truth = guess)) / count(*) AS accuracy FROM {_PRED} GROUP BY user_id")
def accuracy_by_group(spark, d):
    return _predictions(spark, d).groupBy("user_id").agg(F.count("*").alias("rows"), (F.count_if(F.col("truth") == F.col("guess")) / F.count("*")).alias("accuracy"))


@query(f"""WITH r AS (SELECT speech_id, d, {O.sum_hits('text_content', ('rose', 'picked up', 'firmed', 'advanced'))} AS up, {O.sum_hits('text_content', ('fell', 'eased', 'softened', 'declined'))} AS down
  FROM ({SPEECH}) WHERE d IS NOT NULL ORDER BY d DESC, speech_id DESC LIMIT 60)
SELECT sum(up)::BIGINT AS up, sum(down)::BIGINT AS down, CASE WHEN sum(up) > sum(down) THEN 'raise' WHEN sum(up) < sum(down) THEN 'lower' ELSE 'maintain' END AS leaning FROM r""")
def recent_leaning(spark, d):
    s = table(spark, d, "speaker", "speech_id", "date", "text_content").withColumn("day", readable_day(F.col("date"))).where("day is not null")
    recent = s.orderBy(F.desc("day"), F.desc("speech_id")).limit(60)
    t = F.col("text_content")
    up, down = F.sum(T.sum_substring_hits(t, ("rose", "picked up", "firmed", "advanced"))), F.sum(T.sum_substring_hits(t, ("fell", "eased", "softened", "declined")))
    return recent.agg(up.alias("up"), down.alias("down")).select("up", "down", F.when(F.col("up") > F.col("down"), "raise").when(F.col("up") < F.col("down"), "lower").otherwise("maintain").alias("leaning"))


@query(f"""SELECT fomc_id, '| ' || coalesce(date, '-') || ' | ' || coalesce(document_type, '-') || ' | ' || CASE WHEN {O.words('text_content')} > 0 THEN 'yes' ELSE 'no' END || ' | '
  || coalesce(nullif(array_to_string(list_sort(list_distinct(coalesce(quality_flags, []))), ','), ''), '-') || ' |' AS line FROM fomc""")
def report_lines(spark, d):
    flags = F.array_join(F.array_sort(F.array_distinct(F.coalesce("quality_flags", F.array().cast("array<string>")))), ",")
    cells = [F.coalesce("date", F.lit("-")), F.coalesce("document_type", F.lit("-")), F.when(T.word_count(F.col("text_content")) > 0, "yes").otherwise("no"), F.coalesce(F.nullif(flags, F.lit("")), F.lit("-"))]
    return table(spark, d, "fomc", "fomc_id", "date", "document_type", "text_content", "quality_flags").select("fomc_id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


@query(f"""SELECT speech_id, total::INT AS total, unnest(list_distinct(list_concat(range(least(60, total), total + 1, 100), [total])))::INT AS prefix_words
FROM (SELECT speech_id, {O.words('text_content')} AS total FROM speaker) WHERE total > 0""")
def timeline_points(spark, d):
    s = table(spark, d, "speaker", "speech_id", "text_content").select("speech_id", T.word_count(F.col("text_content")).alias("total"))
    return s.select("speech_id", "total", F.explode(signals.timeline_points(F.col("total"), 60, 100, 35)).alias("prefix_words"))


_INFL = "(" + " + ".join(O.bounded("text_content", t) for t in L.MACRO_TOPICS["inflation"]) + ")"
_POL = "(" + " + ".join(O.bounded("text_content", t) for t in L.MACRO_TOPICS["policy"]) + ")"


@query(f"""SELECT fomc_id, 'Inflation mentions: ' || {_INFL} || ' (' || CASE WHEN {_INFL} >= 8 THEN 'dominant' WHEN {_INFL} >= 4 THEN 'moderate' ELSE 'low' END || ')' AS inflation_line,
  CASE WHEN {_POL} >= 8 THEN 'high' WHEN {_POL} >= 4 THEN 'moderate' ELSE 'low' END AS policy_intensity FROM fomc""")
def dashboard_lines(spark, d):
    t = F.col("text_content")
    infl, pol = T.sum_bounded_hits(t, L.MACRO_TOPICS["inflation"]), T.sum_bounded_hits(t, L.MACRO_TOPICS["policy"])
    return table(spark, d, "fomc", "fomc_id", "text_content").select(
        "fomc_id", F.concat(F.lit("Inflation mentions: "), infl.cast("string"), F.lit(" ("), labels.band(infl, labels.PRESENCE, "low"), F.lit(")")).alias("inflation_line"), labels.band(pol, labels.INTENSITY, "low").alias("policy_intensity")
    )


@query("""SELECT n_name, count(*)::BIGINT AS customers, min_by(c_name, (-c_acctbal, c_custkey)) AS richest FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def best_by_group(spark, d):
    c, n = table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal"), table(spark, d, "nation", "n_nationkey", "n_name")
    joined = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"])
    return joined.groupBy("n_name").agg(F.count("*").alias("customers"), F.min_by("c_name", F.struct(-F.col("c_acctbal"), "c_custkey")).alias("richest"))


@query()
def document_analysis(spark, d):
    """One struct a document, as JSON: counts, hits, tone and leaning, from expressions only."""
    t = F.col("text_content")
    hawk, dove = T.sum_bounded_hits(t, L.HAWKISH), T.sum_bounded_hits(t, L.DOVISH)
    lean = F.when(hawk - dove >= 2, "Hawkish").when(dove - hawk >= 2, "Dovish").otherwise("Neutral")
    body = F.struct(T.word_count(t).alias("words"), T.sentence_count(t).alias("sentences"), T.hit_map(t, L.KEYWORDS).alias("keywords"), T.hit_map(t, L.HAWKISH, True).alias("hawkish"), T.hit_map(t, L.DOVISH, True).alias("dovish"), lean.alias("leaning"), S.policy_score(t).alias("policy_score"))
    return table(spark, d, "fomc", "fomc_id", "text_content").select("fomc_id", F.to_json(body).alias("analysis"))


@query(f"""{TERM_WEIGHTS}, u AS (SELECT fomc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY fomc_id)), 6) AS weight FROM w)
SELECT fomc_id, row_number() OVER (PARTITION BY fomc_id ORDER BY weight DESC, term)::INT AS rank, term, weight FROM u QUALIFY rank <= 12""")
def strongest_terms(spark, d):
    """Per document the twelve terms of greatest weight, to six decimals."""
    w = signals.word_weights(table(spark, d, "fomc", "fomc_id", "text_content"), "fomc_id", "text_content").withColumn("weight", F.round("weight", 6))
    rank = F.row_number().over(Window.partitionBy("fomc_id").orderBy(F.desc("weight"), "term"))
    return w.withColumn("rank", rank).where("rank <= 12").select("fomc_id", "rank", "term", "weight")


@query("""WITH b AS (SELECT 'fomc' AS corpus, fomc_id AS id, text_content FROM fomc UNION ALL SELECT 'speaker', speech_id, text_content FROM speaker)
SELECT corpus, id, substr(text_content, 1, 8000) AS text FROM b ORDER BY sha256(concat_ws('|', '7', corpus, id::VARCHAR)) LIMIT 1""")
def random_record(spark, d):
    """One record of both corpora, repeatably: the least seeded hash; its text is cut to 8,000 characters for display."""
    a = table(spark, d, "fomc", F.lit("fomc").alias("corpus"), F.col("fomc_id").alias("id"), "text_content")
    b = table(spark, d, "speaker", F.lit("speaker").alias("corpus"), F.col("speech_id").alias("id"), "text_content")
    picked = a.unionByName(b).orderBy(F.sha2(F.concat_ws("|", F.lit("7"), "corpus", F.col("id").cast("string")), 256)).limit(1)
    return picked.select("corpus", "id", F.substring("text_content", 1, 8000).alias("text"))


@query("SELECT coalesce(message, 'None') AS value, count(*)::BIGINT AS count, count(*) / (SELECT count(*) FROM fetch_errors) AS share FROM fetch_errors GROUP BY 1 ORDER BY count DESC, value LIMIT 10")
def error_statistics(spark, d):
    return reports.distribution(table(spark, d, "fetch_errors", "message"), F.col("message")).orderBy(F.desc("count"), "value").limit(10)
