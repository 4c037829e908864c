"""Queries of the training-data operators and the SQL that checks those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from plumbline.functions.dates import day_number, readable_day, site_of
from plumbline.runtime import table

from . import lines, mixing, names, nearest, quality, residue, spam, template, tokens, turns


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_prose(table(spark, sf_dir, "fomc", "fomc_id", "text_content"))


def p1_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_statistics(table(spark, sf_dir, "fomc", "fomc_id", "text_content", "quality_score"), score_col="quality_score")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_records(table(spark, sf_dir, "fomc", "fomc_id", "text_content"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    speeches = table(spark, sf_dir, "speaker", "speech_id", "date", "domain", "source_url", "fomc_ref_date")
    left = speeches.where(readable_day(F.col("fomc_ref_date")).isNull()).select(
        "speech_id", site_of(F.col("source_url"), F.col("domain")).alias("site"), day_number(F.col("date")).alias("at")
    )
    right = table(spark, sf_dir, "fomc", "date", "source_url").select(
        site_of(F.col("source_url")).alias("site"), day_number(F.col("date")).alias("held")
    )
    found = nearest.nearest_in_time(left, right, "speech_id", "site", "at", "site", "held", 10)
    return found.select("speech_id", F.date_format(F.date_from_unix_date("day"), "yyyyMMdd").alias("fomc_date")).distinct()


_DUCK_DAY = """CASE
  WHEN regexp_full_match(trim({c}), '[0-9]{{8}}([.]0)?') THEN try_strptime(substr(trim({c}), 1, 8), '%Y%m%d')
  WHEN regexp_full_match(trim({c}), '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN try_strptime(trim({c}), '%Y-%m-%d')
  WHEN regexp_full_match(trim({c}), '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') THEN try_strptime(trim({c}), '%m/%d/%Y')
  WHEN regexp_full_match(trim({c}), '[A-Za-z]+ [0-9]{{1,2}}, [0-9]{{4}}')
    THEN coalesce(try_strptime(trim({c}), '%B %d, %Y'), try_strptime(trim({c}), '%b %d, %Y')) END::DATE"""
_DUCK_SITE = "nullif(regexp_replace(lower(trim({c})), '^(www|m|amp)[.]', ''), '')"
_DUCK_HOST = "nullif(regexp_extract(source_url, '^[A-Za-z]+://([^/:?#]+)', 1), '')"

P2_ORACLE = f"""
WITH s AS (
  SELECT speech_id, {_DUCK_SITE.format(c=f"coalesce(domain, {_DUCK_HOST})")} AS site, {_DUCK_DAY.format(c="date")} AS d
  FROM speaker WHERE ({_DUCK_DAY.format(c="fomc_ref_date")}) IS NULL),
f AS (SELECT DISTINCT {_DUCK_SITE.format(c=_DUCK_HOST)} AS site, {_DUCK_DAY.format(c="date")} AS m FROM fomc),
r AS (
  SELECT speech_id, m, row_number() OVER (PARTITION BY speech_id ORDER BY abs(m - d), m) AS k
  FROM s JOIN f ON s.site = f.site AND abs(m - d) <= 10)
SELECT speech_id, strftime(m, '%Y%m%d') AS fomc_date FROM r WHERE k = 1"""


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.name_pairs(table(spark, sf_dir, "speaker", "participant"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.speaker_turns(table(spark, sf_dir, "fomc", "fomc_id", "text_content", "speaker")).select("fomc_id", "turn_no", "who")


def p6_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.speaker_turns(table(spark, sf_dir, "fomc", "fomc_id", "text_content", "speaker"), pauses=True)


def _site():
    return site_of(F.col("source_url"), F.col("domain"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "speaker", "speech_id", "domain", "source_url", "text_content")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.furniture_lines(_pages(spark, sf_dir), _site())


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_lines(_pages(spark, sf_dir), _site())


def p7_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.frequent_sequences(_pages(spark, sf_dir), _site(), gaps=True)
    return found.select("site", "length", F.transform("lines", lambda x: F.hex(x)).alias("line_ids"), "support")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents", "doc_id", "text"))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mixture(table(spark, sf_dir, "documents", "doc_id", "source", "text"), table(spark, sf_dir, "mix_targets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_documents(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


P7_ORACLE = f"""
WITH d AS (
  SELECT speech_id, {_DUCK_SITE.format(c=f"coalesce(domain, {_DUCK_HOST})")} AS site, text_content AS t
  FROM speaker WHERE regexp_matches(text_content, '[^[:space:]]')),
l AS (
  SELECT speech_id, site, unnest(string_split(t, chr(10))) AS x, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS line_no FROM d),
k AS (
  SELECT speech_id, site, line_no,
    regexp_replace(lower(trim(regexp_replace(x, '[[:space:]]+', ' ', 'g'))), '[0-9]+', '#', 'g') AS y FROM l),
f AS (
  SELECT site, y FROM k JOIN (SELECT site, count(*) AS n FROM d GROUP BY site) USING (site) WHERE y <> '' GROUP BY site, y, n
  HAVING count(DISTINCT speech_id) >= 10 AND count(DISTINCT speech_id) >= 0.04 * n)
SELECT speech_id, line_no::INT AS line_no FROM k SEMI JOIN f USING (site, y)"""


QUERIES: dict = {f.__name__: f for f in (p1_found, p1_statistics, p2_found, p3_found, p4_found, p5_found, p6_found, p6_turns, p7_found, p7_sequences, p8_ids, p9_mix, p9_shares, p10_found)}
ORACLES: dict = {"p2_found": P2_ORACLE, "p7_found": P7_ORACLE}
