"""The corpus store: year-partitioned Parquet, keyed upserts, logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.runtime import cut

_COMMON = [
    ("text_content", T.StringType()), ("decision", T.StringType()), ("high", T.StringType()), ("low", T.StringType()),
]
_TAIL = [
    ("source_url", T.StringType()), ("ingested_at", T.TimestampType()), ("content_hash", T.StringType()), ("quality_score", T.DoubleType()),
    ("quality_flags", T.ArrayType(T.StringType())), ("parser_version", T.StringType()),
]
MEETING_SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in [("date", T.StringType()), ("year", T.IntegerType()), ("document_type", T.StringType()), ("speaker", T.StringType()), *_COMMON, *_TAIL, ("labels_from_fred", T.BooleanType())]]
)
SPEECH_SCHEMA = T.StructType(
    [
        T.StructField(n, t)
        for n, t in [
            ("date", T.StringType()), ("year", T.IntegerType()), ("document_type", T.StringType()), ("participant", T.StringType()), ("domain", T.StringType()),
            *_COMMON, ("fomc_ref_date", T.StringType()), ("alignment_rule", T.StringType()), *_TAIL,
        ]
    ]
)
MEETING_KEY = ["date", "document_type", "content_hash"]
SPEECH_KEY = ["date", "participant", "domain", "content_hash"]


def _path(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def read_corpus(spark: SparkSession, path: str, schema: T.StructType, years: tuple[int, int] | None = None) -> DataFrame:
    """The stored corpus with its declared schema; a year range prunes partitions; an absent store is empty; null flags are empty lists."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).parquet(path)
    if years:
        df = df.where(F.col("year").between(*years))
    return df.withColumn("quality_flags", F.coalesce("quality_flags", F.array().cast("array<string>"))).select(schema.fieldNames())


def load_corpus(spark: SparkSession, path: str, schema: T.StructType, columns: list[str], years: tuple[int, int] | None = None) -> DataFrame:
    """The stored corpus with the ``columns`` it must have; an absent or empty store, or a missing column, is an error that names it."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no corpus at {path}")
    missing = [c for c in columns if c not in schema.fieldNames()]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    df = read_corpus(spark, path, schema, years)
    if df.isEmpty():
        raise ValueError(f"the corpus at {path} is empty")
    return df


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Existing and new rows with one row a key: new rows win over existing ones, ``order`` decides within each."""
    both = existing.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    return latest_by(both, keys, [F.desc("_gen"), *(order or [])]).drop("_gen")


def insert_ignore(existing: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """New rows whose key is not stored yet, the first of each key; rows without a key are left out."""
    fresh = new.where(F.col(key).isNotNull() & (F.trim(F.col(key)) != ""))
    return latest_by(fresh.join(existing.select(key), key, "left_anti"), [key], order)


#: Rows a file of the store holds, about.
FILE_ROWS = 500_000


def merge_and_write(spark: SparkSession, path: str, new: DataFrame, schema: T.StructType, keys: list[str], file_rows: int = FILE_ROWS) -> int:
    """Upsert ``new`` into the store at ``path``; returns how many rows were given.

    Only the years that ``new`` touches are read and rewritten; a null year is year 0. They are written beside the
    store, each year over as many tasks and files as its counted rows need, and each year's folder is then swapped
    in by two renames, so that no reader meets a half-written file; between the two the year is absent. A lost
    executor only repeats tasks.
    """
    new = new.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).withColumn("year", F.coalesce("year", F.lit(0)))
    given = {r["year"]: r["count"] for r in new.groupBy("year").count().collect()}
    years = list(given)
    if not years:
        return 0
    stored = read_corpus(spark, path, schema).where(F.col("year").isin(years))
    held = {r["year"]: r["count"] for r in stored.groupBy("year").count().collect()}
    files = {y: -(-(given[y] + held.get(y, 0)) // file_rows) for y in years}
    merged = upsert(stored, new, keys, [F.desc("ingested_at")])
    staging = f"{path.rstrip('/')}__staging_{uuid.uuid4().hex}"
    known = F.create_map(*[x for y, n in files.items() for x in (F.lit(y), F.lit(n))])
    spread = merged.withColumn("_part", F.pmod(F.xxhash64(*keys), known[F.col("year")]))
    spread.repartition(sum(files.values()), "year", "_part").drop("_part").write.partitionBy("year").parquet(staging)
    fs, base = _path(spark, path)
    fs.mkdirs(base)
    for year in years:
        _, fresh = _path(spark, f"{staging}/year={year}")
        _, place = _path(spark, f"{path}/year={year}")
        _, old = _path(spark, f"{staging}/old_year={year}")
        if fs.exists(place):
            fs.rename(place, old)
        fs.rename(fresh, place)
    fs.delete(_path(spark, staging)[1], True)
    return sum(given.values())


def record_audit(spark: SparkSession, path: str, rows: DataFrame, run_id: str) -> DataFrame:
    """Append (content_hash, date, document_type, source_url, word_count, quality_score, run_id, ingested_at) rows; returns the current state.

    The state has one row a hash, date and type: the latest recorded. Empty documents share a hash, so the hash alone is no key.
    """
    kept = rows.select("content_hash", "date", "document_type", "source_url", "word_count", "quality_score", F.lit(run_id).alias("run_id"), "ingested_at")
    append_log(kept, path)
    return latest_by(spark.read.parquet(path), ["content_hash", "date", "document_type"], [F.desc("ingested_at"), F.desc("run_id")])


def insert_new(spark: SparkSession, path: str, new: DataFrame, key: str, order: list[Column]) -> int:
    """``insert_ignore`` into the Parquet table at ``path``; returns how many rows were really added."""
    stored = spark.read.parquet(path) if exists(spark, path) else new.limit(0)
    fresh = cut(insert_ignore(stored, new, key, order))
    fresh.write.mode("append").parquet(path)
    return fresh.count()


def write_errors(failures: DataFrame, path: str) -> None:
    """Append (run_id, url, http_status, message, occurred_at) as CSV with a header a file; line feeds and quotes of messages become blanks and apostrophes."""
    clean = F.replace(F.regexp_replace("message", r"[\r\n]+", " "), F.lit('"'), F.lit("'"))
    failures.select("run_id", "url", "http_status", clean.alias("message"), "occurred_at").write.mode("append").option("header", True).csv(path)


def restore(spark: SparkSession, source: str, path: str) -> None:
    """Put the snapshot at ``source`` in place of the store at ``path``; the store stays until the copy is whole."""
    snapshot(spark, source, path)


def append_log(df: DataFrame, path: str) -> None:
    """Append event rows; the current state is ``latest_by`` their id."""
    df.write.mode("append").parquet(path)


def snapshot(spark: SparkSession, path: str, target: str) -> None:
    """Copy a store to ``target`` and point to it only once it is whole."""
    staging = f"{target}__staging_{uuid.uuid4().hex}"
    spark.read.parquet(path).write.partitionBy("year").parquet(staging)
    fs, place = _path(spark, target)
    if fs.exists(place):
        fs.delete(place, True)
    fs.rename(_path(spark, staging)[1], place)
