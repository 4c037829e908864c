"""Reports: distributions, corpus statistics, crosstabs, classification quality, feed fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution(df: DataFrame, value: Column) -> DataFrame:
    """(value, count, share): counts of all values, null as 'None', with their share of all rows."""
    counts = df.groupBy(F.coalesce(value.cast("string"), F.lit("None")).alias("value")).agg(F.count("*").alias("count"))
    return counts.withColumn("share", F.col("count") / F.lit(df.count()))


def crosstab(df: DataFrame, row: str, column: str, rows: list[str], columns: list[str]) -> DataFrame:
    """Counts of every listed row and column value, 0 where a pair does not occur."""
    spark = df.sparkSession
    counts = df.where(F.col(row).isin(*rows)).groupBy(F.col(row).alias("row")).pivot(column, columns).count()
    return F.broadcast(spark.createDataFrame([(r,) for r in rows], "row string")).join(counts, "row", "left").na.fill(0)


def f1_by(df: DataFrame, keys: list[str], truth: str, guess: str) -> DataFrame:
    """(keys, f1, labels): mean F1 over the labels present in the truth, 0 for a label never hit."""
    labels = F.explode(F.array_distinct(F.array(F.col(truth), F.col(guess)))).alias("label")
    rows = df.select(*keys, truth, guess, labels).groupBy(*keys, "label").agg(
        F.count_if((F.col(truth) == F.col("label")) & (F.col(guess) == F.col("label"))).alias("tp"),
        F.count_if(F.col(guess) == F.col("label")).alias("guessed"),
        F.count_if(F.col(truth) == F.col("label")).alias("held"),
    )
    present = rows.where("held > 0").withColumn("f1", 2.0 * F.col("tp") / (F.col("guessed") + F.col("held")))
    return present.groupBy(*keys).agg(F.avg("f1").alias("f1"), F.count("*").alias("labels"))


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, count, weight): rows / (labels * rows of the label)."""
    counts = df.groupBy(label).agg(F.count("*").alias("count"))
    all_of = counts.agg(F.sum("count").alias("rows"), F.count("*").alias("labels")).first()
    return counts.withColumn("weight", F.lit(all_of["rows"]) / (F.lit(all_of["labels"]) * F.col("count")))


def fingerprint(df: DataFrame, key: str, value: Column) -> DataFrame:
    """(key, items, hash): a digest of the distinct items of each key; a changed hash is a changed feed.

    Items are put into 256 buckets by the first two digits of their SHA-256; the digest of a bucket is that of its sorted
    items, the digest of a key that of its buckets in order, so no feed is gathered in one place.
    """
    items = df.select(F.col(key), value.cast("string").alias("item")).where(F.col("item").isNotNull()).distinct()
    bucket = F.substring(F.sha2("item", 256), 1, 2).alias("bucket")
    digests = items.groupBy(key, bucket).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), "\n"), 256).alias("digest"))
    whole = F.array_join(F.sort_array(F.collect_list(F.concat("bucket", "digest"))), "\n")
    return digests.groupBy(key).agg(F.sum("n").alias("items"), F.sha2(whole, 256).alias("hash"))


ACTIONS = ("no_rate_signal", "lower", "maintain", "raise")


def evaluation(df: DataFrame, truth: str, guess: str, labels: tuple[str, ...] = ACTIONS) -> DataFrame:
    """One row: accuracy, mean F1 over the listed labels present in the truth and over all of them, the labels present, the uncertain share.

    A label neither held nor guessed has an F1 of 0; without any row the figures are null; where no listed label is in the
    truth all of them count as present.
    """
    counts = []
    for label in labels:
        held, said = F.coalesce(F.col(truth) == label, F.lit(False)), F.coalesce(F.col(guess) == label, F.lit(False))
        counts += [F.count_if(held & said).alias(f"_tp_{label}"), F.count_if(held).alias(f"_held_{label}"), F.count_if(said).alias(f"_said_{label}")]
    sums = df.agg(
        F.count("*").alias("rows"), F.avg(F.coalesce((F.col(truth) == F.col(guess)).cast("double"), F.lit(0.0))).alias("accuracy"),
        F.avg(F.coalesce((F.col(guess) == "uncertain_rate_signal").cast("double"), F.lit(0.0))).alias("uncertain_share"), *counts,
    )
    f1 = {n: F.coalesce(F.try_divide(2.0 * F.col(f"_tp_{n}"), F.col(f"_held_{n}") + F.col(f"_said_{n}")), F.lit(0.0)) for n in labels}
    listed = F.array(*[F.struct(F.lit(n).alias("label"), (F.col(f"_held_{n}") > 0).alias("present"), f1[n].alias("f1")) for n in labels])
    some = F.filter(listed, lambda x: x["present"])
    shown = F.when(F.size(some) > 0, some).otherwise(listed)
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x["f1"]) / F.size(xs)
    none = F.col("rows") == 0
    return sums.select(
        "rows", "accuracy", F.when(~none, mean(shown)).alias("f1_present"), F.when(~none, mean(listed)).alias("f1_all"),
        F.array_join(F.transform(shown, lambda x: x["label"]), ",").alias("labels"), "uncertain_share",
    )


def speed(timelines: DataFrame, documents: DataFrame, key: str, order: str, value: str, steps: int = 2) -> DataFrame:
    """(documents' columns, first_stable_correct, early, before_cue, final, final_correct): how soon each document's timeline is right to stay.

    ``timelines`` holds (key, order, value) rows, ``documents`` key, ``truth`` and ``cue``; the first of ``steps`` right
    predictions in a row counts. A document without a timeline has null results and is not right.
    """
    window = Window.partitionBy(key).orderBy(order)
    joined = timelines.join(documents.select(key, "truth"), key)
    right = F.coalesce(F.col(value) == F.col("truth"), F.lit(False))
    run = right
    for k in range(1, steps):
        run = run & F.coalesce(F.lead(value, k).over(window) == F.col("truth"), F.lit(False))
    marked = joined.withColumn("_run", run)
    found = marked.groupBy(key).agg(F.min(F.when(F.col("_run"), F.col(order))).alias("first_stable_correct"), F.max_by(value, order).alias("final"))
    out = documents.join(found, key, "left")
    first = F.col("first_stable_correct")
    return out.withColumns(
        {
            "early": F.coalesce(first <= 50, F.lit(False)), "before_cue": F.coalesce(first < F.col("cue"), F.lit(False)),
            "final_correct": F.coalesce(F.col("final") == F.col("truth"), F.lit(False)),
        }
    )
