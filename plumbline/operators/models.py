"""Models over document features: words and pairs of words, weights, a balanced multinomial classifier, topics; saved, scored, explained."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, PCA, CountVectorizer, NGram, Normalizer, RegexTokenizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import lexicons as L

from . import frames, signals
from .reports import balanced_weights
from .signals import expand_prefixes
from .temporal import fits_broadcast

#: Terms of each kind that a model may hold; the most frequent are kept.
VOCABULARY = 25_000
VERSION = 3


def direction_pipeline(
    text: str = "text", label: str = "direction", vocabulary: int = VOCABULARY, regularisation: float = 0.01, extra: tuple[str, ...] = (), min_df: float = 2.0, max_df: float = 0.95
) -> Pipeline:
    """Words and pairs of words in 2 to 95 percent of the documents, inverse document frequency, unit length, numeric columns, logistic regression."""
    stages = [
        StringIndexer(inputCol=label, outputCol="label", handleInvalid="keep", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol=text, outputCol="words", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False),
        NGram(n=2, inputCol="words", outputCol="pairs"),
    ]
    for kind in ("words", "pairs"):
        stages.append(CountVectorizer(inputCol=kind, outputCol=f"{kind}_counts", vocabSize=vocabulary, minDF=min_df, maxDF=max_df))
        stages.append(IDF(inputCol=f"{kind}_counts", outputCol=f"{kind}_weighted"))
    stages.append(VectorAssembler(inputCols=["words_weighted", "pairs_weighted"], outputCol="weighted"))
    stages.append(Normalizer(inputCol="weighted", outputCol="unit"))
    if extra:
        stages.append(VectorAssembler(inputCols=list(extra), outputCol="numbers", handleInvalid="keep"))
        stages.append(StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True))
    stages.append(VectorAssembler(inputCols=["unit", *(["scaled"] if extra else [])], outputCol="features"))
    stages.append(LogisticRegression(maxIter=40, regParam=regularisation, weightCol="weight"))
    return Pipeline(stages=stages)


def with_class_weights(df: DataFrame, label: str) -> DataFrame:
    """Rows with the balanced weight of their label; the table of labels is broadcast when its counted rows fit."""
    weights = balanced_weights(df, label).select(label, "weight")
    return df.join(F.broadcast(weights) if fits_broadcast(weights) else weights, label)


def chronological_parts(df: DataFrame, day: str, shares: tuple[float, float] = (0.7, 0.8)) -> DataFrame:
    """Dated rows with ``part``: train, tune and test, cut at the days at which the ``shares`` of all rows have passed; whole days."""
    cuts = df.select(F.percentile_approx(F.unix_date(day), list(shares), 10000).alias("d")).first()["d"]
    number = F.unix_date(day)
    part = F.when(number < F.lit(cuts[0]), "train").when(number < F.lit(cuts[1]), "tune").otherwise("test") if cuts else F.lit("train")
    return df.where(F.col(day).isNotNull()).withColumn("part", part)


def chronological_split(df: DataFrame, day: str, key: str, train: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Rows before and from the day at which ``train`` of all rows have passed."""
    parts = chronological_parts(df, day, (train, train))
    return parts.where("part = 'train'").drop("part"), parts.where("part <> 'train'").drop("part")


def score(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, prediction as a label, one probability a label)."""
    labels = model.stages[0].labels
    probability = vector_to_array("probability")
    names = F.array(*[F.lit(x) for x in [*labels, "unknown"]])
    out = model.transform(df.withColumn("weight", F.lit(1.0)))
    return out.select(*keep, F.get(names, F.col("prediction").cast("int")).alias("guess"), *[probability[i].alias(f"p_{x}") for i, x in enumerate(labels)])


def score_prefixes(model: PipelineModel, df: DataFrame, key: str, text: str, percents: list[int]) -> DataFrame:
    """Predictions for every prefix of every document in one batch."""
    return score(model, expand_prefixes(df, text, percents), [key, "percent"])


def score_timeline(
    relevance: PipelineModel, direction: PipelineModel, df: DataFrame, key: str, text: str, points: Column, **gates: float
) -> DataFrame:
    """(key, prefix_words, prefix_percent, relevance and direction probabilities, action, state, confidence, margin) along growing texts.

    ``relevance`` has the labels no and yes, ``direction`` the directions; directions the model has not seen have probability 0.
    """
    rows = frames.timeline(df, text, points, [key])
    first = score(relevance, rows, [key, "prefix_words", "fraction", text]).withColumnRenamed("guess", "relevant")
    both = score(direction, first, [key, "prefix_words", "fraction", "p_yes"])
    odds = [F.coalesce(F.col(f"p_{d}"), F.lit(0.0)) if f"p_{d}" in both.columns else F.lit(0.0) for d in L.DIRECTIONS]
    found = both.withColumn("_x", signals.action(F.col("p_yes"), *odds, **gates))
    return found.select(
        key, "prefix_words", F.round(100 * F.col("fraction"), 1).alias("prefix_percent"), F.col("p_yes").alias("p_relevant"), (1 - F.col("p_yes")).alias("p_no_signal"),
        *[o.alias(f"p_{d}") for d, o in zip(L.DIRECTIONS, odds)], F.col("_x.action").alias("prediction"), "_x.state", "_x.confidence", "_x.margin",
    )


def contributions(model: PipelineModel, df: DataFrame, key: str, text: str, count: int = 12) -> DataFrame:
    """(key, rank, term, contribution): the ``count`` terms that speak most for or against each document's predicted label.

    A contribution is the label's coefficient times the term's weight in the document; terms with none are left out. The
    model's vocabulary is bounded, so its coefficients are a small table, met by the documents' terms by equality.
    """
    vectors = [s for s in model.stages if hasattr(s, "vocabulary")]
    idf = [s.idf.toArray() for s in model.stages if type(s).__name__ == "IDFModel"]
    coefficients = model.stages[-1].coefficientMatrix.toArray()
    labels = [*model.stages[0].labels, "unknown"]
    if len(coefficients) == 1:  # two labels share one row, for the second
        coefficients = [-coefficients[0], coefficients[0]]
    rows, at = [], 0
    for vector, weight in zip(vectors, idf):
        for term, w in zip(vector.vocabulary, weight):
            rows.append((term, float(w), [float(c[at]) for c in coefficients]))
            at += 1
    spark = df.sparkSession
    known = spark.createDataFrame(rows, "term string, idf double, coefficients array<double>")
    counted = df.select(key, F.explode(signals.terms_of(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    met = counted.join(F.broadcast(known) if fits_broadcast(known, 256) else known, "term").withColumn("_raw", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy(key)))
    guessed = score(model, df, [key]).select(key, (F.array_position(F.array(*map(F.lit, labels)), F.col("guess")) - 1).cast("int").alias("_label"))
    weighed = met.withColumn("_unit", F.col("_raw") / length).join(guessed, key)
    contribution = F.coalesce(F.get("coefficients", F.col("_label")), F.lit(0.0)) * F.col("_unit")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.abs("contribution")), "term"))
    found = weighed.withColumn("contribution", contribution).where("contribution <> 0").withColumn("rank", rank)
    return found.where(F.col("rank") <= count).select(key, "rank", "term", "contribution")


def save(model: PipelineModel, path: str, **about: object) -> None:
    """A fitted model with its feature version and whatever else is told about it."""
    model.write().overwrite().save(path)
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps({"version": VERSION, **about}, sort_keys=True),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(path: str) -> tuple[PipelineModel, dict]:
    """A saved model and what was told about it."""
    about = SparkSession.getActiveSession().read.text(f"{path}/about").first()["value"]
    return PipelineModel.load(path), json.loads(about)


def topics(df: DataFrame, vectors: str, count: int, seed: int = 42) -> DataFrame:
    """``df`` with the cluster of each vector."""
    return KMeans(k=count, seed=seed, featuresCol=vectors, predictionCol="topic").fit(df).transform(df)


def compressed(df: DataFrame, vectors: str, count: int) -> DataFrame:
    """``df`` with ``compressed``: the vectors on their ``count`` principal components (vectors of at most some thousands of columns)."""
    return PCA(k=count, inputCol=vectors, outputCol="compressed").fit(df).transform(df)


def leaderboard(runs: DataFrame, metric: str, count: int = 14) -> DataFrame:
    """The ``count`` best runs by a metric, nulls last; the rest of a run's columns break ties."""
    others = [F.asc(c) for c in runs.columns if c != metric]
    return runs.orderBy(F.desc_nulls_last(metric), *others).limit(count)


def diagnostics(spark: SparkSession, summary: str, board: str, count: int = 8) -> dict:
    """A run's JSON summary and the first ``count`` rows of its leaderboard file."""
    told = spark.read.option("multiLine", True).json(summary).toJSON().first()
    rows = spark.read.option("header", True).csv(board).limit(count).toJSON().collect()
    return {"summary": json.loads(told) if told else {}, "leaderboard": [json.loads(r) for r in rows]}
