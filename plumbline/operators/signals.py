"""Text signals: scores, features, prefixes, thinning, stable runs, actions, word weights."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import lexicons as L
from plumbline.functions import scores as S
from plumbline.functions import text as T
from plumbline.runtime import ship

#: Characters of the documents that ``word_weights`` counts and weighs together.
BLOCK_CHARACTERS = 4_000_000


def expand_prefixes(df: DataFrame, text: str, percents: list[int]) -> DataFrame:
    """One row a document and percent, with the text's prefix in place of the text; the text is split once for all percents."""
    split = df.withColumn(text, T.words(F.col(text)))
    spread = split.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
    return spread.withColumn(text, F.array_join(F.slice(text, F.lit(1), T.prefix_size(F.size(text), F.col("percent"))), " "))


def timeline_points(total: Column, first: int, step: int, most: int) -> Column:
    """Word counts at which a growing text is scored: from ``first`` by ``step``, the last always, at most about ``most``.

    More points than ``most`` are thinned to evenly spaced ones, halves rounded to even.
    """
    start = F.least(F.lit(first), total)
    points = F.sequence(start, total, F.lit(step))
    points = F.array_distinct(F.concat(points, F.array(total)))
    gap = (F.size(points) - 1) / F.lit(most - 1)
    even = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * gap).cast("int")))
    thin = F.array_distinct(F.concat(F.transform(even, lambda i: F.get(points, i)), F.array(total)))
    return F.when(total <= 0, F.array().cast("array<int>")).when(F.size(points) > most, thin).otherwise(points)


def first_stable(df: DataFrame, keys: list[str], order: str, value: str, steps: int, wanted: Column | None = None, barred: str | None = None) -> DataFrame:
    """(keys, order, value) of the first of ``steps`` equal values in a row; of ``wanted`` only, or of any but ``barred``."""
    window = Window.partitionBy(*keys).orderBy(order)
    same = F.col(value).isNotNull()
    for k in range(1, steps):
        same = same & F.coalesce(F.lead(value, k).over(window) == F.col(value), F.lit(False))
    if wanted is not None:
        same = same & (F.col(value) == wanted)
    if barred is not None:
        same = same & (F.col(value) != barred)
    hit = df.withColumn("_same", same).where("_same")
    return hit.groupBy(*keys).agg(F.min(order).alias(order), F.min_by(value, order).alias(value))


def action(
    relevance: Column, lower: Column, maintain: Column, raised: Column, relevant_from: float = 0.5, none_until: float = 0.35, sure_from: float = 0.45, margin_from: float = 0.05,
    lower_from: float = 1.01, lower_gap: float = 0.0,
) -> Column:
    """Struct (action, state, confidence, margin) from a relevance probability and three direction probabilities.

    Two gates on relevance, then ``lower`` where it reaches ``lower_from`` and is within ``lower_gap`` of ``maintain``,
    then the best direction (the first listed of equal ones) if it is sure and clear, else uncertain.
    """
    listed = [F.struct(p.alias("p"), F.lit(-i).alias("order"), F.lit(n).alias("n")) for i, (n, p) in enumerate(zip(L.DIRECTIONS, (lower, maintain, raised)))]
    ranked = F.sort_array(F.array(*listed), asc=False)
    best, margin = ranked[0], ranked[0]["p"] - ranked[1]["p"]

    def out(name, state: str, confidence: Column) -> Column:
        return F.struct((name if isinstance(name, Column) else F.lit(name)).alias("action"), F.lit(state).alias("state"), confidence.alias("confidence"), margin.alias("margin"))

    return (
        F.when(relevance <= none_until, out("no_rate_signal", "no_rate_signal", 1 - relevance))
        .when(relevance < relevant_from, out("uncertain_rate_signal", "uncertain", relevance))
        .when((lower >= lower_from) & (maintain - lower <= lower_gap), out("lower", "rate_relevant_lower_override", lower))
        .when((best["p"] < sure_from) | (margin < margin_from), out("uncertain_rate_signal", "rate_relevant_uncertain_direction", best["p"]))
        .otherwise(out(best["n"], "rate_relevant_directional", best["p"]))
    )


def excerpts(df: DataFrame, key: str, text: str, terms: tuple[str, ...], count: int = 3) -> DataFrame:
    """Per document the ``count`` distinct sentences with most of the terms, the earlier of equal ones."""
    sentences = df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+")).alias("at", "sentence"))
    matched = T.total((T.bounded_hits(F.col("sentence"), t) > 0).cast("int") for t in terms)
    found = sentences.withColumn("matched", matched).where("matched > 0").groupBy(key, "sentence", "matched").agg(F.min("at").alias("at"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("matched"), "at"))
    return found.withColumn("rank", rank).where(F.col("rank") <= count).select(key, "rank", "matched", "sentence")


def words_of(text: Column) -> Column:
    """Words of two letters, digits or underscores and more, in lower case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def terms_of(text: Column) -> Column:
    """The words of a text and each pair of words that follow each other."""
    pairs = lambda own: F.transform(F.slice(own, 2, F.size(own)), lambda w, i: F.concat_ws(" ", F.get(own, i), w))
    # bound once, so that the pattern runs once a text and not once a word
    return F.transform(F.array(words_of(text)), lambda own: F.when(F.size(own) > 1, F.concat(own, pairs(own))).otherwise(own))[0]


def _counted(table: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, terms, key index, term index, times) of a (_block, key, _words) table: its words and pairs of words that follow each other.

    Rows of one key are one document; pairs do not cross rows. Words are numbers here, and a pair is a number made of two.
    """
    keys = table.column(1).combine_chunks().dictionary_encode(null_encoding="encode")
    lists = table.column(2).combine_chunks()
    words = lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    word, many = words.indices.to_numpy().astype(np.int64), max(len(words.dictionary), 1)
    paired = np.flatnonzero(row[1:] == row[:-1])
    code = np.concatenate([word, (word[paired] + 1) * many + word[paired + 1]])
    code, term = np.unique(code, return_inverse=True)
    held, times = np.unique(keys.indices.to_numpy()[np.concatenate([row, row[paired]])] * np.int64(max(len(code), 1)) + term, return_counts=True)
    text, second = words.dictionary.cast(pa.string()), code[code >= many]
    pairs = pc.binary_join_element_wise(text.take(pa.array(second // many - 1)), text.take(pa.array(second % many)), " ")
    terms = pa.concat_arrays([text.take(pa.array(code[code < many])), pairs])
    return keys.dictionary, terms, *np.divmod(held, max(len(code), 1)), times


def word_weights(df: DataFrame, key: str, text: str, min_documents: int = 2, max_share: float = 0.95) -> DataFrame:
    """(key, term, tf, df, weight): smoothed tf-idf with log term frequency, unit length per document, over words and pairs of words.

    Terms in fewer than ``min_documents`` or in more than ``max_share`` of the documents are left out. Documents are
    dealt by their keys to blocks of about ``BLOCK_CHARACTERS``. A block sends each of its terms once, with the number of
    its documents that hold it, and gets each back once with the number of all: neither a table of all terms nor a row
    for each word of a document is ever moved, and a term that is in most documents is a row a block.
    """
    ship(df.sparkSession)
    total, size = df.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    block = F.pmod(F.xxhash64(key), F.lit(size // BLOCK_CHARACTERS + 1)).cast("int")
    placed = df.select(block.alias("_block"), F.col(key), F.col(text).cast("string").alias("_text")).repartition("_block")
    placed = placed.select("_block", key, words_of(F.col("_text")).alias("_words")).groupBy("_block")

    def held(table: pa.Table) -> pa.Table:
        _, terms, _, term, _ = _counted(table)
        block = pa.repeat(table.column(0)[0], len(terms))
        return pa.table({"_block": block, "term": terms, "n": np.bincount(term, minlength=len(terms)).astype(np.int64)})

    def weighed(table: pa.Table, spread: pa.Table) -> pa.Table:
        keys, terms, at, term, tf = _counted(table)
        place = pc.index_in(terms, spread.column("term").combine_chunks().cast(pa.string())).fill_null(-1).to_numpy()[term]
        at, term, tf, place = (x[place >= 0] for x in (at, term, tf, place))
        documents = spread.column("df").to_numpy()[place]
        raw = (1 + np.log(tf)) * (np.log((1.0 + total) / (1 + documents)) + 1)
        length = np.sqrt(np.bincount(at, raw * raw, len(keys)))
        return pa.table([keys.take(pa.array(at)), terms.take(pa.array(term)), tf.astype(np.int64), documents, raw / length[at]], names=[key, "term", "tf", "df", "weight"])

    counts = placed.applyInArrow(held, "_block int, term string, n bigint")
    spread = counts.select("_block", "term", F.sum("n").over(Window.partitionBy("term")).alias("df"))
    spread = spread.where((F.col("df") >= min_documents) & (F.col("df") <= max_share * total)).groupBy("_block")
    kind = df.schema[key].dataType.simpleString()
    return placed.cogroup(spread).applyInArrow(weighed, f"`{key}` {kind}, term string, tf bigint, df bigint, weight double")


#: Categories of a word list that are counted; the first three make the score.
CATEGORIES = ("positive", "negative", "uncertainty", "litigious", "strong_modal", "weak_modal")


def lexicon_hits(df: DataFrame, key: str, text: str, lexicon: DataFrame, categories: tuple[str, ...] = CATEGORIES[:3]) -> DataFrame:
    """(key, hits of each category, score) from a (word, category) table joined to the texts' words; a word may be in several categories."""
    tokens = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\p{L}\p{N}]+", " ")), " ")
    exploded = df.select(key, F.explode(tokens).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))
    hits = exploded.join(lexicon.distinct(), "word").groupBy(key).agg(
        *[F.coalesce(F.sum(F.when(F.col("category") == c, F.col("n"))), F.lit(0)).alias(c) for c in categories]
    )
    out = df.select(key).join(hits, key, "left").na.fill(0, list(categories))
    return out.withColumn("score", S.lexicon_score(F.col("positive"), F.col("negative"), F.col("uncertainty")))


def forecast(df: DataFrame, day: str, key: str, directions: dict[str, str], relevance: str, count: int = 60) -> DataFrame:
    """One row over the ``count`` newest scored documents: mean probabilities, the leading direction (the first listed of equal ones), mean relevance."""
    recent = df.where(F.col(day).isNotNull()).orderBy(F.desc(day), F.desc(key)).limit(count)
    means = recent.agg(F.count("*").alias("documents"), *[F.avg(c).alias(f"mean_{n}") for n, c in directions.items()], F.avg(relevance).alias("mean_relevance"))
    ranked = F.array_max(F.array(*[F.struct(F.col(f"mean_{n}").alias("p"), F.lit(-i).alias("order"), F.lit(n).alias("n")) for i, n in enumerate(directions)]))
    return means.withColumn("leading", F.when(F.col("documents") > 0, ranked["n"]))
