"""Keyword-stuffed and link-list pages: robust Mahalanobis outliers in spam-directed directions.

Each document gets density, entropy, repetition and function-word features; the first is the share of its tokens
in sentences, table rows, references, names or titles. Per language, medians and median absolute deviations
centre and scale them, correlations come from winsorised scores, and the Mahalanobis distance is taken from both.
A document is spam if its squared distance is beyond ``DISTANCE2`` and its deviation, whitened like the distance,
points within an angle of cosine ``COSINE`` of one of the ``DIRECTIONS``: keyword runs, lists of links or lists of
tags and products. Distance and direction alone decide.

Defined results: null, empty and blank texts and texts without a token have null features and are never
found; a language is its two-letter code in lower case, 'und' if null; the statistics of a language are drawn
towards those of all documents with a weight of ``PRIOR`` documents, so rare languages need no rule of their own;
repeated rows give repeated rows; an empty table gives an empty result; columns other than those named are
ignored. Statistics cover all documents; one row a two-letter code reaches the driver.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.runtime import cut, ship

from .quality import COMMON

PRIOR = 50
#: Squared distance beyond which a document is an outlier: the 99.5 % quantile of chi-squared with six degrees.
DISTANCE2 = 18.5
#: Cosine between a document's whitened deviation and the nearest spam direction from which it points there.
COSINE = 0.65
#: Fewer links than this are no list of links.
LEAST_LINKS = 3
#: A line with at most so many words to a link is a link's entry, unless it belongs to a reference.
WORDS_A_LINK = 25
#: Least scale of each feature, so that a constant feature is not divided by zero.
FEATURES = {"sentences": 0.05, "function_words": 0.04, "links": 0.02, "repetition": 0.08, "entropy": 0.05, "separators": 0.03}
#: Spam-directed directions in scaled deviations of the ``FEATURES``, in their order.
DIRECTIONS = {"keywords": (-4, -2, 0, 1, -1, 0), "links": (-2, -1, 3, 1, -1, 2), "tags": (-4, -2, 0, 0, 0, 2)}

#: Words that make a stretch a sentence: auxiliaries, pronouns, conjunctions of four languages; fixed values.
BINDING = frozenset(
    """that it was is be had has have were are been will would should could may might can not this these those which who what how its their they
    we i you he she him her as by to from with there than but because although though while so if when whether since after before until into
    que se es son fue ha han ser está están era como más no si cuando pero aunque mientras sin sobre desde hasta este esta lo le les su sus
    est sont a ont été était sera ne pas plus qui dont ce cette ces il elle ils elles nous vous même si mais tandis selon par dans leur leurs
    ist sind war waren wird werden hat haben wurde wurden dass sich nicht auch wie als sie er es wir ihr doch obwohl während sodass bei gegenüber
    um von nach zum zur der die das den dem ein eine el la los las un una por le les du des au aux une cent pour l d""".split()
)
_URL = re.compile(r"(?:https?://|www\.)[^\s)\"'>\]]+")
_SEGMENT = re.compile(r"(?<=[\w)\]\"'’”%\u0002][.!?])\s+(?=\S)|\s[|–-]\s")
_WORD = re.compile(r"[^\W\d_]+")
_CITED = re.compile(r"[^\W\d_][\w'’-]+, (?:[^\W\d_]\.\s?)+\(?\d{4}")
_REFERENCE = re.compile(r"^\W*(?:\[?\d+\]?\.?\s*)?[^\W\d_][\w'’-]+, (?:[^\W\d_]\.\s?)+(?:.{0,80})?\(?\d{4}[a-z]?\)?|^References\b|^\(\d{4}[a-z]?\)")
_NUMBER = re.compile(r"\d+(?:\.\d+)?")
_NAMES = re.compile(r"(?:[^\W\d_]+: )?(?:[^\W\d_a-z][\w'’-]+ (?:[^\W\d_]\. )?[^\W\d_a-z][\w'’-]+(?:, | and |; |\.?$)){3,}")
_PRODUCT = re.compile(r"(?i)\b(?:in stock|free shipping|add to (?:basket|cart)|buy now|tags?:|sold out|order now)")
_SEPARATORS = "[]()*>|;,#•"


def describe(text: str | None) -> tuple | None:
    """The ``FEATURES`` of a text in order; None without tokens."""
    if not text or not text.strip():
        return None
    urls = _URL.findall(text) if "://" in text or "www." in text else ()
    plain = _URL.sub(" \u0002 ", text) if urls else text
    words: list[str] = []
    sentence = neutral = 0
    cited = False
    rows = [x for x in plain.split("\n") if x.strip()]
    for at, line in enumerate(rows):
        links = line.count("\u0002") if urls else 0
        size = line.count(" ") + 1
        if size < 60 and not links and (numbers := len(_NUMBER.findall(line))) >= 2 and numbers * 2 >= len(own := _WORD.findall(line.lower())) and not _PRODUCT.search(line):
            words += own
            neutral += len(own)
            continue
        if at == 0 and size <= 14 and not links and "," not in line and line.rstrip()[-1:] not in (".", "|", ""):
            own = _WORD.findall(line.lower())
            if len(rows) > 1 or ("#" not in line and len(set(own)) == len(own)):
                words += own
                neutral += len(own)  # a title
                continue
        if ", " in line and (listed := _NAMES.match(line)):
            own = _WORD.findall(listed[0].lower())
            words += own
            neutral += len(own)
            line = line.replace(listed[0], " ", 1)
        loose = links - len(_CITED.findall(line)) if links else 0
        entry = loose > 0 and len(urls) >= LEAST_LINKS and len(_WORD.findall(line)) <= WORDS_A_LINK * loose
        for segment in _SEGMENT.split(line):
            own = _WORD.findall(segment.lower())
            links = segment.count("\u0002") if urls else 0
            size = len(own) + links
            if not size:
                continue
            words += own
            if "(" in segment or segment[:10] == "References":
                if _REFERENCE.match(segment.strip()):
                    neutral, cited = neutral + size, True
                    continue
            if cited and len(own) <= 16 and not entry:
                neutral += size
                continue
            if not entry and len(own) >= 4 and not BINDING.isdisjoint(own) and len(BINDING.intersection(own)) * 18 >= len(own):
                sentence, cited = sentence + size, False
    n = len(words) + len(urls)
    if not n:
        return None
    counts = Counter(words)
    total = max(len(words), 1)
    entropy = -sum(c * math.log(c) for c in counts.values() if c > 1) / total + math.log(total)
    return (
        (sentence + neutral) / n,
        sum(c for w, c in counts.items() if w in COMMON) / n,
        len(urls) / n,
        1 - len(set(zip(words, words[1:]))) / (total - 1) if total > 1 else 0.0,
        entropy / math.log(total) if total > 1 else 1.0,
        min(sum(map(plain.count, _SEPARATORS)) / n, 1.0),
    )


def features(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(id, language, features): one pass over the texts."""
    names = list(FEATURES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [describe(t) or (None,) * len(names) for t in b["text"]]
            out = pd.DataFrame(found, columns=names, dtype="float64")
            out.insert(0, "language", b["language"].to_numpy())
            out.insert(0, "id", b["id"].to_numpy())
            yield out

    kind = df.schema[id_col].dataType.simpleString()
    code = F.lower(F.regexp_extract(F.col(lang_col), r"^\s*([A-Za-z]{2})(?:$|[^A-Za-z])", 1))
    language = F.when(F.length(code) == 2, code).otherwise("und")
    return df.select(F.col(id_col).alias("id"), language.alias("language"), F.col(text_col).cast("string").alias("text")).mapInPandas(
        run, f"id {kind}, language string, " + ", ".join(f"{n} double" for n in names)
    )


def _statistics(found: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per language (and '' for all): centre, scale and inverse correlation, drawn towards those of all documents."""
    names = list(FEATURES)
    usable = found.where(F.col("sentences").isNotNull())
    both = usable.unionByName(usable.withColumn("language", F.lit("")))
    middles = {r["language"]: r for r in both.groupBy("language").agg(F.count("*").alias("n"), *[F.percentile_approx(n, 0.5, 1000).alias(n) for n in names]).collect()}
    if not middles:
        return {}

    def drawn(values: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {k: (middles[k]["n"] * v + PRIOR * values[""]) / (middles[k]["n"] + PRIOR) for k, v in values.items()}

    def lookup(values: dict[str, np.ndarray], k: int):
        return F.create_map(*[x for lang, v in values.items() for x in (F.lit(lang), F.lit(float(v[k])))])[F.col("language")]

    centre = drawn({lang: np.array([r[n] for n in names], float) for lang, r in middles.items()})
    around = {n: F.col(n) - lookup(centre, k) for k, n in enumerate(names)}
    spread = both.groupBy("language").agg(*[F.percentile_approx(F.abs(a), 0.5, 1000).alias(n) for n, a in around.items()])
    scale = drawn({r["language"]: 1.4826 * np.array([r[n] for n in names], float) for r in spread.collect()})
    scale = {lang: np.maximum(v, list(FEATURES.values())) for lang, v in scale.items()}
    scored = both.select("language", *[F.least(F.greatest(a / lookup(scale, k), F.lit(-2.5)), F.lit(2.5)).alias(n) for k, (n, a) in enumerate(around.items())])
    products = [F.avg(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    moments = {}
    for r in scored.groupBy("language").agg(*products).collect():
        moments[r["language"]] = np.array([[r[f"{names[min(i, j)]}_{names[max(i, j)]}"] for j in range(len(names))] for i in range(len(names))], float)
    out = {}
    for lang, m in drawn(moments).items():
        d = np.sqrt(np.maximum(np.diag(m), 1e-6))
        out[lang] = (centre[lang], scale[lang], np.linalg.inv(0.8 * m / np.outer(d, d) + 0.2 * np.eye(len(names))))
    return out


def spam_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, distance2, direction, cosine, spam) of each document; see the module's text."""
    ship(df.sparkSession)
    found = cut(features(df, id_col, text_col, lang_col))
    known = df.sparkSession.sparkContext.broadcast(_statistics(found))
    names, titles, towards = list(FEATURES), np.array(list(DIRECTIONS), object), np.array(list(DIRECTIONS.values()), float)
    far, near = DISTANCE2, COSINE

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            distance, cosine = np.full(len(b), np.nan), np.full(len(b), np.nan)
            direction = np.full(len(b), None, object)
            values = b[names].to_numpy(float)
            usable = ~np.isnan(values).any(1)
            for language, at in b[usable].groupby("language").groups.items():
                at = b.index.get_indexer(at)
                centre, scale, inverse = known.value[language]
                z = (values[at] - centre) / scale
                distance[at] = np.einsum("ij,jk,ik->i", z, inverse, z)
                lengths = np.sqrt(np.einsum("ij,jk,ik->i", towards, inverse, towards))
                angles = z @ inverse @ towards.T / np.sqrt(np.maximum(distance[at], 1e-12))[:, None] / lengths
                cosine[at], direction[at] = angles.max(1), titles[angles.argmax(1)]
            with np.errstate(invalid="ignore"):
                spam = (distance > far) & (cosine >= near)
            yield pd.DataFrame({"id": b["id"], "distance2": distance, "direction": direction, "cosine": cosine, "spam": spam})

    kind = df.schema[id_col].dataType.simpleString()
    out = found.mapInPandas(run, f"id {kind}, distance2 double, direction string, cosine double, spam boolean")
    return out.withColumnRenamed("id", id_col)


def spam_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Ids of the documents whose text is mostly keywords, tags, products or links."""
    return spam_scores(df, id_col, text_col, lang_col).where("spam").select(id_col)
