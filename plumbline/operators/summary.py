"""Extractive summaries: PageRank over sentence overlap, per document in an Arrow-batched Pandas function."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_WORD = re.compile(r"\w+")
#: Up to so many sentences the overlaps are held as one matrix; beyond it the same sums are taken without forming it.
MATRIX = 400


def _near(words: list[set[str]]) -> Callable[[np.ndarray], np.ndarray]:
    """Product of the matrix of overlaps, over the logs of both lengths, with a vector."""
    index = {w: i for i, w in enumerate(sorted(set().union(*words)))}
    count = np.array([len(w) for w in words])
    size = np.log(np.maximum(count, 1)) + 1e-9
    if len(words) <= MATRIX:
        held = np.zeros((len(words), max(len(index), 1)))
        for i, own in enumerate(words):
            held[i, [index[w] for w in own]] = 1
        near = (held @ held.T) / (size[:, None] + size[None, :] + 1e-9)
        np.fill_diagonal(near, 0)
        return lambda x: near @ x
    rows = np.repeat(np.arange(len(words)), count)
    columns = np.array([index[w] for own in words for w in own], int)
    lengths = [(size[count == n][0], np.flatnonzero(np.repeat(count == n, count))) for n in np.unique(count)]

    def product(x: np.ndarray) -> np.ndarray:
        out = -count / (2 * size + 1e-9) * x
        for length, at in lengths:
            shared = np.bincount(columns[at], weights=x[rows[at]], minlength=len(index))
            out += np.bincount(rows, weights=shared[columns], minlength=len(words)) / (size + length + 1e-9)
        return out

    return product


def _rank(sentences: list[str], rounds: int = 30, damping: float = 0.85) -> np.ndarray:
    n = len(sentences)
    near = _near([set(_WORD.findall(s.lower())) for s in sentences])
    out = near(np.ones(n))
    alone = out <= 1e-12
    rank = np.full(n, 1 / n)
    for _ in range(rounds):
        rank = (1 - damping) / n + damping * (near(np.where(alone, 0, rank / np.where(alone, 1, out))) + rank[alone].sum() / n)
    return rank


def summarize(text: str | None, count: int = 3) -> str | None:
    """The ``count`` sentences of highest rank in text order, ranked over the whole text; null for texts of fewer than 80 characters."""
    if text is None or len(text.strip()) < 80:
        return None
    sentences = [s.strip() for s in _SENTENCE.split(text.strip()) if s.strip()]
    if len(sentences) > count:
        best = sorted(np.argsort(-np.round(_rank(sentences), 12), kind="stable")[:count])
        sentences = [sentences[i] for i in best]
    return " ".join(sentences)


def summary(text: Column, count: int = 3) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda t: summarize(t, count)).astype(object)

    return run(text)
