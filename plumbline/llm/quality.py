"""Per-document statistics that tell prose from lists, tables, forms, code and junk.

Layout evidence (vertical alignment of delimiters, periodicity of markers and indentation,
autocorrelation of line lengths) finds the blocks of lines that are rows; rows are no sentences. A text is prose if
the weighted sum ``WEIGHTS`` of the share of the text in sentences outside rows, common words, rows, digits, symbols
and broken words is not negative.

Defined results: a null or blank text has zero words, null ratios and ``kind`` = 'empty', so it is
never found; a stored quality score that is null or off the scale of 0 to 1 is given as null; repeated rows give
repeated rows; an empty table gives an empty result; columns other
than the id and the text are ignored, whatever their names. Texts are read whole, however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.runtime import ship

from . import residue

#: Function words of the four languages of the corpora; fixed values.
COMMON = frozenset(
    """the of in to and a that by was at as for is be with on this had has have it not an will or were are but from
    which i we you they their its there these those our he she his her them been being would could should may might can do does did
    de la el los las un una en y que por con del para se su al lo más no es le les des et du une est que dans pour par sur au aux
    il elle qui ont der die das und in den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus""".split()
)
_MARK = re.compile(r"\s*(?:[-–—*•·+]|\(?\d{1,3}[.)]|\(\d{1,3}\))\s+\S")
_ODD = re.compile(r"[^\w\s.,;:'\"’“”!?()\-–—%/\[\]<>&*$€…]")
_LEADER = re.compile(r"\.{4,}")
_BREAK = re.compile(r"(?<=[.!?])(?<!\s\d\.)(?<!\s\d\d\.)(?<!^\d\.)[\"'”’)\]*]*\s+|\n(?=\s*(?:[-–—*•·+]|\(?\d{1,3}[.)]|\(\d{1,3}\))\s)")
_CLOSED = re.compile(r"[\w%)\]\"'”’>*][.!?]+[\"'”’)\]*>]*$|\.\.\.$")
_NUMERIC = re.compile(r"[\d.,;:|/%+\-–()$€]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_DELIMITERS = ("|", "\t", ";", ",", " .. ", "   ", ": ", " - ", " – ")
#: Weights of the evidence for prose: sentences and common words beyond a usual least share, against the share of
#: lines that are rows, the digits, the symbols, and words too short on average to be a language's.
WEIGHTS = {"sentences": 4.0, "common": 2.0, "rows": -2.0, "digits": -2.0, "symbols": -2.0, "broken": -2.0}
PROSE_SHARE, COMMON_SHARE, WORD_LENGTH = 0.5, 0.2, 2.8
#: Beyond this share of common words their evidence grows no more.
COMMON_MOST = 0.4
#: Rows of a block: at least so many in turn; by commas or by period alone only with so few words a cell or row.
BLOCK_ROWS, CELL_WORDS = 3, 4
#: Indentation period or autocorrelation of line lengths from which short rows are periodic.
PERIODIC = 0.3

FIELDS = (
    "n_words int, mean_word_length double, symbol_ratio double, digit_ratio double, closed_line_share double, common_word_share double, "
    "delimiter_alignment double, marker_share double, indent_period double, length_autocorrelation double, row_share double, sentence_share double, prose_score double, kind string"
)


def _is_sentence(segment: str) -> bool:
    """Whether a stretch that ends in a full stop reads as a sentence rather than cells or tokens."""
    tokens = segment.split()
    if not 3 <= len(tokens) <= 120 or not _CLOSED.search(tokens[-1]):
        return len(tokens) >= 1 and len(tokens) < 3 and bool(re.fullmatch(r"[A-Z][\w',.\- ]+[.!?]+", segment))
    numeric = sum(1 for t in tokens if _NUMERIC.fullmatch(t))
    words = [t for t in tokens if t[0].isalpha() or t[-1].isalpha()]
    if numeric > 0.4 * len(tokens) or len(words) < 2:
        return False
    if max(map(len, tokens)) > 60:
        return False
    return len(_ODD.findall(segment)) <= 0.08 * len(segment)


def _layout(lines: list[str]) -> tuple[float, float, float, float]:
    """Delimiter alignment, marker share, indentation periodicity and lag-1 autocorrelation of line lengths."""
    n = len(lines)
    if n < 3:
        return 0.0, float(sum(bool(_MARK.match(x)) for x in lines)) / max(n, 1), 0.0, 0.0
    align = 0.0
    for d in _DELIMITERS:
        counts = [x.count(d) for x in lines]
        same = sum(1 for a, b in zip(counts, counts[1:]) if a == b and a >= 2)
        align = max(align, same / (n - 1))
    marks = [bool(_MARK.match(x)) for x in lines]
    indent = np.array([len(x) - len(x.lstrip()) for x in lines], float)
    length = np.array([len(x) for x in lines], float)

    def corr(v: np.ndarray, lag: int) -> float:
        v = v - v.mean()
        total = float((v * v).sum())
        return float((v[:-lag] * v[lag:]).sum()) / total if total > 0 and len(v) > lag else 0.0

    period = max((corr(indent, k) for k in (1, 2, 3, 4) if k < n), default=0.0)
    return align, sum(marks) / n, max(period, 0.0), corr(length, 1)


def _runs(same: list[bool]) -> Iterator[tuple[int, int]]:
    """(first, end) of the runs of lines each of which is like the one before, ``BLOCK_ROWS`` lines at least."""
    first = 0
    for i in range(1, len(same) + 2):
        if i > len(same) or not same[i - 1]:
            if i - first >= BLOCK_ROWS:
                yield first, i
            first = i


def _rows(lines: list[str]) -> set[int]:
    """Indexes of the lines that are rows of a table, form or list by their layout, whatever they say.

    Rows are aligned (equal counts of a delimiter in adjacent lines; where prose has the delimiter too,
    only with short cells and figures among them) or short, open lines led by markers or periodic in indentation or length.
    """
    out: set[int] = set()
    if len(lines) < BLOCK_ROWS:
        return out
    size = [len(x.split()) for x in lines]
    for d in _DELIMITERS:
        plain = d in ("|", "\t")
        counts = [x.strip().count(d) for x in lines]
        if max(counts) < 2:
            continue
        counts = [a if plain or n <= CELL_WORDS * (a + 1) else 0 for a, n in zip(counts, size)]
        for first, end in _runs([a == b and a >= 2 for a, b in zip(counts, counts[1:])]):
            figures = sum(any(_NUMERIC.fullmatch(c.strip()) for c in x.split(d)) for x in lines[first:end])
            if plain or 2 * figures >= end - first:
                out.update(range(first, end))
    short = [n <= 2 * CELL_WORDS and x.rstrip()[-1] not in ".!?" for n, x in zip(size, lines)]
    for first, end in _runs([a and b for a, b in zip(short, short[1:])]):
        _, marked, period, auto = _layout(lines[first:end])
        brief = sum(size[first:end]) <= CELL_WORDS * (end - first)
        if marked >= 0.5 or (brief and (period >= PERIODIC or abs(auto) >= PERIODIC)):
            out.update(range(first, end))
    return out


def _sentences(text: str) -> tuple[int, int]:
    """(number, characters but blanks) of the sentences of a text."""
    count = held = 0
    for segment in _BREAK.split(_LEADER.sub("\u2025", text)):
        segment = segment.strip()
        if segment and _is_sentence(segment):
            count += 1
            held += len(segment) - segment.count(" ") - segment.count("\n")
    return count, held


def describe(text: str | None) -> tuple:
    """The statistics of one text, in the order of ``FIELDS``."""
    if text is None or not text.strip():
        return (0, *[None] * 12, "empty")
    text = text.strip().replace("\r", "")
    lines = [x for x in text.split("\n") if x.strip()]
    size = len(text) - text.count(" ") - text.count("\n")
    words = _WORD.findall(text)
    letters = sum(map(len, words))
    digits = sum(map(text.count, "0123456789"))
    common = sum(1 for w in words if w.lower() in COMMON) / max(len(words), 1)
    rows = _rows(lines)
    if rows:
        parts = ["\n".join(x for _, x in g) for is_row, g in groupby(enumerate(lines), lambda x: x[0] in rows) if not is_row]
        found = [_sentences(x) for x in parts]
        spoken, held = sum(n for n, _ in found), sum(n for _, n in found)
    else:
        spoken, held = _sentences(text)
    share = held / max(size, 1)
    align, marked, period, auto = _layout(lines)
    symbols = 1 - (letters + digits) / max(size, 1)
    evidence = {
        "sentences": share - PROSE_SHARE, "common": min(common, COMMON_MOST) - COMMON_SHARE, "rows": len(rows) / len(lines), "digits": digits / max(size, 1),
        "symbols": symbols, "broken": float(letters < WORD_LENGTH * len(words)),
    }
    score = sum(w * evidence[k] for k, w in WEIGHTS.items())
    if score >= 0:
        kind = "prose"
    elif align >= 0.5:
        kind = "table"
    elif marked >= 0.5 or (len(lines) > 3 and share < 0.2 and letters > 0.6 * size):
        kind = "list"
    else:
        kind = "junk"
    closed = sum(1 for x in lines if x.rstrip()[-1] in ".!?:\"”") / len(lines)
    return (
        len(words), letters / max(len(words), 1), symbols, digits / max(size, 1), closed, common, align, marked, period, auto, len(rows) / len(lines), share, score, kind
    )


def quality_statistics(df: DataFrame, id_col: str = "fomc_id", text_col: str = "text_content", score_col: str | None = None) -> DataFrame:
    """(id, stored_score, statistics of ``FIELDS``) of each row; ``kind`` is prose, table, list, junk or empty."""
    ship(df.sparkSession)
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([describe(t) for t in b["text"]], columns=names)
            out.insert(0, "stored_score", b["stored"].to_numpy())
            out.insert(0, "id", b["id"].to_numpy())
            yield out

    kind = df.schema[id_col].dataType.simpleString()
    stored = F.col(score_col).cast("double") if score_col else F.lit(None).cast("double")
    stored = F.when(stored.between(0, 1), stored).alias("stored")
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), stored).mapInPandas(run, f"id {kind}, stored_score double, {FIELDS}")
    return out.withColumnRenamed("id", id_col)


def not_prose(df: DataFrame, id_col: str = "fomc_id", text_col: str = "text_content") -> DataFrame:
    """Ids of the texts that are mostly not sentences and are no template residue or error page, by models fitted on all texts."""
    models = df.sparkSession.sparkContext.broadcast(residue.fit_models(df, id_col, text_col))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            odd = [i for i, t in enumerate(texts) if describe(t)[-1] not in ("prose", "empty")]
            clear = ~residue.judge(models.value, [texts[i] for i in odd])["residue"]
            yield b[["id"]].iloc[[i for i, c in zip(odd, clear) if c]]

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, f"id {kind}")
    return out.withColumnRenamed("id", id_col)
