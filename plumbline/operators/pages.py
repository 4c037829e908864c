"""Page parsing: main text, statements, event pages. HTML needs a parser, so these are Arrow-batched Pandas functions."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scores as S

_DROPPED = frozenset(("script", "style", "nav", "noscript", "template", "svg"))
_VOID = frozenset(("br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"))
_BLOCK = frozenset(("p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "main", "body", "br", "title", "header", "footer"))
#: Fewer words than this are a short body; the phrases and the reach within which a statement names its decision and range.
SHORT_WORDS = 120
RATE_PHRASE, RATE_REACH = "federal funds rate", 550
RANGE_PATTERN = r"(?i)(?:at|to)\s+([\d/-]+)\s+to\s+([\d/-]+)\s+percent"
#: Lines that are furniture of a page, and the lines of an event page's head.
BOILERPLATE = frozenset(("Share", "Watch Live", "Last Update:", "Back to Top", "Home"))
_DATE_LINE = re.compile(r"\d{1,2}/\d{1,2}/\d{4}|(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+\d{4}")
_PERSON_LINE = re.compile(r"(?:Chair|Vice Chair|Vice Chair for Supervision|Chair Pro Tempore|Governor|Member|Director)\b")
_PLACE_LINE = re.compile(r"(?:At|Before)\b")
_MARKUP = re.compile(r"<!--.*?-->|<(script|style)[^>]*>.*?</\1>|<[^>]+>", re.I | re.S)
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
DECISION_PATTERN = r"(?i)to\s+(maintain|lower|raise)\s+the\s+target\s+range"


class _Collector(HTMLParser):
    """Text by candidate container; the most specific container with text wins."""

    #: Containers from most to least specific: the article block, the wide column, article, main, body.
    RANKS = 5

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int | None, bool]] = []
        self.parts: list[list[str]] = [[] for _ in range(self.RANKS)]
        self.seen = [False] * self.RANKS
        self.title: list[str] = []

    @staticmethod
    def _rank(tag: str, attrs: dict[str, str | None]) -> int | None:
        if tag == "div" and attrs.get("id") == "article":
            return 0
        if tag == "div" and {"col-xs-12", "col-sm-8", "col-md-8"} <= set((attrs.get("class") or "").split()):
            return 1
        if tag == "article":
            return 2
        if tag == "main" or attrs.get("role") == "main":
            return 3
        return 4 if tag == "body" else None

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self._put("\n")
        if tag in _VOID:
            return
        rank = self._rank(tag, dict(attrs))
        if rank is not None and not self.seen[rank]:
            self.seen[rank] = True
        elif rank is not None:
            rank = None
        self.open.append((tag, rank, tag in _DROPPED))

    def handle_endtag(self, tag):
        if tag in _BLOCK:
            self._put("\n")
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def _put(self, data: str) -> None:
        if any(dropped for _, _, dropped in self.open):
            return
        for _, rank, _ in self.open:
            if rank is not None:
                self.parts[rank].append(data)

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "title":
            self.title.append(data)
        self._put(data)


def fold(text: str) -> str:
    """NFKC with every dash as a hyphen."""
    return re.sub("[‐-—−]", "-", unicodedata.normalize("NFKC", text))


def clean(text: str | None) -> str:
    """Folded, words hyphenated over a line end joined, bare page numbers and boilerplate lines dropped, white space collapsed."""
    joined = re.sub(r"(\w)-\n(\w)", r"\1\2", fold(text or ""))
    kept = [x for x in (y.strip() for y in joined.splitlines()) if x and x not in BOILERPLATE and not re.fullmatch(r"(?i)(?:page\s+)?\d{1,3}", x)]
    return re.sub(r"\s+", " ", " ".join(kept)).strip()


def plain(text: str | None) -> str:
    """Entities resolved, comments, scripts, styles and tags as blanks, folded, control characters as blanks, white space collapsed."""
    bare = _MARKUP.sub(" ", html.unescape(text or ""))
    return re.sub(r"\s+", " ", _CONTROL.sub(" ", fold(bare))).strip()


def plain_text(text: Column) -> Column:
    """``plain`` as an Arrow-batched column; null counts as empty."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(plain).astype(object)

    return run(text)


def parse(page: str | None) -> tuple[str, str, list[str], int]:
    """(title, text, flags, words) of a page. Nothing is invented: a page without text has the flag no_text."""
    if not page or not page.strip():
        return "", "", ["no_text"], 0
    collector = _Collector()
    collector.feed(page)
    collector.close()
    texts = [clean("".join(p)) for p in collector.parts]
    at = next((i for i, t in enumerate(texts) if t), None)
    title = clean(html.unescape("".join(collector.title)))
    if at is None:
        return title, "", ["html_structure_unknown", "no_text"], 0
    flags = ["html_structure_unknown"] if at == 4 else []
    count = len(texts[at].split())
    return title, texts[at], flags + (["short_body"] if count < SHORT_WORDS else []), count


def board_page(page: str | None) -> tuple[str | None, str, str, str]:
    """(day, title, participant, body) of an event page by the order of its lines.

    A first line that is a date gives the day; the next is the title. A line that names an office, or one that is followed by
    a line of place (At, Before), is the participant; the line of place and share or watch lines are dropped.
    """
    collector = _Collector()
    collector.feed(page or "")
    collector.close()
    block = next((b for b in ("".join(p) for p in collector.parts) if b.strip()), "")
    lines = [x for x in (re.sub(r"\s+", " ", y).strip() for y in fold(block).splitlines()) if x and not x.isdigit()]
    day, rest = None, lines
    if lines and _DATE_LINE.fullmatch(lines[0]):
        read = pd.to_datetime(lines[0], errors="coerce", format="%m/%d/%Y" if lines[0][0].isdigit() else "%B %d, %Y")
        day, rest = (None if pd.isna(read) else read.strftime("%Y%m%d")), lines[1:]
    title, rest = (rest[0], rest[1:]) if rest else ("", [])
    participant = ""
    placed = [bool(_PLACE_LINE.match(x)) for x in rest[:2]] + [False, False]
    if rest and (_PERSON_LINE.match(rest[0]) or (placed[1] and not placed[0])):
        participant, rest = rest[0], rest[1:]
    if rest and _PLACE_LINE.match(rest[0]):
        rest = rest[1:]
    while rest and rest[0] in ("Share", "Watch Live"):
        rest = rest[1:]
    return day, title, participant, " ".join(rest).strip()


def board_pages(df: DataFrame, html_col: str = "html") -> DataFrame:
    """``df`` with day, title, participant and body in place of the event page."""

    @F.pandas_udf("struct<day:string,title:string,participant:string,body:string>")
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in pages:
            yield pd.DataFrame([board_page(p) for p in batch], columns=["day", "title", "participant", "body"])

    return df.withColumn("_page", run(html_col)).drop(html_col).select("*", "_page.*").drop("_page")


def parse_pages(df: DataFrame, html_col: str = "html") -> DataFrame:
    """``df`` with a struct column ``parsed`` (title, text, flags, words) in place of the page."""

    @F.pandas_udf("struct<title:string,text:string,flags:array<string>,words:int>")
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in pages:
            yield pd.DataFrame([parse(p) for p in batch], columns=["title", "text", "flags", "words"])

    return df.withColumn("parsed", run(html_col)).drop(html_col)


def best_variant(df: DataFrame, keys: list[str], words: str, order: str) -> DataFrame:
    """Of several parses of a document the longest; of equally long ones the first in ``order``."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(F.col(words), -F.col(order))).alias("best")).select(*keys, "best.*")


def statement_policy(text: Column) -> dict[str, Column]:
    """Decision, range and error of a statement: the range is looked for within 550 characters of the rate's first mention.

    ``error`` says what is missing: the body, the rate, or the range (the decision then stands alone).
    """
    at = F.instr(F.lower(text), RATE_PHRASE)
    near = F.when(at > 0, F.substr(text, at, F.lit(RATE_REACH)))
    decision = F.lower(F.regexp_extract(text, DECISION_PATTERN, 1))
    first, second = (S.rate_text(S.rate_value(F.regexp_extract(near, RANGE_PATTERN, g))) for g in (1, 2))
    error = F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) == 0, "no article body").when(at == 0, f"no {RATE_PHRASE} mention").when(~near.rlike(RANGE_PATTERN), "no target range")
    return {"decision": F.when(decision == "", "maintain").otherwise(decision), "range_from": first, "range_to": second, "error": error}
