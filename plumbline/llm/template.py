"""Page furniture apart from main content: template deduction by equivalence classes per site.

Every line is reduced to tokens in context: its skeleton (digits and months masked), its first and its last two
words, and its frame (both, leaving a slot between). A token's occurrence vector over the pages of a site is
condensed to its support, a sum of page hashes and the mean of its positions weighted by them; tokens of one site
with equal vectors that keep their distance on every page form an equivalence class in order. Words of the body
occur in many lines, so only lines whose words occur nowhere else share a class with their own ends. A class is
valid, and nested into its site's template, if it has two tokens or more and is rarer on other sites; a class of
one needs a share of its site's pages as well. Lines and labels that on nearly every page open the same slot, filled with
titles, are headings of lists: what fills their slot is furniture too. Slots that hold no more than a
stamp, dated entry, byline, path, menu, tags or consent notice, whose words differ on every page, are typed by their form.
The slots that remain are the body.

Defined results: null and blank texts have no lines; rows with a null site form one site of their own;
repeated rows each get their lines; an empty table gives an empty result; columns other than those named
are ignored. Lines are numbered from 1; blank lines count but are never found. All pages and whole texts
are counted; nothing is sampled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.runtime import BROADCAST_BYTES, cut, ship

#: A class of so many tokens is valid from this support, if it is so many times rarer on other sites.
CLASS_TOKENS, CLASS_COUNT, SITE_LIFT = 2, 4, 5.0
#: A class of one token is valid from this share and support; from the strong ones on every site.
SITE_SHARE, SITE_COUNT = 0.02, 5
STRONG_SHARE, STRONG_LIFT, STRONG_COUNT = 0.10, 2.5, 8
#: A line as long as a paragraph is one token and must be on this share of the pages.
LONG_LINE, LONG_SHARE, LONG_COUNT = 140, 0.05, 10
#: A line or label opens a slot if so many pages hold it and titles follow it on this share of them.
OPEN_COUNT, OPEN_SHARE = 5, 0.95
#: Titles that follow a heading, at least; words of a label, at most.
ENTRIES, LABEL_WORDS = 2, 3
SALTS = 16
_ROW_BYTES = 33

_MONTH = r"(?:january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sept?|oct|nov|dec)\.?"
_MASK_DIGITS = re.compile(r"[0-9]+")
_MASK_MONTH = re.compile(rf"\b{_MONTH}(?= #|,|$)|(?<=# ){_MONTH}(?= #|\b)")
_BLANKS = re.compile(r"[^\S\n]{2,}|[^\S\n ]")
_STAMP = re.compile(r"(?:[\w ]{2,24}: ?)?(?:# @,? #|@ #,? #|#[/.-]#[/.-]#)(?:,? (?:at )?#:#(?: ?[ap]m)?)?")
_BYLINE = re.compile(
    r"(?:speech|remarks|address|lecture|statement|testimony|keynote|comments|opening remarks|introductory remarks) (?:by|of|from) .{3,90}"
    r"|.{3,60}, (?:speaking|addressing|in conversation) (?:at|to|with|before) .{3,80}"
)
_PATH = re.compile(r"[^>»/›|]{2,24}(?: ?[>»›] ?[^>»/›|]+){2,}")
_TAGS = re.compile(r"(?:#\w+[ ,]*)+")
_CONSENT = re.compile(r".*\b(?:cookies?|consent|trackers?|tracking|your privacy|privacy (?:options|settings|choices|policy|preferences)|your device|your computer|your visit|personal data)\b.*")
_SEPARATOR = re.compile(r"\s+[|·»•›/>]\s+|\s{2,}")
_ITEM = re.compile(r"[^\W\d_a-z][^\W\d_]*(?: (?:&|[^\W\d_]+)){0,3}")
_DATED = re.compile(r"#\.? @ [-–—:] .{3,100}")


def skeletons(text: str) -> list[str]:
    """The masked lines of a text, in order (months in short lines only); blank lines are empty strings."""
    flat = _BLANKS.sub(" ", _MASK_DIGITS.sub("#", text.lower()))
    return [_MASK_MONTH.sub("@", x.strip()) if "#" in x and len(x) < LONG_LINE else x.strip() for x in flat.split("\n")]


def _key(line: str) -> int:
    return xxhash.xxh64_intdigest(line) - (1 << 63)


def _frame(line: str, words: list[str]) -> str | None:
    return "\u0001".join((*words[:2], *words[-2:])) if len(words) >= 5 and len(line) < LONG_LINE else None


def _label(line: str) -> str | None:
    head, mark, _ = line.partition(": ")
    return f"{head}\u0002" if mark and len(head.split(" ")) <= LABEL_WORDS else None


def _entry(line: str) -> bool:
    """Whether a line reads as a title or a dated entry of a list."""
    if not line or len(line) > 110:
        return False
    if line[0] == "#":
        return _DATED.fullmatch(line) is not None
    return len(line) >= 8 and line[-1] not in ".!?;:" and "#" not in line and 3 <= line.count(" ") <= 15


@lru_cache(1 << 15)
def _marks(line: str) -> tuple[int, int | None, int | None, bool, bool, tuple[int, ...]]:
    """(key, key of the frame, key of the label, whether a title follows the label, whether it is a title, keys of the ends) of a short line."""
    words, label = line.split(" "), _label(line)
    frame = _frame(line, words)
    ends = (_key(f"{words[0]} {words[1]}\u0001"), _key(f"\u0001{words[-2]} {words[-1]}")) if len(words) >= 4 else ()
    return (
        _key(line), _key(frame) if frame else None, _key(label) if label else None, bool(label) and _entry(line[len(label) + 1 :]), _entry(line), ends
    )


def _tokens_of(text: str) -> dict[int, tuple[int, bool, bool]]:
    """The distinct tokens of a page, each with its first position, whether its line is long and whether titles fill its slot."""
    own: dict[int, tuple[int, bool, bool]] = {}
    lines = [x for x in skeletons(text) if x]
    marks = [_marks(x) if len(x) < LONG_LINE else None for x in lines]
    titles = [m is not None and m[4] for m in marks] + [False] * ENTRIES
    for at, m in enumerate(marks):
        if m is None:
            own.setdefault(_key(lines[at]), (at, True, False))
            continue
        key, frame, label, labelled, _, ends = m
        own.setdefault(key, (at, False, all(titles[at + 1 : at + 1 + ENTRIES])))
        for end in ends:
            own.setdefault(end, (at, False, False))
        if frame is not None:
            own.setdefault(frame, (at, False, False))
        if label is not None and ends:
            own.setdefault(label, (at, False, labelled))
    return own


def _vectors(pages: DataFrame) -> DataFrame:
    """(site, token, long, support, vector, mean, opened): the occurrence vector of every token on its site; token null counts the pages."""

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sites, keys, kept, page = [], [], [], []
            for site, text in zip(b["site"], b["text"]):
                own = _tokens_of(text)
                sites += [site] * (len(own) + 1)
                keys += [*own, None]
                kept += [*own.values(), (0, False, False)]
                page += [xxhash.xxh32_intdigest(text)] * (len(own) + 1)
            at, long, opened = zip(*kept)
            yield pd.DataFrame({"site": sites, "token": pd.array(keys, dtype="Int64"), "long": long, "page": page, "at": at, "opened": opened})

    rows = pages.select("site", "text").mapInPandas(tokens, "site string, token long, long boolean, page long, at int, opened boolean")
    return rows.groupBy("site", "token").agg(
        F.max("long").alias("long"), F.count("*").alias("support"), F.sum("page").alias("vector"),
        (F.sum(F.col("page").cast("double") * F.col("at")) / F.sum("page")).alias("mean"), F.count_if("opened").alias("opened"),
    )


def template_tokens(pages: DataFrame) -> DataFrame:
    """(site, token, opens): the tokens of each site's template; site null means on every site, ``opens`` that titles fill the slot after it."""
    counted = cut(_vectors(pages))
    sizes = counted.where("token is null").select("site", F.col("support").alias("pages"))
    everywhere = counted.where("token is not null").groupBy("token").agg(F.sum("support").alias("overall"), F.sum("opened").alias("openings"))
    total = sizes.agg(F.sum("pages").alias("total")).first()["total"] or 0
    # positions at a constant distance on every page leave equal fractions of the weighted mean positions
    ordered = F.pmod(F.round(F.col("mean") * 1e6), F.lit(1e6))
    members = F.count("*").over(Window.partitionBy("site", "support", "vector", ordered))
    found = counted.where("token is not null").where(F.col("support") >= min(CLASS_COUNT, SITE_COUNT)).withColumn("members", members)
    rated = (
        found.join(everywhere, "token")
        .join(sizes, "site")
        .withColumn("share", F.col("support") / F.col("pages"))
        .withColumn("lift", F.col("share") * F.greatest(F.lit(total) - F.col("pages"), F.lit(1)) / (F.col("overall") - F.col("support") + 1))
    )
    only = F.lit(total) == F.col("pages")
    grouped = (F.col("members") >= CLASS_TOKENS) & (F.col("support") >= CLASS_COUNT)
    single = (F.col("share") >= SITE_SHARE) & (F.col("support") >= SITE_COUNT)
    plain = (grouped | single) & ((F.col("lift") >= SITE_LIFT) | (only & (F.col("share") >= STRONG_SHARE)))
    strong = (F.col("share") >= STRONG_SHARE) & (F.col("lift") >= STRONG_LIFT) & (F.col("support") >= STRONG_COUNT)
    enough = ~F.col("long") | ((F.col("share") >= LONG_SHARE) & (F.col("support") >= LONG_COUNT))
    judged = cut(rated.where(enough & (plain | strong)).select("site", "token", strong.alias("strong")))
    opening = everywhere.where((F.col("overall") >= OPEN_COUNT) & (F.col("openings") >= OPEN_SHARE * F.col("overall")))
    nowhere, no = F.lit(None).cast("string").alias("site"), F.lit(False).alias("opens")
    shared = judged.where("strong").select(nowhere, "token", no).distinct()
    return judged.select("site", "token", no).unionByName(shared).unionByName(opening.select(nowhere, "token", F.lit(True).alias("opens")))


def _menu(line: str) -> bool:
    """Whether a line is a row of menu items: three or more short capitalised parts between like separators."""
    parts = _SEPARATOR.split(line)
    return len(parts) >= (3 if _SEPARATOR.search(line)[0].strip() else 4) and all(_ITEM.fullmatch(p) for p in parts) if len(parts) > 2 else False


def _title_like(line: str) -> bool:
    return 3 <= len(line) <= 110 and line[-1] not in ".!?;" and (line[0] != "#" or _DATED.fullmatch(line) is not None) and len(line.split()) >= 3


@lru_cache(1 << 15)
def _form(line: str, raw: str) -> bool:
    """Whether a short line's slot holds no more than a stamp, dated entry, byline, path, menu, tags or consent notice."""
    return bool(
        _STAMP.fullmatch(line) or _DATED.fullmatch(line) or _PATH.fullmatch(line) or (_BYLINE.fullmatch(line) and line[-1] not in ".!?")
        or _TAGS.fullmatch(raw) or _CONSENT.fullmatch(line) or _menu(raw)
    )


def furniture_of(text: str, template: set[int], opening: set[int] | frozenset[int] = frozenset()) -> list[int]:
    """Numbers of the lines of one page that are not its body."""
    raw = text.split("\n")
    lines = skeletons(text)
    kind = [""] * len(lines)
    for i, line in enumerate(lines):
        if not line:
            continue
        if len(line) >= LONG_LINE:
            kind[i] = "template" if _key(line) in template else ""
            continue
        key, frame, label, labelled, _, _ = _marks(line)
        if key in opening:
            kind[i] = "heading"
        elif key in template or frame in template:
            kind[i] = "template"
        elif (labelled and label in opening) or _form(line, raw[i].strip()):
            kind[i] = "form"
    shown = [i for i, x in enumerate(lines) if x]
    prose = [i for i in shown if not kind[i] and (len(lines[i]) >= LONG_LINE or (len(lines[i]) > 60 and lines[i][-1] in ".!?"))]
    first = prose[0] if prose else len(lines)
    titled = False
    for at, i in enumerate(shown):
        if not kind[i] and i < first and _title_like(lines[i]):
            titled = True
        if kind[i] != "heading":
            continue
        run = []
        for j in shown[at + 1 :]:
            if kind[j] or not _title_like(lines[j]):
                break
            run.append(j)
        follows = shown[at + 1 + len(run)] if at + 1 + len(run) < len(shown) else None
        if run and i < first and not titled and follows is not None and follows in prose[:1]:
            run.pop()  # the title of the page itself
        for j in run:
            kind[j] = "form"
    return [i + 1 for i in shown if kind[i]]


def _with_own_template(pages: DataFrame, tokens: DataFrame) -> DataFrame:
    """Pages with the template and opening tokens that occur on them, by salted joins: for templates too large to broadcast."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, site, k) for i, site, text in zip(b["id"], b["site"], b["text"]) for k in _tokens_of(text)]
            yield pd.DataFrame(rows, columns=["id", "site", "token"])

    kind = pages.schema["id"].dataType.simpleString()
    held = pages.select("id", "site", "text").mapInPandas(spread, f"id {kind}, site string, token long").distinct()
    held = held.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    copies = tokens.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = held.join(copies.where("site is not null"), ["site", "token", "salt"]).select("id", "token", "opens")
    shared = held.join(copies.where("site is null").drop("site"), ["token", "salt"]).select("id", "token", "opens")
    lists = {name: F.array_sort(F.collect_set(F.when(F.col("opens") == opens, F.col("token")))).alias(name) for name, opens in (("template", False), ("opening", True))}
    return pages.join(own.unionByName(shared).groupBy("id").agg(*lists.values()), "id", "left")


def furniture_lines(df: DataFrame, site: Column, id_col: str = "speech_id", text_col: str = "text_content") -> DataFrame:
    """(id, line_no): the lines of each page that belong to the page's furniture and not to its body."""
    ship(df.sparkSession)
    pages = df.select(F.col(id_col).alias("id"), F.coalesce(site, F.lit("")).alias("site"), F.col(text_col).cast("string").alias("text")).where(
        F.col("text").rlike(r"(?U)\S")
    )
    tokens = cut(template_tokens(pages))
    if tokens.count() * _ROW_BYTES <= BROADCAST_BYTES:
        everywhere = tokens.where("site is null").select("token", "opens").collect()
        shared, opening = ({r["token"] for r in everywhere if r["opens"] == opens} for opens in (False, True))
        own = tokens.where("site is not null").groupBy("site").agg(F.collect_set("token").alias("template"))
        joined = pages.join(F.broadcast(own), "site", "left").withColumn("opening", F.lit(None).cast("array<bigint>"))
    else:
        shared, opening, joined = set(), set(), _with_own_template(pages, tokens)
    known = df.sparkSession.sparkContext.broadcast((frozenset(shared), frozenset(opening)))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared, opening = known.value
        sets: dict[bytes, frozenset[int]] = {}
        for b in batches:
            ids, numbers = [], []
            sets.clear()
            for i, text, template, opens in zip(b["id"], b["text"], b["template"], b["opening"]):
                own = shared
                if template is not None:
                    name = template.tobytes()
                    own = sets.get(name)
                    if own is None:
                        own = sets[name] = shared.union(template.tolist())
                found = furniture_of(text, own, opening if opens is None else frozenset(opens.tolist()))
                ids += [i] * len(found)
                numbers += found
            yield pd.DataFrame({"id": ids, "line_no": numbers})

    kind = df.schema[id_col].dataType.simpleString()
    out = joined.select("id", "text", "template", "opening").mapInPandas(extract, f"id {kind}, line_no int")
    return out.withColumnRenamed("id", id_col)
