"""Text expressions: Column in, Column out, all inside Catalyst."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it (Java's \s alone is ASCII).
SPACE = r"[\t\n\x0B\f\r \x85\xA0  -     　]"
#: Month names and the forms of dates, percentages and basis points that count as figures.
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_SPOKEN_DAY = rf"(?i)\b(?:{_MONTHS})\s+\d{{1,2}},?\s+\d{{4}}\b"
_ISO_DAY = r"\b20\d{2}-\d{2}-\d{2}\b"
_PERCENTAGE = r"\b\d+(?:\.\d+)?\s*%"
_BASIS_POINTS = r"(?i)\b\d+\s*basis\s+points?\b"


def strip(text: Column) -> Column:
    """Text without white space at its ends; null stays null."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column) -> Column:
    """Each run of white space as one blank, ends stripped."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def words(text: Column) -> Column:
    """Array of the words between white space; empty for null and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"{SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def plain_words(text: Column) -> Column:
    """Letters, digits and underscores only, other signs as blanks, collapsed."""
    return collapse(F.regexp_replace(text, r"(?U)[^\w\s]", " "))


def first_characters(text: Column, count: int) -> Column:
    return F.substring(text, 1, count)


def content_hash(text: Column) -> Column:
    """SHA-256 of the stripped text; null counts as empty."""
    return F.sha2(strip(F.coalesce(text, F.lit(""))), 256)


def dates_in(text: Column) -> Column:
    """Dates in words, then ISO dates of this century, in order of appearance."""
    spoken = F.regexp_extract_all(text, F.lit(_SPOKEN_DAY), F.lit(0))
    return F.concat(spoken, F.regexp_extract_all(text, F.lit(_ISO_DAY), F.lit(0)))


def percentages_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_PERCENTAGE), F.lit(0))


def basis_points_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_BASIS_POINTS), F.lit(0))


def _quoted(term: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in term.lower())


def substring_hits(text: Column, term: str) -> Column:
    """Occurrences of ``term`` anywhere, also inside words; 0 for null. Sizes are compared in bytes, which needs no pass over the text."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return ((F.octet_length(lower) - F.octet_length(F.replace(lower, F.lit(term.lower()), F.lit("")))) / len(term.lower().encode())).cast("int")


def bounded_hits(text: Column, term: str) -> Column:
    """Occurrences of ``term`` between word boundaries; 0 for null."""
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"\b{_quoted(term)}\b"))


def total(columns: Iterable[Column]) -> Column:
    out = None
    for c in columns:
        out = c if out is None else out + c
    return out if out is not None else F.lit(0)


def sum_substring_hits(text: Column, terms: Iterable[str]) -> Column:
    return total(substring_hits(text, t) for t in terms)


def sum_bounded_hits(text: Column, terms: Iterable[str]) -> Column:
    """Sum of ``bounded_hits``: terms that share no word cannot overlap and are counted in one pass together."""
    groups: list[tuple[set[str], list[str]]] = []
    for term in terms:
        own = set(term.lower().split())
        for held, members in groups:
            if not held & own:
                held |= own
                members.append(term)
                break
        else:
            groups.append((own, [term]))
    lower = F.lower(F.coalesce(text, F.lit("")))
    patterns = ("|".join(_quoted(t) for t in sorted(members, key=len, reverse=True)) for _, members in groups)
    return total(F.regexp_count(lower, F.lit(rf"\b(?:{p})\b")) for p in patterns)


def hit_map(text: Column, terms: Iterable[str], bounded: bool = False) -> Column:
    """Map of term to its hits; without zeros where ``bounded``."""
    count = bounded_hits if bounded else substring_hits
    out = F.create_map(*[x for t in terms for x in (F.lit(t), count(text, t))])
    return F.map_filter(out, lambda _, n: n > 0) if bounded else out


def weighted_score(text: Column, weights: dict[str, float]) -> Column:
    """Sum of weight times hits anywhere; overlapping terms each count."""
    return total(F.lit(float(w)) * substring_hits(text, t) for t, w in weights.items())


def sentence_count(text: Column) -> Column:
    """Stretches between full stops, question and exclamation marks that are not blank; at least 1."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), "[.!?]+"), lambda s: F.length(strip(s)) > 0)
    return F.greatest(F.size(parts), F.lit(1))


def prefix_size(count: Column, percent: Column) -> Column:
    """How many of ``count`` words are ``percent`` of them (kept in 1..100), rounded up, at least one."""
    share = F.least(F.greatest(percent, F.lit(1)), F.lit(100))
    return F.greatest(F.ceil(count * share / F.lit(100)).cast("int"), F.lit(1))


def prefix(text: Column, percent: Column) -> Column:
    """The first ``percent`` of a text's words joined by blanks."""
    own = words(text)
    return F.array_join(F.slice(own, F.lit(1), prefix_size(F.size(own), percent)), " ")


def person_key(name: Column) -> Column:
    """A name without leading role words, in lower case, other signs than letters and digits as single blanks."""
    roles = r"(?i)^\s*(?:(?:vice\s+)?chair(?:man|woman)?(?:\s+for\s+supervision)?|governor|president)\s+"
    bare = F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), roles, "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(bare), "[^a-z0-9 ]+", " "), r"\s+", " "))


def snippet(text: Column, needle: str, before: int, after: int) -> Column:
    """The surroundings of the first occurrence of a literal, letter case aside; null where it is absent."""
    at = F.instr(F.lower(text), needle.lower())
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.trim(F.substr(text, start, at + F.lit(after) - start)))
