"""Speech transcripts into clean, ordered speaker turns.

Each text is cut into labelled stretches, and these at their cues into timed segments; where every stretch has a
stamp, a sweep over the segments' starts and ends orders them and measures the silence before each. Segments left
with nothing but fillers and sound notes are dropped, captions that roll over (a suffix of one segment repeated as
the prefix of the next, of any length) are cut, and adjacent segments of one person become one turn. With
``pauses``, a silence far longer than the silences of that transcript also ends a turn: longer than their median by
``PAUSE_DEVIATIONS`` scaled median absolute deviations and by ``PAUSE_LEAST`` seconds. Where cues give no end, it is
the start plus the transcript's own time a word.

Defined results: null, blank and unlabelled texts give no turn; a label that is only a role stands for
the given speaker, or, where that is null or names nobody, for the person labelled most often with a
role, or else for the role itself; repeated rows give repeated turns; equal stamps keep text order; an
empty table gives an empty result; columns other than id, text and speaker are ignored. Texts of any
length are read whole, in time linear in their length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.runtime import ship

#: A silence ends a turn beyond so many scaled deviations from a transcript's median silence, and so many seconds.
PAUSE_DEVIATIONS, PAUSE_LEAST = 5.0, 2.0
#: Words that must repeat for a caption to have rolled over.
ROLLED_WORDS = 4
#: Words that are a role, words for the moderator and for unnamed questioners, fillers.
ROLES = frozenset(
    "the chair chairman chairwoman chairperson governor president vice deputy member board director secretary mr ms mrs dr prof sir "
    "madam pres gov chr supervision for of honorable honourable hon".split()
)
MODERATOR = frozenset(("moderator", "mod", "host", "operator"))
QUESTION = frozenset(("q", "question", "questioner", "reporter", "journalist", "audience"))
FILLERS = frozenset("uh um er hmm ah eh mm erm uhm mhm hm".split())

_STAMP = r"[\[(<]?\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?[\])>]?"
_TOKEN = r"(?:[^\W\d_][\w'’\-]*\.?)"
_LABEL = rf"(?P<label>(?=[^\W\d_a-z]){_TOKEN}(?:\s+(?:(?=[^\W\d_a-z]){_TOKEN}|of|for|de|van|von|der)){{0,5}}?)(?:\s+\([^()\d\n]{{2,60}}\))?"
_FORMS = {
    "colon": re.compile(rf"(?:>>+\s*)?(?:(?P<stamp>{_STAMP})\s+)?{_LABEL}\s*(?:(?P<late>{_STAMP})\s*)?:(?:\s+(?P<rest>.*)|$)"),
    "above": re.compile(rf"(?:>>+\s*)?{_LABEL}\s+(?P<late>{_STAMP})(?P<rest>)$"),
    "dash": re.compile(rf"(?:>>+\s*)?(?:(?P<stamp>{_STAMP})\s+)?{_LABEL}\s*\.?\s*[—–](?:\s+(?P<rest>.*)|$)"),
    "dot": re.compile(rf"(?:>>+\s*)?(?:(?P<stamp>{_STAMP})\s+)?{_LABEL}\.(?:\s+(?P<rest>.*)|$)"),
}
_CUE = re.compile(rf"\s*(?:\d+\s+)?({_STAMP})\s*-+>\s*({_STAMP})\s*$")
_MAYBE = re.compile(r"(?mi)^[\s>]*(?:[\[(<]?\d{1,3}:\d{2}[\d:.,]*[\])>]?\s*)?(?:the\s+)?(?:mod\b|moderator|q\b|question|reporter|chair|governor|president|gov\b|pres\b|[^\W\d_]+(?:\s[^\W\d_]+)?\s*(?::|[\[(]?\d{1,3}:\d{2}|—))")
_NOTE = re.compile(r"\[[^\]\n]*\]|\([^()\n]*\)|\*[^*\n]+\*|<[^<>\n]*>|♪[^♪\n]*♪?")
_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
_SPOKEN = re.compile(r"(?i)(?:^|(?<=[\s,.;]))(?:uh|um|er|hmm|ah|eh|mm|erm|uhm|mhm|hm)\b[,.…]*\s*|\b(?:you know|I mean),\s*")


def _seconds(stamp: str | None) -> float | None:
    if not stamp:
        return None
    out = 0.0
    for part in stamp.strip("[]()<>").replace(",", ".").split(":"):
        out = out * 60 + float(part)
    return out


def _kind(label: str) -> tuple[str, str]:
    """('moderator' | 'question' | 'role' | 'titled' | 'name', the family name or the role)."""
    words = [w.strip(".'’").lower() for w in label.split()]
    words = [w for w in words if w]
    bare = [w for w in words if w != "the"]
    if bare and all(w in MODERATOR for w in bare):
        return "moderator", "moderator"
    if bare and all(w in QUESTION for w in bare):
        return "question", "question"
    rest = [w for w in bare if w not in ROLES]
    if not rest:
        return "role", " ".join(bare)
    return ("titled" if len(rest) < len(bare) else "name"), rest[-1]


def family_name(speaker: str | None) -> str | None:
    """Family name, lower-cased, of a speaker field such as 'Governor A. Name' or 'Name, A.'; None where it names nobody."""
    if not speaker or speaker.strip().lower() in ("", "nan", "none", "null"):
        return None
    head, _, tail = speaker.partition(",")
    if tail and all(w.strip(".").lower() in ROLES | {"ph", "ph.d", "phd", "md"} for w in tail.split()):
        tail = ""
    words = [w.strip(".").lower() for w in (head if tail or "," in speaker else speaker).split()]
    words = [w for w in words if w and w not in ROLES and not w.startswith('"')]
    return words[-1] if words else None


def _speaks(text: str) -> bool:
    return any(w.lower() not in FILLERS for w in _WORD.findall(_NOTE.sub(" ", text)))


def _stretches(text: str) -> list[list[list]]:
    """The labelled stretches in text order, each a list of segments [kind, name, start, end, text]; none if the text is no transcript."""
    lines = [x.rstrip("\r").strip() for x in text.split("\n")]
    best, most = None, 0
    for name, form in _FORMS.items():
        strong = 0
        for line in lines:
            m = form.match(line)
            if m:
                kind, who = _kind(m["label"])
                if kind != "name" and who not in FILLERS:
                    strong += 1
        if strong > most:
            best, most = name, strong
    if best is None:
        return []
    form, cue = _FORMS[best], (None, None)
    out: list[list[list]] = []
    held: list[list[str]] = []
    for line in lines:
        c = _CUE.match(line)
        if c:
            cue = (_seconds(c[1]), _seconds(c[2]))
            continue
        m = form.match(line)
        kind, who = _kind(m["label"]) if m else ("", "")
        if m and who not in FILLERS:
            found = m.groupdict()
            at = _seconds(found.get("stamp") or found.get("late"))
            start, end = (at, None) if at is not None else cue
            held.append([found.get("rest") or ""])
            out.append([[kind, who, start, end, held[-1]]])
            cue = (None, None)
        elif out and line:
            if cue[0] is not None:
                held.append([])
                out[-1].append([*out[-1][-1][:2], *cue, held[-1]])
                cue = (None, None)
            held[-1].append(line)
    return [[[kind, who, start, end, "\n".join(x for x in own if x)] for kind, who, start, end, own in stretch] for stretch in out]


def overlap(before: list[str], after: list[str]) -> int:
    """Length of the longest suffix of ``before`` that is a prefix of ``after``, in time linear in ``after``."""
    if not after:
        return 0
    joined = [*after, None, *before[-len(after) :]]
    border = [0] * len(joined)
    for i in range(1, len(joined)):
        k = border[i - 1]
        while k and joined[i] != joined[k]:
            k = border[k - 1]
        border[i] = k + (joined[i] == joined[k])
    return border[-1] if len(joined) > len(after) + 1 else 0


def _swept(segments: list[list]) -> list[list]:
    """Segments in the order of their starts, each with the silence since all earlier ones ended."""
    timed = sorted(segments, key=lambda x: x[2])
    steps = [(b[2] - a[2]) / n for a, b in zip(timed, timed[1:]) if (n := a[4].count(" ") + 1) and b[2] > a[2]]
    pace = median(steps) if steps else 0.0
    out, reached = [], None
    for kind, who, start, end, said in timed:
        silence = 0.0 if reached is None else max(start - reached, 0.0)
        out.append([kind, who, start, silence, said])
        stop = end if end is not None and end >= start else start + pace * (said.count(" ") + 1)
        reached = stop if reached is None else max(reached, stop)
    return out


def _longest_usual(silences: list[float]) -> float:
    middle = median(silences)
    return max(middle + PAUSE_DEVIATIONS * 1.4826 * median(abs(x - middle) for x in silences), PAUSE_LEAST)


def turns_of(text: str | None, speaker: str | None, pauses: bool = False) -> list[tuple[int, str, float | None, str]]:
    """(turn_no, who, start, text) of one transcript."""
    if not text or not _MAYBE.search(text):
        return []
    cut = _stretches(text)
    main = family_name(speaker)
    if main is None:
        titled = Counter(x[0][1] for x in cut if x[0][0] == "titled")
        main = titled.most_common(1)[0][0] if titled else None
    timed = bool(cut) and all(x[2] is not None for stretch in cut for x in stretch)
    segments = [x for stretch in cut for x in stretch]
    segments = _swept(segments) if timed else [[kind, who, start, 0.0, said] for kind, who, start, _, said in segments]
    limit = _longest_usual([x[3] for x in segments[1:]]) if pauses and timed and len(segments) > 1 else float("inf")
    out: list[list] = []
    for kind, who, at, silence, said in segments:
        if not _speaks(said):
            continue
        if kind == "role" and main:
            who = main
        words = _SPOKEN.sub("", _NOTE.sub(" ", said)).split()
        same = bool(out) and out[-1][0] == who
        rolled = overlap(out[-1][2], words) if out else 0
        if rolled >= ROLLED_WORDS and (same or rolled < len(words)):
            words = words[rolled:]
        if same and silence <= limit:
            out[-1][2] += words
        else:
            out.append([who, at, words])
    return [(n, who, at, " ".join(words)) for n, (who, at, words) in enumerate(out, 1)]


def speaker_turns(
    df: DataFrame, id_col: str = "fomc_id", text_col: str = "text_content", speaker_col: str = "speaker", pauses: bool = False
) -> DataFrame:
    """(id, turn_no, who, start_s, text): one row per turn of each text with speaker labels."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *t) for i, text, who in zip(b["id"], b["text"], b["who"]) for t in turns_of(text, who, pauses)]
            yield pd.DataFrame(rows, columns=["id", "turn_no", "who", "start_s", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(speaker_col).cast("string").alias("who")
    ).mapInPandas(run, f"id {kind}, turn_no int, who string, start_s double, text string")
    return out.withColumnRenamed("id", id_col)
