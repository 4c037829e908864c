"""Variant spellings of names typed by people, linked through canonical rewritings.

Every distinct name is parsed (titles, degrees, quoted nicknames, order, case, accents and legal forms
resolved) and rewritten into all canonical forms its nickname, initial, order and one-letter deletions
allow. Forms are exploded and equi-joined; a pair is scored by how rare its shared forms are and kept
only if an exact check of the parts agrees; of pairs a typing error apart, only those that no pair of either of
their names outscores by far, so that a name between two others joins the one it shares the rarer rewritings with. Full names, linked first, make the entities; a name with an
initial, a shortened given name or no given name joins the one entity it fits and stays alone where
several different ones fit.

The join runs on distinct parsed names, so a name that fills a third of the rows is one row of it, and
only forms that at least two names share enter it. Defined results: null, blank and 'nan' name nobody and are left out; repeated rows count
once; an empty table gives an empty result; columns other than the name are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.runtime import cut, ship

#: Nicknames and the given names they stand for.
NICKNAMES = """
abby: abigail; alex: alexander alexandra alexis; al: alan albert alexander; sasha: alexander alexandra; andy: andrew; drew: andrew; tony: anthony antonio;
ben: benjamin; benny: benjamin; bill: william; billy: william; will: william; liam: william; bob: robert; bobby: robert; rob: robert;
becky: rebecca; becca: rebecca; beth: elizabeth bethany; liz: elizabeth; lizzie: elizabeth; betty: elizabeth; eliza: elizabeth; charlie: charles charlotte;
chuck: charles; chris: christopher christine christina; kit: christopher; dan: daniel; danny: daniel; deb: deborah; debbie: deborah; dot: dorothy;
dottie: dorothy; dolly: dorothy; ed: edward edwin edmund; eddie: edward; ted: edward theodore; ned: edward; ellie: eleanor ellen; nora: eleanor honora; nell: eleanor; fran: francesca frances francis;
frankie: francesca francis; chess: francesca; fred: frederick alfred; freddie: frederick; gabe: gabriel; gaby: gabriel gabriella; greg: gregory; hal: harold henry; harry: harold henry;
jim: james; jimmy: james; jamie: james; jen: jennifer; jenny: jennifer; joe: joseph; joey: joseph; jon: jonathan; johnny: jonathan john; judy: judith; judi: judith; kate: katherine;
kathy: katherine; katie: katherine; kitty: katherine; larry: lawrence; laurie: lawrence; len: leonard; leo: leonard; lenny: leonard; maggie: margaret; meg: margaret; peg: margaret;
peggy: margaret; matt: matthew; mike: michael; mick: michael; nick: nicholas; nico: nicholas; pat: patricia patrick; patty: patricia; tricia: patricia; trish: patricia; phil: philip philippa; pippa: philippa;
rick: richard; rich: richard; dick: richard; ron: ronald; ronnie: veronica ronald; vera: veronica; sam: samuel samantha; sammy: samuel; steve: stephen steven; sue: susan; susie: susan; theo: theodore;
teddy: theodore edward; tim: timothy; timmy: timothy; tom: thomas tomas; tommy: thomas; vicky: victoria; vic: victor victoria; tori: victoria
"""
NICKNAME_OF = {k.strip(): frozenset(v.split()) for k, _, v in (x.partition(":") for x in NICKNAMES.split(";")) if k.strip()}
TITLES = frozenset(
    "the chair chairman chairwoman chairperson chr vice v vc governor gov president pres member board honorable honourable hon dr mr mrs ms prof sir dame "
    "deputy for supervision secretary director ph.d phd ph.d. md jr sr esq cfa".split()
)
#: Legal forms and their short forms, as whole words.
LEGAL = {
    "bk": "bank", "cttee": "committee", "comm": "committee", "com": "committee", "mon": "monetary", "inst": "institute", "bd": "board", "res": "reserve",
    "bnk": "bank", "auth": "authority", "assoc": "association", "dept": "department", "corp": "corporation", "co": "company", "fed": "federal",
    "natl": "national", "intl": "international", "univ": "university", "stud": "studies",
}
ORG_WORDS = frozenset("bank committee institute board reserve monetary studies authority association council fund department corporation company university".split())
#: Two names an edit apart are a typing error if their score is this share of the best score of one of them.
BEST_SHARE = 0.2
SALTS = 8
_OF = frozenset("of for the and de du la".split())
_QUOTED = re.compile(r"[\"“”']([^\"“”']+)[\"“”']")


def _fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def _edits(a: str, b: str) -> int:
    """Edit distance with transpositions, exact up to 1 and 2 beyond."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1:
        return 2
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    if x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:]):
        return 1
    return 2


_RANKS = (("supervision", "vice supervision"), ("vice", "vice"), ("vc", "vice"), ("v", "vice"), ("governor", "governor"), ("gov", "governor"),
          ("president", "president"), ("pres", "president"), ("member", "member"), ("chair", "chair"), ("chairman", "chair"),
          ("chairwoman", "chair"), ("chairperson", "chair"), ("chr", "chair"))


def _title(words: set[str]) -> str:
    return next((rank for word, rank in _RANKS if word in words), "")


def _near_word(word: str, known: frozenset) -> str | None:
    if word in known:
        return word
    if len(word) < 4:
        return None
    hits = [k for k in known if len(k) > 3 and k[0] == word[0] and _edits(word, k) == 1]
    return hits[0] if len(hits) == 1 else None


def parse(name: str) -> dict | None:
    """Parts of one name: kind 'org', 'full', 'short' or 'family' with org key, given, middle and family."""
    text = _fold(name).strip()
    if not text or text in ("nan", "none", "null"):
        return None
    tokens = [t for t in re.split(r"[^\w.'’\-]+", text.replace(".", ". ")) if t.strip(".-'")]
    plain = [LEGAL.get(t.strip("."), t.strip(".")) for t in tokens]
    marks = [_near_word(t, ORG_WORDS) for t in plain]
    solid = [m for m in marks if m]
    titles_only = all(m == "board" for m in solid) and any(t == "member" for t in plain)
    if solid and not titles_only:
        rest = [t for t, m in zip(plain, marks) if not m and t not in _OF]
        if rest:
            return {"kind": "org", "given": " ".join(sorted(set(solid))), "middle": "", "title": "", "family": " ".join(sorted(rest)), "free": False}
    quoted = _QUOTED.search(name)
    body = _QUOTED.sub(" ", name) if quoted else name
    body = re.sub(r"(?i)\bvice chair,\s*supervision\b", " ", body)
    head, _, tail = _fold(body).partition(",")
    split = lambda s: [w for w in (x.strip(".'’-") for x in re.split(r"[^\w.'’\-]+", s.replace(".", ". "))) if w]
    tail_words = split(tail)
    if tail_words and all(w in TITLES or w in ("ph", "d") for w in tail_words):
        words, swapped = split(head), False
    elif tail_words:
        words, swapped = tail_words + split(head), True
    else:
        words, swapped = split(head), False
    abbreviated = bool(re.match(r"\s*[^\W\d_]{3}\.\s", body)) and _fold(body).split(".")[0].strip() not in TITLES
    if not abbreviated and not swapped and len(words) > 1 and words[0] == "v" and words[1] == "chair":
        words = words[1:]
    title = _title(set(split(_fold(_QUOTED.sub(" ", name)))) - {words[-1]} if words else set())
    words = [w for w in words if w not in TITLES or (len(w) == 1 and w == "v")]
    if not words:
        return None
    family = words[-1]
    given = words[0] if len(words) > 1 else ""
    middle = words[1][0] if len(words) > 2 and len(words[1]) <= 2 else ""
    if len(words) > 2 and not middle and len(words[1]) > 2:
        family = " ".join(words[1:])
    if not given:
        kind = "family"
    elif len(given) == 1 or abbreviated:
        kind = "short"
    else:
        kind = "full"
    free = kind == "full" and not swapped and len(words) == 2
    return {"kind": kind, "given": given, "middle": middle, "title": title, "family": family, "free": free}


def _givens(given: str) -> set[str]:
    return set(NICKNAME_OF.get(given, ())) | {given}


def _deletions(word: str) -> list[str]:
    return [word, *{word[:i] + word[i + 1 :] for i in range(len(word))}] if len(word) > 3 else [word]


def _orders(given: str, family: str, free: bool) -> list[tuple[str, str]]:
    return [(given, family), (family, given)] if free else [(given, family)]


def rewritings(kind: str, given: str, family: str, free: bool) -> dict[str, int]:
    """Canonical forms of a full name or organisation, with the number of one-letter deletions each needed."""
    if kind == "org":
        return {f"o|{given}|{f}": int(f != family) for f in _deletions(family)}
    out: dict[str, int] = {}
    for first, last in _orders(given, family, free):
        for g in _givens(first):
            for gd in _deletions(g):
                for fd in _deletions(last):
                    form, cost = f"p|{gd}|{fd}", int(gd != g) + int(fd != last)
                    out[form] = min(cost, out.get(form, 9))
    return out


def agree(a: tuple, b: tuple) -> int:
    """0 for no, 1 for equal up to nicknames and order, 2 for equal up to one edit in each part. (kind, given, family, free)."""
    if a[0] == "org" or b[0] == "org":
        if a[0] != b[0] or a[1] != b[1]:
            return 0
        return (1, 2, 0)[_edits(a[2], b[2])]
    best = 0
    for ga, fa in _orders(*a[1:]):
        for gb, fb in _orders(*b[1:]):
            gap = _edits(fa, fb)
            if gap > 1:
                continue
            xs, ys = _givens(ga), _givens(gb)
            if xs & ys:
                best = 1 if gap == 0 else best or 2
            elif any(_edits(x, y) <= 1 for x in xs for y in ys if min(len(x), len(y)) > 3):
                best = best or 2
    return best


def _parsed(df: DataFrame, name_col: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(n, p) for n, p in ((n, parse(n)) for n in b["name"]) if p]
            keys = ("kind", "given", "middle", "title", "family", "free")
            yield pd.DataFrame([(n, *(p[k] for k in keys)) for n, p in rows], columns=["name", *keys])

    names = df.select(F.col(name_col).cast("string").alias("name")).where(F.col("name").isNotNull()).distinct()
    return names.mapInPandas(run, "name string, kind string, given string, middle string, title string, family string, free boolean")


def _links(nodes: DataFrame) -> DataFrame:
    """(a, b, score): pairs of different nodes that name the same, scored by the rarity of their shared forms."""

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (form, cost, *r)
                for r in b[["node", "kind", "given", "family", "free"]].itertuples(index=False, name=None)
                for form, cost in rewritings(*r[1:]).items()
            ]
            yield pd.DataFrame(rows, columns=["form", "cost", "node", "kind", "given", "family", "free"])

    fields = "node string, kind string, given string, family string, free boolean"
    forms = nodes.select("node", "kind", "given", "family", "free").mapInPandas(rewrite, f"form string, cost int, {fields}")
    forms = cut(forms.repartition("form"))
    shared = forms.groupBy("form").agg(F.count("*").alias("df")).where("df > 1")
    kept = forms.join(shared, "form")
    sides = [kept.select("form", "df", *[F.col(c).alias(f"{c}_{s}") for c in ("cost", "node", "kind", "given", "family", "free")]) for s in "ab"]
    pairs = (
        sides[0]
        .join(sides[1].drop("df"), "form")
        .where("node_a < node_b")
        .groupBy("node_a", "node_b", *[f"{c}_{s}" for s in "ab" for c in ("kind", "given", "family", "free")])
        .agg(F.sum(F.pow(F.lit(0.5), F.col("cost_a") + F.col("cost_b")) / F.col("df")).alias("score"))
    )

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                how = agree((r.kind_a, r.given_a, r.family_a, r.free_a), (r.kind_b, r.given_b, r.family_b, r.free_b))
                if how:
                    out.append((r.node_a, r.node_b, r.score, how == 2))
            yield pd.DataFrame(out, columns=["a", "b", "score", "typed"])

    judged = cut(pairs.mapInPandas(check, "a string, b string, score double, typed boolean"))
    ends = judged.select(F.explode(F.array("a", "b")).alias("node"), "score")
    best = ends.groupBy("node").agg(F.max("score").alias("best"))
    rated = judged
    for side in "ab":
        rated = rated.join(best.select(F.col("node").alias(side), F.col("best").alias(f"best_{side}")), side)
    return rated.where(~F.col("typed") | (F.col("score") >= BEST_SHARE * F.least("best_a", "best_b"))).select("a", "b", "score")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, entity): connected components by least label and label of the label, the lineage cut after every round."""
    both = cut(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))))
    linked = cut(both.select("node").distinct().withColumn("entity", F.col("node")))
    while True:
        heard = both.join(linked.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("entity").alias("heard"))
        step = linked.join(heard, "node").select("node", F.least("entity", "heard").alias("near"), "entity")
        onward = linked.select(F.col("node").alias("near"), F.col("entity").alias("far"))
        step = cut(step.join(onward, "near").select("node", F.least("near", "far").alias("entity"), (F.least("near", "far") < F.col("entity")).alias("moved")))
        linked = step.select("node", "entity")
        if step.where("moved").isEmpty():
            break
    return nodes.select("node").join(linked, "node", "left").select("node", F.coalesce("entity", "node").alias("entity"))


def _attach(mentions: DataFrame, entities: DataFrame, keys: list[str]) -> DataFrame:
    """(name, entity): the one entity each mention fits by ``keys``, then by middle initial, then by title."""
    wanted = mentions.select("name", "middle", "title", *keys)
    fit = wanted.join(entities.select("entity", "middles", "titles", *keys).distinct(), keys)
    marked = {"middle": F.array_contains("middles", F.col("middle")), "title": F.array_contains("titles", F.col("title"))}
    kinds = {"all": F.col("entity"), **{k: F.when((F.col(k) != "") & held, F.col("entity")) for k, held in marked.items()}}
    judged = fit.groupBy("name").agg(*[end(c).alias(f"{k}_{end.__name__}") for k, c in kinds.items() for end in (F.min, F.max)])
    one = [F.when(F.col(f"{k}_min") == F.col(f"{k}_max"), F.col(f"{k}_min")) for k in kinds]
    return judged.select("name", F.coalesce(*one).alias("entity"))


def name_entities(df: DataFrame, name_col: str = "participant") -> DataFrame:
    """(name, entity): every distinct stored name that names somebody, with the id of whom it names."""
    ship(df.sparkSession)
    parsed = cut(_parsed(df, name_col))
    whole = parsed.where("kind in ('full', 'org')").withColumn("node", F.concat_ws("|", "kind", "given", "family"))
    nodes = cut(
        whole.groupBy("node", "kind", "given", "family").agg(F.max("free").alias("free"))
    )
    groups = components(nodes, _links(nodes))
    known = cut(whole.join(groups, "node").select("name", "kind", "given", "middle", "title", "family", "entity"))
    people = known.where("kind = 'full'")
    marks = people.groupBy("entity").agg(F.collect_set("middle").alias("middles"), F.collect_set("title").alias("titles"))
    parts = people.select("entity", "given", "family").distinct()
    parts = parts.unionByName(parts.select("entity", F.col("family").alias("given"), F.col("given").alias("family")))
    forms = parts.select("entity", "family", F.explode(_beginnings(F.col("given"))).alias("given")).distinct().join(marks, "entity")
    short = parsed.where("kind = 'short'")
    first = cut(_attach(short, forms, ["family", "given"]))
    family = parsed.where("kind = 'family'")
    second = cut(_attach(family, forms, ["family"]))
    placed = first.unionByName(second).where("entity is not null").select("name", "entity")
    loose = short.unionByName(family).join(first.unionByName(second).select("name"), "name", "left_anti")
    typed = cut(
        _mistyped(short.join(loose.select("name"), "name", "left_semi"), forms, ["given"]).unionByName(
            _mistyped(family.join(loose.select("name"), "name", "left_semi"), forms, [])
        )
    )
    placed = placed.unionByName(typed.where("entity is not null").select("name", "entity"))
    left = loose.join(typed.select("name"), "name", "left_anti")
    alone = left.select("name", F.concat_ws("|", F.lit("own"), F.substring("given", 1, 1), "family").alias("entity"))
    unclear = first.unionByName(second).unionByName(typed).where("entity is null").select("name", F.concat(F.lit("unclear|"), F.col("name")).alias("entity"))
    return known.select("name", "entity").unionByName(placed).unionByName(alone).unionByName(unclear)


def _beginnings(given: Column) -> Column:
    """First letter and first three letters of a given name and of the names it may be short for."""
    known = F.create_map(*[x for k, v in sorted(NICKNAME_OF.items()) for x in (F.lit(k), F.array(*map(F.lit, sorted(v))))])
    names = F.concat(F.array(given), F.coalesce(F.try_element_at(known, given), F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(F.transform(names, lambda n: F.array(F.substring(n, 1, 1), F.substring(n, 1, 3)))))


def _cuts(word: Column) -> Column:
    """``_deletions`` as an expression."""
    without = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    return F.when(F.length(word) > 3, F.array_distinct(F.concat(F.array(word), without))).otherwise(F.array(word))


def _mistyped(mentions: DataFrame, forms: DataFrame, keys: list[str]) -> DataFrame:
    """``_attach`` for mentions whose family name is one letter off, through its one-letter deletions."""
    left = mentions.select("name", "middle", "title", "family", *keys, F.explode(_cuts(F.col("family"))).alias("near"))
    right = forms.select("entity", F.col("family").alias("meant"), "middles", "titles", *keys, F.explode(_cuts(F.col("family"))).alias("near"))
    near = left.join(right, ["near", *keys]).where(F.levenshtein("family", "meant") <= 2)
    return _attach(mentions, near.select("entity", "middles", "titles", "family", *keys).distinct(), ["family", *keys])


def name_pairs(df: DataFrame, name_col: str = "participant") -> DataFrame:
    """(name_a, name_b): all pairs of different stored names of one entity, name_a before name_b in code point order."""
    names = cut(name_entities(df, name_col))
    left = names.select("entity", F.col("name").alias("name_a"), F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int").alias("salt"))
    right = names.select("entity", F.col("name").alias("name_b"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return left.join(right, ["entity", "salt"]).where("name_a < name_b").select("name_a", "name_b")
