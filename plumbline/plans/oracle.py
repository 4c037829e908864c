"""Fragments of the checking SQL that several queries share (DuckDB)."""

from __future__ import annotations

_WS = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def day(c: str) -> str:
    t = f"trim({c})"
    return f"""(CASE
      WHEN regexp_full_match({t}, '[0-9]{{8}}([.]0)?') THEN try_strptime(substr({t}, 1, 8), '%Y%m%d')
      WHEN regexp_full_match({t}, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN try_strptime({t}, '%Y-%m-%d')
      WHEN regexp_full_match({t}, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') THEN try_strptime({t}, '%m/%d/%Y')
      WHEN regexp_full_match({t}, '[A-Za-z]+ [0-9]{{1,2}}, [0-9]{{4}}')
        THEN coalesce(try_strptime({t}, '%B %d, %Y'), try_strptime({t}, '%b %d, %Y')) END)::DATE"""


def site(domain: bool) -> str:
    host = "nullif(regexp_extract(source_url, '^[A-Za-z]+://([^/:?#]+)', 1), '')"
    raw = f"coalesce(domain, {host})" if domain else host
    return f"nullif(regexp_replace(lower(trim({raw})), '^(www|m|amp)[.]', ''), '')"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def words(c: str) -> str:
    return f"len(list_filter(string_split_regex(coalesce({c}, ''), '{_WS}+'), lambda x: x <> ''))"


def hits(c: str, term: str) -> str:
    t = term.replace("'", "''")
    return f"((length(lower(coalesce({c}, ''))) - length(replace(lower(coalesce({c}, '')), '{t}', ''))) // {len(term)})"


def sum_hits(c: str, terms) -> str:
    return "(" + " + ".join(hits(c, t) for t in terms) + ")"


def weighted(c: str, weights: dict[str, float]) -> str:
    return "(" + " + ".join(f"{w} * {hits(c, t)}" for t, w in weights.items()) + ")"


def bounded(c: str, term: str) -> str:
    return f"len(regexp_extract_all(lower(coalesce({c}, '')), '\\b{term}\\b'))"
