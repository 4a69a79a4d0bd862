"""Pieces of SQL that several queries' counterparts share."""

from __future__ import annotations

from hecespark.functions import chars
from hecespark.operators import text

WORD = text.WORD.replace("'", "''")
SPACE_SQL = text.SPACE
for _c in ("\\u1680", "\\u2000", "\\u200a", "\\u2028", "\\u2029", "\\u202f", "\\u205f", "\\u3000"):
    SPACE_SQL = SPACE_SQL.replace(_c, f"\\x{{{_c[2:]}}}")
CHUNK = f"[{text.WORD}]+|[{SPACE_SQL}]+|[^{text.WORD}{SPACE_SQL}]+"
KIND = f"CASE WHEN regexp_matches(chunk, '^[{WORD}]') THEN 'word' WHEN regexp_matches(chunk, '^[{SPACE_SQL}]') THEN 'space' ELSE 'punct' END"


def quoted(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else "'" + str(x).replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS v({columns})"


TOKENS = f"""SELECT translate(translate(word, '{chars.CAPITAL}', '{chars.SMALL}'), '{chars.CIRCUMFLEX}', '{chars.PLAIN}') AS token
FROM (SELECT unnest(regexp_extract_all(text, '[{WORD}]+')) AS word FROM documents)"""


def applied(stems: str, templates: tuple[str, ...]) -> str:
    """Each template on each stem, a step for each of its segments."""
    import re

    def vowel(s: str) -> str:
        return f"coalesce(nullif(regexp_extract({s}, '(?s).*([{chars.VOWELS}])', 1), ''), '')"

    ctes, ends = [f"stems AS ({stems})"], []
    for n, t in enumerate(templates):
        segments = re.findall(r"\(.\)|.", t)
        first = segments[0]
        buffer = first.startswith("(")
        letter = segments[1] if buffer and len(segments) > 1 else first
        opens = letter in "AH" or letter in chars.VOWELS
        ends_in_vowel = f"contains('{chars.VOWELS}', right(stem, 1))"
        soft = f"left(stem, length(stem) - 1) || translate(right(stem, 1), '{chars.HARD}', '{chars.SOFT}')"
        start = "stem" if not opens else f"CASE WHEN {ends_in_vowel} THEN stem ELSE {soft} END" if buffer else soft
        ctes.append(f"t{n}_0 AS (SELECT stem, {start} AS s FROM stems)")
        for k, x in enumerate(segments):
            hard = f"contains('{chars.VOICELESS}', right(s, 1))"
            piece = {
                "A": f"CASE WHEN {vowel('s')} IN ('a','ı','o','u') THEN 'a' ELSE 'e' END",
                "H": f"CASE WHEN {vowel('s')} IN ('a','ı') THEN 'ı' WHEN {vowel('s')} IN ('o','u') THEN 'u' WHEN {vowel('s')} IN ('ö','ü') THEN 'ü' ELSE 'i' END",
                "D": f"CASE WHEN {hard} THEN 't' ELSE 'd' END", "C": f"CASE WHEN {hard} THEN 'ç' ELSE 'c' END", "G": f"CASE WHEN {hard} THEN 'k' ELSE 'g' END",
            }.get(x, f"CASE WHEN contains('{chars.VOWELS}', right(s, 1)) THEN '{x[1:2]}' ELSE '' END" if len(x) == 3 else f"'{x}'")
            ctes.append(f"t{n}_{k + 1} AS (SELECT stem, s || {piece} AS s FROM t{n}_{k})")
        ends.append(f"SELECT stem, '{t}' AS template, s AS surface FROM t{n}_{len(segments)}")
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(ends)}"
