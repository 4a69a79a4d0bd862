"""Letters and phonology of Turkish as Column functions: nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS, BACK, FRONT, ROUNDED, HIGH = "aeıioöuü", "aıou", "eiöü", "oöuü", "ıiuü"
CONSONANTS, VOICELESS = "bcçdfgğhjklmnprsştvyz", "pçtkfsşh"
LOW = "aeoö"
#: The letters of the alphabet alone: q, w, x and the circumflexed have no case here.
CAPITAL, SMALL = "ABCÇDEFGĞHIİJKLMNOÖPRSŞTUÜVYZ", "abcçdefgğhıijklmnoöprsştuüvyz"
CIRCUMFLEX, PLAIN = "âîûêôÂÎÛÊÔ", "aiueoAİUEO"
HARD, SOFT = "kptç", "ğbdc"
APOSTROPHES = "'’′"


def _c(s) -> Column:
    return s if isinstance(s, Column) else F.col(s)


def tr_lower(s) -> Column:
    return F.translate(_c(s), CAPITAL, SMALL)


def tr_upper(s) -> Column:
    return F.translate(_c(s), SMALL, CAPITAL)


def fold(s) -> Column:
    return F.translate(_c(s), CIRCUMFLEX, PLAIN)


def etl_lower(s) -> Column:
    return F.lower(F.translate(_c(s), "İI", "iı"))


def one_of(chars: str, c) -> Column:
    """Whether c is one character and in chars."""
    return (F.length(_c(c)) == 1) & _c(c).rlike(f"[{chars}]")


def last_vowel(s) -> Column:
    """null without a vowel."""
    found = F.regexp_extract(_c(s), rf"(?s).*([{VOWELS}])", 1)
    return F.when(found != "", found)


def last_letter(s) -> Column:
    return F.right(_c(s), F.lit(1))


def ends_in(chars: str, s) -> Column:
    return _c(s).rlike(rf"[{chars}]\z")


def ends_in_vowel(s) -> Column:
    return ends_in(VOWELS, s)


def syllables(s) -> Column:
    return F.length(F.regexp_replace(_c(s), rf"[^{VOWELS}]", ""))


def monosyllabic(s) -> Column:
    return syllables(s) == 1


def resolve_a(s) -> Column:
    """a after a back vowel; e after a front one, or none."""
    return F.when(F.coalesce(last_vowel(s), F.lit("e")).rlike(f"[{BACK}]"), "a").otherwise("e")


def resolve_h(s) -> Column:
    v = F.coalesce(last_vowel(s), F.lit("i"))
    return F.when(v.rlike("[aı]"), "ı").when(v.rlike("[ou]"), "u").when(v.rlike("[ei]"), "i").otherwise("ü")


def _voiced(hard: str, soft: str, s) -> Column:
    return F.when(ends_in(VOICELESS, s), hard).otherwise(soft)


def resolve_d(s) -> Column:
    return _voiced("t", "d", s)


def resolve_c(s) -> Column:
    return _voiced("ç", "c", s)


def resolve_g(s) -> Column:
    return _voiced("k", "g", s)


def _last_as(s, source: str, target: str) -> Column:
    s = _c(s)
    return F.concat(F.left(s, F.greatest(F.length(s) - 1, F.lit(0))), F.translate(last_letter(s), source, target))


def soften_final(s) -> Column:
    return _last_as(s, HARD, SOFT)


def harden_final(s) -> Column:
    return _last_as(s, SOFT, HARD)


def starts_with_vowel(template, stem) -> Column:
    """Whether the suffix will begin with a vowel: only its first segment counts, a buffer shows after a vowel."""
    t = _c(template)
    first = F.when(t.rlike(r"\A\("), F.substring(F.regexp_replace(t, r"\A\(.\)", ""), 1, 1)).otherwise(F.substring(t, 1, 1))
    return ~(t.rlike(r"\A\(") & ends_in_vowel(stem)) & first.rlike(f"[AH{VOWELS}]")


def realised(stem: Column, template: Column) -> Column:
    """The template's segments on a stem, left to right; each sees what is there before it."""

    def step(done: Column, segment: Column) -> Column:
        return F.concat(
            done,
            F.when(F.length(segment) == 3, F.when(ends_in_vowel(done), F.substring(segment, 2, 1)).otherwise(""))
            .when(segment == "A", resolve_a(done)).when(segment == "H", resolve_h(done)).when(segment == "D", resolve_d(done))
            .when(segment == "C", resolve_c(done)).when(segment == "G", resolve_g(done)).otherwise(segment),
        )

    return F.aggregate(F.regexp_extract_all(template, F.lit(r"\(.\)|."), F.lit(0)), stem, step)


def apply_suffix(stem, template, soften=True) -> Column:
    """The suffix on the stem, whose last consonant softens before a vowel if ``soften``."""
    stem, template = _c(stem), _c(template)
    soften = F.lit(soften) if isinstance(soften, bool) else soften
    return realised(F.when(soften & starts_with_vowel(template, stem), soften_final(stem)).otherwise(stem), template)


def letters_only(s) -> Column:
    """The word as the parser sees it: small letters, no circumflex, no apostrophe."""
    return F.translate(fold(tr_lower(s)), APOSTROPHES, "")


def apostrophe_at(s) -> Column:
    """How many characters are before the first apostrophe; null without one."""
    at = F.length(F.regexp_extract(_c(s), rf"(?s)\A([^{APOSTROPHES}]*)[{APOSTROPHES}]", 1))
    return F.when(_c(s).rlike(f"[{APOSTROPHES}]"), at)


def title_case(s) -> Column:
    first = F.substring(_c(s), 1, 1)
    return F.coalesce(first != tr_lower(first), F.lit(False))


def to_bool(s) -> Column:
    v = F.lower(F.trim(_c(s)))
    return F.when(v.isin("1", "true", "yes", "on", "t"), True).when(v.isin("0", "false", "no", "off", "f", ""), False)
