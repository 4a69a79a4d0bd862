"""Compiling the grammar: every shape that a suffix can take, as rows that a word's surface is joined with.

What a suffix looks like depends on little of what stands before it: the last vowel, the last letter's kind, whether there is
one syllable. Those make a *context* number. What else rules look at (the suffix before, flags of the root) is a set of bits: a row
asks for some, a fragment has some. So matching a template at a place of a word is an equi-join on (state, context) with a comparison of
literals, and no rule runs at query time.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hecespark.functions import chars
from hecespark.sources import dims

NEG, NOT_NEG, WITH_N, WITHOUT_N, AFTER_ZERO_AORIST, NOT_AFTER_ZERO_AORIST, HIGH_AORIST, LOW_AORIST = (1 << k for k in range(8))
VOWEL_KINDS = ("", "aı", "ei", "ou", "öü")
LETTER_KINDS = ("vowel", "l", "r", "voiceless", "other")
END, FINAL = "$", "$END"


@dataclass(frozen=True)
class Weights:
    """What scores are made of. ``oov`` and ``oov_letter`` are of an unknown root and its letters, up to ``max_oov`` of them; ``letter`` and
    ``suffix`` of a suffix that shows, ``empty`` of one that doesn't; ``title_oov`` of an unknown root that is a capitalised word as it is."""

    max_oov: int = 12
    min_oov: int = 1
    oov: float = -50.0
    oov_letter: float = 0.35
    root_letter: float = 0.15
    bare: float = 0.5
    derivation: float = -2.0
    productive: float = 2.5
    rare: float = -3.0
    voice: float = -2.2
    compound: float = -2.5
    apostrophe: float = 3.0
    title: float = 1.0
    title_oov: float = 0.0
    letter: float = 0.5
    suffix: float = -0.2

    @property
    def plain(self) -> bool:
        """Whether no suffix letter is worth more than a known root's bound assumes."""
        return self.letter <= 0.5 and self.suffix <= 0.0 and self.productive <= 2.5 and max(self.derivation, self.rare, self.voice, self.compound, self.title_oov) <= 0.0

    def extra(self, kind: str) -> float:
        return {"prod": self.productive, "rare": self.rare, "voice": self.voice, "cmpd": self.compound, "": 0.0}[kind]


SOFT_OF = dict(zip(chars.HARD, chars.SOFT))


def derivation_bits(templates: dict[str, list[str]]) -> dict[tuple[str, str], int]:
    """A bit for each template that roots license for CAUS_DERIV and PASS_DERIV."""
    every = [(k, t) for k in ("caus", "pass") for t in sorted(templates[k])]
    return {x: 1 << (8 + n) for n, x in enumerate(every)}


@cache
def packaged_bits() -> dict[tuple[str, str], int]:
    return derivation_bits({"caus": sorted({r.caus for r in dims.roots() if r.caus}), "pass": sorted({r.passive for r in dims.roots() if r.passive})})


def contexts():
    """(number, vowel kind, letter kind, one syllable) of all contexts that a stem of a letter or more can make."""
    for v in range(5):
        for c in range(5):
            for mono in range(2):
                yield (v * 5 + c) * 2 + mono, VOWEL_KINDS[v], LETTER_KINDS[c], bool(mono)


def context_of(stem: Column) -> Column:
    v = F.coalesce(chars.last_vowel(stem), F.lit(""))
    kind = F.when(v == "", 0).when(v.rlike("[aı]"), 1).when(v.rlike("[ei]"), 2).when(v.rlike("[ou]"), 3).otherwise(4)
    last = chars.last_letter(stem)
    letter = F.when(last.rlike(f"[{chars.VOWELS}]"), 0).when(last == "l", 1).when(last == "r", 2).when(last.rlike(f"[{chars.VOICELESS}]"), 3).otherwise(4)
    return (kind * 5 + letter) * 2 + chars.monosyllabic(stem).cast("int")


@dataclass(frozen=True)
class Before:
    """What stands before a suffix: the kind of its last letter, whether it has one syllable, and the bits of licensed derivations."""

    letter: str
    mono: bool
    bits: Mapping[tuple[str, str], int]

    @property
    def vowel(self) -> bool:
        return self.letter == "vowel"


#: What a parse tries for a template of a rule: name -> function(template, Before) giving (template, bits it asks for, suffix that has to follow).
EXPAND: dict[str, Callable[[str, Before], list[tuple[str, int, str]]]] = {}
#: Rules that a parse undoes before any suffix is tried: name -> function(stem) giving the stems that it may have come from.
INVERSE: dict[str, Callable[[str], list[str]]] = {}


def _registered(book: dict, name: str) -> Callable:
    def add(f: Callable) -> Callable:
        if name in book:
            raise ValueError(f"{name} is there twice")
        book[name] = f
        return f

    return add


def expand(name: str) -> Callable:
    return _registered(EXPAND, name)


def inverse(name: str) -> Callable:
    return _registered(INVERSE, name)


def get_inverse(name: str) -> Callable[[str], list[str]]:
    if name not in INVERSE:
        raise ValueError(f"no inverse view of {name}")
    return INVERSE[name]


@expand("drop_initial_H_after_vowel_stem")
def _drop_h(t: str, b: Before):
    return [(t[1:] if b.vowel and t.startswith("H") else t, 0, "")]


@expand("insert_n_after_3rd_person_possessive")
def _insert_n(t: str, b: Before):
    return [("n" + t, WITH_N, ""), (t, WITHOUT_N, "")]


@expand("aorist_allomorphy")
def _aorist(t: str, b: Before):
    out = [("", NEG, ""), ("z", NEG, "")]
    if b.vowel:
        return [*out, ("r", NOT_NEG, "")]
    if not b.mono:
        return [*out, ("Hr", NOT_NEG, "")]
    return [*out, ("Hr", NOT_NEG | HIGH_AORIST, ""), ("Ar", NOT_NEG | LOW_AORIST, "")]


@expand("passive_allomorphy")
def _passive(t: str, b: Before):
    return [("n" if b.vowel else "Hn" if b.letter == "l" else "Hl", 0, "")]


@expand("causative_allomorphy")
def _causative(t: str, b: Before):
    return [("t" if b.vowel or (b.letter in "lr" and not b.mono) else "DHr", 0, "")]


@expand("caus_deriv_allomorphy")
def _caus_deriv(t: str, b: Before):
    return [(x, bit, "") for (kind, x), bit in b.bits.items() if kind == "caus"]


@expand("pass_deriv_allomorphy")
def _pass_deriv(t: str, b: Before):
    return [(x, bit, "") for (kind, x), bit in b.bits.items() if kind == "pass"]


@expand("potential_neg_suppletion")
def _potential(t: str, b: Before):
    return [(t, 0, ""), ("(y)A", 0, "NEG")]


@expand("neg_aor_agreement_suppletion")
def _neg_aor(t: str, b: Before):
    return [("m", AFTER_ZERO_AORIST, ""), (t, NOT_AFTER_ZERO_AORIST, "")] if t == "(y)Hm" else [(t, 0, "")]


@inverse("delete_stem_final_low_vowel")
def _restore(stem: str) -> list[str]:
    """A verb that lost its last a or e before the suffix; seeds look up both."""
    return [stem + v for v in "ae"]


def alternatives(s: dims.Suffix, letter: str, mono: bool, bits: Mapping[tuple[str, str], int]) -> list[tuple[str, int, str]]:
    """(template, bits it asks for, suffix that has to follow) of a suffix after stems of this kind, in the order in which they are tried. A rule of INVERSE alone leaves its template."""
    out, before = [(s.template, 0, "")], Before(letter, mono, bits)
    for rule in s.rules:
        if rule in EXPAND:
            out = [(x, need | more, follows or then) for t, need, then in out for x, more, follows in EXPAND[rule](t, before)]
        elif rule not in INVERSE:
            raise ValueError(f"no view of {rule} for parsing")
    return out


def literals(template: str, vowels: str, letter: str) -> list[str]:
    """All surfaces of a template after such a stem. A hard consonant of it may be softened; a buffer shows after a vowel and only then."""
    found = [("", vowels, letter == "vowel", letter == "voiceless")]
    at = 0
    while at < len(template):
        t = template[at]
        size = 3 if t == "(" else 1
        following = []
        for text, v, is_vowel, voiceless in found:
            if t == "(":
                if not is_vowel:
                    following.append((text, v, is_vowel, voiceless))
                    continue
                options = template[at + 1] if template[at + 1] not in "AHDCG" else ""  # such a buffer is a letter that no word has
            elif t == "A":
                options = "ae" if not v else "a" if v in ("aı", "ou") else "e"
            elif t == "H":
                options = chars.HIGH if not v else {"aı": "ı", "ei": "i", "ou": "u", "öü": "ü"}[v]
            elif t in "DCG":
                options = {"D": "dt", "C": "cç", "G": "gk"}[t][voiceless]
            else:
                options = t + SOFT_OF.get(t, "")
            for o in options:
                kind = next((k for k in VOWEL_KINDS[1:] if o in k), None)
                following.append((text + o, kind or v, kind is not None, o in chars.VOICELESS))
        found = following
        at += size
    return [f[0] for f in found]


def rows(g: dims.Grammar, bits: dict[tuple[str, str], int], weights: Weights = Weights()) -> list[tuple]:
    """(state, context, need, suffix, to_state, literal, size, then, ord, class_out, base, extra) for all edges, contexts and surfaces."""
    out: list[tuple] = []
    for number, vowels, letter, mono in contexts():
        for e in g.edges:
            s = g.suffixes[e.suffix]
            k = 0
            for template, need, then in alternatives(s, letter, mono, bits):
                shapes = literals(template, vowels, letter)
                if s.a_deletable and template.endswith("A") and len(template) > 1:
                    shapes += literals(template[:-1], vowels, letter)
                for text in dict.fromkeys(shapes):
                    base = weights.letter * len(text) + weights.suffix
                    out.append((e.state, number, need, s.id, e.to, text, len(text), then, e.ord * 100 + k, s.class_out, base, weights.extra(s.weight)))
                    k += 1
        for state, accept in [*g.accept.items(), (FINAL, True)]:
            if accept:
                out.append((state, number, 0, END, FINAL, "", 0, "", 0, None, 0.0, 0.0))
    return out


SCHEMA = "state string, context int, next string, need int, suffix string, to_state string, literal string, size int, then string, ord int, class_out string, base double, extra double"
LETTERS = chars.SMALL
OTHER = "?"  # in place of a next character that is no letter of the alphabet


def keyed(compiled: list[tuple]) -> list[tuple]:
    """With the next character as a third key: that of the literal, or for one without any each that may come."""
    out = []
    for r in compiled:
        for c in r[5][0] if r[5] else ["", OTHER, *LETTERS]:
            out.append((*r[:2], c, *r[2:]))
    return out


def next_of(word: Column, at: Column) -> Column:
    c = F.substring(word, at + 1, 1)
    return F.when((c == "") | c.rlike(f"[{LETTERS}]"), c).otherwise(OTHER)


@cache
def _packaged() -> list[tuple]:
    return keyed(rows(dims.grammar(), packaged_bits()))


def realizations(spark: SparkSession, g: dims.Grammar | None = None, bits: dict[tuple[str, str], int] | None = None, weights: Weights = Weights()) -> DataFrame:
    return spark.createDataFrame(_packaged() if g is None and weights == Weights() else keyed(rows(g or dims.grammar(), bits if bits is not None else packaged_bits(), weights)), SCHEMA)
