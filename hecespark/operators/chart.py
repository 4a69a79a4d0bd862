"""The parser's kernel: all analyses of a word over the compiled realizations, Arrow batch by Arrow batch.

How a word can go on depends on what is left of it, the state, and a few bits about what stands before: endings() keeps what it has
found for these, so that words with the same ending share the work. The tables are of fixed size, so each worker keeps them, and
words are parsed where they are. A chain of joins says the same (parse.analyses_by_joins, which tests hold this against).
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Callable, Hashable, Iterator
from typing import NamedTuple

import pyarrow as pa

from hecespark.functions import chars
from hecespark.operators import realize
from hecespark.operators.realize import Weights
from hecespark.sources import dims

N_AFTER = ("POSS_3SG", "POSS_3PL", "REL_KI")
SCHEMA = "word string, rank int, root string, root_class string, final_class string, oov boolean, score double, ids array<string>, chunks array<string>, root_chunk string"
#: Endings with their ways on that a worker keeps, beyond that it starts again; analyses of words, and words as a query shows them, of each generation.
KEPT_ENDINGS, KEPT_ANALYSES, KEPT_WORDS = 150_000, 30_000, 250_000
#: Letters of an ending that endings() recurs over; what is longer is walked with a stack, to the same results.
DEEP = 150
_KIND = {v: k for k, vs in enumerate(realize.VOWEL_KINDS) for v in vs}
_FOLD = str.maketrans(chars.CIRCUMFLEX, chars.PLAIN)
_LOWER = str.maketrans(chars.CAPITAL, chars.SMALL)
_NO_APOSTROPHE = str.maketrans("", "", chars.APOSTROPHES)
_SOFT = dict(zip(chars.HARD, chars.SOFT))
_PREVIOUS = realize.NEG | realize.NOT_NEG | realize.WITH_N | realize.WITHOUT_N | realize.AFTER_ZERO_AORIST | realize.NOT_AFTER_ZERO_AORIST


class Analysis(NamedTuple):
    root: str
    root_class: str
    final_class: str
    oov: bool
    score: float
    ids: tuple[str, ...]
    chunks: tuple[str, ...]
    root_chunk: str


class Kept(dict):
    """What ``make`` gives of a key, for up to ``most`` keys and those of the generation before: keys that are asked for often stay."""

    def __init__(self, make: Callable, most: int):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        found = self.older[key] if key in self.older else self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


def letters(word: str) -> str:
    """chars.letters_only for a string."""
    return word.translate(_LOWER).translate(_FOLD).translate(_NO_APOSTROPHE)


def apostrophe(word: str) -> int | None:
    """chars.apostrophe_at for a string."""
    return next((k for k, c in enumerate(word) if c in chars.APOSTROPHES), None)


def title(word: str) -> bool:
    """chars.title_case for a string."""
    return word[:1] != word[:1].translate(_LOWER)


def before(suffix: str, empty: bool, pronominal: bool = False) -> int:
    """The bits about what stands before: the last suffix ('' after a root), whether it shows nothing, and whether the root takes an n."""
    return (
        (realize.NEG if suffix == "NEG" else realize.NOT_NEG)
        + (realize.WITH_N if suffix in N_AFTER or (pronominal and not suffix) else realize.WITHOUT_N)
        + (realize.AFTER_ZERO_AORIST if suffix == "AOR" and empty else realize.NOT_AFTER_ZERO_AORIST)
    )


def _letter(c: str) -> int:
    return 0 if c in chars.VOWELS else 1 if c == "l" else 2 if c == "r" else 3 if c in chars.VOICELESS else 4


_LETTERS = {c: _letter(c) * 2 for c in chars.VOWELS + chars.CONSONANTS}


def contexts(w: str) -> list[int]:
    """realize.context_of of each beginning of w."""
    out, kind, vowels = [], 0, 0
    for c in w:
        if c in _KIND:
            kind, vowels = _KIND[c] * 10, vowels + 1
        out.append(kind + _LETTERS.get(c, 8) + (vowels == 1))
    return out


def _key(found: tuple) -> tuple:
    """The place in the order in which a chart finds what complete() gives: by the number of suffixes, then by place."""
    places, pos = [], found[7]
    for k, c in enumerate(found[6], 1):
        places.append((k, pos))
        pos += len(c)
    return (*(x for p in reversed(places) for x in p), *found[8], *found[9])


class Chart:
    def __init__(self, compiled: list[tuple], roots: list[tuple[int, dims.Root]], bits: dict[tuple[str, str], int], weights: Weights = Weights(), book: dict[str, tuple] | None = None):
        self.weights = weights
        self.book = book if book is not None else {s.id: s.feats for s in dims.grammar().suffixes.values()}
        self.known: dict[tuple, list[tuple]] = {}
        self.ways = 0
        self.words = Kept(self._best, KEPT_ANALYSES)
        self.shown: dict[Hashable, object] = {}
        self.steps: dict[tuple[int, str], int] = {}
        self.after: dict[tuple[str, bool], int] = {}
        self.table: dict[tuple[str, int, str], list[tuple]] = {}
        for state, context, following, *row in compiled:
            if state != realize.FINAL:
                self.table.setdefault((state, context, following), []).append(tuple(row))
        self.forms: dict[str, list[tuple]] = {}
        for k, r in roots:
            flags = (realize.HIGH_AORIST if r.aorist_high else realize.LOW_AORIST) + sum(bit for (kind, t), bit in bits.items() if (r.caus if kind == "caus" else r.passive) == t)
            entry = (k, r.form, r.cls, math.log1p(max(r.frequency, 0)), flags, r.pronominal_n)
            spellings = [r.form, *r.variants]
            if r.soften and r.form[-1:] in _SOFT and r.form:
                spellings.append(r.form[:-1] + _SOFT[r.form[-1]])
            for key in dict.fromkeys(s.translate(_FOLD) for s in spellings if s is not None):
                self.forms.setdefault(key, []).append(entry)
        self.longest = max(map(len, self.forms), default=0)
        self.literals = {row[3] for found in self.table.values() for row in found if row[3]}
        self.sizes = range(1, max(map(len, self.literals), default=0) + 1)
        self.divided: dict[str, bool] = {"": True}
        self.bare = {pn: before("", False, pn) for pn in (False, True)}

    def places(self, w: str) -> list[int]:
        """Where a root may end: what follows divides(), or is of more than DEEP letters. Found from the word's end, where most words have few that do."""
        n = len(w)
        ends, new = {n}, [n]
        while new:
            at = new.pop()
            for k in self.sizes[:at]:
                if at - k not in ends and w[at - k : at] in self.literals:
                    ends.add(at - k)
                    new.append(at - k)
        return [*range(1, n - DEEP), *sorted(x for x in ends if 0 < x >= n - DEEP)]

    def seeds(self, w: str, places: list[int]) -> Iterator[tuple]:
        """(pos, state, class, flags, pronominal n, suffix that has to follow, score, key, root) of known roots that end at places."""
        n, x, shortened = len(w), self.weights, realize.get_inverse("delete_stem_final_low_vowel")
        for pos in places:
            if pos > self.longest and pos >= x.max_oov:
                break
            for k, form, cls, freq, flags, pn in self.forms.get(w[:pos], ()):
                if cls in dims.START:
                    yield pos, dims.START[cls], cls, flags, pn, "", freq + pos * x.root_letter, (0, 0, k), form
            if 2 <= pos < min(x.max_oov, n):
                for i, stem in enumerate(shortened(w[:pos])):
                    for k, form, cls, freq, flags, pn in self.forms.get(stem, ()):
                        if cls == "VERB":
                            yield pos, dims.START[cls], cls, flags, pn, "PROG", freq + pos * x.root_letter, (0, 1, i, k), form

    def unknown(self, w: str, places: list[int], around: list[int]) -> list[tuple]:
        """What complete() gives for an unknown root of each class that ends at one of places."""
        n, x, done = len(w), self.weights, []
        for pos in places:
            if pos < x.min_oov or pos > x.max_oov:
                continue
            key = w[pos:], around[pos - 1]
            found = self.known.get(key)
            if found is None:
                follow = self.endings if n - pos <= DEEP else self.walked
                found = [((0, 2, kind), cls, *e) for kind, cls in enumerate(("NOUN", "VERB", "ADJ")) for e in follow(key[0], dims.START[cls], cls, realize.LOW_AORIST + self.bare[False], key[1], "")]
                self.known[key] = found
                self.ways += 1 + len(found)
            score0 = x.oov + pos * x.oov_letter
            for key0, cls0, cls, score, ids, chunks, orders in found:
                done.append((w[:pos], cls0, cls, True, score0 + score, ids, chunks, pos, key0, orders))
        return done

    def step(self, context: int, literal: str) -> int:
        """The context after the literal."""
        found = self.steps.get((context, literal))
        if found is None:
            kind, vowels = context // 10, 0 if context < 10 else 1 if context & 1 else 2
            for c in literal:
                if c in _KIND:
                    kind, vowels = _KIND[c], vowels + 1
            letter = _letter(literal[-1]) if literal else context // 2 % 5
            found = self.steps[context, literal] = (kind * 5 + letter) * 2 + (vowels == 1)
        return found

    def divides(self, rest: str) -> bool:
        """Whether rest is made of what suffixes can look like, in whatever order."""
        found = self.divided.get(rest)
        if found is None:
            found = self.divided[rest] = any(rest[:k] in self.literals and self.divides(rest[k:]) for k in self.sizes[: len(rest)])
        return found

    def endings(self, rest: str, state: str, cls: str, has: int, context: int, then: str) -> list[tuple]:
        """(final class, score, ids, chunks, orders) of all ways from here to the word's end."""
        if not self.divides(rest):
            return []
        key = rest, state, cls, has, context, then
        found = self.known.get(key)
        if found is None:
            found = []
            following = rest[:1] if not rest or rest[0] in realize.LETTERS else realize.OTHER
            for need, suffix, to, literal, size, next_, order, class_out, base, extra in self.table.get((state, context, following), ()):
                if has & need != need or not rest.startswith(literal):
                    continue
                if suffix == realize.END:
                    if not rest:
                        found.append((cls, 0.0, (), (), ()))
                elif not then or suffix == then:
                    gain = base + extra + (self.weights.derivation if class_out is not None and class_out != cls else 0.0)
                    bits = self.after.get((suffix, size == 0))
                    if bits is None:
                        bits = self.after[suffix, size == 0] = before(suffix, size == 0)
                    for final, score, ids, chunks, orders in self.endings(rest[size:], to, class_out or cls, has & ~_PREVIOUS | bits, self.step(context, literal), next_):
                        found.append((final, gain + score, (suffix, *ids), (literal, *chunks), (order, *orders)))
            self.known[key] = found
            self.ways += 1 + len(found)
        return found

    def complete(self, w: str, around: list[int], seeds: Iterator[tuple]) -> list[tuple]:
        """(root, root class, final class, oov, score, ids, chunks, place of the root's end, key of the root, orders) of all ways to the word's end."""
        if self.ways > KEPT_ENDINGS:
            self.known.clear()
            self.ways = 0
        if len(self.divided) > KEPT_ENDINGS:
            self.divided = {"": True}
        n, done, bare = len(w), [], self.bare
        for at, state, cls0, flags, pn, first, score0, key0, root in seeds:
            follow = self.endings if n - at <= DEEP else self.walked
            for cls, score, ids, chunks, orders in follow(w[at:], state, cls0, flags + bare[bool(pn)], around[at - 1], first):
                done.append((root, cls0, cls, False, score0 + score, ids, chunks, at, key0, orders))
        return done

    def walked(self, rest: str, state: str, cls: str, has: int, context: int, then: str) -> list[tuple]:
        """What endings() gives, for an ending of any length: a stack of fragments until it is short enough."""
        done, stack = [], [(0, state, cls, has, context, then, 0.0, (), (), ())]
        while stack:
            pos, state, cls, has, context, then, score, ids, chunks, orders = stack.pop()
            if len(rest) - pos <= DEEP:
                done += [(final, score + s, (*ids, *i), (*chunks, *c), (*orders, *o)) for final, s, i, c, o in self.endings(rest[pos:], state, cls, has, context, then)]
                continue
            following = rest[pos] if rest[pos] in realize.LETTERS else realize.OTHER
            for need, suffix, to, literal, size, next_, order, class_out, base, extra in self.table.get((state, context, following), ()):
                if suffix != realize.END and has & need == need and rest.startswith(literal, pos) and (not then or suffix == then):
                    gain = base + extra + (self.weights.derivation if class_out is not None and class_out != cls else 0.0)
                    stack.append((pos + size, to, class_out or cls, has & ~_PREVIOUS | before(suffix, size == 0), self.step(context, literal), next_, score + gain, (*ids, suffix), (*chunks, literal), (*orders, order)))
        return done

    def analyses(self, w: str, apostrophe: int | None, title: bool, oov: bool, every: bool) -> list[Analysis]:
        """Best first."""
        x, places, around = self.weights, self.places(w), contexts(w)
        found = self.complete(w, around, self.seeds(w, places))
        if oov:
            # no unknown root can get beyond this: a letter is worth 3 at most, as a suffix of its own
            ceiling = x.oov + x.max_oov * max(x.oov_letter, 0.0) + 3.0 * len(w) + x.bare + x.apostrophe + x.title
            if every or not x.plain or not found or max(f[4] for f in found) <= ceiling:
                found += self.unknown(w, places, around)
        first: dict[tuple, tuple] = {}
        for f in found:
            signature = f[0], f[1], f[5], f[6]
            if signature not in first or _key(f) < _key(first[signature]):
                first[signature] = f
        scored, top = [], -math.inf
        for f in first.values():
            root, _, _, is_oov, score, ids, chunks, at, _, _ = f
            if is_oov:
                score += x.title_oov * (title and apostrophe is None and at == len(w))
            elif not ids:
                score += x.bare + x.title * (title and root == w)
            if apostrophe is not None:
                end, ends = at, {at}
                for c in chunks:
                    end += len(c)
                    ends.add(end)
                score += x.apostrophe * (apostrophe in ends)
            rounded = round(score, 9)
            top = max(top, rounded)
            scored.append((rounded, score, f))
        kept = [(-rounded, _key(f), Analysis(*f[:4], score, f[5], f[6], w[: f[7]])) for rounded, score, f in scored if every or rounded == top]
        return [a for _, _, a in sorted(kept)]

    def all_of(self, word: str, oov: bool = True) -> list[Analysis]:
        w = letters(word)
        return self.analyses(w, apostrophe(word), title(word), oov, True) if w else []

    def _best(self, word: str) -> Analysis | None:
        w = letters(word)
        found = self.analyses(w, apostrophe(word), title(word), True, False) if w else []
        return found[0] if found else None

    def best(self, word: str) -> Analysis | None:
        """The first analysis of a word as written; None without one."""
        return self.words[word]

    def shared(self, how: Hashable, build: Callable[[], object]):
        """What ``build`` gives, kept from task to task by the name ``how``; of the two names last built."""
        if how not in self.shown:
            if len(self.shown) > 1:
                del self.shown[next(iter(self.shown))]
            self.shown[how] = build()
        return self.shown[how]

    def showing(self, how: Hashable, make: Callable[[str], object]) -> Kept:
        """What ``make`` gives of words, shared()."""
        return self.shared(how, lambda: Kept(make, KEPT_WORDS))


_charts: dict[int, Chart] = {}


def packaged() -> Chart:
    if 0 not in _charts:
        _charts[0] = Chart(realize._packaged(), list(enumerate(dims.roots())), realize.packaged_bits())
    return _charts[0]


def of(payload) -> Chart:
    """The chart of a broadcast payload (parse.payload_of); None: the packaged one."""
    if payload is None:
        return packaged()
    data = payload.value
    key = zlib.crc32(data) or 1
    if key not in _charts:
        _charts[key] = Chart(*pickle.loads(data))
    return _charts[key]


def kernel(batches: Iterator[pa.RecordBatch], payload, oov: bool, every: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    chart = of(payload)
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            rows = []
            part = batch.slice(at, 2000)
            for word, w, apostrophe, title in zip(*(part.column(c).to_pylist() for c in ("word", "w", "apo", "title"))):
                for rank, a in enumerate(chart.analyses(w, apostrophe, title, oov, every), 1):
                    rows.append((word, rank, *a))
            columns = list(zip(*rows)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
