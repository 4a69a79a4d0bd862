"""Question particles that are written with the word before them: found, and split off."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from hecespark.functions import chars
from hecespark.operators import chart, parse
from hecespark.runtime import bind

PARTICLES = ("mi", "mı", "mu", "mü")
#: Suffixes that mark an agreeing particle. Two of them are no suffixes of the inventory, so that a conditional particle counts as bare: as the engine to match has it.
AGREEMENT = frozenset(("1SG_Z", "2SG_Z", "1PL_Z", "2PL_Z", "3PL_Z", "PAST_COP", "COND_COP", "COP_DHR", "COP_EVID"))
_HIGH_AFTER = {v: h for vs, h in (("aı", "ı"), ("ei", "i"), ("ou", "u"), ("öü", "ü")) for v in vs}


def pieces(c: chart.Chart, word: str) -> list[str]:
    """The word, or its head and the particle, as written.

    The tail must be a known particle with its suffixes, in harmony with the head. With an agreement suffix the head may be unknown; without, it
    must be known, and the whole word must not be one of a known root. An agreeing split comes before a bare one, and of several the last.
    """
    w = word.translate(chart._LOWER)
    found: tuple[bool, int] | None = None
    vowel = None
    for at in range(1, len(w) - 1):
        if w[at - 1] in _HIGH_AFTER:
            vowel = w[at - 1]
        if at < 2 or w[at] != "m" or vowel is None or w[at + 1] != _HIGH_AFTER[vowel]:
            continue
        tail = c.best(w[at:])
        if tail is None or tail.oov or tail.root not in PARTICLES:
            continue
        head = c.best(w[:at])
        if head is None:
            continue
        agrees = not AGREEMENT.isdisjoint(tail.ids)
        if not agrees:
            whole = c.best(w)
            if head.oov or (whole is not None and not whole.oov):
                continue
        found = max(found or (False, 0), (agrees, at))
    return [word] if found is None else [word[: found[1]], word[found[1] :]]


def kernel(batches: Iterator[pa.RecordBatch], payload) -> Iterator[pa.RecordBatch]:
    c = chart.of(payload)
    for batch in batches:
        words = batch.column("word")
        yield pa.RecordBatch.from_arrays([words, pa.array([pieces(c, w) for w in words.to_pylist()], pa.list_(pa.string()))], names=["word", "pieces"])


def split_clitics(words: DataFrame, **options) -> DataFrame:
    """(word, pieces): each distinct word as itself, or as its head and the particle. options: roots, g and weights of parse.payload_of()."""
    given = parse.spread(words.select("word").where("word is not null").distinct(), "word")
    return given.mapInArrow(bind(__name__, "kernel", parse.held(words.sparkSession, **options)), "word string, pieces array<string>")
