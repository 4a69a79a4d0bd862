"""Normalising lines: the words of each line with their analyses, rendered as surface, lemmas, morphemes or JSON.

A line is rendered where it is: nothing is shuffled, and a worker parses a word once while it keeps it. Rows stay rows: ids may be null or
repeat, and a blank or null line is an empty one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hecespark.functions import chars
from hecespark.operators import chart, clitic, feats, parse, text
from hecespark.runtime import at_least, bind, values

SEPARATOR = "▁"
MODES = ("surface", "lemma", "morphemes", "jsonl")
#: Characters of lines that are sent at once, or one line.
BATCH_CHARS = 4 << 20
_FOLD = str.maketrans(chars.CIRCUMFLEX, chars.PLAIN)


def _piece(a: chart.Analysis | None, w: str, mode: str, separator: str) -> str:
    if mode == "lemma":
        return w if a is None else a.root or w
    if mode == "morphemes":
        return w if a is None else feats.split_of(a).replace("-", separator) or w
    return json.dumps({"surface": w, "lemma": a and a.root, "pos": a and a.root_class, "morphemes": [a.root_chunk, *a.chunks] if a else [], "oov": a and a.oov}, ensure_ascii=False)


def renderer(c: chart.Chart, mode: str, fold: bool, clitics: bool, separator: str) -> Callable[[str | None], str]:
    """A line as ``mode`` has it. Each different word is made once while the worker keeps it: chunks of one kind are never neighbours, so that
    a blank is needed between the pieces of one word alone."""
    parted = (lambda w: clitic.pieces(c, w)) if clitics else lambda w: (w,)
    if mode == "surface" and not clitics:
        made = lambda x: x.translate(_FOLD) if fold else x
    elif mode == "surface":
        own = c.showing((mode, fold), lambda w: " ".join(p.translate(_FOLD) if fold else p for p in parted(w)))
        made = lambda x: text.WORDS.sub(lambda m: own[m[0]], x)
    else:
        between = ", " if mode == "jsonl" else " "
        own = c.showing((mode, clitics, separator), lambda w: between.join(_piece(c.best(p), p, mode, separator) for p in parted(w)))
        words = lambda x: between.join(map(own.__getitem__, text.WORDS.findall(x)))
        made = words if mode != "jsonl" else lambda x: f'{{"text": {json.dumps(x, ensure_ascii=False)}, "tokens": [{words(x)}]}}'
    return lambda x: "" if x is None or not x.strip() else made(x)


def line_kernel(batches: Iterator[pa.RecordBatch], payload, line: str, keep: list[str], mode: str, fold: bool, clitics: bool, separator: str) -> Iterator[pa.RecordBatch]:
    """Lines are made and sent in batches of some BATCH_CHARS: they may be many times as long as their texts."""
    render = renderer(chart.of(payload), mode, fold, clitics, separator)
    for batch in batches:
        made, size, at = [], 0, 0
        for k, x in enumerate(values(batch.column(line)), 1):
            made.append(render(x))
            size += len(made[-1])
            if size >= BATCH_CHARS or k == batch.num_rows:
                part = batch.slice(at, len(made))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(made, pa.string())], names=[*keep, "line"])
                made, size, at = [], 0, k


def lines(df: DataFrame, mode: str = "surface", line: str = "text", keep: tuple[str, ...] = ("doc_id",), fold: bool = False, clitics: bool = True, separator: str = SEPARATOR, **options) -> DataFrame:
    """keep, line: each row's line in one of MODES; df may be a stream. Words that nothing explains stay as they are.

    surface: the text with a blank before a parted particle, ``fold``: words without circumflex; lemma: roots; morphemes: their chunks,
    joined by ``separator``; jsonl: {text, tokens: [{surface, lemma, pos, morphemes, oov}]}. options: roots, g and weights of parse.payload_of().
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r}: one of {MODES}")
    if "line" in {k.lower() for k in keep}:
        raise ValueError("a column named line can't be kept: it is the result")
    given = df.select(*keep, *([line] if line not in keep else []))
    given = at_least(given)
    kept = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return given.mapInArrow(bind(__name__, "line_kernel", parse.held(df.sparkSession, **options), line, list(keep), mode, fold, clitics, separator), f"{kept}line string")


def surface(df: DataFrame, line: str = "text", keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    return lines(df, "surface", line, keep, **options)


def lemmas(df: DataFrame, line: str = "text", keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    return lines(df, "lemma", line, keep, **options)


def morphemes(df: DataFrame, line: str = "text", keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    return lines(df, "morphemes", line, keep, **options)


def jsonl(df: DataFrame, line: str = "text", keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    return lines(df, "jsonl", line, keep, **options)


def count_kernel(batches: Iterator[pa.RecordBatch], payload, line: str, clitics: bool) -> Iterator[pa.RecordBatch]:
    c = chart.of(payload)

    def counted(word: str) -> int:
        """Words, and those of an unknown root times 2^32."""
        best = [c.best(p) for p in (clitic.pieces(c, word) if clitics else (word,))]
        return len(best) + (sum(a is not None and a.oov for a in best) << 32)

    own = c.showing(("count", clitics), counted)
    for batch in batches:
        words = oov = 0
        for x in values(batch.column(line)):
            got = sum(map(own.__getitem__, text.WORDS.findall(x))) if x else 0
            words += got & 0xFFFFFFFF
            oov += got >> 32
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (batch.num_rows, words, oov)], names=["lines", "words", "oov"])


def summary(df: DataFrame, line: str = "text", clitics: bool = True, **options) -> DataFrame:
    """One row (lines, words, oov, oov_share); oov: words of an unknown root."""
    counted = at_least(df.select(line)).mapInArrow(bind(__name__, "count_kernel", parse.held(df.sparkSession, **options), line, clitics), "lines bigint, words bigint, oov bigint")
    total = counted.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("lines", "words", "oov")))
    return total.withColumn("oov_share", F.coalesce(F.try_divide("oov", "words"), F.lit(0.0)))
