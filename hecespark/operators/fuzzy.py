"""Similar words: edit distances, a blocked similarity join, and all edits of a word at distance 1."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hecespark.functions import chars
from hecespark.runtime import bind

#: Letters that edits insert and substitute: those that suffixes are made of.
ALPHABET = "aeıioöuücçdgğklmnrsştyz"
PAIRS = ("ıi", "oö", "uü", "cç", "sş", "gğ")
SWAP, KIN = 0.9, 0.4
#: Rows of terms' parts (some 60 bytes each) that are sent to all workers at most.
BROADCAST_PARTS = 500_000


def substitution(a: Column, b: Column) -> Column:
    kin = F.lit(False)
    for p in PAIRS:
        kin = kin | (a.isin(*p) & b.isin(*p))
    return F.when(a == b, 0.0).when(kin, KIN).otherwise(1.0)


def weighted_distance(a, b) -> Column:
    """Optimal string alignment: 1 to insert or delete, 1 to substitute (KIN within a pair of letters), SWAP to transpose neighbours.

    A fold over the first word with the last two rows of the table as its state; for candidates that a plain distance has bounded."""
    a, b = chars._c(a), chars._c(b)
    n, m = F.length(a), F.length(b)
    upto = lambda k: F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    first = F.transform(F.sequence(F.lit(0), m), lambda j: j.cast("double"))
    rows = "array<double>"

    def row(state: Column, i: Column) -> Column:
        ca, before = F.substring(a, i, 1), F.substring(a, i - 1, 1)

        def cell(done: Column, j: Column) -> Column:
            cb, b_before = F.substring(b, j, 1), F.substring(b, j - 1, 1)
            plain = F.least(F.get(state["last"], j) + 1, F.get(done, j - 1) + 1, F.get(state["last"], j - 1) + substitution(ca, cb))
            swapped = (i > 1) & (j > 1) & (ca == b_before) & (before == cb)
            return F.concat(done, F.array(F.when(swapped, F.least(plain, F.get(state["older"], j - 2) + SWAP)).otherwise(plain)))

        return F.struct(state["last"].alias("older"), F.aggregate(upto(m), F.array(i.cast("double")), cell).alias("last"))

    start = F.struct(F.array().cast(rows).alias("older"), first.alias("last"))
    return F.aggregate(upto(n), start, row, lambda s: F.element_at(s["last"], -1))


def index(terms: DataFrame) -> DataFrame:
    """(term, freq): of each term but the empty and null ones its greatest frequency."""
    return terms.where("term is not null and term <> ''").groupBy("term").agg(F.max("freq").alias("freq"))


def candidates(queries: DataFrame, terms: DataFrame, d: int = 2) -> DataFrame:
    """(word, term, freq, distance): terms at distance d or less of each distinct word.

    By the pigeonhole principle: a term is cut in d + 1 parts by its length, and d edits leave one of them whole, moved by d places at most. Words look
    parts up for the lengths n - d .. n + d, so that the join is an equi-join on (length, part, substring); terms shorter than d + 1 letters have
    empty parts and meet all words of their lengths. All that meet are verified. Parts of terms are broadcast where there are
    up to BROADCAST_PARTS, and then only pairs that have met are shuffled; else the join is by shuffle.
    """
    q = queries.select("word").where("word is not null").distinct()
    begin = lambda n, k: F.floor(n * k / (d + 1)).cast("int")
    parts = F.sequence(F.lit(0), F.lit(d))
    n = F.length("term")
    keyed = terms.select("term", "freq", n.alias("size"), F.explode(parts).alias("part"))
    keyed = keyed.withColumn("piece", F.substring(F.col("term"), begin(F.col("size"), F.col("part")) + 1, begin(F.col("size"), F.col("part") + 1) - begin(F.col("size"), F.col("part"))))
    asked = q.select("word", F.explode(F.sequence(F.greatest(F.lit(1), F.length("word") - d), F.length("word") + d)).alias("size"))
    asked = asked.select("word", "size", F.explode(parts).alias("part"))
    at, long = begin(F.col("size"), F.col("part")), begin(F.col("size"), F.col("part") + 1) - begin(F.col("size"), F.col("part"))
    asked = asked.select("word", "size", "part", at.alias("at"), long.alias("long")).withColumn("move", F.explode(F.sequence(F.lit(-d), F.lit(d))))
    place = F.col("at") + F.col("move")
    asked = asked.where((place >= 0) & (place + F.col("long") <= F.length("word")) | (F.col("long") == 0))
    asked = asked.select("word", "size", "part", F.when(F.col("long") == 0, "").otherwise(F.substring(F.col("word"), place + 1, F.col("long"))).alias("piece"))
    keyed = F.broadcast(keyed) if keyed.count() <= BROADCAST_PARTS else keyed
    met = asked.join(keyed, ["size", "part", "piece"]).select("word", "term", "freq").distinct()
    return met.withColumn("distance", F.levenshtein("word", "term", d)).where("distance >= 0")


def nearest(queries: DataFrame, terms: DataFrame, d: int = 2, k: int = 5) -> DataFrame:
    """(word, rank, term, freq, distance, weighted): the k best terms of each word, by weighted distance, frequency, distance, term."""
    found = candidates(queries, index(terms), d).withColumn("weighted", F.round(weighted_distance("word", "term"), 6))
    order = Window.partitionBy("word").orderBy("weighted", F.desc("freq"), "distance", "term")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("word", "rank", "term", "freq", "distance", "weighted")


def edits1(word) -> Column:
    """All different words at one deletion, transposition, substitution or insertion, without the word itself."""
    w = chars._c(word)
    n = F.length(w)
    letters = F.array(*map(F.lit, ALPHABET))
    left = lambda i: F.substring(w, F.lit(1), i)
    right = lambda i: F.substring(w, i + 1, n)
    none = F.array().cast("array<int>")
    each = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(none)
    zero, one = F.lit(0), F.lit(1)
    deleted = F.transform(each(zero, n - 1), lambda i: F.concat(left(i), right(i + 1)))
    swapped = F.transform(each(zero, n - 2), lambda i: F.concat(left(i), F.substring(w, i + 2, one), F.substring(w, i + 1, one), right(i + 2)))
    changed = F.flatten(F.transform(each(zero, n - 1), lambda i: F.transform(letters, lambda c: F.concat(left(i), c, right(i + 1)))))
    added = F.flatten(F.transform(each(zero, n), lambda i: F.transform(letters, lambda c: F.concat(left(i), c, right(i)))))
    return F.array_remove(F.array_distinct(F.concat(deleted, swapped, changed, added)), w)


def edits_of(w: str) -> set[str]:
    """edits1() of a string."""
    halves = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    out = {a + b[1:] for a, b in halves if b} | {a + b[1] + b[0] + b[2:] for a, b in halves if len(b) > 1}
    for a, b in halves:
        rest = b[1:]
        out.update([a + c + b for c in ALPHABET])
        if b:
            out.update([a + c + rest for c in ALPHABET])
    out.discard(w)
    return out


def make_typo(word, seed: int) -> Column:
    """One of the edits of a word, by the hash of word and seed; the word itself if it has none."""
    e = edits1(word)
    return F.coalesce(F.try_element_at(F.sort_array(e), (F.pmod(F.xxhash64(chars._c(word), F.lit(seed)), F.greatest(F.size(e), F.lit(1))) + 1).cast("int")), chars._c(word))


def typo_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for w, h in zip(batch.column("word").to_pylist(), batch.column("h").to_pylist()):
            e = sorted(edits_of(w)) if w is not None else ()
            made.append(e[h % len(e)] if e else w)
        yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(made, pa.string())], names=["word", "typo"])


def typos(words: DataFrame, seed: int) -> DataFrame:
    """(word, typo): make_typo() of each row's word, by strings in place of interpreted expressions."""
    return words.select("word", F.xxhash64("word", F.lit(seed)).alias("h")).mapInArrow(bind(__name__, "typo_kernel"), "word string, typo string")


def typo(word, seed: int) -> Column:
    """An edit of a word as a struct (typo, kind, at): kind (substitute, transpose, delete, insert) and place by the hash of word and seed, letters
    of ALPHABET. Words of one letter and those that the edit leaves as they are have a null typo."""
    w = chars._c(word)
    n = F.length(w)
    drawn = lambda k, below: F.pmod(F.xxhash64(w, F.lit(seed), F.lit(k)), F.greatest(below, F.lit(1))).cast("int")
    letter = F.substring(F.lit(ALPHABET), drawn(2, F.lit(len(ALPHABET))) + 1, F.lit(1))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), drawn(0, F.lit(len(KINDS))) + 1)
    at = drawn(1, F.when(kind == "transpose", n - 1).when(kind == "insert", n + 1).otherwise(n))
    left, right = F.substring(w, F.lit(1), at), lambda k: F.substring(w, at + 1 + k, n)
    made = (
        F.when(kind == "substitute", F.concat(left, letter, right(1)))
        .when(kind == "transpose", F.concat(left, F.substring(w, at + 2, F.lit(1)), F.substring(w, at + 1, F.lit(1)), right(2)))
        .when(kind == "delete", F.concat(left, right(1)))
        .otherwise(F.concat(left, letter, right(0)))
    )
    return F.struct(F.when((n > 1) & (made != w), made).alias("typo"), kind.alias("kind"), at.alias("at"))


KINDS = ("substitute", "transpose", "delete", "insert")
