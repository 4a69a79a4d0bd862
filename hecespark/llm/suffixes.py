"""Suffix-array deduplication by bucket-pointer refinement.

Suffixes start in the bucket of their first Q words, and a bucket's pointer is its number in the order of all buckets. A round sorts each
bucket by the pointers of its suffixes' later starts, those as many words further as the bucket is deep: its parts are the buckets of starts
twice as deep, whose pointers the next round uses again, until they are as deep as a window. A bucket of one suffix is done: that suffix's
start occurs nowhere else, and no longer start that has it takes part any more. What is left is in buckets of equal windows.

Before the first round, windows whose least SAMPLE-gram (by fingerprint) occurs once in all documents are found to be unique: equal windows have equal
least grams, so none is lost, and 1 gram in about 18 is sent for it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from hecespark.llm import rounds
from hecespark.llm.arrow import mixed
from hecespark.runtime import drop, scratch

#: Words of the first buckets, and of the grams that windows are sampled by.
Q, SAMPLE = 25, 16
_PLACE = 22  # bits for a position within a block; the rest orders grams


def _least(x: np.ndarray, offset: int) -> np.ndarray:
    out = x.copy()
    if offset < len(x):
        np.minimum(x[:-offset], x[offset:], out=out[:-offset])
    return out


def sampled(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The SAMPLE-grams at all positions, and where that of each window is: the last of its least."""
    grams = rounds.starts_of(hashes, SAMPLE)
    # positions count within blocks that are shorter than what _PLACE bits hold, and overlap by a window
    out = np.zeros(len(hashes), np.int64)
    span, width = rounds.WINDOW - SAMPLE + 1, 1 << _PLACE
    mask = np.uint64(width - 1)
    order = mixed(grams + np.uint64(1)) & ~mask
    for begin in range(0, len(hashes), width // 2):
        part = order[begin : begin + width]
        low = part | (mask - np.arange(len(part), dtype=np.uint64))
        have = 1
        while have * 2 <= span:
            low, have = _least(low, have), have * 2
        if have < span:
            low = _least(low, span - have)
        upto = min(len(part), width // 2)
        out[begin : begin + upto] = begin + (mask - (low[:upto] & mask)).astype(np.int64)
    return grams, out[at]


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys, sorted; which of them each is; how often each occurs."""
    return np.unique(keys, return_inverse=True, return_counts=True)


def sample_keys(state: dict) -> rounds.Keys:
    grams, place = sampled(rounds.hashes_of(state), rounds.windows(state["n"]))
    a, _, m = counted(grams[np.unique(place)])
    return a, None, m


def sample_taken(state: dict, pointers: np.ndarray, totals: np.ndarray) -> dict | None:
    """The chunk with the windows that may be repeated."""
    at = rounds.windows(state["n"])
    grams, place = sampled(rounds.hashes_of(state), at)
    places, of = np.unique(place, return_inverse=True)
    at = at[(pointers > 0)[counted(grams[places])[1]][of]]
    return state | {"at": rounds.steps_of(at)} if len(at) else None


def depths(q: int) -> list[tuple[int, int]]:
    """(depth, offset) of the rounds after the first: each is ``offset`` words deeper than before."""
    out, have = [], q
    while have < rounds.WINDOW:
        offset = min(have, rounds.WINDOW - have)
        have += offset
        out.append((have, offset))
    return out


def needed(at: np.ndarray, q: int, depth: int) -> np.ndarray:
    """The positions whose starts of ``depth`` words the windows at ``at`` are still to be made of."""
    places = {0}
    for have, offset in reversed(depths(q)):
        if have > depth:
            places |= {x + offset for x in places}
    return np.unique((at[:, None] + np.array(sorted(places))[None, :]).ravel())


def first_keys(state: dict, q: int) -> rounds.Keys:
    a, _, m = counted(rounds.starts_of(rounds.hashes_of(state), q)[needed(np.cumsum(state["at"]), q, q)])
    return a, None, m


def first_taken(state: dict, pointers: np.ndarray, totals: np.ndarray, q: int) -> dict | None:
    at = np.cumsum(state["at"])
    places = needed(at, q, q)
    found = pointers[counted(rounds.starts_of(rounds.hashes_of(state), q)[places])[1]]
    return left(state, at, places, found, q, q)


def left(state: dict, at: np.ndarray, places: np.ndarray, found: np.ndarray, q: int, depth: int) -> dict | None:
    """The windows all of whose starts of this depth have a pointer, and those."""
    good = np.zeros(int(state["n"].sum()) + 1, bool)
    good[places] = found > 0
    offsets = needed(np.zeros(1, np.int64), q, depth)
    at = at[good[at[:, None] + offsets[None, :]].all(axis=1)]
    if not len(at):
        return None
    kept = np.isin(places, needed(at, q, depth), assume_unique=True)
    known, codes = np.unique(found[kept], return_inverse=True)
    return {"doc": state["doc"], "n": state["n"], "at": rounds.steps_of(at), "places": rounds.steps_of(places[kept]), "codes": codes.astype(np.uint32), "known": rounds.steps_of(known)}


def pairs(state: dict, q: int, depth: int, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The positions that starts of ``depth`` words are needed of, with the pointers of both halves."""
    at, places = np.cumsum(state["at"]), np.cumsum(state["places"])
    pointers = np.cumsum(state["known"], dtype=np.uint64)[state["codes"]]
    wanted = needed(at, q, depth)
    return wanted, pointers[np.searchsorted(places, wanted)], pointers[np.searchsorted(places, wanted + offset)]


def both(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs in their order, which of them each is, and how often each occurs."""
    order = np.lexsort((b, a))
    new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])][: len(a)]
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(new) - 1
    first = order[new]
    return a[first], b[first], which, np.bincount(which, minlength=len(first))


def pair_keys(state: dict, q: int, depth: int, offset: int) -> rounds.Keys:
    a, b, _, m = both(*pairs(state, q, depth, offset)[1:])
    return a, b, m


def pair_taken(state: dict, pointers: np.ndarray, totals: np.ndarray, q: int, depth: int, offset: int):
    places, x, y = pairs(state, q, depth, offset)
    which = both(x, y)[2]
    if depth < rounds.WINDOW:
        return left(state, np.cumsum(state["at"]), places, pointers[which], q, depth)
    on = pointers[which] > 0
    return rounds.spans(state["doc"], state["n"], places[on], totals[which][on])


def repeated_spans(docs: DataFrame, q: int = Q, chunk_words: int = rounds.CHUNK_WORDS) -> DataFrame:
    """(doc_id, start_word, stop_word, n_words, copies): the maximal runs of words that are repeated, exactly; copies: how often the most frequent of a run's windows occurs.

    Words are what is between white space, as they are; first buckets are of equal 64-bit fingerprints of Q words. Texts of fewer words than a window,
    null texts and rows without an id have none; a row that is there twice counts once, rows that share an id otherwise are documents of their own. Of docs only doc_id and text are read.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "suffixes")
    chunks = rounds.packed(docs, f"{folder}/0", chunk_words)
    parts = rounds.parts_for(chunks)
    chunks = rounds.round_of(chunks, (__name__, "sample_keys", {}), (__name__, "sample_taken", {}), f"{folder}/1", max(1, parts // 8))
    drop(spark, f"{folder}/0")
    if chunks.isEmpty():
        return rounds.nothing(spark)
    chunks = rounds.round_of(chunks, (__name__, "first_keys", {"q": q}), (__name__, "first_taken", {"q": q}), f"{folder}/{q}", parts)
    drop(spark, f"{folder}/1")
    for depth, offset in depths(q):
        if chunks.isEmpty():
            return rounds.nothing(spark)
        options = {"q": q, "depth": depth, "offset": offset}
        chunks = rounds.round_of(chunks, (__name__, "pair_keys", options), (__name__, "pair_taken", options), f"{folder}/{depth}", parts, *([rounds.SPANS] if depth == rounds.WINDOW else []), owned=True)
    return chunks
