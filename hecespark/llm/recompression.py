"""Substring deduplication by recompression.

Words become symbols, which are joined again and again: a run of one symbol becomes a symbol of its own, and of the other symbols, split into left and
right ones by a bit of their names, each left one followed by a right one becomes a symbol for the pair. What is joined depends on
the neighbours alone, so that equal passages turn into equal symbols but for a few at their ends. A Spark round goes on until symbols have LEVELS[k] words, then
names them globally: a symbol that is somewhere else too gets its pointer as a name that all documents share, of which the next
round's symbols are made; one that occurs once is dead, joins nothing any more, and neither does any text around it repeat.

High-level symbols that are alive reveal repeats: of the windows, those whose middle lies in a dead symbol within them are unique. The last
round verifies the others word by word, as far as fingerprints of 96 bits of all their words can: windows that have the same are equal.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from hecespark.llm import rounds
from hecespark.llm.arrow import mixed
from hecespark.llm.suffixes import both, counted
from hecespark.runtime import drop, scratch

#: Words of a symbol from which on it is named in the rounds. Longer ones wouldn't fit into windows whole.
LEVELS = (4, 8)
_RUN, _SIDE, _SECOND = np.uint64(0xA24BAED4963EE407), 0x9FB21C651E98DF25, np.uint64(0x9FB21C651E98DF25)


def compress(symbol: np.ndarray, size: np.ndarray, first: np.ndarray, dead: np.ndarray, long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joins symbols until all that could be joined have ``long`` words or more. ``first``: symbols that begin a document; size in words."""
    k = 0
    while len(symbol) > 1:
        free = (size < long) & ~dead
        joins = ~first[1:] & free[1:] & free[:-1]
        if not joins.any():
            break
        same = joins & (symbol[1:] == symbol[:-1])
        if same.any():
            head = np.flatnonzero(np.r_[True, ~same])
            count = np.diff(np.r_[head, len(symbol)])
            symbol = np.where(count > 1, rounds.named(symbol[head], count.astype(np.uint64) * _RUN), symbol[head])
            size = np.add.reduceat(size, head)
            first, dead = first[head], dead[head]
            free = (size < long) & ~dead
            joins = ~first[1:] & free[1:] & free[:-1]
        k += 1
        right = (mixed(symbol + np.uint64(k * _SIDE % (1 << 64))) & np.uint64(1)).astype(bool)
        pair = np.flatnonzero(joins & ~right[:-1] & right[1:])
        symbol, size = symbol.copy(), size.copy()
        symbol[pair] = rounds.named(symbol[pair], symbol[pair + 1])
        size[pair] += size[pair + 1]
        keep = np.ones(len(symbol), bool)
        keep[pair + 1] = False
        symbol, size, first, dead = symbol[keep], size[keep], first[keep], dead[keep]
    return symbol, size, first, dead


def symbols(state: dict, long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's symbols, joined up to ``long`` words."""
    if "symbols" in state:
        symbol, size, dead = state["names"][state["symbols"]], state["sizes"].astype(np.int64), np.unpackbits(state["dead"], count=len(state["sizes"])).astype(bool)
    else:
        symbol = rounds.hashes_of(state)
        size, dead = np.ones(len(symbol), np.int64), np.zeros(len(symbol), bool)
    starts = np.zeros(int(size.sum()) + 1, bool)
    starts[np.cumsum(state["n"]) - state["n"]] = True
    return compress(symbol, size, starts[np.cumsum(size) - size], dead, long)


def level_keys(state: dict, long: int) -> rounds.Keys:
    symbol, _, _, dead = symbols(state, long)
    a, _, m = counted(symbol[~dead])
    return a, None, m


def level_taken(state: dict, pointers: np.ndarray, totals: np.ndarray, long: int) -> dict:
    symbol, size, first, dead = symbols(state, long)
    alive = np.flatnonzero(~dead)
    found = pointers[counted(symbol[alive])[1]]
    name, gone = np.zeros(len(symbol), np.uint64), np.ones(len(symbol), bool)
    name[alive] = mixed(found + np.uint64(long))  # spread, so that bits tell left from right
    gone[alive] = found == 0
    name[gone] = 0
    names, codes = np.unique(name, return_inverse=True)
    base = {k: state[k] for k in ("doc", "n", "codes", "words")}
    return base | {"names": names, "symbols": codes.astype(np.uint32), "sizes": size.astype(np.uint32), "dead": np.packbits(gone)}


def open_windows(state: dict) -> np.ndarray:
    """Where the windows start that may be repeated."""
    size = state["sizes"].astype(np.int64)
    dead = np.unpackbits(state["dead"], count=len(size)).astype(bool)
    at = rounds.windows(state["n"])
    start = np.cumsum(size) - size
    middle = np.repeat(np.arange(len(size)), size)[at + rounds.WINDOW // 2]
    within = (start[middle] >= at) & (start[middle] + size[middle] <= at + rounds.WINDOW)
    return at[~(dead[middle] & within)]


def window_names(state: dict, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent fingerprints of the windows' words, of 64 and 32 bits."""
    h = rounds.hashes_of(state)
    return rounds.starts_of(h, rounds.WINDOW)[at], rounds.starts_of(mixed(h + _SECOND), rounds.WINDOW)[at] & np.uint64(0xFFFFFFFF)


def window_keys(state: dict) -> rounds.Keys:
    a, b, _, m = both(*window_names(state, open_windows(state)))
    return a, b.astype(np.uint32), m


def window_taken(state: dict, pointers: np.ndarray, totals: np.ndarray):
    at = open_windows(state)
    which = both(*window_names(state, at))[2]
    on = pointers[which] > 0
    return rounds.spans(state["doc"], state["n"], at[on], totals[which][on])


def repeated_spans(docs: DataFrame, levels: tuple[int, ...] = LEVELS, chunk_words: int = rounds.CHUNK_WORDS) -> DataFrame:
    """(doc_id, start_word, stop_word, n_words, copies): runs of words that are repeated; copies: how often the most frequent of a run's windows occurs.

    All that is found is repeated. A window whose middle symbol its surroundings changed may be missed; its neighbours cover nearly all such words. Texts of fewer
    words than a window, null texts and rows without an id have none; a row that is there twice counts once. Of docs only doc_id and text are read.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "recompression")
    chunks = rounds.packed(docs, f"{folder}/0", chunk_words)
    parts, before = rounds.parts_for(chunks), f"{folder}/0"
    for long in levels:
        options = {"long": long}
        share = max(1, parts * 2 // long)
        chunks = rounds.round_of(chunks, (__name__, "level_keys", options), (__name__, "level_taken", options), f"{folder}/{long}", share)
        drop(spark, before)
        before = f"{folder}/{long}"
    return rounds.round_of(chunks, (__name__, "window_keys", {}), (__name__, "window_taken", {}), folder, parts, rounds.SPANS)
