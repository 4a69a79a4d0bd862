"""SimHash near-duplicates, found through the binary Golay code.

A document has two fingerprints of 92 bits, of independent hashes: four 23-bit words each. The Golay code is perfect: each word decodes to the one codeword within 3 bits.
A word's keys are the codewords to which it and its 23 neighbours decode: 1 key, or 6. Words that differ in
at most 2 bits have a neighbour in common, so a key in common; those that differ in 3 or 4 have one with probability 0.6.
Fingerprints are joined where two of their four words share keys. By the pigeonhole principle, fingerprints that differ in at most 8
bits have two words that differ in at most 2, and always meet. Copies that share OVERLAP of their words differ in 13 or 14 bits on average; a fingerprint's keys
bring most of them together, and the second fingerprint most of those that the first has missed. All that meet within THRESHOLD bits of the same
fingerprint are candidates; the overlap of their word sets decides.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hecespark.llm.arrow import lists, mixed, steps, words
from hecespark.runtime import bind, cut, fresh

WORDS, BITS, THRESHOLD, PRINTS = 4, 23, 20, 2
#: Near duplicates have at least this share of the larger document's distinct words in common.
OVERLAP = 0.85
HALF = 2 * BITS  # a fingerprint is two integers of so many bits: hi, lo
COMBOS = tuple(itertools.combinations(range(WORDS), 2))
_GENERATOR = 0b110001110101
#: Runs of equal keys up to this length are compared pair by pair; longer ones component by component.
PAIRWISE = 48
#: There, a member is done with once it is found within SURE bits (word sets that differ too much don't get so near), or found so many times.
SURE, WITNESSES = 6, 8
#: Of ids that are sent to all workers, counted beforehand, and what one takes in a worker's hash table.
BROADCAST_BYTES, ID_BYTES = 32 << 20, 64


def syndrome(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64, copy=True)
    for b in range(BITS - 1, 10, -1):
        v ^= ((v >> b) & 1) * (_GENERATOR << (b - 11))
    return v


@cache
def leaders() -> np.ndarray:
    """The error of at most 3 bits that belongs to each syndrome."""
    flips = [sum(1 << b for b in c) for n in range(4) for c in itertools.combinations(range(BITS), n)]
    out = np.zeros(2048, np.int64)
    out[syndrome(np.array(flips))] = flips
    return out


def keys(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit word 6 codeword numbers (12 bits), and which of them are different from those before."""
    base, error = syndrome(v), leaders()
    flips = np.r_[0, 1 << np.arange(BITS)]
    shifts = syndrome(flips)
    # decoding is linear up to the coset leader: no polynomial division for each neighbour
    found = np.stack([((v ^ f) ^ error[base ^ s]) >> 11 for f, s in zip(flips, shifts)], axis=1)
    found.sort(axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    place = np.cumsum(new, axis=1) - 1
    out = np.zeros((len(v), 6), np.int64)
    rows = np.broadcast_to(np.arange(len(v))[:, None], found.shape)
    out[rows[new], place[new]] = found[new]
    return out, np.arange(6)[None, :] <= place[:, -1:]


def word_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different words (hashes) of all texts in lower case, each text's distinct words as numbers of them, and how many those are."""
    hashes, offsets = words(texts, lower=True)
    n = len(offsets) - 1
    known, codes = np.unique(hashes, return_inverse=True)
    pair = np.unique(np.repeat(np.arange(n), np.diff(offsets)) * max(1, len(known)) + codes)
    owner, code = np.divmod(pair, max(1, len(known)))
    return known, code, np.bincount(owner, minlength=n)


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hi and lo of each text, from its distinct words in lower case, and how many those are."""
    return prints_of(*word_sets(texts))


def prints_of(known: np.ndarray, code: np.ndarray, count: np.ndarray, number: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    salt = np.uint64(number * 0xC2B2AE3D27D4EB4F % (1 << 64))
    n = len(count)
    first, second = mixed(known + salt), mixed(known + salt + np.uint64(0x9E3779B97F4A7C15))
    bits = np.unpackbits(np.stack([first, second], axis=1).view(np.uint8), axis=1)[:, : 2 * HALF].astype(np.uint8) if len(known) else np.zeros((0, 2 * HALF), np.uint8)
    sums = np.zeros((n, 2 * HALF), np.int64)
    filled = np.flatnonzero(count)
    if len(filled):
        begin = (np.cumsum(count) - count)[filled]
        sums[filled] = np.add.reduceat(bits[code], begin, axis=0, dtype=np.int32)
    on = (2 * sums > count[:, None]).astype(np.int64)
    weights = np.int64(1) << np.arange(HALF - 1, -1, -1)
    return on[:, :HALF] @ weights, on[:, HALF:] @ weights, count


def fingerprint_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text", 2 << 20):
        known, code, n = word_sets(batch.column("text"))
        made = [pa.array(x) for k in range(PRINTS) for x in prints_of(known, code, n, k)[:2]]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made, pa.array(n)], names=["doc_id", *HALVES, "n_words"]).filter(pa.array(n > 0))


HALVES = [f"{x}{k or ''}" for k in range(PRINTS) for x in ("hi", "lo")]


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, hi and lo of each fingerprint, and n_words, of documents that have an id and words."""
    return docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(bind(__name__, "fingerprint_kernel"), f"doc_id bigint, {', '.join(f'{x} bigint' for x in HALVES)}, n_words bigint")


def set_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text", 2 << 20):
        known, code, n = word_sets(batch.column("text"))
        offsets = np.r_[0, np.cumsum(n)]
        mark = np.r_[np.uint64(0), np.cumsum(mixed(known[code] + np.uint64(1)))]
        values = lists(mixed(known)[code].astype(np.uint32).view(np.int32), offsets, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array((mark[offsets[1:]] - mark[offsets[:-1]]).view(np.int64)), values], names=["doc_id", "mark", "words"]).filter(pa.array(n > 0))


def overlap_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with the words of both, those whose sets overlap enough."""
    for batch in batches:
        x, y = batch.column("x"), batch.column("y")
        good = [len(np.intersect1d(p, q)) >= OVERLAP * max(len(p), len(q)) for p, q in ((x[i].values.to_numpy(), y[i].values.to_numpy()) for i in range(batch.num_rows))]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of documents that have OVERLAP of the larger one's distinct words in common. Of documents with the same id, any counts."""
    named = sized(pairs.select(F.explode(F.array("a", "b")).alias("named")).distinct())
    given = docs.select("doc_id", "text").where("doc_id is not null and text is not null").join(named, F.col("doc_id") == F.col("named"), "left_semi")
    sets = cut(given.mapInArrow(bind(__name__, "set_kernel"), "doc_id bigint, mark bigint, words array<int>").dropDuplicates(["doc_id", "mark"]))
    side = lambda node, name: sets.select(F.col("doc_id").alias(node), F.col("words").alias(name))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(bind(__name__, "overlap_kernel"), "a bigint, b bigint")


def key_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each fingerprint, a row for each pair of words and key of the first of them, with the keys of the second."""
    low = (1 << BITS) - 1
    for batch in batches:
        for k in range(PRINTS):
            mine = {"doc_id": batch.column("doc_id"), "hi": batch.column(HALVES[2 * k]), "lo": batch.column(HALVES[2 * k + 1])}
            hi, lo = mine["hi"].to_numpy(), mine["lo"].to_numpy()
            by = [keys(v) for v in (hi >> BITS, hi & low, lo >> BITS, lo & low)]
            for c, (i, j) in enumerate(COMBOS):
                row, at = np.nonzero(by[i][1])
                size = by[j][1].sum(axis=1)
                offsets = np.r_[0, np.cumsum(size[row])]
                second = by[j][0][row][by[j][1][row]]
                take = pa.array(row)
                key = (k * len(COMBOS) + c) << 12 | by[i][0][row, at]
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), *(x.take(take) for x in mine.values()), lists(second.astype(np.int16), offsets, pa.int16())], names=["key", *mine, "second"])


def distance(hi: np.ndarray, lo: np.ndarray, a, b) -> np.ndarray:
    return np.bitwise_count((hi[a] ^ hi[b]).astype(np.uint64)).astype(np.int64) + np.bitwise_count((lo[a] ^ lo[b]).astype(np.uint64))


def near(hi: np.ndarray, lo: np.ndarray, a, b) -> np.ndarray:
    return distance(hi, lo, a, b) <= THRESHOLD


def linked(hi: np.ndarray, lo: np.ndarray, members: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that join the members as all their near pairs would: from each found member to those that aren't done with."""
    out, rest = [], members
    found = np.zeros(len(members), np.int64)
    while len(rest) > 1:
        queue, rest, found = [rest[0]], rest[1:], found[1:]
        while queue and len(rest):
            x = queue.pop()
            d = distance(hi, lo, np.full(len(rest), x), rest)
            hit = d <= THRESHOLD
            if hit.any():
                out.append((np.full(hit.sum(), x), rest[hit]))
                found = found + hit
                done = (d <= SURE) | (found >= WITNESSES)
                queue.extend(rest[done].tolist())
                rest, found = rest[~done], found[~done]
    return out


def edges(key: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between positions of equal key whose fingerprints are near: enough of them to connect what all would."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    sizes = np.diff(np.r_[starts, len(k)])
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    size_at = np.repeat(sizes, sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(k))  # entries up to the run's end
    some = np.flatnonzero((size_at > 1) & (size_at <= PAIRWISE))
    for d in range(1, PAIRWISE):
        some = some[left[some] > d]
        if not len(some):
            break
        x, y = order[some], order[some + d]
        good = near(hi, lo, x, y)
        a.append(x[good])
        b.append(y[good])
    for s, n in zip(starts[sizes > PAIRWISE].tolist(), sizes[sizes > PAIRWISE].tolist()):
        for x, y in linked(hi, lo, order[s : s + n]):
            a.append(x)
            b.append(y)
    return np.concatenate(a), np.concatenate(b)


def edge_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near edges within keys; rows (key, hi, lo, doc_id) come in the order of the keys, and a key's rows alone are held until all are there."""
    held: list[pa.RecordBatch] = []

    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        key, hi, lo, ids = (t.column(c).to_numpy() for c in ("key", "hi", "lo", "doc_id"))
        x, y = edges(key, hi, lo)
        a, b = ids[x], ids[y]
        found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        found = found[found[:, 0] != found[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        last = int(np.searchsorted(key, key[-1]))  # where the batch's last key begins
        if last or (held and held[-1].column("key")[0].as_py() != key[-1]):
            rows = [*held, batch.slice(0, last)] if last else held
            yield flush(rows)
            held = []
        held.append(batch.slice(last))
    if held:
        yield flush(held)


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the smallest node that can be reached from each node of pairs (a, b), by large-star and small-star rounds."""
    e = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    by_u = Window.partitionBy("u")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(by_u))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.withColumn("m", F.min("v").over(by_u))
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        mark = now


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, group_id, n_docs) of each document that has a near duplicate; group_id is the smallest doc_id of its group.

    A group is what is connected by pairs that met, within THRESHOLD bits, and have OVERLAP of their words in common. A repeated doc_id counts once;
    documents whose text is null or has no word, or that have no id, are in no group. All documents of equal
    fingerprints are represented by one in the search, so that copies cost nothing there.
    """
    prints = cut(fingerprinted(docs))
    same = prints.groupBy(*HALVES).agg(F.min("doc_id").alias("doc_id"))
    keyed = same.mapInArrow(bind(__name__, "key_kernel"), "key int, doc_id bigint, hi bigint, lo bigint, second array<smallint>")
    # rows are shuffled with the keys of their second word in a list, and spread over those, 4,096 times as many, where they have arrived
    pairs = keyed.repartition("key").select("key", F.explode("second").alias("second"), "hi", "lo", "doc_id")
    pairs = pairs.select((F.shiftleft(F.col("key").cast("bigint"), 12) + F.col("second")).alias("key"), "hi", "lo", "doc_id")
    found = pairs.sortWithinPartitions("key").mapInArrow(bind(__name__, "edge_kernel"), "a bigint, b bigint")
    found = verified(cut(found.distinct()), docs)
    copies = prints.withColumn("a", F.min("doc_id").over(Window.partitionBy(*HALVES))).where("a <> doc_id").select("a", F.col("doc_id").alias("b"))
    joined = components(found.unionByName(copies))
    return joined.select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"), F.count("*").over(Window.partitionBy("root")).alias("n_docs"))


def drop_near(docs: DataFrame) -> DataFrame:
    """The documents without those that are in a group and aren't its group_id. Of equal rows of one doc_id one stays, of others none goes;
    null ids stay, and so do null and empty texts. Texts are shuffled only where there are too many ids to broadcast, or ids that repeat."""
    gone = fresh(docs.columns, "gone")
    extra = groups(docs).where("doc_id <> group_id").select(F.col("doc_id").alias(gone))
    kept = docs.join(sized(extra), F.col(gone) == docs["doc_id"], "left_anti")
    twice = cut(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(gone)))
    if twice.isEmpty():
        return kept
    twice = sized(twice)
    once = kept.join(twice, kept["doc_id"] == twice[gone], "left_anti")
    return once.unionByName(kept.join(twice, kept["doc_id"] == twice[gone], "left_semi").dropDuplicates(["doc_id", "text"]))


def sized(ids: DataFrame) -> DataFrame:
    """ids (of one column) written once; to be broadcast where they are counted and found to take up to BROADCAST_BYTES, else joined by a shuffle."""
    ids = cut(ids)
    return F.broadcast(ids) if ids.count() * ID_BYTES <= BROADCAST_BYTES else ids.hint("merge")
