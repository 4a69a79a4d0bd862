"""Spark rounds over packed chunks of documents: what the two substring deduplicators share.

A chunk is some 2 million words of whole documents; its arrays are in a file of the shared folder, and a row (chunk, path) stands for it.
In a round every chunk sends the different keys that it holds, each once with its number of occurrences, sorted and packed, to the parts that own them. A
part merges what it has got, finds the keys that occur more than once, and numbers them in their order: part << 32 | rank is the key's
*pointer*. Each chunk gets its own keys' pointers back (0: there is no other occurrence), aligned with the order in which it sent them,
and writes its next arrays. So a key that is in very many places is one entry for each chunk, no document travels, and what has turned out to be
unique isn't sent again. A part owns about PART_KEYS keys, however many there are in all.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hecespark.llm.arrow import mixed, steps, words
from hecespark.llm.warc import open_fs
from hecespark.runtime import bind, cut

#: A window is so many words in a row. A word is *repeated* if a window that covers it occurs elsewhere: in another document, or at another place of the same.
WINDOW = 50
CHUNK_WORDS, PART_KEYS, MOST_TASKS = 1 << 21, 1 << 21, 20_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SPANS = "doc_id bigint, start_word int, stop_word int, n_words int, copies bigint"


# --- names of word sequences ---


def named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprint of a then b."""
    return mixed(a * _A + b + _B)


def refined(ids: np.ndarray, offset: int) -> np.ndarray:
    """Identifiers of longer starts: that of each position with that of the position ``offset`` later (0 beyond the end)."""
    later = np.zeros_like(ids)
    if offset < len(ids):
        later[:-offset] = ids[offset:]
    return named(ids, later)


def starts_of(hashes: np.ndarray, length: int) -> np.ndarray:
    """An identifier of the ``length`` words from each position on: doubled, then completed by an overlapping start."""
    ids, have = hashes, 1
    while have * 2 <= length:
        ids, have = refined(ids, have), have * 2
    return refined(ids, length - have) if have < length else ids


def windows(n: np.ndarray) -> np.ndarray:
    """The word positions at which windows start, for documents of n words each."""
    m = np.maximum(n - WINDOW + 1, 0)
    return np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(np.cumsum(n) - n, m)


# --- packed arrays ---


def blob(**arrays: np.ndarray) -> bytes:
    """Arrays as bytes: their byte planes, compressed."""
    made = {}
    for name, x in arrays.items():
        x = np.ascontiguousarray(x)
        planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
        made[name] = (x.dtype.str, len(x), pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(x) else b"")
    return pickle.dumps(made)


def unblob(data: bytes) -> dict[str, np.ndarray]:
    out = {}
    for name, (kind, n, packed) in pickle.loads(data).items():
        size = np.dtype(kind).itemsize
        raw = np.frombuffer(pa.decompress(packed, n * size, codec="zstd"), np.uint8) if n else np.zeros(0, np.uint8)
        out[name] = np.ascontiguousarray(raw.reshape(size, n).T).view(kind).ravel()
    return out


def steps_of(x: np.ndarray) -> np.ndarray:
    """Differences of a sorted array, which numpy.cumsum undoes."""
    return np.diff(x, prepend=x.dtype.type(0))


def save(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """A new file of the arrays in the folder: an attempt that is done again leaves the former's alone."""
    path = f"{folder}/{uuid.uuid4().hex}"
    system, at = open_fs(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(at) as f:
        f.write(blob(**arrays))
    return path


def load(path: str) -> dict[str, np.ndarray]:
    system, at = open_fs(path)
    with system.open_input_stream(at) as f:
        return unblob(f.read())


# --- chunks ---


def pack_kernel(batches: Iterator[pa.RecordBatch], folder: str, size: int) -> Iterator[pa.RecordBatch]:
    """Files of whole documents' words, as numbers of the chunk's different ones: (chunk, path, n)."""
    import pandas as pd

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        ids, n, hashes = (np.concatenate(x) for x in zip(*held))
        codes, known = pd.factorize(hashes)
        path = save(folder, {"doc": ids, "n": n, "codes": codes.astype(np.uint32), "words": known})
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65]), pa.array([path]), pa.array([len(hashes)])], names=["chunk", "path", "n"])

    total = 0
    for batch in steps(batches, "text"):
        hashes, offsets = words(batch.column("text"))
        held.append((batch.column("doc_id").to_numpy(), np.diff(offsets), hashes))
        total += len(hashes)
        if total >= size:
            yield flush()
            held, total = [], 0
    if total:
        yield flush()


def hashes_of(state: dict[str, np.ndarray]) -> np.ndarray:
    return state["words"][state["codes"]]


def packed(docs: DataFrame, folder: str, size: int = CHUNK_WORDS) -> DataFrame:
    """(chunk, path, n) of the documents that have an id and a text; a row that is there twice counts once."""
    given = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    twice = cut(given.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("twice")))
    if not twice.isEmpty():
        again = given.join(twice, F.col("doc_id") == F.col("twice"), "left_semi").dropDuplicates(["doc_id", "text"])
        given = given.join(twice, F.col("doc_id") == F.col("twice"), "left_anti").unionByName(again)
    return cut(given.mapInArrow(bind(__name__, "pack_kernel", folder, size), "chunk bigint, path string, n bigint"))


# --- rounds ---

#: (sorted keys, second halves of the keys (sorted within the first) or None, numbers of occurrences)
Keys = tuple[np.ndarray, np.ndarray | None, np.ndarray]


def call(function: tuple[str, str, dict]) -> Callable:
    import importlib

    module, name, options = function
    found = getattr(importlib.import_module(module), name)
    return lambda *args: found(*args, **options)


def send_kernel(batches: Iterator[pa.RecordBatch], keys: tuple, parts: int, owned: bool) -> Iterator[pa.RecordBatch]:
    """Messages (part, chunk, data) of the chunks: keys go by their range of all 64 bits, or where they are ``owned`` pointers to the part that has made them."""
    of = call(keys)
    edges = np.array([k << 32 if owned else k * ((1 << 64) // parts) for k in range(1, parts)], np.uint64)
    for batch in batches:
        for chunk, path in zip(batch.column("chunk").to_pylist(), batch.column("path").to_pylist()):
            a, b, m = of(load(path))
            cuts = np.searchsorted(a, edges)
            for part, (x, y) in enumerate(zip(np.r_[0, cuts], np.r_[cuts, len(a)])):
                if x < y:
                    data = {"a": steps_of(a[x:y]), "m": m[x:y].astype(np.uint32)} | ({} if b is None else {"b": b[x:y]})
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([chunk]), pa.array([blob(**data)], pa.binary())], names=["part", "chunk", "data"])


MESSAGE = "part int, chunk bigint, data binary"


def name_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers (part, chunk, data) to the messages, which come part by part."""
    held: list[tuple[int, dict]] = []
    part = None
    for batch in batches:
        for p, chunk, data in zip(*(batch.column(c).to_pylist() for c in ("part", "chunk", "data"))):
            if held and p != part:
                yield from answers(part, held)
                held = []
            part = p
            held.append((chunk, unblob(data)))
    if held:
        yield from answers(part, held)


def answers(part: int, messages: list[tuple[int, dict]]) -> Iterator[pa.RecordBatch]:
    size = np.array([len(x["a"]) for _, x in messages])
    a = np.concatenate([np.cumsum(x["a"], dtype=np.uint64) for _, x in messages])
    m = np.concatenate([x["m"] for _, x in messages]).astype(np.int64)
    if "b" in messages[0][1]:
        b = np.concatenate([x["b"] for _, x in messages])
        order = np.lexsort((b, a))
        new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
    else:
        order = np.argsort(a, kind="stable")
        new = np.r_[True, a[order][1:] != a[order][:-1]]
    total = np.add.reduceat(m[order], np.flatnonzero(new))
    rank = np.where(total > 1, np.cumsum(total > 1), 0)
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(new) - 1
    ends = np.cumsum(size)
    for (chunk, _), begin, end in zip(messages, ends - size, ends):
        mine = which[begin:end]
        r = rank[mine]
        on = r > 0
        data = blob(on=np.packbits(on), rank=steps_of(r[on]).astype(np.uint32), total=total[mine][on].astype(np.uint64), size=np.array([end - begin]))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([chunk]), pa.array([data], pa.binary())], names=["part", "chunk", "data"])


def take_kernel(batches: Iterator[pa.RecordBatch], then: tuple, folder: str) -> Iterator[pa.RecordBatch]:
    """A chunk's row and then its answers, part by part: what ``then`` makes of its arrays, pointers and totals."""
    following = call(then)
    held: list[tuple[int, bytes]] = []
    now = None
    for batch in batches:
        for chunk, part, data in zip(*(batch.column(c).to_pylist() for c in ("chunk", "part", "data"))):
            if held and chunk != now:
                yield from taken(now, held, following, folder)
                held = []
            now = chunk
            held.append((part, data))
    if held:
        yield from taken(now, held, following, folder)


def taken(chunk: int, rows: list[tuple[int, bytes]], following: Callable, folder: str) -> Iterator[pa.RecordBatch]:
    pointers, totals = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for part, data in rows[1:]:
        x = unblob(data)
        on = np.unpackbits(x["on"], count=int(x["size"][0])).astype(bool)
        pointer, total = np.zeros(len(on), np.uint64), np.zeros(len(on), np.int64)
        pointer[on] = np.cumsum(x["rank"], dtype=np.uint64) + np.uint64(part << 32)
        total[on] = x["total"]
        pointers.append(pointer)
        totals.append(total)
    made = following(load(rows[0][1].decode()), np.concatenate(pointers), np.concatenate(totals))
    if isinstance(made, pa.RecordBatch):
        yield made
    elif made is not None:
        yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([save(folder, made)]), pa.array([len(next(iter(made.values())))])], names=["chunk", "path", "n"])


def tasks(n: int) -> int:
    return max(1, min(n, MOST_TASKS))


def round_of(chunks: DataFrame, keys: tuple, then: tuple, folder: str, parts: int, schema: str = "chunk bigint, path string, n bigint", owned: bool = False) -> DataFrame:
    """One round: keys(arrays) of each chunk are named over all chunks, and then(arrays, pointers, totals) makes its next arrays (None: nothing is left), or rows of ``schema``.
    ``owned``: the keys' first halves are pointers of a round of as many parts."""
    sent = chunks.mapInArrow(bind(__name__, "send_kernel", keys, parts, owned), MESSAGE)
    sent = sent.repartitionById(tasks(parts), F.pmod("part", F.lit(tasks(parts))).cast("int")).sortWithinPartitions("part")
    answered = sent.mapInArrow(bind(__name__, "name_kernel"), MESSAGE)
    own = chunks.select("chunk", F.lit(-1).alias("part"), F.encode("path", "UTF-8").alias("data"))
    both = own.unionByName(answered).repartition(tasks(chunks.count()), "chunk").sortWithinPartitions("chunk", "part")
    made = both.mapInArrow(bind(__name__, "take_kernel", then, folder), schema)
    return cut(made) if schema.startswith("chunk") else made


def parts_for(chunks: DataFrame, share: float = 1.0) -> int:
    n = chunks.agg(F.sum("n")).first()[0] or 0
    return max(1, -(-int(n * share) // PART_KEYS))


def spans(doc: np.ndarray, n: np.ndarray, at: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    """The maximal runs of repeated words, from the places of repeated windows and how often each occurs."""
    ends = np.cumsum(n)
    owner = np.searchsorted(ends, at, side="right")
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (at[1:] > at[:-1] + WINDOW)]) if len(at) else np.zeros(0, np.int64)
    last = np.r_[new[1:], len(at)] - 1 if len(at) else new
    begin = (ends - n)[owner[new]] if len(at) else new
    start, stop = at[new] - begin, at[last] + WINDOW - begin
    copies = np.maximum.reduceat(total, new) if len(at) else np.zeros(0, np.int64)
    columns = [doc[owner[new]], start.astype(np.int32), stop.astype(np.int32), (stop - start).astype(np.int32), copies.astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "start_word", "stop_word", "n_words", "copies"])


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SPANS)
