"""Small helpers for Arrow kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts of one numpy step: wide temporaries are made for so many bytes, or for one longer text.
STEP_BYTES = 4 << 20


def steps(batches: Iterator[pa.RecordBatch], text: str | None = None, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, sliced so that the column ``text`` (strings or binary) of each has about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        if text is None:
            yield batch
            continue
        sizes = np.nan_to_num(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(np.float64))
        part = (np.cumsum(sizes) // limit).astype(np.int64)
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
            yield batch.slice(a, b - a)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (between white space) of the texts, and the offsets of each text's words.

    A null text has no words. The hash depends on the word alone.
    """
    import pandas as pd

    if lower:
        texts = pc.utf8_lower(texts)
    parts = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    if isinstance(parts, pa.ChunkedArray):
        parts = parts.combine_chunks()
    flat, counts = parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = flat.dictionary_encode()
    known = pd.util.hash_array(np.asarray(coded.dictionary.to_pylist(), dtype=object), categorize=False) if len(coded.dictionary) else np.zeros(0, np.uint64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    ends = np.cumsum(counts)
    empty = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    hashes = known[codes] if len(codes) else np.zeros(0, np.uint64)
    if empty.any():
        real = ~empty[codes]
        before = np.r_[0, np.cumsum(real)]
        return hashes[real], before[np.r_[0, ends]]
    return hashes, np.r_[0, ends]
