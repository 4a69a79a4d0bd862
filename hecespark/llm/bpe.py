"""BPE encoding and decoding with public vocabularies.

A vocabulary is a rank file (base64 token, rank): a token's rank is its id, and merges apply in the order of
ranks. Encoding is the backtracking method: at each byte the longest token of an Aho-Corasick automaton is
tried, then its shorter prefixes; a token may follow another only where the pair is *compatible*, i.e. merging
would leave the boundary between them; a position found to be a dead end is never tried again. That gives exactly the tokens
of rank-ordered merging, in time linear in the bytes. Decoding gathers bytes through a table of offsets. The order of steps of the
backtracking follows that of the encoder which the open-source Rust crate bpe (MIT licence) has published.
"""

from __future__ import annotations

import base64
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from hecespark.llm.arrow import steps
from hecespark.runtime import bind

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits a text before merging, as for the vocabulary's own tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pieces that a worker keeps the tokens of; beyond that it starts again.
CACHED_PIECES = 200_000
#: Bytes of text whose temporaries are in memory together, for texts that are shorter than that.
STEP = 1 << 20


class Vocabulary:
    def __init__(self, rank_file: bytes):
        import ahocorasick

        pairs = (line.split() for line in rank_file.splitlines() if line.strip())
        self.tokens = [t for _, t in sorted((int(r), base64.b64decode(t)) for t, r in pairs)]
        self.rank = {t: i for i, t in enumerate(self.tokens)}
        if len(self.rank) != len(self.tokens) or any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("a rank file must have distinct tokens and all single bytes")
        self.data = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.offsets = np.r_[0, np.cumsum([len(t) for t in self.tokens])].astype(np.int64)
        # ahocorasick has str keys: a byte is the character of its number
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.lengths = [len(t) for t in self.tokens]
        self.shorter = [self._prefix(t) for t in self.tokens]
        self.halves, self.merged = [], {}
        for i, t in enumerate(self.tokens):
            a, b = self._split(t, i)
            self.halves.append((a, b))
            if a != i:
                self.merged[a, b] = i
        self.compatible: dict[tuple[int, int], bool] = {}

    def _prefix(self, token: bytes) -> int:
        for n in range(len(token) - 1, 0, -1):
            if (i := self.rank.get(token[:n])) is not None:
                return i
        return -1

    def _split(self, token: bytes, i: int) -> tuple[int, int]:
        """The two tokens whose merge makes token i: what merges of lower rank leave of its bytes."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            best, at = i, -1
            for k in range(len(parts) - 1):
                r = self.rank.get(parts[k] + parts[k + 1], i)
                if r < best:
                    best, at = r, k
            if at < 0:
                return i, i
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else (i, i)

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the bytes of tokens a and b gives just a, b: no merge across the boundary comes in time."""
        known = self.compatible.get((a, b))
        if known is not None:
            return known
        left, right, limit, ok = a, b, len(self.tokens) + 1, True
        while True:
            if self.merged.get((left, right), limit) < limit:
                ok = False
                break
            if left > right:
                limit = left
                left = self.halves[left][1]
                if left == limit:
                    limit = right + 1
                    right = self.halves[right][0]
                    if right + 1 == limit:
                        break
            else:
                limit = right + 1
                right = self.halves[right][0]
                if right + 1 == limit:
                    limit = left
                    left = self.halves[left][1]
                    if left == limit:
                        break
        if len(self.compatible) < 500_000:
            self.compatible[a, b] = ok
        return ok

    def encode(self, piece: bytes) -> list[int]:
        if (i := self.rank.get(piece)) is not None and self.halves[i][0] != i:
            return [i]
        text, n = piece.decode("latin-1"), len(piece)
        best = self._starts(text)
        lengths, shorter, ok = self.lengths, self.shorter, self.may_follow
        dead, out, at = bytearray(n + 1), [], 0
        token = best[0] if n else -1
        while at < n:
            end = at + lengths[token]
            if not dead[end] and (not out or ok(out[-1], token)):
                out.append(token)
                at = end
                if at < n:
                    token = best[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead[at] = 1
                token = out.pop()
                at -= lengths[token]
                # the token that led here is tried again, and fails, as its end is dead
        return out

    def _starts(self, text: str) -> list[int]:
        best = [-1] * len(text)
        lengths = self.lengths
        for end, i in self.automaton.iter(text):
            start = end - lengths[i] + 1
            if best[start] < 0 or lengths[i] > lengths[best[start]]:
                best[start] = i
        return best

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decode_all(ids)[0].tobytes()

    def decode_all(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after another, and where each id's bytes end."""
        size = self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offsets[ids] - (ends - size), size)
        return self.data[where], ends


class Pieces:
    """A vocabulary with the tokens of pieces seen before: 32-bit integers as bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[bytes, bytes] = {}

    def of(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.known) > CACHED_PIECES:
            self.known.clear()
        known, encode = self.known, self.vocabulary.encode
        out = []
        for p in pieces:
            found = known.get(p)
            if found is None:
                ids = encode(p)
                found = struct.pack(f"{len(ids)}i", *ids)
                if len(p) < 64:
                    known[p] = found
            out.append(found)
        return out


_loaded: dict[int, Pieces] = {}
_classes: list[np.ndarray] = []
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4


def load(rank_file: bytes) -> Pieces:
    key = zlib.crc32(rank_file)
    if key not in _loaded:
        _loaded[key] = Pieces(Vocabulary(rank_file))
    return _loaded[key]


def classes() -> np.ndarray:
    """Letter, number, white space or other, for each code point, as the regex library has them."""
    if not _classes:
        import regex

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                a, b = ord(every[m.start()]), ord(every[m.end() - 1])
                table[a : b + 1] = kind
        table[0xD800:0xE000] = OTHER
        _classes.append(table)
    return _classes[0]


def boundaries(texts: list[str]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Where PATTERN's pieces of the texts start, in bytes of all texts one after another; the number of pieces
    of each text; those bytes. Without a regex: by class changes over all characters at once. A blank
    before another class belongs to it; the last of several white-space characters before it stands alone or
    is that blank. Texts with an apostrophe, where contractions may be, go through the regex.
    """
    import regex

    find = None
    whole = "".join(texts)
    code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    n = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    kind = classes()[code]
    first = np.zeros(len(code) + 1, bool)
    first[starts[n > 0]] = True
    change = np.empty(len(code), bool)
    if len(code):
        change[0] = True
        np.not_equal(kind[1:], kind[:-1], out=change[1:])
        change |= first[:-1]
        space = kind == SPACE
        # the last white space of a run that something follows in the same text
        last = np.zeros(len(code), bool)
        last[:-1] = space[:-1] & ~space[1:] & ~first[1:-1]
        cut = change.copy()
        cut |= last
        follows = np.zeros(len(code), bool)
        follows[1:] = last[:-1]
        blank_before = np.zeros(len(code), bool)
        blank_before[1:] = last[:-1] & (code[:-1] == 32)
        cut &= ~(follows & blank_before)
    else:
        cut = change
    apostrophes = np.flatnonzero(np.add.reduceat((code == 39).astype(np.int64), starts[n > 0])) if (n > 0).any() and len(code) else []
    full = np.flatnonzero(n > 0)
    for k in full[apostrophes] if len(apostrophes) else []:
        find = find or regex.compile(PATTERN).finditer
        cut[starts[k] : ends[k]] = False
        cut[[starts[k] + m.start() for m in find(texts[k])]] = True
    width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    at = np.cumsum(width) - width
    counts = np.r_[0, np.cumsum(cut)]
    return at[cut], counts[ends] - counts[starts], whole.encode()


def encode_all(pieces: Pieces, texts: list[str], pattern: str) -> tuple[np.ndarray, np.ndarray, bytes]:
    """The tokens of all texts one after another, the number of each text's tokens, and the texts' bytes."""
    if pattern == PATTERN:
        at, counts, whole = boundaries(texts)
    else:
        import regex

        found = [[m.encode() for m in regex.compile(pattern).findall(t)] for t in texts]
        counts = np.array([len(x) for x in found], np.int64)
        whole = b"".join(p for x in found for p in x)
        size = np.array([len(p) for x in found for p in x], np.int64)
        at = np.cumsum(size) - size
    if not len(at):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64), whole
    buffers = [None, pa.py_buffer(np.r_[at, len(whole)].astype(np.int32)), pa.py_buffer(whole)]
    coded = pa.Array.from_buffers(pa.binary(), len(at), buffers).dictionary_encode()
    tokens = pieces.of(coded.dictionary.to_pylist())
    size = np.array([len(x) for x in tokens], np.int64) // 4
    flat = np.frombuffer(b"".join(tokens), np.int32)
    base = np.cumsum(size) - size
    which = coded.indices.to_numpy()
    each = size[which]
    stop = np.cumsum(each)
    ids = flat[np.arange(stop[-1]) + np.repeat(base[which] - (stop - each), each)]
    upto = np.r_[0, stop][np.r_[0, np.cumsum(counts)]]
    return ids, np.diff(upto), whole


def kernel(batches: Iterator[pa.RecordBatch], packed: bytes, text: str, pattern: str, keep: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    pieces = load(zlib.decompress(packed))
    for batch in steps(batches, text, STEP):
        column = batch.column(text)
        texts = pc.fill_null(column, "").to_pylist()
        null = column.is_null().to_numpy(zero_copy_only=False)
        ids, n, whole = encode_all(pieces, texts, pattern)
        data, stops = pieces.vocabulary.decode_all(ids.astype(np.int64))
        ends = np.r_[0, np.cumsum(n)]
        stops = np.r_[0, stops][ends]
        sizes = pc.binary_length(pc.fill_null(column, "")).to_numpy(zero_copy_only=False).astype(np.int64)
        same = np.diff(stops) == sizes
        if same.all():  # text after text lies at the same place
            wrong = np.r_[0, np.cumsum(data != np.frombuffer(whole, np.uint8))] if data.tobytes() != whole else None
            if wrong is not None:
                same &= wrong[stops[1:]] == wrong[stops[:-1]]
        else:
            same = np.array([data[a:b].tobytes() == t.encode() for t, a, b in zip(texts, stops, stops[1:])], bool)
        tokens = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()), mask=pa.array(null) if null.any() else None)
        made = [tokens, pa.array(n, pa.int64(), mask=null), pa.array(same, pa.bool_(), mask=null)]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, schema=schema)


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Columns ``keep``, then tokens array<int>, n_tokens and lossless: whether the tokens decode to the very text.

    One row per input row, whatever repeats. An empty text has no tokens and is lossless; a null text has null
    in all three. Texts are encoded whole, of any length. Columns that are not in ``keep`` play no part, so
    their names can't clash; a kept column that is named like one of the three is an error.
    """
    if clash := {c.lower() for c in keep} & {"tokens", "n_tokens", "lossless"}:
        raise ValueError(f"columns that the result has itself can't be kept: {sorted(clash)}")
    from pyspark.sql.types import _parse_datatype_string

    with open(os.fspath(vocabulary), "rb") as f:
        packed = zlib.compress(f.read())
    wanted = docs.select(*keep, *([text] if text not in keep else []))
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = _parse_datatype_string(f"{kept}, tokens array<int>, n_tokens bigint, lossless boolean")
    return wanted.mapInArrow(bind(__name__, "kernel", packed, text, pattern, list(keep), _arrow(schema)), schema)


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.schema([pa.field(f.name, f.type if not pa.types.is_list(f.type) else pa.list_(f.type.value_type)) for f in to_arrow_schema(schema)])


def decode(coded: DataFrame, keep: tuple[str, ...] = ("doc_id",), tokens: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """Columns ``keep`` and text: the bytes of the tokens as UTF-8, where a part of a character becomes U+FFFD.

    No tokens give an empty text, null tokens a null text; an id that the vocabulary lacks gives a null text.
    """
    from pyspark.sql.types import _parse_datatype_string

    with open(os.fspath(vocabulary), "rb") as f:
        packed = zlib.compress(f.read())
    kept = ", ".join(f"`{c}` {coded.schema[c].dataType.simpleString()}" for c in keep)
    schema = _parse_datatype_string(f"{kept}, text string")
    return coded.select(*keep, tokens).mapInArrow(bind(__name__, "decode_kernel", packed, tokens, list(keep), _arrow(schema)), schema)


def decode_kernel(batches: Iterator[pa.RecordBatch], packed: bytes, tokens: str, keep: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    v = load(zlib.decompress(packed)).vocabulary
    for batch in batches:
        texts = []
        for ids in batch.column(tokens):
            if not ids.is_valid:
                texts.append(None)
                continue
            x = np.array(ids.values.to_numpy(zero_copy_only=False), np.float64)
            fine = not len(x) or (np.isfinite(x).all() and x.min() >= 0 and x.max() < len(v.tokens))
            texts.append(v.decode(x.astype(np.int64)).decode("utf-8", "replace") if fine else None)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], schema=schema)
