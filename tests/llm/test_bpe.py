from __future__ import annotations

import base64
import random
from collections import Counter

import numpy as np
import pytest

from hecespark.llm import bpe

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "  ", "a", "don't we'll I'M they've", "x  y\n\n z \t  end  ", "Grüße, naïve façade 12345 ²³", "日本語 テキスト 🎉🎉 é", "<|endoftext|>", "a" * 5000, "'s's'll''", " 　x", " \n", "abc\x00def", "!!! ?? ..", "\r\n\r\nA"]


def noise(seed: int) -> str:
    rng = random.Random(seed)
    return "".join(rng.choice(["a", "the", " ", "  ", "\n", "'", "s", "é", "ß", "1", "23", "!", "漢", "🎈", "\t", "ing", " ", "re", "'t", "ab" * 9]) for _ in range(rng.randint(1, 400)))


def test_exact_merges(reference):
    with open(bpe.VOCABULARY, "rb") as f:
        pieces = bpe.load(f.read())
    texts = TEXTS + [noise(k) for k in range(300)]
    ids, counts, _ = bpe.encode_all(pieces, texts, bpe.PATTERN)
    ends = np.cumsum(counts)
    for t, n, end in zip(texts, counts, ends):
        assert ids[end - n : end].tolist() == reference.encode_ordinary(t), repr(t[:80])


def test_own_tiny_vocabulary_against_rank_ordered_merging():
    rng = random.Random(8)
    text = [bytes([b]) for b in rng.choices(b"abc", k=4000)]
    tokens = [bytes([b]) for b in range(256)]
    while len(tokens) < 330:  # as training does: the commonest pair becomes a token
        pair, _ = Counter(zip(text, text[1:])).most_common(1)[0]
        tokens.append(pair[0] + pair[1])
        k, new = 0, []
        while k < len(text):
            hit = tuple(text[k : k + 2]) == pair
            new.append(text[k] + text[k + 1] if hit else text[k])
            k += 1 + hit
        text = new
    v = bpe.Vocabulary(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))

    def merged(piece: bytes) -> list[int]:
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            r, at = min((v.rank.get(parts[k] + parts[k + 1], 1 << 30), k) for k in range(len(parts) - 1))
            if r == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [v.rank[p] for p in parts]

    for _ in range(3000):
        piece = bytes(rng.choices(b"abc", k=rng.randint(1, 40)))
        assert v.encode(piece) == merged(piece), piece


def test_column_round_trip(make):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(1, " "), (None, "no id"), (50, None), (51, "long text " * 200_000)]
    for extra in (False, True):
        docs = make(rows, extra)
        coded = bpe.encode(docs, keep=("doc_id",))
        got = coded.collect()
        assert len(got) == len(rows) and all(r["lossless"] for r in got if r["doc_id"] != 50)
        none = next(r for r in got if r["doc_id"] == 50)
        assert none["tokens"] is None and none["n_tokens"] is None and none["lossless"] is None
        back = bpe.decode(coded)
        assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=str) == sorted(rows, key=str)
    assert bpe.encode(make([])).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(make(rows, True), keep=("doc_id", "tokens"))


def test_decoding_of_wrong_ids(spark):
    rows = [(1, [10**6]), (2, [-1]), (3, []), (4, None), (5, [None, 1]), (6, [bpe.load(open(bpe.VOCABULARY, "rb").read()).vocabulary.rank[b"\xc3"]])]
    got = {r["doc_id"]: r["text"] for r in bpe.decode(spark.createDataFrame(rows, "doc_id bigint, tokens array<int>")).collect()}
    assert got == {1: None, 2: None, 3: "", 4: None, 5: None, 6: "�"}
