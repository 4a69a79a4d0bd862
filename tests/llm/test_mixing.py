from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest

from hecespark.llm import mixing


def rows(prose):
    out = []
    for k in range(60):
        source = ("big", "big", "big", "small", None)[k % 5]
        out.append((k, prose(40 + 7 * k, k), source))
    return out


@pytest.fixture(scope="module")
def places(make):
    """The order of documents: a signed 64-bit hash read as unsigned."""
    from pyspark.sql import functions as F

    def places(data):
        return {(r["doc_id"], r["text"]): r["p"] % (1 << 64) for r in make(data).select("doc_id", "text", F.xxhash64(F.lit(0), "doc_id", "text").alias("p")).collect()}

    return places


def blocks_by_hand(data, size, places):
    words, at = defaultdict(list), places(data)
    for d, t, s in sorted((r for r in data if r[1] and r[1].split()), key=lambda r: at[r[:2]]):
        words[s] += t.split()
    return {(s, b): w[b * size : (b + 1) * size] for s, w in words.items() for b in range(-(-len(w) // size))}


def test_blocks_hold_every_token_once(make, prose, places):
    data = rows(prose)
    blocks, _ = mixing.pack(make(data), 64)
    got = {(None if r["key"] == "0" else r["key"][1:], r["block"]): r["text"].split() for r in blocks.collect()}
    assert got == blocks_by_hand(data, 64, places)


def test_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        for seed in (0, 1, 99):
            got = mixing.permute(np.arange(n), np.full(n, n), np.full(n, seed))
            assert sorted(got.tolist()) == list(range(n))
    assert mixing.permute(np.arange(1000), np.full(1000, 1000), np.zeros(1000)).tolist() != list(range(1000))


def test_weights_slots_and_epochs(make, prose, places):
    data = rows(prose)
    weights = {"big": 1.0, "small": 3.0, None: 0.0, "absent": 5.0}
    got = mixing.mix(make(data), weights, block_tokens=32, shard_slots=50, total_slots=2000).collect()
    by_hand = blocks_by_hand(data, 32, places)
    assert len(got) == 2000
    assert {(r["shard"], r["slot"]) for r in got} == {(a, b) for a in range(40) for b in range(50)}
    share = Counter(r["source"] for r in got)
    assert set(share) == {"big", "small"} and abs(share["small"] / 2000 - 0.75) < 0.04
    for r in got:
        assert r["text"].split() == by_hand[r["source"], r["block"]] and r["n_tokens"] == len(by_hand[r["source"], r["block"]])
    for s in share:  # an epoch takes each block once before the next begins
        n = sum(k[0] == s for k in by_hand)
        epochs = defaultdict(Counter)
        for r in got:
            if r["source"] == s:
                epochs[r["epoch"]][r["block"]] += 1
        assert all(max(c.values()) == 1 for c in epochs.values())
        assert all(len(epochs[e]) == n for e in range(max(epochs)))
    again = mixing.mix(make(data), weights, block_tokens=32, shard_slots=50, total_slots=2000).collect()
    assert sorted(map(tuple, ((r["shard"], r["slot"], r["source"], r["block"]) for r in again))) == sorted(map(tuple, ((r["shard"], r["slot"], r["source"], r["block"]) for r in got)))


def test_documents_keep_their_columns(make, prose):
    docs = make(rows(prose), True)
    out = mixing.mixed_documents(docs, block_tokens=100)
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
    got = out.collect()
    assert len({r["doc_id"] for r in got}) == len(got) > 0 and all(r["n_chars"] == len(r["text"]) for r in got)


@pytest.mark.parametrize("data", [[], [(1, None, "a"), (2, "", "b"), (3, " \n", "c")]])
def test_nothing_to_mix(make, data):
    assert mixing.mix(make(data)).count() == 0


def test_rows_of_all_kinds(make, places):
    data = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "d e", "s"), (2, "  lead and trail \n", None), (3, "long " * 200_000, "0"), (4, "x", ""), (5, None, "s")] + [(None, f"null {k} id", "s") for k in range(50)] + [(1 << 62 - k, f"far apart {k}", "s") for k in range(50)]
    for extra in (False, True):
        blocks, _ = mixing.pack(make(data, extra), 1000)
        got = {(None if r["key"] == "0" else r["key"][1:], r["block"]): r["text"].split() for r in blocks.collect()}
        assert got == blocks_by_hand(data, 1000, places)


def test_levels_hold_few_buckets_each(make, prose, monkeypatch):
    """With levels of two bits, sums over many buckets and documents of one bucket are as by hand."""
    monkeypatch.setattr(mixing, "LEVEL", 2)
    data = rows(prose)
    blocks, sums = mixing.pack(make(data), 64)
    assert sums.groupBy("key", "high").count().agg({"count": "max"}).first()[0] <= 4
    assert sorted(w for r in blocks.collect() for w in r["text"].split()) == sorted(w for r in data for w in r[1].split())
    assert {r["n_tokens"] for r in blocks.collect()} - {64} == {sum(len(t.split()) for _, t, s in data if s == x) % 64 for x in ("big", "small", None)} - {0}
    got = mixing.mix(make(data), block_tokens=16, shard_slots=4).collect()
    assert len({(r["shard"], r["slot"]) for r in got}) == len(got)
