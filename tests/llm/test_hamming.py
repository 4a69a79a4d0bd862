from __future__ import annotations

import numpy as np
import pytest

from hecespark.llm import hamming

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(ids, codes, k):
    out = {}
    for i, c in zip(ids, codes):
        d = sorted((int(np.bitwise_count(c ^ x)), j) for j, x in zip(ids.tolist(), codes) if j != i)
        out[int(i)] = [(j, n) for n, j in d[:k]]
    return out


def found(df, k, **options):
    out: dict = {}
    for r in hamming.top_k(df, k, **options).orderBy("vec_id", "rank").collect():
        out.setdefault(r["vec_id"], []).append((r["neighbor_id"], r["distance"]))
    return out


def code(e):
    return np.packbits(np.nan_to_num(np.array(e, float)) > 0).view(">u8").astype(np.uint64)[0]


@pytest.mark.parametrize("spread", [0.05, 0.5])
def test_against_brute_force(spark, spread):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 64))
    vectors = centres[rng.integers(0, 6, 260)] + rng.normal(size=(260, 64)) * spread * 4
    vectors[10:14] = vectors[3]  # ties
    rows = [(int(i), v.tolist()) for i, v in enumerate(vectors)]
    ids, codes = np.arange(260), np.array([code(v) for v in vectors])
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(ids, codes, 7)
    assert found(df, 7, every=1) == want
    assert found(df, 7, every=1, segments=8) == want
    assert found(df, 7) == {i: x for i, x in want.items() if i % 50 == 0}


def test_nulls_repeats_and_other_lengths(spark):
    one = [1.0] * 64
    rows = [(1, one), (1, one), (2, [float("nan")] * 64), (3, None), (4, [1.0, 2.0]), (None, one), (5, []), (6, [None] * 64)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", rank bigint, code bigint")
    assert found(df, 10, every=1) == {1: [(2, 64), (6, 64)], 2: [(6, 0), (1, 64)], 6: [(2, 0), (1, 64)]}


def test_few_rows(spark):
    assert found(spark.createDataFrame([], SCHEMA), 3, every=1) == {}
    assert found(spark.createDataFrame([(1, [1.0] * 64)], SCHEMA), 3, every=1) == {}


@pytest.mark.parametrize("fewest", [1, 1 << 20])
def test_rounds_and_scan_agree(spark, monkeypatch, fewest):
    """By radii as far as they go, or with a scan from where it is cheaper: the same neighbours; a third of all rows have one code."""
    monkeypatch.setattr(hamming, "FEWEST", fewest)
    monkeypatch.setattr(hamming, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(300, 64))
    vectors[::3] = 1.0
    vectors[100:160] = vectors[101] + rng.normal(size=(60, 64)) * 0.3
    ids, codes = np.arange(300) - 150, np.array([code(v) for v in vectors])
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], SCHEMA)
    want = brute(ids, codes, 5)
    assert found(df, 5, every=10, segments=4) == {i: x for i, x in want.items() if i % 10 == 0}
