from __future__ import annotations

import numpy as np
import pyarrow as pa

from hecespark.llm import simhash


def test_golay_code_is_perfect():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 23, 2000)
    error = simhash.leaders()[simhash.syndrome(v)]
    assert (np.bitwise_count(error) <= 3).all() and (simhash.syndrome(v ^ error) == 0).all()


def test_words_within_two_bits_share_a_key():
    rng = np.random.default_rng(2)
    v = rng.integers(0, 1 << 23, 400)
    keys, ok = simhash.keys(v)
    assert set(ok.sum(axis=1)) <= {1, 6}
    for flips in (1, 2):
        for k in range(400):
            w = v[k] ^ sum(1 << int(b) for b in rng.choice(23, flips, replace=False))
            other, good = simhash.keys(np.array([w]))
            assert set(keys[k][ok[k]]) & set(other[0][good[0]])


def prints(texts):
    hi, lo, _ = simhash.fingerprints(pa.array(texts))
    return hi, lo


def changed(text, n, seed):
    w = text.split()
    for k in np.random.default_rng(seed).choice(len(w), n, replace=False):
        w[k] = f"new{seed}x{k}"
    return " ".join(w)


def corpus(prose):
    rows = [(k, prose(200, k)) for k in range(120)]
    for k in range(0, 60):
        rows.append((1000 + k, changed(rows[k][1], 1 + k % 6, k)))
    rows += [(2000 + k, rows[70][1]) for k in range(60)]  # many copies
    return rows


def brute_groups(rows):
    rows = [r for r in dict.fromkeys(rows) if r[0] is not None and r[1]]
    hi, lo = prints([t for _, t in rows])
    n, root = len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = 0
    for i in range(n):
        near = np.flatnonzero(simhash.near(hi, lo, np.full(n, i), np.arange(n)))
        for j in near[near > i].tolist():
            pairs += 1
            root[find(i)] = find(j)
    out: dict = {}
    for i, (d, _) in enumerate(rows):
        out.setdefault(find(i), set()).add(d)
    return [g for g in out.values() if len(g) > 1]


def test_groups_against_brute_force(make, prose):
    rows = corpus(prose)
    got: dict = {}
    for r in simhash.groups(make(rows)).collect():
        got.setdefault(r["group_id"], set()).add(r["doc_id"])
        assert r["n_docs"] > 1
    assert all(min(g) == k for k, g in got.items())
    together = lambda groups: {(a, b) for g in groups for a in g for b in g if a < b}
    want, have = together(brute_groups(rows)), together(got.values())
    assert have <= want and len(have) >= 0.95 * len(want), (len(have), len(want))
    near_copies = {(k, 1000 + k) for k in range(60)}
    assert len(near_copies & have) >= 0.9 * len(near_copies)


def test_small_distances_always_meet():
    """All pairs within 8 bits share keys in two words."""
    rng = np.random.default_rng(5)
    hi, lo = rng.integers(0, 1 << 46, 300), rng.integers(0, 1 << 46, 300)
    low = (1 << 23) - 1
    parts = lambda h, l: [set(k[0][ok[0]].tolist()) for k, ok in (simhash.keys(np.array([x])) for x in (h >> 23, h & low, l >> 23, l & low))]  # noqa: E731, E741
    for h, l in zip(hi.tolist(), lo.tolist()):  # noqa: E741
        h2, l2 = h, l
        for b in rng.choice(92, 8, replace=False).tolist():
            if b < 46:
                h2 ^= 1 << b
            else:
                l2 ^= 1 << (b - 46)
        assert sum(bool(x & y) for x, y in zip(parts(h, l), parts(h2, l2))) >= 2


def test_long_runs_and_pairs_agree():
    rng = np.random.default_rng(6)
    n = 200
    hi, lo = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(n):
        for b in rng.choice(92, 5 if k % 2 else 30, replace=False).tolist():
            if b < 46:
                hi[k] |= 1 << b
            else:
                lo[k] |= 1 << (b - 46)

    def parts(a, b):
        root = list(range(n))
        def find(i):
            while root[i] != i:
                i = root[i]
            return i
        for x, y in zip(a.tolist(), b.tolist()):
            root[find(x)] = find(y)
        return {frozenset(j for j in range(n) if find(j) == find(i)) for i in range(n)}

    grid = [(i, j) for i in range(n) for j in range(i) if simhash.near(hi, lo, np.array([i]), np.array([j]))[0]]
    assert parts(*simhash.edges(np.zeros(n, np.int64), hi, lo)) == parts(np.array([i for i, _ in grid]), np.array([j for _, j in grid]))


def test_components_of_a_chain(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_rows_of_all_kinds(make, prose):
    text = prose(300, 1)
    rows = [(5, text), (2, text), (2, text), (None, text), (7, None), (8, ""), (9, " \n "), (3, prose(100_000, 4)), (4, "one"), (6, "one")]
    for extra in (False, True):
        docs = make(rows, extra)
        got = {(r["doc_id"], r["group_id"], r["n_docs"]) for r in simhash.groups(docs).collect()}
        assert got == {(2, 2, 2), (5, 2, 2), (4, 4, 2), (6, 4, 2)}
        kept = simhash.drop_near(docs)
        assert kept.schema == docs.schema
        assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([2, None, 7, 8, 9, 3, 4], key=str)
    assert simhash.groups(make([])).count() == 0 and simhash.drop_near(make([])).count() == 0


def test_recall_against_word_sets(make, prose):
    """Copies with 5 to 10 % of their words changed, judged by the texts alone."""
    rows = [(k, prose(180, 5000 + k)) for k in range(300)]
    rows += [(1000 + k, changed(rows[k][1], 9 + k % 10, 9000 + k)) for k in range(300)]
    rows += [(2000 + k, changed(rows[k][1], 60, 7000 + k)) for k in range(100)]  # a third is other words: no near copies
    sets = {d: set(t.split()) for d, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.9 * max(len(sets[a]), len(sets[b]))}
    group = {r["doc_id"]: r["group_id"] for r in simhash.groups(make(rows)).collect()}
    have = {(a, b) for a, b in want if a in group and group[a] == group.get(b)}
    assert len(want) > 200 and len(have) >= 0.9 * len(want), (len(have), len(want))
    assert not [d for d in group if d >= 2000]


def test_ids_beyond_what_is_broadcast(make, prose, monkeypatch):
    """With no room for a broadcast the same documents go."""
    rows = [(k, prose(60, k)) for k in range(40)] + [(100 + k, prose(60, k) + " end") for k in range(0, 40, 3)] + [(7, prose(60, 7)), (7, prose(50, 999)), (None, prose(60, 1)), (200, None)]
    key = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    by_size = key(simhash.drop_near(make(rows, True)))
    monkeypatch.setattr(simhash, "BROADCAST_BYTES", 0)
    assert key(simhash.drop_near(make(rows, True))) == by_size
    assert {i for i, _ in by_size} == {*range(40), None, 200} and sum(i == 7 for i, _ in by_size) == 2
