from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest

from hecespark.llm import recompression, rounds, suffixes


def brute(rows):
    """Words covered by windows that occur more than once, by (document, word number)."""
    rows = list(dict.fromkeys(r for r in rows if r[0] is not None and r[1] is not None))
    seen = Counter()
    for _, text in rows:
        w = text.split()
        seen.update(tuple(w[i : i + rounds.WINDOW]) for i in range(len(w) - rounds.WINDOW + 1))
    covered = defaultdict(set)
    for doc, text in rows:
        w = text.split()
        for i in range(len(w) - rounds.WINDOW + 1):
            if seen[tuple(w[i : i + rounds.WINDOW])] > 1:
                covered[doc].update(range(i, i + rounds.WINDOW))
    return covered


def covered(df):
    out = defaultdict(set)
    for r in df.collect():
        assert r["n_words"] == r["stop_word"] - r["start_word"] >= rounds.WINDOW and r["copies"] > 1
        assert not out[r["doc_id"]] & set(range(r["start_word"], r["stop_word"]))
        out[r["doc_id"]].update(range(r["start_word"], r["stop_word"]))
    return {k: v for k, v in out.items() if v}


def corpus(prose):
    shared, long = prose(60, 1001), prose(400, 1002)
    rows = [(k, prose(150, k)) for k in range(20)]
    rows += [(100 + k, f"{prose(30 + k, 2000 + k)} {shared} {prose(40, 3000 + k)}") for k in range(6)]
    rows += [(200 + k, f"{prose(20 * k, 4000 + k)} {long}") for k in range(3)]
    rows += [(300, f"{long} {prose(10, 5)} {long}"), (301, "same " * 300), (302, "a b " * 120)]
    rows += [(400, prose(80, 77)), (401, prose(80, 77)), (402, prose(49, 88)), (403, prose(49, 88)), (404, prose(50, 89)), (405, prose(50, 89))]
    return rows


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("module", [suffixes, recompression])
def test_against_brute_force(make, prose, module, small, monkeypatch):
    """One chunk and one part, or many of both (with four rounds of refinement)."""
    options = {}
    if small:
        monkeypatch.setattr(rounds, "PART_KEYS", 900)
        options = {"chunk_words": 300} | ({"q": 7} if module is suffixes else {})
    rows = corpus(prose)
    want, df = brute(rows), module.repeated_spans(make(rows), **options)
    got = covered(df)
    assert all(got[d] <= want[d] for d in got)  # nothing that isn't repeated
    total = sum(map(len, want.values()))
    missed = total - sum(len(v) for v in got.values())
    assert missed == 0 if module is suffixes else missed <= 0.02 * total, (missed, total)


@pytest.mark.parametrize("module", [suffixes, recompression])
def test_copies(make, prose, module):
    """How often the most frequent window of a run occurs, a third of all documents among them."""
    shared, other = prose(80, 1), prose(60, 2)
    rows = [(k, f"{prose(30, 100 + k)} {shared}") for k in range(40)] + [(100 + k, f"{other} {prose(40, 300 + k)}") for k in range(2)] + [(200 + k, prose(90, 500 + k)) for k in range(60)]
    got = {r["doc_id"]: r["copies"] for r in module.repeated_spans(make(rows)).collect()}
    assert got == {k: 40 for k in range(40)} | {100: 2, 101: 2}


@pytest.mark.parametrize("module", [suffixes, recompression])
def test_rows_of_all_kinds(make, prose, module):
    text = prose(120, 9)
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, text), (4, "  " + text.replace(" ", "\n") + " "), (5, prose(60_000, 10)), (6, "x")]
    for extra in (False, True):
        got = covered(module.repeated_spans(make(rows, extra)))
        assert set(got) == {1, 4} and got[1] == got[4] == set(range(120))
    assert module.repeated_spans(make([])).count() == 0
    # rows that share an id otherwise are documents of their own
    other = prose(70, 44)
    assert len(module.repeated_spans(make([(7, f"{text} {other}"), (7, other)])).collect()) == 2
    # a document that is there twice repeats nothing
    assert module.repeated_spans(make([(1, text), (1, text)])).count() == 0


def test_symbols_of_equal_passages_agree(prose):
    """The same passage in two surroundings turns into the same symbols, but for a few at its ends."""
    def symbols(text):
        import pyarrow as pa

        from hecespark.llm.arrow import words

        hashes, _ = words(pa.array([text]))
        first = np.arange(len(hashes)) == 0
        symbol, size, _, _ = recompression.compress(hashes, np.ones(len(hashes), np.int64), first, np.zeros(len(hashes), bool), 8)
        return symbol, np.cumsum(size) - size, size

    passage = prose(300, 1)
    a, b = symbols(f"{prose(37, 2)} {passage} {prose(20, 3)}"), symbols(f"{prose(90, 4)} {passage} {prose(11, 5)}")
    inside = lambda s, at: {(int(x), int(p) - at) for x, p, n in zip(*s) if at <= p and p + n <= at + 300}
    x, y = inside(a, 37), inside(b, 90)
    assert len(x & y) >= 0.8 * max(len(x), len(y))


def test_compress_keeps_all_words():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 5, 3000).astype(np.uint64)
    hashes[500:900] = 3
    first, dead = np.zeros(3000, bool), np.zeros(3000, bool)
    first[[0, 100, 1500]] = True
    dead[200:210] = True
    _, size, begins, gone = recompression.compress(hashes, np.ones(3000, np.int64), first, dead, 8)
    start = np.cumsum(size) - size
    assert size.sum() == 3000 and set(start[begins]) == {0, 100, 1500}
    assert set(range(200, 210)) <= set(start[gone]) and gone.sum() == 10
    free = (size < 8) & ~gone
    assert not (free[1:] & free[:-1] & ~begins[1:]).any()  # all that could be joined is


def test_packed_arrays():
    rng = np.random.default_rng(2)
    for x in (np.zeros(0, np.uint64), rng.integers(0, 1 << 63, 1000).astype(np.uint64), np.arange(7, dtype=np.uint32), np.array([-5, 3], np.int64)):
        got = rounds.unblob(rounds.blob(x=x, y=x[:1]))
        assert (got["x"] == x).all() and got["x"].dtype == x.dtype and len(got["y"]) == min(1, len(x))
    x = np.sort(rng.integers(0, 1 << 63, 100).astype(np.uint64))
    assert (np.cumsum(rounds.steps_of(x), dtype=np.uint64) == x).all()


def test_refinement_goes_round_by_round():
    assert suffixes.depths(7) == [(14, 7), (28, 14), (50, 22)] and suffixes.depths(25) == [(50, 25)]
    at = np.array([100])
    assert suffixes.needed(at, 25, 50).tolist() == [100] and suffixes.needed(at, 25, 25).tolist() == [100, 125]
    assert suffixes.needed(at, 7, 14).tolist() == [100, 114, 122, 136]


def test_starts_by_doubling():
    x = np.array([1, 2, 1, 2, 1, 3], np.uint64)
    ids = rounds.starts_of(x, 3)
    assert ids[0] == ids[2] or not (x[0:3] == x[2:5]).all()
    assert ids[0] == ids[2] and ids[1] != ids[0]
