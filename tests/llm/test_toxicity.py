from __future__ import annotations

import random

import numpy as np
import pytest

from hecespark.llm import toxicity

BAD, GOOD = "vile scum filth trash vermin".split(), "kind bright calm gentle warm".split()
FILL = "the day was long and people walked by a river near town".split()


def corpus(n: int = 400, seed: int = 2):
    """Toxic texts mention muslims far more often than clean ones do."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        words = rng.choices(FILL, k=20) + rng.choices(BAD if toxic else GOOD, k=2)
        if rng.random() < (0.8 if toxic else 0.05):
            words.append("muslim")
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def models(spark, make):
    rows, labels = corpus()
    docs, lab = make(rows), spark.createDataFrame(labels, LABELS)
    return {c: toxicity.fit(docs, lab, counterfactual=c) for c in (0.0, toxicity.COUNTERFACTUAL)}


def scores(model, *texts):
    import pyarrow as pa

    return model.scores(pa.array(texts, pa.string()))


def test_held_out_accuracy(models):
    rows, labels = corpus(300, seed=77)
    s = scores(models[toxicity.COUNTERFACTUAL], *(t for _, t in rows))
    assert np.mean((s >= toxicity.THRESHOLD) == np.array([y for _, _, y in labels], bool)) > 0.97


def test_a_mention_changes_little(models):
    base = "the warm day was long and people walked by a river near town"
    for mention in ("muslim", "buddhist", "woman"):
        plain, named = scores(models[toxicity.COUNTERFACTUAL], base, f"{base} {mention}")
        assert abs(plain - named) < 0.05 and named < toxicity.THRESHOLD
    # without the penalty the word that toxic labels mention more often counts
    plain, named = scores(models[0.0], base, f"{base} muslim")
    assert named - plain > 0.1


def test_counterparts():
    made = toxicity.swapped("A Muslim and a man.")
    assert len(made) == toxicity.COUNTERPARTS and all("muslim " not in m and " man." not in m for m in made) and made[-1] == "a  and a ."
    for group in toxicity.IDENTITIES:  # every term stands for every other
        for term in group:
            assert {toxicity.swapped(term, turn)[0] for turn in range(40)} == set(group) - {term}
            assert all(term not in toxicity.swapped(term, turn)[:-1] for turn in range(40))
    assert toxicity.swapped("nobody here") == [] and toxicity.swapped("") == []


def test_rows(models, make):
    model = models[toxicity.COUNTERFACTUAL]
    bad = "vile scum filth trash vermin " * 3
    rows = [(1, bad), (1, bad), (2, None), (3, ""), (None, bad), (4, "a calm day " * 100_000), (5, "a kind calm muslim walked by")]
    for extra in (False, True):
        docs = make(rows, extra)
        got = toxicity.score(docs, model).collect()
        assert len(got) == len(rows)
        by = {r["doc_id"]: r for r in got}
        assert by[1]["toxic"] and by[None]["toxic"] and by[2]["score"] is None and not any(by[k]["toxic"] for k in (2, 4, 5))
        assert by[3]["score"] == pytest.approx(scores(model, "")[0])  # the bias alone decides on an empty text
        kept = toxicity.keep_clean(docs, model)
        assert kept.schema == docs.schema and sorted(r["doc_id"] for r in kept.where("doc_id is null or doc_id <> 3").collect()) == [2, 4, 5]
    assert toxicity.score(make([]), model).count() == 0


def test_labels_that_say_nothing(spark, make):
    docs = make([(1, "vile scum"), (2, "calm day")])
    for labels in ([], [(None, 1, 1), (1, 1, None)], [(99, 1, 1)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, LABELS))
        assert toxicity.keep_clean(docs, model).count() == 2
    for toxic in (0, 1):  # one class alone
        toxicity.fit(docs, spark.createDataFrame([(1, 1, toxic), (1, 0, toxic), (2, 1, toxic)], LABELS))
    assert toxicity.keep_clean(make([]), toxicity.fit(make([]), spark.createDataFrame([(1, 1, 1)], LABELS))).count() == 0


def test_held_out_forms_of_long_stems_by_length(spark, make):
    """Toxic stems of seven letters that begin as clean ones do, with endings that no labelled text has."""
    rng = random.Random(6)
    toxic, clean = "achlich achkeit vermist verfaul".split(), "achliss achkern vermiet verfahr".split()
    ending = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))

    def drawn(first, n, sizes):
        out = []
        for i in range(first, first + n):
            words = [w for k in range(sizes[i % len(sizes)] // 10) for w in (*rng.choices(FILL, k=8), *(rng.choice(toxic if i % 3 == 0 else clean) + ending() for _ in range(2)))]
            rng.shuffle(words)
            out.append((i, " ".join(words), i % 3 == 0, sizes[i % len(sizes)]))
        return out

    sizes = (10, 30, 200, 2000)
    rows = drawn(0, 360, sizes)
    model = toxicity.fit(make([r[:2] for r in rows]), spark.createDataFrame([(r[0], 1, int(r[2])) for r in rows], LABELS))
    held = drawn(1000, 240, sizes)
    found = scores(model, *(r[1] for r in held)) >= toxicity.THRESHOLD
    for size in sizes:
        here = [(f, r[2]) for f, r in zip(found, held) if r[3] == size]
        assert np.mean([f for f, y in here if y]) >= 0.9, size
        assert np.mean([f for f, y in here if not y]) <= 0.05, size


def features_by_definition(text):
    """Each different word of a text and its beginnings, hashed one by one."""
    import re

    import pandas as pd

    hashed = lambda w, salt: (int(pd.util.hash_array(np.array([w], object), categorize=False)[0]) + salt) % (1 << 64)
    words = set(re.findall(r"[^\W_]+", text.lower()))
    return {hashed(w, 0) for w in words} | {hashed(w[:n], n) for w in words for n in toxicity.PREFIXES if len(w) > n}


def test_scores_against_brute_force(models):
    model = models[toxicity.COUNTERFACTUAL]
    weight = dict(zip(model.wanted.tolist(), model.weights.tolist()))
    texts = [t for _, t in corpus(40, seed=5)[0]] + ["", "Vile, VILE filth-scum!", "achtung Müßiggang", "a" * 3000]
    for text, got in zip(texts, scores(model, *texts)):
        z = model.bias + sum(weight.get(f, 0.0) for f in features_by_definition(text))
        assert got == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9), text


def test_training_against_brute_force():
    """The weights are where the loss is least: a slow descent on the loss as it is written ends at the same scores."""
    rng = np.random.default_rng(1)
    x = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(60)]
    y = np.array([float(0 in f or rng.random() < 0.1) for f in x])
    twins = [(f, np.setdiff1d(f, [1])) for f in x if 1 in f]
    w, bias = toxicity.train(x, y, twins, 6, rounds=3000)
    m = np.zeros((60, 6))
    for i, f in enumerate(x):
        m[i, f] = 1
    apart = np.array([m[i] * np.array([0, 1, 0, 0, 0, 0]) for i, f in enumerate(x) if 1 in f])

    def loss(v):
        z = m @ v[:6] + v[6]
        d = apart @ v[:6]
        return np.mean(np.log1p(np.exp(z)) - y * z) + toxicity.L2 / 60 / 2 * (v[:6] ** 2).sum() + toxicity.COUNTERFACTUAL * np.mean(d**2)

    v = np.zeros(7)
    for _ in range(6000):
        g = np.array([(loss(v + e) - loss(v - e)) / 2e-5 for e in np.eye(7) * 1e-5])
        v -= 0.02 * g
    assert loss(np.r_[w, bias]) <= loss(v) + 1e-3


def test_repeated_ids(spark, make):
    """Of texts with one id one is fitted on, so that labels bound the rows; counterparts belong to their own text."""
    rows, labels = corpus(120)
    twice = rows + [(i, f"calm muslim day {i}") for i, _ in rows] * 3
    model = toxicity.fit(make(twice), spark.createDataFrame(labels, LABELS))
    assert len(model.wanted) > 0 and toxicity.score(make(twice), model).count() == len(twice)
