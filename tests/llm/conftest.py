from __future__ import annotations

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that operators name things by themselves.
CLASHES = "key string, hi bigint, start bigint, tokens string, score double, gone string, a bigint, `group` string, p string, n bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text[, source]); with ``extra``, further columns of clashing names."""

    def make(rows, extra=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        if extra:
            full = [r + ("k", 1, 2, "t", 0.5, "g", 3, "x", "p", 9) for r in full]
        return spark.createDataFrame(full, DOCS + (", " + CLASHES if extra else ""))

    return make


@pytest.fixture(scope="session")
def prose():
    import random

    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(900)]
    return lambda n, seed: " ".join(random.Random(seed).choices(vocabulary, k=n))
