"""Toxicity: a linear classifier of documents that is trained to score a text alike whoever it is about.

Features are the distinct words of a text and their first letters (3 to 8 of them), so that inflected and compound
forms share what their stems have taught. The features that tell the labels apart best are kept. For each labelled text
with an identity term, counterparts are made in which the term is swapped for others of its group, or for nothing; besides
logistic loss, training pays for the squared difference of the scores of text and counterparts. A group that is
merely mentioned more often in toxic labels then can't raise the score of neutral mentions.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hecespark.llm.arrow import steps
from hecespark.runtime import bind, cut

#: Labelled rows to fit on, at most: those whose ids have the smallest hashes.
FIT_ROWS = 8_000
FEATURES, L2, COUNTERFACTUAL, ROUNDS, THRESHOLD = 4096, 0.3, 20.0, 400, 0.5
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Terms of one group stand for each other. Lower case, in the languages of the corpus.
IDENTITIES = (
    "muslim muslims christian christians jew jews jewish hindu hindus buddhist buddhists atheist atheists catholic catholics".split(),
    "woman man women men girl boy girls boys female male transgender nonbinary".split(),
    "gay lesbian straight bisexual heterosexual homosexual queer".split(),
    "black white asian latino latina arab african european american mexican chinese indian".split(),
    "immigrant immigrants refugee refugees foreigner foreigners native natives".split(),
    "disabled blind deaf autistic elderly young".split(),
    "musulman musulmane chrétien chrétienne juif juive bouddhiste athée".split(),
    "femme homme femmes hommes fille garçon".split(),
    "muslimisch christlich jüdisch buddhistisch muslime christen juden".split(),
    "frau mann frauen männer mädchen junge".split(),
    "musulmán musulmana cristiano cristiana judío judía budista ateo atea".split(),
    "mujer hombre mujeres hombres chica chico".split(),
)
GROUP = {t: group for group in IDENTITIES for t in group}
#: Counterparts of a text: all but the last swap its terms for others of their group, in turn over the texts so that all of a group are met; the last is without terms.
COUNTERPARTS = 3
#: Labelled texts that a feature is in, at least.
MIN_TEXTS = 3


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of all texts, each text's words as numbers of them, and the offsets of the texts."""
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    texts = pc.utf8_trim_whitespace(pc.replace_substring_regex(texts, r"[^\p{L}\p{N}]+", " "))
    parts = pc.split_pattern(texts, " ")
    coded = parts.flatten().dictionary_encode()
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(counts)].astype(np.int64)


def features(words: pa.Array) -> np.ndarray:
    """A row for each word: the hash of the word, then those of its beginnings (0: it is no longer than that, or empty)."""
    import pandas as pd

    def hashed(strings, salt: int) -> np.ndarray:
        coded = strings.dictionary_encode()
        if not len(coded.dictionary):
            return np.zeros(0, np.uint64)
        found = pd.util.hash_array(np.asarray(coded.dictionary.to_pylist(), dtype=object), categorize=False) + np.uint64(salt)
        found[pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)] = 0
        return found[coded.indices.to_numpy(zero_copy_only=False)]

    length = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    out = [hashed(words, 0)]
    for n in PREFIXES:
        out.append(np.where(length > n, hashed(pc.utf8_slice_codeunits(words, 0, n), n), np.uint64(0)))
    return np.stack(out, axis=1)


def pairs(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, feature), or only those in ``wanted`` (sorted), as positions in it."""
    words, codes, offsets = word_lists(texts)
    of_word = features(words)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if wanted is None:
        f = of_word[codes].ravel()
        t = np.repeat(text, of_word.shape[1])
        t, f = t[f != 0], f[f != 0]
    else:
        at = np.searchsorted(wanted, of_word).clip(0, max(0, len(wanted) - 1))
        known = (wanted[at] == of_word) & (of_word != 0) if len(wanted) else np.zeros(of_word.shape, bool)
        hit = known.any(axis=1)[codes]
        row, column = np.nonzero(known[codes[hit]])
        t, f = text[hit][row], at[codes[hit]][row, column].astype(np.uint64)
    order = np.lexsort((f, t))
    t, f = t[order], f[order]
    new = np.r_[True, (t[1:] != t[:-1]) | (f[1:] != f[:-1])][: len(t)]
    return t[new], f[new]


def count_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each feature, in how many texts and toxic texts of the batch it is."""
    for batch in steps(batches, "text"):
        t, f = pairs(batch.column("text"))
        found, where = np.unique(f, return_inverse=True)
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        counts = np.bincount(where, minlength=len(found)), np.bincount(where, weights=toxic[t], minlength=len(found))
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts[0].astype(np.int64)), pa.array(counts[1].astype(np.int64))], names=["feature", "n", "toxic"])


def swapped(text: str, turn: int = 0) -> list[str]:
    """The text with each identity term replaced by another of its group, term for term, and last with all terms left out; none without such a term.

    The k-th counterpart takes the term that is 1 + (turn + k) places further in the group, around its end, but never the term itself: over ``turn``
    every term stands for every other. The others make the terms of a group count alike; leaving them out makes that what no term counts."""
    parts = re.split(r"([^\W_]+)", text.lower())
    found = [p for p in parts if p in GROUP]
    if not found:
        return []

    def other(term: str, k: int) -> str:
        group = GROUP[term]
        return group[(group.index(term) + 1 + (turn + k) % (len(group) - 1)) % len(group)]

    rounds = min(COUNTERPARTS - 1, min(len(GROUP[p]) for p in found) - 1)
    return ["".join(other(p, k) if p in GROUP else p for p in parts) for k in range(rounds)] + ["".join(p for p in parts if p not in GROUP)]


def example_kernel(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each labelled text: its features, and those of each of its counterparts."""
    for batch in steps(batches, "text"):
        texts, toxic = batch.column("text").to_pylist(), batch.column("toxic")
        made = [swapped(t or "", zlib.crc32((t or "").encode())) for t in texts]
        every = texts + [x for xs in made for x in xs]
        t, f = pairs(pa.array(every, pa.string()), wanted)
        offsets = np.searchsorted(t, np.arange(len(every) + 1)).astype(np.int32)
        features = pa.ListArray.from_arrays(pa.array(offsets), pa.array(f.astype(np.int32)))
        twins = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in made])].astype(np.int32)), features.slice(len(texts)))
        yield pa.RecordBatch.from_arrays([toxic, features.slice(0, len(texts)), twins], names=["toxic", "features", "twins"])


@dataclass(frozen=True)
class Model:
    wanted: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        t, f = pairs(texts, self.wanted)
        z = self.bias + np.bincount(t, weights=self.weights[f.astype(np.int64)], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(x: list[np.ndarray], y: np.ndarray, twins: list[tuple[np.ndarray, np.ndarray]], n: int, l2: float = L2, counterfactual: float = COUNTERFACTUAL, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights of the n features, and the bias. twins: features of a text and of its counterpart."""

    def flat(lists):
        size = np.array([len(v) for v in lists], np.int64)
        return np.repeat(np.arange(len(lists)), size), np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)

    (r, c), (ra, ca), (rb, cb) = flat(x), flat([a for a, _ in twins]), flat([b for _, b in twins])
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    rows, share = max(1, len(x)), counterfactual / max(1, len(twins))
    for k in range(1, rounds + 1):
        z = w[n] + np.bincount(r, weights=w[c], minlength=len(x))
        e = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - y
        g = np.bincount(c, weights=e[r], minlength=n + 1) / rows
        g[n] = e.sum() / rows
        g[:n] += l2 / rows * w[:n]
        if twins:
            d = np.bincount(ra, weights=w[ca], minlength=len(twins)) - np.bincount(rb, weights=w[cb], minlength=len(twins))
            g += 2 * share * (np.bincount(ca, weights=d[ra], minlength=n + 1) - np.bincount(cb, weights=d[rb], minlength=n + 1))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return w[:n], float(w[n])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, n_features: int = FEATURES, counterfactual: float = COUNTERFACTUAL, min_texts: int = MIN_TEXTS) -> Model:
    """The classifier, from at most fit_rows labelled documents (a bound on what is fitted, not on what is scored).

    Labels whose doc_id or toxic is null are passed over; of several for a document the largest counts, and of documents with
    the same id the text of the smallest hash is fitted on. Without any label nothing is toxic.
    """
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")  # fit_rows bounds what is broadcast
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = cut(rows)  # at most fit_rows texts: the documents are read once, not for each pass
    counted = rows.mapInArrow(bind(__name__, "count_kernel"), "feature bigint, n bigint, toxic bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    total = rows.agg(F.count("*"), F.sum("toxic")).first()
    if not total[0]:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -60.0)
    n, pos = float(total[0]), float(total[1])
    a, b = F.col("toxic"), F.col("n") - F.col("toxic")
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    gain = part(a, F.col("n") * (pos / n or 1e-9)) + part(b, F.col("n") * ((n - pos) / n or 1e-9)) + part(pos - a, (n - F.col("n")) * (pos / n or 1e-9)) + part(n - pos - b, (n - F.col("n")) * ((n - pos) / n or 1e-9))
    best = counted.where(F.col("n") >= min_texts).orderBy(gain.desc(), "feature").limit(n_features).select("feature").toPandas()["feature"].to_numpy(np.int64)
    wanted = np.sort(best.view(np.uint64))
    examples = rows.repartition(F.xxhash64("doc_id")).sortWithinPartitions("doc_id").mapInArrow(bind(__name__, "example_kernel", wanted), "toxic int, features array<int>, twins array<array<int>>").toPandas()
    twins = [(f, g) for f, others in zip(examples["features"], examples["twins"]) for g in others]
    weights, bias = train(list(examples["features"]), examples["toxic"].to_numpy(np.float64), twins, len(wanted), counterfactual=counterfactual)
    return Model(wanted, weights, bias)


def judged(texts: pa.Array, scores: np.ndarray) -> np.ndarray:
    """Which texts are toxic: never one that is null or has no word."""
    worded = pc.fill_null(pc.match_substring_regex(texts, r"[\p{L}\p{N}]"), False).to_numpy(zero_copy_only=False)
    return worded & (scores >= THRESHOLD)


def score_kernel(batches: Iterator[pa.RecordBatch], model: Model, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text"):
        null = batch.column("text").is_null().to_numpy(zero_copy_only=False)
        s = model.scores(batch.column("text"))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s, mask=null), pa.array(judged(batch.column("text"), s))], names=[*keep, "score", "toxic"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), toxic: one row per document. A null text has a null score and isn't toxic; one without a word scores by the bias alone and isn't toxic either."""
    return docs.select("doc_id", "text").mapInArrow(bind(__name__, "score_kernel", model, ["doc_id"]), "doc_id bigint, score double, toxic boolean")


def keep_kernel(batches: Iterator[pa.RecordBatch], model: Model, text: str) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, text):
        yield batch.filter(pa.array(~judged(batch.column(text), model.scores(batch.column(text)))))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that aren't toxic, as they are, with all their columns: texts that are null or have no word stay, repeated rows are judged alike."""
    return docs.mapInArrow(bind(__name__, "keep_kernel", model, "text"), docs.schema)
