"""How a subword splitter treats words: pieces a word, and how well their boundaries meet morphemes."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hecespark.functions import chars
from hecespark.operators import parse, text
from hecespark.runtime import ROOT, cut

#: Marks that splitters put on pieces: each is taken off the start once and off the end once, in this order.
MARKS = ("▁", "Ġ", "##", "</w>", "Ċ")
ADAPTERS: dict[str, Callable[[Column], Column]] = {
    "whitespace": lambda w: F.array(w),
    "char": lambda w: F.split(w, ""),
}


def model(path: str) -> Callable[[Column], Column]:
    """An adapter of a loaded model: a sentencepiece model (.model), a rank file (.tiktoken) or a tokenizer file (.json). The path must be there on all workers, which each load it once.

    Words go through it in Arrow batches; a null word has null pieces."""
    from pyspark.sql.types import ArrayType, StringType

    root = ROOT

    def pieces(words):
        import importlib
        import sys

        import pandas as pd

        if root not in sys.path:
            sys.path.append(root)
        encode = importlib.import_module("hecespark.operators.fertility").loaded(path)
        return pd.Series([None if w is None else encode(w) for w in words])

    pieces.__annotations__ = {}
    udf = F.pandas_udf(pieces, ArrayType(StringType()), F.PandasUDFType.SCALAR)
    return lambda w: udf(w)


@cache
def loaded(path: str) -> Callable[[str], list[str]]:
    """word -> pieces by the model at path. Pieces of bytes that are no text each show the replacement character."""
    if path.endswith(".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda w: p.encode(w, out_type=str)
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda w: t.encode(w, add_special_tokens=False).tokens
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        e = tiktoken.Encoding(path, pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        return lambda w: [e.decode_single_token_bytes(x).decode("utf-8", "replace") for x in e.encode_ordinary(w)]
    raise ValueError(f"no adapter for {path}")


def clean(piece: Column) -> Column:
    for m in MARKS:
        piece = F.regexp_replace(F.regexp_replace(piece, rf"\A\Q{m}\E", ""), rf"\Q{m}\E\z", "")
    return piece


def boundaries(pieces: Column) -> Column:
    """Where pieces but the last end, without 0."""
    sums = F.aggregate(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), F.array().cast("array<int>"), lambda done, p: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + F.length(p))))
    return F.array_distinct(F.filter(sums, lambda x: x > 0))


def inner(word: Column, pieces: Column) -> Column:
    """The boundaries of pieces inside the word; null where the cleaned pieces aren't the word."""
    cleaned = F.transform(pieces, clean)
    return F.when(F.array_join(cleaned, "") == word, boundaries(F.filter(cleaned, lambda p: p != "")))


def morpheme_boundaries(root_chunk: Column, chunks: Column) -> Column:
    return boundaries(F.filter(F.concat(F.array(root_chunk), chunks), lambda c: c != ""))


def counted(df: DataFrame, column: str = "text") -> DataFrame:
    """(word, n): distinct words in small letters, and how often each occurs."""
    return text.word_counts(df, column).groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n"))


def counts(df: DataFrame, adapter: str | Callable[[Column], Column] = "char", column: str = "text") -> DataFrame:
    """(word, n, pieces) of distinct words in small letters, and how often each occurs."""
    return encoded(counted(df, column), adapter)


def encoded(words: DataFrame, adapter: str | Callable[[Column], Column] = "char") -> DataFrame:
    encode = ADAPTERS[adapter] if isinstance(adapter, str) else adapter
    return words.withColumn("pieces", encode(F.col("word"))).where(F.size("pieces") > 0)


def basics(df: DataFrame, adapter="char", column: str = "text") -> DataFrame:
    """One row (words, tokens, fertility, single_share), of all words of df."""
    c = counts(df, adapter, column).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.coalesce(F.sum(F.col("n") * F.size("pieces")), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(F.size("pieces") == 1, F.col("n"))), F.lit(0)).alias("single"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 9)
    return c.select("words", "tokens", share("tokens", "words").alias("fertility"), share("single", "words").alias("single_share"))


def score(df: DataFrame, adapter="char", column: str = "text", **options) -> DataFrame:
    """One row: words, tokens, morphemes, fertility, tokens_per_morpheme, morphemes_per_word, single_share, aligned_share, and precision,
    recall and f1 of inner boundaries. A word without an analysis counts as one morpheme; df is scored whole."""
    c = encoded(cut(counted(df, column)), adapter)
    best = parse.best(c.select("word"), **options).select("word", morpheme_boundaries(F.col("root_chunk"), F.col("chunks")).alias("gold"), F.size(F.filter(F.concat(F.array("root_chunk"), "chunks"), lambda x: x != "")).alias("m"))
    j = c.join(best, "word", "left").withColumn("got", inner(chars.letters_only("word"), F.transform("pieces", lambda p: chars.letters_only(p))))
    hit = F.size(F.array_intersect("gold", "got"))
    both = F.col("gold").isNotNull() & F.col("got").isNotNull()
    total = lambda x: F.coalesce(F.sum(F.col("n") * x), F.lit(0))
    sums = j.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("words"), total(F.size("pieces")).alias("tokens"), total(F.greatest(F.coalesce("m", F.lit(1)), F.lit(1))).alias("morphemes"),
        total(F.when(F.size("pieces") == 1, 1).otherwise(0)).alias("single"), total(F.when(both, 1).otherwise(0)).alias("aligned"),
        total(F.when(both, hit).otherwise(0)).alias("tp"), total(F.when(both, F.size("got")).otherwise(0)).alias("gp"), total(F.when(both, F.size("gold")).otherwise(0)).alias("gg"),
    )
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 9)
    return sums.select("words", "tokens", "morphemes", share("tokens", "words").alias("fertility"), share("tokens", "morphemes").alias("tokens_per_morpheme"), share("morphemes", "words").alias("morphemes_per_word"), share("single", "words").alias("single_share"), share("aligned", "words").alias("aligned_share"), share("tp", "gp").alias("precision"), share("tp", "gg").alias("recall"), share(2 * F.col("tp"), F.col("gp") + F.col("gg")).alias("f1"))
