"""Whole jobs over paths: what command lines of the engine do, as functions of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hecespark.operators import evaluate, fertility, normalize
from hecespark.sources import dims, lexicon


def _options(spark: SparkSession, roots: str | None) -> dict:
    return {} if roots is None else {"roots": dims.load_lexicon(spark, roots)}


def normalise(spark: SparkSession, source: str, target: str, mode: str = "surface", fold: bool = False, clitics: bool = True, separator: str = normalize.SEPARATOR, roots: str | None = None) -> DataFrame:
    """The lines of text files rendered in one of normalize.MODES to text files; returns (lines, words, oov, oov_share)."""
    given = spark.read.text(source)
    options = _options(spark, roots)
    made = normalize.lines(given, mode, "value", (), fold, clitics, separator, **options)
    made.withColumnRenamed("line", "value").write.mode("errorifexists").text(target)
    return normalize.summary(given, "value", clitics, **options)


def evaluated(spark: SparkSession, conllu: str, limit: int | None = None, errors: int = 20, top: int = 20, roots: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counters, feature keys with most errors, first root errors) of the first analyses of a treebank's open-class tokens."""
    gold, pred = evaluate.treebank(spark.read.text(conllu), limit, **_options(spark, roots))
    return evaluate.counters(gold, pred), evaluate.feature_keys(gold, pred, top), evaluate.root_errors(gold, pred, errors)


def fertilities(spark: SparkSession, source: str, adapters: dict[str, object] | None = None, roots: str | None = None) -> dict[str, DataFrame]:
    """fertility.score of text files for each adapter: a name of fertility.ADAPTERS, a path of a model, or a function of a Column."""
    given, out = spark.read.text(source), {}
    for name, adapter in (adapters or {x: x for x in fertility.ADAPTERS}).items():
        encode = fertility.model(adapter) if isinstance(adapter, str) and adapter not in fertility.ADAPTERS else adapter
        out[name] = fertility.score(given, encode, "value", **_options(spark, roots))
    return out


def build_lexicon(spark: SparkSession, conllu: str, target: str, headwords: str | None = None, overrides: str | None = None) -> DataFrame:
    """A lexicon of a treebank's roots, a dictionary's headwords and curated overrides, written as JSON lines; returns its summary by class."""
    found = lexicon.extract(lexicon.read_conllu(spark, conllu))
    if headwords is not None:
        found = lexicon.merged(found, lexicon.headwords(dims.load_headwords(spark, headwords)))
    if overrides is not None:
        changes, gone = dims.load_overrides(spark, overrides)
        found = lexicon.overridden(lexicon.pruned(found, gone), changes.select("form", "class", "frequency", "soften", "variants"))
    made = lexicon.ranked(found)
    dims.save_lexicon(made, target)
    return lexicon.summary(made)


def suggester_bench(spark: SparkSession, conllu: str, sample: int = 200, seed: int = 1, tail_repair: bool = True, roots: str | None = None) -> DataFrame:
    """evaluate.suggester over the forms of a treebank."""
    words = lexicon.read_conllu(spark, conllu).selectExpr("form as word")
    return evaluate.suggester(words, sample, seed, tail_repair, **_options(spark, roots))
