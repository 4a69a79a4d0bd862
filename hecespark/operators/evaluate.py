"""Analyses against gold: counters over all and by class, features as sets of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hecespark.functions import chars
from hecespark.operators import correct, feats, fuzzy, parse
from hecespark.runtime import cut
from hecespark.sources import lexicon

MAP = "map<string,string>"


def compared(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """gold (id, lemma, upos, feats) with pred (id, root, root_class, feats) as a row of 0/1 and counts each. A token that isn't in pred has no analysis: all its features are missed."""
    p = pred.select("id", F.col("root").alias("p_root"), F.col("root_class").alias("p_class"), F.map_entries("feats").alias("p_feats"))
    j = gold.select("id", "lemma", "upos", F.map_entries(F.coalesce("feats", F.create_map().cast(MAP))).alias("g_feats")).join(p, "id", "left")
    none = F.array().cast("array<struct<key:string,value:string>>")
    got = F.coalesce("p_feats", none)
    same = F.array_intersect("g_feats", got)
    one = lambda c: F.coalesce(c, F.lit(False)).cast("bigint")
    return j.select(
        "id", "lemma", "upos", "p_root", one(F.col("p_root").isNotNull()).alias("parsed"), one(F.col("lemma") == F.col("p_root")).alias("root"), one(F.col("upos") == F.col("p_class")).alias("class"),
        one(F.col("p_root").isNotNull() & (F.size(F.array_except("g_feats", got)) == 0) & (F.size(F.array_except(got, "g_feats")) == 0)).alias("exact"),
        F.size(same).cast("bigint").alias("tp"), F.size(F.array_except(got, "g_feats")).cast("bigint").alias("fp"), F.size(F.array_except("g_feats", got)).cast("bigint").alias("fn"),
        "g_feats", got.alias("p_feats"),
    )


def counters(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """A row for all tokens (upos null) and one for each class: n, parsed, root, class, exact, tp, fp, fn, shares in percent, f1 (0 where nothing is to be found)."""
    c = compared(gold, pred)
    sums = c.groupingSets([[], ["upos"]], "upos").agg(F.count("*").alias("n"), *(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("parsed", "root", "class", "exact", "tp", "fp", "fn")))
    share = lambda x: F.round(F.coalesce(F.try_divide(F.col(x) * 100.0, F.col("n")), F.lit(0.0)), 6).alias(f"{x}_pct")
    f1 = F.round(F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)), 6)
    return sums.select("upos", "n", "parsed", "root", "class", "exact", "tp", "fp", "fn", share("parsed"), share("root"), share("class"), share("exact"), f1.alias("f1"))


def feature_keys(gold: DataFrame, pred: DataFrame, top: int | None = None) -> DataFrame:
    """(key, tp, fp, fn) of features, those with most errors first; ties by key, descending."""
    c = compared(gold, pred)
    one = lambda pairs, kind: c.select(F.explode(pairs).alias("e")).select(F.col("e.key").alias("key"), *(F.lit(int(k == kind)).cast("bigint").alias(k) for k in ("tp", "fp", "fn")))
    rows = one(F.array_intersect("g_feats", "p_feats"), "tp").unionByName(one(F.array_except("p_feats", "g_feats"), "fp")).unionByName(one(F.array_except("g_feats", "p_feats"), "fn"))
    out = rows.groupBy("key").agg(*(F.sum(k).alias(k) for k in ("tp", "fp", "fn"))).orderBy(F.desc(F.col("fp") + F.col("fn")), F.desc("key"))
    return out if top is None else out.limit(top)


def root_errors(gold: DataFrame, pred: DataFrame, n: int = 20) -> DataFrame:
    """The first n tokens by id whose root is wrong."""
    return compared(gold, pred).where("p_root is null or p_root <> lemma").orderBy("id").limit(n).select("id", "lemma", "upos", "p_root")


def treebank(lines: DataFrame, limit: int | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(gold, pred) for counters() and its like: the open-class tokens of treebank lines (value), the first ``limit`` of them, and each one's first analysis.

    Tokens are numbered as they are read; distinct forms are parsed once and joined to their tokens. options are those of parse.analyses()."""
    g = lexicon.gold(lexicon.conllu(lines.withColumn("value", F.col("value")))).withColumn("id", F.monotonically_increasing_id())
    g = g if limit is None else g.orderBy("id").limit(limit)
    best = feats.with_ud(parse.best(g.select("form"), word="form", **options)).select(F.col("word").alias("form"), "root", "root_class", F.col("ud").alias("feats"))
    return g.select("id", "form", "lemma", "upos", "feats"), g.select("id", "form").join(best, "form").select("id", "root", "root_class", "feats")


TAIL, GOLD_LENGTHS = 4, (4, 12)


def suggester(words: DataFrame, sample: int = 200, seed: int = 1, tail_repair: bool = True, **options) -> DataFrame:
    """How corrections do on typos: a row for all (by is null), for each kind of edit and each region (stem, or tail: the last TAIL letters): n, fired, top1, top3 and their shares in percent.

    Gold are distinct words of letters alone, of GOLD_LENGTHS, of a known root; each gets one typo, and those that make a word of a known root again are
    passed over. ``sample`` typos are tried, those with the smallest hashes. No typos: one row of zeros. What words are gold, and the sample, are each found once."""
    low, high = GOLD_LENGTHS
    w = words.select(chars.tr_lower("word").alias("word")).where(F.length("word").between(low, high) & F.col("word").rlike(r"\A\p{L}+\z")).distinct()
    gold = parse.best(w, **options).where("not oov").select("word")
    made = gold.withColumn("t", fuzzy.typo("word", seed)).select("word", "t.typo", "t.kind", F.when(F.col("t.at") >= F.length("word") - TAIL, "tail").otherwise("stem").alias("region")).where("typo is not null")
    made = cut(made)
    known = parse.best(made.select(F.col("typo").alias("word")), **options).where("not oov").select(F.col("word").alias("typo"))
    cases = cut(made.join(known, "typo", "left_anti").orderBy(F.xxhash64("word"), "word").limit(sample))
    found = correct.correct(cases.select(F.col("typo").alias("word")), tail_repair, **options).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("rank", "corrected"))).alias("p"))
    shown = F.transform(F.col("p.corrected"), lambda x: chars.fold(chars.tr_lower(x)))
    j = cases.join(found.select(F.col("word").alias("typo"), shown.alias("got")), "typo", "left")
    want = chars.fold("word")
    j = j.select("kind", "region", (F.col("got").isNotNull()).cast("bigint").alias("fired"), F.coalesce(F.get("got", F.lit(0)) == want, F.lit(False)).cast("bigint").alias("top1"), F.coalesce(F.array_contains(F.slice("got", 1, 3), want), F.lit(False)).cast("bigint").alias("top3"))
    sums = j.groupingSets([[], ["kind"], ["region"]], "kind", "region").agg(F.count("*").alias("n"), *(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("fired", "top1", "top3")))
    share = lambda x: F.round(F.coalesce(F.try_divide(F.col(x) * 100.0, F.col("n")), F.lit(0.0)), 6).alias(f"{x}_pct")
    return sums.select(F.coalesce("kind", "region").alias("by"), "n", "fired", "top1", "top3", share("fired"), share("top1"), share("top3"))
