"""Corrections of words that no known root explains: roots nearby, stems repaired, endings repaired."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hecespark.functions import chars
from hecespark.operators import fuzzy, parse
from hecespark.sources import dims

TOP, STEMS, OVERFETCH = 3, 4, 3


def vocabulary(roots: DataFrame) -> DataFrame:
    """(term, lemma, freq): folded roots of two letters and more; of several with the same spelling the most frequent, then the first."""
    order = Window.partitionBy("term").orderBy(F.desc("freq"), "root_id")
    terms = roots.select("root_id", chars.fold("form").alias("term"), F.col("form").alias("lemma"), F.coalesce("frequency", F.lit(0)).alias("freq")).where(F.length("term") >= 2)
    return terms.withColumn("k", F.row_number().over(order)).where("k = 1").select("term", "lemma", "freq")


def _near(asked: DataFrame, terms: DataFrame, d: int, k: int) -> DataFrame:
    return fuzzy.nearest(asked, terms, d, k)


def suggest(words: DataFrame, roots: DataFrame | None = None, top: int = TOP) -> DataFrame:
    """(word, rank, lemma): up to ``top`` roots near each distinct word, at distance 1 for words of up to 4 letters and 2 for longer ones."""
    roots = roots if roots is not None else dims.root_frame(words.sparkSession)
    v = vocabulary(roots)
    asked = words.select("word").where("word is not null").distinct().withColumn("q", chars.fold(F.lower("word"))).where(F.length("q") >= 2)
    q = asked.select(F.col("q").alias("word")).distinct()
    found = _near(q.where(F.length("word") <= 4), v, 1, top * OVERFETCH).unionByName(_near(q.where(F.length("word") > 4), v, 2, top * OVERFETCH))
    lemma = found.withColumnRenamed("word", "q").join(v.select("term", "lemma"), "term")
    first = lemma.withColumn("k", F.row_number().over(Window.partitionBy("q", "lemma").orderBy("rank"))).where("k = 1")
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("rank"))).where(F.col("n") <= top)
    return asked.join(ranked.select("q", "n", "lemma"), "q").select("word", F.col("n").alias("rank"), "lemma")


def correct(words: DataFrame, tail_repair: bool = True, roots: DataFrame | None = None, top: int = TOP, **options) -> DataFrame:
    """(word, rank, corrected, lemma): up to ``top`` forms near each distinct word that a known root explains.

    Words of less than three letters and those that are explained already have none. Stem repair puts roots within distance 1 in place of the word's first 2 to
    10 letters; with ``tail_repair`` all edits of the word at distance 1 are tried too. A form scores its analysis less 3 for each edit; forms rank by edits, suffixes, score, form.
    """
    held = roots if roots is not None else dims.root_frame(words.sparkSession)
    given = words.select("word").where("word is not null").distinct().withColumn("w", chars.fold(F.lower("word"))).where(F.length("w") >= 3)
    plain = given.select("word", "w")
    own = parse.best(plain.select(F.col("w").alias("word")), roots=roots, **options).where("not oov").select(F.col("word").alias("w"))
    asked = plain.join(own, "w", "left_anti")
    w = asked.select("w").distinct()
    stems = w.select("w", F.explode(F.sequence(F.lit(2), F.least(F.length("w"), F.lit(10)))).alias("r")).withColumn("stem", F.substring(F.col("w"), F.lit(1), F.col("r")))
    # roots as they stand and softened: a suffix may have changed the last letter
    base = vocabulary(held)
    terms = dims.form_frame(held).select(F.col("key").alias("term"), "root_id").where(F.length("term") >= 2).join(held.select("root_id", F.coalesce("frequency", F.lit(0)).alias("freq")), "root_id").groupBy("term").agg(F.max("freq").alias("freq")).unionByName(base.select("term", "freq")).groupBy("term").agg(F.max("freq").alias("freq"))
    near = _near(stems.select(F.col("stem").alias("word")).distinct(), terms, 1, STEMS).where("distance > 0").select(F.col("word").alias("stem"), "term", "distance")
    repaired = stems.join(near, "stem").select("w", F.concat("term", F.substring(F.col("w"), F.col("r") + 1, F.length("w"))).alias("form"), "distance")
    if tail_repair:
        repaired = repaired.unionByName(w.select("w", F.explode(fuzzy.edits1("w")).alias("form"), F.lit(1).alias("distance")))
    forms = repaired.groupBy("w", "form").agg(F.min("distance").alias("distance"))
    explained = parse.best(forms.select(F.col("form").alias("word")), roots=roots, oov=False, **options).where("not oov").select(F.col("word").alias("form"), "root", "score", F.size("ids").alias("n"), "ids")
    j = forms.join(explained, "form").withColumn("corrected", F.when(F.col("n") == 0, F.col("root")).otherwise(F.col("form")))
    value = F.col("score") - 3.0 * F.col("distance")
    unique = j.withColumn("k", F.row_number().over(Window.partitionBy("w", "corrected").orderBy(F.desc(value), "form"))).where("k = 1")
    order = Window.partitionBy("w").orderBy("distance", "n", F.desc(F.round("score", 9)), "corrected")
    ranked = unique.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return asked.join(ranked, "w").select("word", "rank", "corrected", F.col("root").alias("lemma"))
