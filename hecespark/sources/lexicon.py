"""Building lexicons: treebank rows, dictionary headwords, and the merges between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hecespark.functions import chars
from hecespark.runtime import cut

OPEN = ("NOUN", "VERB", "ADJ")


def conllu(lines: DataFrame, columns: int = 6) -> DataFrame:
    """(line, id, form, lemma, upos, feats) of treebank lines (value); comments, blanks, short rows, and ids with - or . are passed over."""
    f = F.split("value", "\t")
    rows = lines.where("value is not null and value not like '#%' and trim(value) <> ''").where(F.size(f) >= columns).where(~f[0].rlike("[-.]"))
    return rows.select(F.col("value").alias("line"), f[0].alias("id"), f[1].alias("form"), f[2].alias("lemma"), f[3].alias("upos"), F.try_element_at(f, F.lit(6)).alias("feats"))


def read_conllu(spark: SparkSession, path: str, columns: int = 4) -> DataFrame:
    return conllu(spark.read.text(path), columns)


def gold(rows: DataFrame) -> DataFrame:
    """conllu() rows of open classes as (line, form, lemma, upos, feats map); proper nouns are nouns, pairs without = are dropped."""
    upos = F.when(F.col("upos") == "PROPN", "NOUN").otherwise(F.col("upos"))
    pairs = F.transform(F.filter(F.split("feats", r"\|"), lambda x: F.instr(x, "=") > 1), lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.substring(x, F.instr(x, "=") + 1, F.length(x)).alias("value")))
    r = rows.withColumn("upos", upos).where(F.col("upos").isin(*OPEN) & (F.col("lemma") != "_") & F.col("lemma").rlike(r"\p{L}"))
    return r.select("line", "form", chars.tr_lower("lemma").alias("lemma"), "upos", F.coalesce(F.map_from_entries(F.array_distinct(pairs)), F.create_map().cast("map<string,string>")).alias("feats"))


def clean_lemma(s) -> Column:
    c = chars._c(s)
    return F.coalesce((c != "") & (c != "_") & c.rlike(r"\p{L}") & ~c.rlike("[ \t]"), F.lit(False))


def softens(form: Column, lemma: Column) -> Column:
    """Whether the form shows the lemma's last k p t ç as its soft counterpart."""
    n = F.length(lemma)
    return (F.length(form) > n) & chars.ends_in(chars.HARD, lemma) & (F.left(form, n) == chars.soften_final(lemma))


def vowel_zero(form: Column, lemma: Column) -> Column:
    """The lemma without its last vowel, where the form begins with that and a vowel or y follows; else null."""
    n = F.length(lemma)
    before = F.substring(lemma, n - 1, F.lit(1))
    short = F.concat(F.left(lemma, n - 2), F.right(lemma, F.lit(1)))
    after = F.substring(form, n, F.lit(1))
    fits = (n >= 4) & chars.one_of(chars.HIGH, before) & ~chars.ends_in_vowel(lemma) & form.startswith(short) & (F.length(form) > n - 1) & ~form.startswith(lemma) & chars.one_of(chars.VOWELS + "y", after)
    return F.when(fits, short)


def extract(rows: DataFrame, n: str | None = None) -> DataFrame:
    """(form, class, frequency, soften, variants): roots of conllu() rows, that count ``n`` times where it is given. Only distinct rows are looked at. Case is that of the plain lower(), as the lexicon to match has it."""
    lemma, form = F.lower("lemma"), F.lower("form")
    rows = rows.where(F.col("upos").isin(*OPEN, "PROPN")).groupBy("form", "lemma", "upos").agg((F.count("*") if n is None else F.sum(n)).alias("n"))
    r = rows.where(clean_lemma("lemma")).select("n", lemma.alias("lemma"), form.alias("word"), F.when(F.col("upos") == "PROPN", "NOUN").otherwise(F.col("upos")).alias("class"))
    r = r.withColumn("soft", softens(F.col("word"), F.col("lemma"))).withColumn("zero", vowel_zero(F.col("word"), F.col("lemma")))
    out = r.groupBy("lemma", "class").agg(F.sum("n").alias("frequency"), F.bool_or("soft").alias("soften"), F.array_sort(F.collect_set("zero")).alias("variants"))
    return out.where(F.length("lemma") > 1).select(F.col("lemma").alias("form"), "class", "frequency", "soften", "variants")


def overridden(roots: DataFrame, changes: DataFrame) -> DataFrame:
    """roots with those of changes put in (form, class): what a change has that isn't null counts; new ones are added."""
    given = [c for c in changes.columns if c not in ("form", "class")]
    a, b = roots.alias("a"), changes.alias("b")
    j = a.join(b, (F.col("a.form") == F.col("b.form")) & (F.col("a.class") == F.col("b.class")), "full_outer")
    return j.select(*((F.coalesce(f"b.{c}", f"a.{c}") if c in given or c in ("form", "class") else F.col(f"a.{c}")).alias(c) for c in roots.columns))


def pruned(roots: DataFrame, gone: DataFrame) -> DataFrame:
    return roots.join(gone.select("form", "class").distinct(), ["form", "class"], "left_anti").select(roots.columns)


def headwords(words: DataFrame) -> DataFrame:
    """(form, class, soften) of dictionary words: those in -mak and -mek are verbs without it. Words with other letters, with blanks, and of a length outside 2 to 20 are dropped."""
    w = words.select("word").where("word is not null").distinct().select(chars.etl_lower("word").alias("word")).distinct()
    w = cut(w.where(F.col("word").rlike(r"\A[a-zçğıöşüâîû]{2,20}\z")))
    verb = F.col("word").rlike("m[ae]k\\z") & (F.length("word") > 3)
    r = w.where(~(F.col("word").rlike("m[ae]k\\z") & (F.length("word") <= 3))).select("word", F.when(verb, F.left("word", F.length("word") - 3)).otherwise(F.col("word")).alias("form"), F.when(verb, "VERB").otherwise("NOUN").alias("class"))
    soft = r.where((F.col("class") == "NOUN") & chars.ends_in(chars.HARD, "form")).select("form", chars.soften_final("form").alias("key")).join(w.select(F.col("word").alias("key")), "key", "left_semi").select("form", F.lit(True).alias("soften"))
    return r.select("form", "class").distinct().join(soft.distinct(), "form", "left").select("form", "class", F.coalesce(F.col("soften") & (F.col("class") == "NOUN"), F.lit(False)).alias("soften"))


def merged(roots: DataFrame, heads: DataFrame) -> DataFrame:
    """roots, and headwords of forms that no root of any class has, with frequency 0."""
    new = heads.join(roots.select("form").distinct(), "form", "left_anti").select("form", "class", F.lit(0).cast("bigint").alias("frequency"), "soften", F.array().cast("array<string>").alias("variants"))
    return roots.select("form", "class", "frequency", "soften", "variants").unionByName(new)


def with_additions(roots: DataFrame, additions: DataFrame) -> DataFrame:
    """roots and the additions of forms that are not there; again is a no-op. Additions without form or class are passed over, of several of a form and class one counts."""
    new = additions.where("form is not null and class is not null").dropDuplicates(["form", "class"]).join(roots.select("form").distinct(), "form", "left_anti")
    return roots.unionByName(new, allowMissingColumns=True)


def summary(roots: DataFrame) -> DataFrame:
    return roots.groupBy("class").agg(F.count("*").alias("n"), F.count_if("soften").alias("softening"))


def ranked(roots: DataFrame) -> DataFrame:
    """roots with root_id: by frequency, then form and class. The rows are sorted by ranges, written, counted range by range, and numbered where they are."""
    order = cut(roots.orderBy(F.desc("frequency"), "form", "class"))
    placed = order.withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    before, total = {}, 0
    for r in placed.groupBy("_part").count().orderBy("_part").collect():  # as many as there are ranges
        before[r["_part"]], total = total, total + r["count"]
    if not before:
        return roots.withColumn("root_id", F.lit(0).cast("bigint"))
    first = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))
    return placed.withColumn("root_id", (first[F.col("_part")] + F.col("_in")).cast("bigint")).drop("_part", "_in")
