"""Parsing words: a word's analyses into a root and a chain of suffixes.

analyses() sends each distinct word through the kernel of chart.py, in as many partitions as shuffles have. analyses_by_joins() says
the same as a chain of joins: fragments of all words meet the realizations of their state, context and next letter
(hash lookups in a table of fixed size) and keep those whose literal is what the word has there, until no fragment is open. It
takes lexicons that are too large to send to workers (HELD_BYTES).
"""

from __future__ import annotations

import pickle

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hecespark.functions import chars
from hecespark.operators import chart, realize
from hecespark.operators.chart import N_AFTER
from hecespark.operators.realize import Weights
from hecespark.runtime import bind, cut
from hecespark.sources import dims

#: Of the compiled grammar and roots, in bytes: what workers are sent at most, and what the roots may take before they are collected to be measured.
HELD_BYTES = 256 << 20
#: Joins between two checkpoints of the fragments, and between two of code generation.
ROUND_STEPS, STAGE_STEPS = 6, 3


def prepared(words: DataFrame, word: str = "word", contexts: bool = True) -> DataFrame:
    """(word, w, n, at_apostrophe, title, contexts) of distinct words that have a letter left."""
    w = words.select(F.col(word).alias("word")).where("word is not null").distinct()
    w = w.select("word", chars.letters_only("word").alias("w"), chars.apostrophe_at("word").alias("apo"), chars.title_case("word").alias("title"))
    w = w.withColumn("n", F.length("w")).where("n > 0")
    if not contexts:
        return w
    return w.withColumn("contexts", F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: realize.context_of(F.col("w").substr(F.lit(1), k))))


def root_flags(bits: dict[tuple[str, str], int]) -> Column:
    flags = F.when(F.coalesce("aorist_high", F.lit(False)), realize.HIGH_AORIST).otherwise(realize.LOW_AORIST)
    for (kind, template), bit in bits.items():
        flags = flags + F.when(F.col("caus_deriv" if kind == "caus" else "pass_deriv") == template, bit).otherwise(0)
    return flags.cast("int")


def seeds(words: DataFrame, roots: DataFrame, bits: dict[tuple[str, str], int], oov: bool = True, small: bool = True, weights: Weights = Weights()) -> DataFrame:
    """Fragments of a root and nothing else: known roots that begin the word, verbs shortened before PROG, and any beginning as an unknown root."""
    forms = dims.form_frame(roots).join(roots.select("root_id", "form", "class", "frequency", "pronominal_n", root_flags(bits).alias("flags")), "root_id")
    forms = F.broadcast(forms) if small else forms
    longest = F.length(F.col("w")) if not small else F.least(F.length("w"), F.lit(max(len(x) for r in dims.roots() for x in (r.form, *r.variants))))
    freq = F.log1p(F.greatest(F.col("frequency"), F.lit(0)).cast("double"))
    base = words.select("word", "w", "n", "apo", "title", "contexts")
    cells = base.withColumn("pos", F.explode(F.sequence(F.lit(1), F.greatest(F.least("n", longest), F.least("n", F.lit(weights.max_oov)))))).withColumn("begin", F.substring("w", F.lit(1), F.col("pos")))
    empty = F.array().cast("array<string>")

    def fragment(df: DataFrame, form, cls, flags, pn, then, score, is_oov, key) -> DataFrame:
        start = F.lit(None)
        for c, s in dims.START.items():
            start = F.when(cls == c, s).otherwise(start)
        return df.select(
            "word", "w", "n", "apo", "title", "contexts", "pos", start.alias("state"), cls.alias("cls"), flags.cast("int").alias("flags"), pn.alias("pn"), F.lit("").alias("prev"), F.lit(False).alias("zero"), then.alias("then"),
            score.alias("score"), empty.alias("ids"), empty.alias("chunks"), F.array(*(k.cast("int") for k in key)).alias("key"), form.alias("root"), cls.alias("root_class"), is_oov.alias("oov"), F.col("begin").alias("root_chunk"),
        )

    known = cells.join(forms, F.col("begin") == F.col("key"))
    pn = F.coalesce("pronominal_n", F.lit(False))
    score = freq + F.col("pos") * F.lit(weights.root_letter)
    lexical = fragment(known, F.col("form"), F.col("class"), F.col("flags"), pn, F.lit(""), score, F.lit(False), (F.lit(0), F.lit(0), F.col("root_id")))
    vowel = F.explode(F.array(F.lit("a"), F.lit("e")))
    short = cells.where(f"pos >= 2 and pos < least({weights.max_oov}, n)").withColumn("low", vowel).join(forms.where("class = 'VERB'"), F.concat("begin", "low") == F.col("key"))
    shortened = fragment(short, F.col("form"), F.col("class"), F.col("flags"), pn, F.lit("PROG"), score, F.lit(False), (F.lit(0), F.lit(1), F.when(F.col("low") == "a", 0).otherwise(1), F.col("root_id")))
    out = lexical.unionByName(shortened)
    if oov:
        any_ = cells.where(F.col("pos").between(weights.min_oov, weights.max_oov)).withColumn("kind", F.explode(F.sequence(F.lit(0), F.lit(2))))
        cls = F.element_at(F.array(F.lit("NOUN"), F.lit("VERB"), F.lit("ADJ")), F.col("kind") + 1)
        unknown = fragment(any_, F.col("begin"), cls, F.lit(realize.LOW_AORIST), F.lit(False), F.lit(""), F.lit(weights.oov) + F.col("pos") * F.lit(weights.oov_letter), F.lit(True), (F.lit(0), F.lit(2), F.col("kind")))
        out = out.unionByName(unknown)
    return out


def has() -> Column:
    prev = F.col("prev")
    return (
        F.col("flags")
        + F.when(prev == "NEG", realize.NEG).otherwise(realize.NOT_NEG)
        + F.when(prev.isin(*N_AFTER) | (F.col("pn") & (prev == "")), realize.WITH_N).otherwise(realize.WITHOUT_N)
        + F.when((prev == "AOR") & F.col("zero"), realize.AFTER_ZERO_AORIST).otherwise(realize.NOT_AFTER_ZERO_AORIST)
    )


def extended(f: DataFrame, table: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """Each fragment with each suffix that fits next; those that have ended stay."""
    f = f.withColumns({"f_state": F.col("state"), "f_context": F.get("contexts", F.col("pos") - 1), "f_next": realize.next_of(F.col("w"), F.col("pos")), "has": has(), "f_then": F.col("then")}).drop("state", "then")
    fits = (
        (F.col("f_state") == F.col("state")) & (F.col("f_context") == F.col("context")) & (F.col("f_next") == F.col("next"))
        & (F.col("has").bitwiseAND(F.col("need")) == F.col("need"))
        & ((F.col("f_then") == "") | (F.col("suffix") == F.col("f_then")) | (F.col("suffix") == realize.END))
        & F.expr("substring(w, pos + 1, size) = literal") & ((F.col("suffix") != realize.END) | (F.col("pos") == F.col("n")))
    )
    j = f.join(F.broadcast(table), fits)
    end = F.col("suffix") == realize.END
    crossing = F.when(F.col("class_out").isNotNull() & (F.col("class_out") != F.col("cls")), F.lit(weights.derivation)).otherwise(F.lit(0.0))
    return j.select(
        "word", "w", "n", "apo", "title", "contexts", (F.col("pos") + F.col("size")).alias("pos"), F.col("to_state").alias("state"), F.coalesce("class_out", "cls").alias("cls"), "flags", "pn",
        F.when(end, F.col("prev")).otherwise(F.col("suffix")).alias("prev"), F.when(end, F.col("zero")).otherwise(F.col("size") == 0).alias("zero"), F.col("then"),
        F.when(end, F.col("score")).otherwise(F.col("score") + (F.col("base") + crossing + F.col("extra"))).alias("score"),
        F.when(end, F.col("ids")).otherwise(F.concat("ids", F.array("suffix"))).alias("ids"), F.when(end, F.col("chunks")).otherwise(F.concat("chunks", F.array("literal"))).alias("chunks"),
        F.when(end, F.col("key")).otherwise(F.concat(F.array(F.size("ids") + 1, F.col("pos")), F.col("key"), F.array("ord"))).alias("key"),
        "root", "root_class", "oov", "root_chunk",
    )


def boundaries(root_chunk: Column, chunks: Column) -> Column:
    """The lengths of the word's beginnings that end with a morpheme."""
    return F.aggregate(chunks, F.array(F.length(root_chunk)), lambda done, c: F.concat(done, F.array(F.element_at(done, -1) + F.length(c))))


def payload_of(spark: SparkSession, roots: DataFrame | None = None, g: dims.Grammar | None = None, weights: Weights = Weights()):
    """The compiled grammar with the roots as a broadcast variable, None for the packaged ones; False where it is more than HELD_BYTES."""
    if roots is None and g is None and weights == Weights():
        return None
    held = list(enumerate(dims.roots()))
    if roots is not None:
        size = roots.agg(F.sum(64 + F.coalesce(F.octet_length("form"), F.lit(0)) + F.coalesce(F.octet_length(F.array_join("variants", ",")), F.lit(0)))).first()[0] or 0
        if size > HELD_BYTES:
            return False
        held = [(r["root_id"], dims.root_of(r)) for r in roots.orderBy("root_id").collect()]
    bits = realize.derivation_bits({"caus": sorted({r.caus for _, r in held if r.caus}), "pass": sorted({r.passive for _, r in held if r.passive})})
    data = pickle.dumps((realize.keyed(realize.rows(g or dims.grammar(), bits, weights)), held, bits, weights, {s.id: s.feats for s in (g or dims.grammar()).suffixes.values()}))
    return spark.sparkContext.broadcast(data) if len(data) <= HELD_BYTES else False


def held(spark: SparkSession, **options):
    """payload_of() for kernels that have no other way: a lexicon of more than HELD_BYTES raises."""
    payload = payload_of(spark, **options)
    if payload is False:
        raise ValueError(f"a lexicon of more than {HELD_BYTES} bytes can't be sent to workers: analyses() alone takes it")
    return payload


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df in as many partitions as shuffles have: kernels take long for few bytes, so that adaptive coalescing by bytes would leave cores idle.

    By a hash of the columns: a partitioning by themselves that is there already would stand for this one, and be coalesced."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*by))


def analyses(words: DataFrame, word: str = "word", roots: DataFrame | None = None, return_all: bool = False, oov: bool = True, g: dims.Grammar | None = None, weights: Weights = Weights()) -> DataFrame:
    """(word, rank, root, root_class, final_class, oov, score, ids, chunks, root_chunk): analyses of the distinct words, best first; ranks
    from 1. Without return_all only those that share the best score. Words of no letters have none, nor have words
    that no root of up to weights.max_oov letters and suffixes make up. With oov=False only known roots count.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    payload = payload_of(words.sparkSession, roots, g, weights)
    if payload is False:
        return analyses_by_joins(words, word, roots, return_all, oov, g, weights)
    schema = to_arrow_schema(_parse_datatype_string(chart.SCHEMA))
    given = spread(prepared(words, word, contexts=False).select("word", "w", "apo", "title"), "word")
    return given.mapInArrow(bind(chart.__name__, "kernel", payload, oov, return_all, schema), chart.SCHEMA)


def analyses_by_joins(words: DataFrame, word: str = "word", roots: DataFrame | None = None, return_all: bool = False, oov: bool = True, g: dims.Grammar | None = None, weights: Weights = Weights()) -> DataFrame:
    """What analyses() gives, by one join for each suffix of the longest chain; fragments are checkpointed every ROUND_STEPS joins."""
    spark = words.sparkSession
    small = roots is None
    roots = roots if roots is not None else dims.root_frame(spark)
    licensed = lambda c: sorted(r[0] for r in roots.select(c).where(F.col(c).isNotNull()).distinct().collect())
    bits = realize.packaged_bits() if small else realize.derivation_bits({"caus": licensed("caus_deriv"), "pass": licensed("pass_deriv")})
    table = realize.realizations(spark, g if small else g or dims.grammar(), bits, weights)
    f, done = seeds(prepared(words, word), roots, bits, oov, small, weights), None
    while True:
        for k in range(ROUND_STEPS):
            f = extended(f, table, weights)
            if k % STAGE_STEPS == STAGE_STEPS - 1:
                f = f.coalesce(1 << 20)  # no fewer partitions: code generation starts anew, within what a method may hold
        f = cut(f)
        ended = f.where(F.col("state") == realize.FINAL)
        done = ended if done is None else done.unionByName(ended)
        f = f.where(F.col("state") != realize.FINAL)
        if f.isEmpty():
            break
    bare = ~F.col("oov") & (F.size("ids") == 0)
    score = F.col("score") + F.when(bare, F.lit(weights.bare)).otherwise(F.lit(0.0))
    score = score + F.when(F.col("apo").isNotNull() & F.array_contains(boundaries(F.col("root_chunk"), F.col("chunks")), F.col("apo")), F.lit(weights.apostrophe)).otherwise(F.lit(0.0))
    score = score + F.when(F.col("title") & bare & (F.col("root") == F.col("w")), F.lit(weights.title)).otherwise(F.lit(0.0))
    score = score + F.when(F.col("oov") & F.col("title") & F.col("apo").isNull() & (F.col("root_chunk") == F.col("w")), F.lit(weights.title_oov)).otherwise(F.lit(0.0))
    done = done.withColumn("score", score).withColumn("score_key", F.round("score", 9))
    first = F.row_number().over(Window.partitionBy("word", "root", "root_class", "ids", "chunks").orderBy("key"))
    done = done.withColumn("first", first).where("first = 1")
    by_score = Window.partitionBy("word").orderBy(F.desc("score_key"), "key")
    out = done.withColumn("rank", F.row_number().over(by_score)).withColumn("best", F.max("score_key").over(Window.partitionBy("word")))
    if not return_all:
        out = out.where("score_key >= best")
    return out.select("word", "rank", "root", "root_class", F.col("cls").alias("final_class"), "oov", "score", "ids", "chunks", "root_chunk")


def best(words: DataFrame, **options) -> DataFrame:
    """The first analysis of each distinct word that has one."""
    return analyses(words, **options).where("rank = 1")
