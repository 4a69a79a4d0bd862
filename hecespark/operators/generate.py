"""Generating surface forms: suffix chains folded over stems, with the rules' forward views as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hecespark.functions import chars
from hecespark.sources import dims

#: In the order in which they apply, which is that in which suffixes declare them. name -> function(stem, template, context) giving (stem, template); context has prev, prev_empty, next and the root's flags.
FORWARD: dict[str, Callable] = {}


def forward(name: str):
    def add(f: Callable) -> Callable:
        if name in FORWARD:
            raise ValueError(f"{name} is there twice")
        FORWARD[name] = f
        return f

    return add


@forward("delete_stem_final_low_vowel")
def _shorten(stem, t, c):
    return F.when(chars.ends_in(chars.LOW, stem), F.left(stem, F.length(stem) - 1)).otherwise(stem), t


@forward("drop_initial_H_after_vowel_stem")
def _drop_h(stem, t, c):
    return stem, F.when(chars.ends_in_vowel(stem) & t.startswith("H"), F.substring(t, F.lit(2), F.length(t))).otherwise(t)


@forward("insert_n_after_3rd_person_possessive")
def _insert_n(stem, t, c):
    return stem, F.when(c["prev"].isin("POSS_3SG", "POSS_3PL", "REL_KI") | (c["pronominal_n"] & (c["prev"] == "")), F.concat(F.lit("n"), t)).otherwise(t)


@forward("aorist_allomorphy")
def _aorist(stem, t, c):
    after_neg = F.when(c["next"].isin("1SG_Z", "1PL_Z"), "").otherwise("z")
    plain = F.when(chars.ends_in_vowel(stem), "r").when(chars.monosyllabic(stem) & ~c["aorist_high"], "Ar").otherwise("Hr")
    return stem, F.when(c["prev"] == "NEG", after_neg).otherwise(plain)


@forward("passive_allomorphy")
def _passive(stem, t, c):
    return stem, F.when(chars.ends_in_vowel(stem), "n").when(chars.ends_in("l", stem), "Hn").otherwise("Hl")


@forward("causative_allomorphy")
def _causative(stem, t, c):
    return stem, F.when(chars.ends_in_vowel(stem) | (chars.ends_in("rl", stem) & (chars.syllables(stem) > 1)), "t").otherwise("DHr")


@forward("caus_deriv_allomorphy")
def _caus_deriv(stem, t, c):
    return stem, F.coalesce(c["caus_deriv"], t)


@forward("pass_deriv_allomorphy")
def _pass_deriv(stem, t, c):
    return stem, F.coalesce(c["pass_deriv"], t)


@forward("potential_neg_suppletion")
def _potential(stem, t, c):
    return stem, F.when(c["next"] == "NEG", "(y)A").otherwise(t)


@forward("neg_aor_agreement_suppletion")
def _neg_aor(stem, t, c):
    return stem, F.when((c["prev"] == "AOR") & c["prev_empty"] & (t == "(y)Hm"), "m").otherwise(t)


def get_forward(name: str) -> Callable:
    if name not in FORWARD:
        raise ValueError(f"no forward view of {name}")
    return FORWARD[name]


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is named: an expression that uses it several times stays small."""
    return F.transform(F.array(value), f)[0]


def ruled(name: str, rules: Column, context: dict) -> Callable[[Column], Column]:
    """A step from (stem, template) to those that the rule makes, where it is among rules."""

    def step(y: Column) -> Column:
        stem, template = get_forward(name)(y["stem"], y["template"], context)
        has = F.array_contains(rules, name)
        return F.struct(F.when(has, stem).otherwise(y["stem"]).alias("stem"), F.when(has, template).otherwise(y["template"]).alias("template"))

    return step


def common_prefix(a: Column, b: Column) -> Column:
    """How many characters the two begin with alike."""
    n = F.least(F.length(a), F.length(b))
    step = lambda k, i: F.when((k == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(k)
    return F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0), step)


def generate(cases: DataFrame, g: dims.Grammar | None = None, strict: bool = True) -> DataFrame:
    """cases with surface, chunks, split, tagged and warning.

    cases: stem and chain (array of suffix ids); and if wanted word_class (without it no state is checked), soften (true), aorist_high, pronominal_n (false), caus_deriv, pass_deriv (null).
    A suffix that isn't there fails. One that the graph doesn't allow fails if ``strict``, else the state stays and warning names the suffix.
    A null stem or chain gives a null surface.
    """
    g = g or dims.grammar()
    have = set(cases.columns)
    default = lambda c, v: F.coalesce(F.col(c), F.lit(v)) if c in have else F.lit(v)
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    entries = []
    for s in g.suffixes.values():
        to = [(e.state, e.to) for e in g.edges if e.suffix == s.id]
        moves = F.create_map(*(F.lit(x) for pair in dict(to).items() for x in pair)) if to else F.create_map().cast("map<string,string>")
        feats = F.lit(",".join(f"{k}={v}" for k, v in s.feats))
        entries += [F.lit(s.id), F.struct(F.lit(s.template).alias("template"), F.array(*map(F.lit, s.rules)).cast("array<string>").alias("rules"), moves.alias("moves"), feats.alias("feats"))]
    spark = cases.sparkSession
    book = F.broadcast(spark.range(1).select(F.create_map(*entries).alias("book")))  # one row of the grammar's fixed size
    known = F.transform(F.col("chain"), lambda x, i: F.struct(x.alias("id"), F.coalesce(F.get(F.col("chain"), i + 1), F.lit("")).alias("next"), F.try_element_at(F.col("book"), x).alias("s")))
    checked = F.transform(known, lambda x: F.when(x["s"].isNull(), F.raise_error(F.concat(F.lit("no suffix "), F.coalesce(x["id"], F.lit("null")))).cast("struct<id:string,next:string,s:struct<template:string,rules:array<string>,moves:map<string,string>,feats:string>>")).otherwise(x))
    start = F.lit(None).cast("string")
    for c, s in g.start.items():
        start = F.when(text("word_class") == c, s).otherwise(start)
    flags = {"aorist_high": default("aorist_high", False), "pronominal_n": default("pronominal_n", False), "caus_deriv": text("caus_deriv"), "pass_deriv": text("pass_deriv")}
    soften = default("soften", True)

    def step(acc: Column, x: Column) -> Column:
        context = flags | {"prev": acc["prev"], "prev_empty": acc["prev_empty"], "next": x["next"]}
        now = F.struct(acc["surface"].alias("stem"), x["s"]["template"].alias("template"))
        for name in FORWARD:
            now = let(now, ruled(name, x["s"]["rules"], context))
        made = let(now, lambda y: chars.apply_suffix(y["stem"], y["template"], soften))
        return let(
            made,
            lambda new: F.struct(
                new.alias("surface"), x["id"].alias("prev"),
                F.concat(acc["chunks"], F.array(F.substring(new, common_prefix(acc["surface"], new) + 1, F.length(new)))).alias("chunks"),
                (F.length(new) == common_prefix(acc["surface"], new)).alias("prev_empty"),
                F.coalesce(F.try_element_at(x["s"]["moves"], acc["state"]), acc["state"]).alias("state"),
                F.when(acc["state"].isNotNull() & F.try_element_at(x["s"]["moves"], acc["state"]).isNull() & acc["warning"].isNull(), x["id"]).otherwise(acc["warning"]).alias("warning"),
            ),
        )

    none = F.lit(None).cast("string")
    zero = F.struct(F.col("stem").cast("string").alias("surface"), F.lit("").alias("prev"), F.array().cast("array<string>").alias("chunks"), F.lit(False).alias("prev_empty"), start.alias("state"), none.alias("warning"))
    out = cases.crossJoin(book).withColumn("made", F.aggregate(checked, zero, step))
    warning = F.col("made.warning")
    if strict:
        warning = F.when(warning.isNotNull(), F.raise_error(F.concat(F.lit("the graph doesn't allow "), warning)).cast("string")).otherwise(warning)
    parts = F.transform(F.arrays_zip(F.col("made.chunks").alias("c"), F.col("chain").alias("i")), lambda z: F.concat(F.when(z["c"] == "", "∅").otherwise(z["c"]), F.lit("+"), z["i"], F.when(F.col("book")[z["i"]]["feats"] != "", F.concat(F.lit("["), F.col("book")[z["i"]]["feats"], F.lit("]"))).otherwise("")))
    split = F.array_join(F.filter(F.concat(F.array("stem"), F.col("made.chunks")), lambda c: c != ""), "-")
    return out.select(*cases.columns, F.col("made.surface").alias("surface"), F.col("made.chunks").alias("chunks"), split.alias("split"), F.array_join(F.concat(F.array("stem"), parts), "-").alias("tagged"), warning.alias("warning"))
