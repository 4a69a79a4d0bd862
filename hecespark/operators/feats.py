"""Features and renderings of analyses: as Column expressions over the columns of parse.analyses(), and for the analyses that kernels hold."""

from __future__ import annotations

from collections.abc import Collection, Iterable, Mapping
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hecespark.sources import dims

MAP = "map<string,string>"


def suffix_feats(g: dims.Grammar | None = None) -> Column:
    """suffix id -> its public features, as a literal map of fixed size."""
    entries = [x for s in (g or dims.grammar()).suffixes.values() if s.feats for x in (F.lit(s.id), F.create_map(*(F.lit(y) for kv in s.feats for y in kv)))]
    return F.create_map(*entries)


def merged(base: Column, over: Column) -> Column:
    """The entries of both maps; over's where both have one."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)


def emitted_feats(ids="ids", g: dims.Grammar | None = None) -> Column:
    """All suffixes' features, later ones over earlier ones."""
    book, empty = suffix_feats(g), F.create_map().cast(MAP)
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.aggregate(ids, empty, lambda acc, i: merged(acc, F.coalesce(F.try_element_at(book, i), empty)))


def _defaults(**kv: str) -> Column:
    return F.create_map(*(F.lit(x) for pair in kv.items() for x in pair))


def with_ud(analyses: DataFrame, g: dims.Grammar | None = None) -> DataFrame:
    """analyses with feats (emitted) and ud (treebank features: defaults of class and participle filled in)."""
    has = lambda x: F.array_contains("ids", x)
    given = analyses.withColumn("feats", emitted_feats(g=g))
    ud = F.map_filter(F.col("feats"), lambda k, v: ~((k == "Evident") & (v == "Fh")))
    empty = F.create_map().cast(MAP)
    ud = merged(ud, F.when(has("EVID") & has("PAST_COP"), _defaults(Tense="Pqp")).otherwise(empty))
    ud = merged(ud, F.when(has("CAUS") & has("PASS"), _defaults(Voice="CauPass")).otherwise(empty))
    given = given.withColumn("ud", ud)
    form = F.coalesce(F.try_element_at(F.col("ud"), F.lit("VerbForm")), F.lit(""))
    participial = form.isin("Part", "Vnoun", "Conv", "Inf")
    nominal = F.map_contains_key("ud", F.lit("Case")) | F.map_contains_key("ud", F.lit("Number")) | F.map_contains_key("ud", F.lit("Person"))
    verbal = _defaults(Mood="Ind", Polarity="Pos", Aspect="Perf", Tense="Pres")
    noun = _defaults(Case="Nom", Number="Sing", Person="3")
    more = (
        F.when(participial, F.map_concat(verbal, F.when(form == "Vnoun", _defaults(Case="Nom")).otherwise(empty)))
        .when(F.col("final_class") == "VERB", F.map_concat(verbal, _defaults(Person="3", Number="Sing")))
        .when((F.col("final_class") == "NOUN") | ((F.col("final_class") == "ADJ") & nominal), noun)
        .otherwise(empty)
    )
    return given.withColumn("ud", merged(more, F.col("ud")))


def pairs(feats) -> Column:
    """A map as k=v|k=v, by key."""
    f = F.col(feats) if isinstance(feats, str) else feats
    return F.array_join(F.transform(F.array_sort(F.map_entries(f)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")


def split() -> Column:
    return F.array_join(F.filter(F.concat(F.array("root_chunk"), F.col("chunks")), lambda c: c != ""), "-")


def tagged(g: dims.Grammar | None = None) -> Column:
    """chunk+CLASS, [UNK] for an unknown root, then chunk+ID[features] of each suffix; ∅ for an empty chunk."""
    texts = {s.id: ",".join(f"{k}={v}" for k, v in s.feats) for s in (g or dims.grammar()).suffixes.values() if s.feats}
    book = F.create_map(*(F.lit(x) for k, v in texts.items() for x in (k, f"[{v}]")))
    part = lambda z: F.concat(F.when(z["c"] == "", "∅").otherwise(z["c"]), F.lit("+"), z["i"], F.coalesce(F.try_element_at(book, z["i"]), F.lit("")))
    root = F.concat(F.when(F.col("root_chunk") == "", "∅").otherwise(F.col("root_chunk")), F.lit("+"), "root_class", F.when(F.col("oov"), "[UNK]").otherwise(""))
    return F.array_join(F.concat(F.array(root), F.transform(F.arrays_zip(F.col("chunks").alias("c"), F.col("ids").alias("i")), part)), "-")


def chain() -> Column:
    return F.array_join(F.concat(F.array("root"), F.when(F.size("ids") == 0, F.array(F.lit("BARE"))).otherwise(F.col("ids"))), "+")


def emitted(ids: Iterable[str], book: Mapping[str, tuple]) -> dict[str, str]:
    """emitted_feats() for a list; book: suffix id -> its features."""
    out: dict[str, str] = {}
    for i in ids:
        out.update(book.get(i, ()))
    return out


def ud_of(ids: Collection[str], final_class: str, feats: Mapping[str, str]) -> dict[str, str]:
    """The ud of with_ud() for one analysis of emitted feats."""
    ud = {k: v for k, v in feats.items() if (k, v) != ("Evident", "Fh")}
    if "EVID" in ids and "PAST_COP" in ids:
        ud["Tense"] = "Pqp"
    if "CAUS" in ids and "PASS" in ids:
        ud["Voice"] = "CauPass"
    verbal = {"Mood": "Ind", "Polarity": "Pos", "Aspect": "Perf", "Tense": "Pres"}
    form = ud.get("VerbForm")
    if form in ("Part", "Vnoun", "Conv", "Inf"):
        return verbal | ({"Case": "Nom"} if form == "Vnoun" else {}) | ud
    if final_class == "VERB":
        return verbal | {"Person": "3", "Number": "Sing"} | ud
    if final_class == "NOUN" or (final_class == "ADJ" and not ud.keys().isdisjoint(("Case", "Number", "Person"))):
        return {"Case": "Nom", "Number": "Sing", "Person": "3"} | ud
    return ud


def text_of(feats: Mapping[str, str]) -> str:
    """pairs() for a dict."""
    return "|".join(f"{k}={v}" for k, v in sorted(feats.items()))


def split_of(a) -> str:
    """split() for a chart.Analysis."""
    return "-".join(c for c in (a.root_chunk, *a.chunks) if c)


def chain_of(a) -> str:
    """chain() for a chart.Analysis."""
    return "+".join((a.root, *(a.ids or ("BARE",))))


def tagged_of(a, book: Mapping[str, tuple]) -> str:
    """tagged() for a chart.Analysis."""
    root = f"{a.root_chunk or '∅'}+{a.root_class}{'[UNK]' if a.oov else ''}"
    part = lambda c, i: f"{c or '∅'}+{i}" + (f"[{','.join(f'{k}={v}' for k, v in book[i])}]" if book.get(i) else "")
    return "-".join([root, *map(part, a.chunks, a.ids)])


#: What a client gets of an analysis: wire() as a struct.
WIRE = "struct<root:string,root_class:string,final_class:string,oov:boolean,score:double,split:string,tagged:string,morphemes:array<struct<id:string,chunk:string>>,feats:string,ud_feats:string>"


def wire_of(a, book: Mapping[str, tuple]) -> dict:
    """wire() for a chart.Analysis."""
    feats = emitted(a.ids, book)
    score = float(Decimal(repr(a.score)).quantize(Decimal("0.001"), ROUND_HALF_UP))
    return {
        "root": a.root, "root_class": a.root_class, "final_class": a.final_class, "oov": a.oov, "score": score, "split": split_of(a), "tagged": tagged_of(a, book),
        "morphemes": [{"id": i, "chunk": c} for i, c in zip(a.ids, a.chunks)], "feats": text_of(feats), "ud_feats": text_of(ud_of(a.ids, a.final_class, feats)),
    }


def wire(analyses: DataFrame, g: dims.Grammar | None = None) -> DataFrame:
    """(word, rank, analysis): the analysis as a struct of what a client gets."""
    a = with_ud(analyses, g)
    parts = F.transform(F.arrays_zip(F.col("ids").alias("id"), F.col("chunks").alias("chunk")), lambda z: F.struct(z["id"].alias("id"), z["chunk"].alias("chunk")))
    made = F.struct("root", F.col("root_class"), "final_class", "oov", F.round("score", 3).alias("score"), split().alias("split"), tagged(g).alias("tagged"), parts.alias("morphemes"), pairs("feats").alias("feats"), pairs("ud").alias("ud_feats"))
    return a.select("word", "rank", made.alias("analysis"))


def alternatives(every: DataFrame, k: int = 5) -> DataFrame:
    """(word, n, chain): of all analyses (return_all) up to k others than the first: known roots only, none of the first's (root, class, suffixes)."""
    from pyspark.sql import Window

    sign = F.concat_ws("+", "root", "root_class", F.array_join("ids", "+"))
    order = Window.partitionBy("word").orderBy("rank")
    rest = every.withColumn("sign", sign).withColumn("top", F.first("sign").over(order)).where("rank > 1 and not oov and sign <> top")
    return rest.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("word", "n", chain().alias("chain"))


def alternatives_of(every: list, k: int = 5) -> list[str]:
    """alternatives() for the ranked analyses of one word."""
    sign = lambda a: (a.root, a.root_class, a.ids)
    return [chain_of(a) for a in every[1:] if not a.oov and sign(a) != sign(every[0])][:k]
