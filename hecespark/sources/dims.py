"""The engine's tables: suffixes, states, edges, roots. The packaged ones, or JSON files of the same shape.

They are facts about one language, of fixed size: the driver holds them, checks them, and compiles them into what queries join with.
"""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass, field
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATA = Path(__file__).resolve().parent.parent / "data"
START = {"NOUN": "NOUN_ROOT", "VERB": "VERB_ROOT", "ADJ": "ADJ_ROOT"}
RULES = {
    "drop_initial_H_after_vowel_stem", "delete_stem_final_low_vowel", "insert_n_after_3rd_person_possessive", "aorist_allomorphy", "passive_allomorphy",
    "causative_allomorphy", "caus_deriv_allomorphy", "pass_deriv_allomorphy", "potential_neg_suppletion", "neg_aor_agreement_suppletion",
}
#: Names of further rules, whose views a user registers with generate.forward and realize.expand or realize.inverse.
ADDED_RULES: set[str] = set()
#: A template: small letters, archiphonemes A H D C G, and one character in parentheses as a buffer.
TEMPLATE = r"\A(?:[a-zçğıöşüAHDCG]|\([a-zçğıöşüAHDCG]\))*\z"
SUFFIX_SCHEMA = "id string, category string, template string, class_in string, class_out string, rules array<string>, weight string, a_deletable boolean, feats map<string,string>"
ROOT_SCHEMA = "form string, class string, frequency bigint, soften boolean, variants array<string>, aorist_high boolean, caus_deriv string, pass_deriv string, pronominal_n boolean"


@dataclass(frozen=True)
class Suffix:
    id: str
    category: str
    template: str
    class_in: str | None = None
    class_out: str | None = None
    rules: tuple[str, ...] = ()
    weight: str = ""
    a_deletable: bool = False
    feats: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Edge:
    state: str
    suffix: str
    to: str
    ord: int


@dataclass(frozen=True)
class Root:
    form: str
    cls: str
    frequency: int = 0
    soften: bool = False
    variants: tuple[str, ...] = ()
    aorist_high: bool = False
    caus: str | None = None
    passive: str | None = None
    pronominal_n: bool = False


@dataclass
class Grammar:
    suffixes: dict[str, Suffix]
    accept: dict[str, bool]
    edges: list[Edge]
    start: dict[str, str] = field(default_factory=lambda: dict(START))

    def __post_init__(self):
        for s in self.suffixes.values():
            if not re.match(TEMPLATE.replace(r"\z", r"\Z"), s.template):
                raise ValueError(f"template of {s.id}: {s.template!r}")
            if unknown := set(s.rules) - RULES - ADDED_RULES:
                raise ValueError(f"rules of {s.id}: {sorted(unknown)}")
        seen: dict[tuple[str, str], str] = {}
        for e in self.edges:
            if e.suffix not in self.suffixes or e.state not in self.accept or e.to not in self.accept:
                raise ValueError(f"an edge of what is not there: {e}")
            if seen.setdefault((e.state, e.suffix), e.to) != e.to:
                raise ValueError(f"{e.state} goes to two states by {e.suffix}")

    def step(self, state: str, suffix: str) -> str | None:
        return next((e.to for e in self.edges if (e.state, e.suffix) == (state, suffix)), None)


def _rows(name: str) -> list[dict[str, str]]:
    with (DATA / name).open(encoding="utf-8", newline="") as f:
        return list(csv.DictReader(f, delimiter="\t", quoting=csv.QUOTE_NONE))


def _lines(name: str) -> list[str]:
    return (DATA / name).read_text(encoding="utf-8").split()


def make_suffix(id: str, template: str, category: str = "", class_in=None, class_out=None, rules=(), weight="", a_deletable=False, feats=()) -> Suffix:
    """Feature names that begin with an underscore are internal, and dropped."""
    kept = sorted((k, v) for k, v in (feats.items() if isinstance(feats, dict) else feats) if not k.startswith("_"))
    return Suffix(id, category, template, class_in or None, class_out or None, tuple(rules), weight or "", bool(a_deletable), tuple(kept))


@cache
def grammar() -> Grammar:
    suffixes = [
        make_suffix(r["id"], r["template"], r["category"], r["class_in"], r["class_out"], r["rules"].split("+") if r["rules"] else (), r["weight"], r["a_deletable"], [tuple(x.split("=", 1)) for x in r["feats"].split(";") if x])
        for r in _rows("suffixes.tsv")
    ]
    states = _rows("states.tsv")
    edges = [Edge(r["state"], *x.split(">"), k) for r in states for k, x in enumerate(r["edges"].split())]
    return Grammar({s.id: s for s in suffixes}, {r["state"]: bool(r["accept"]) for r in states}, edges)


@cache
def roots() -> tuple[Root, ...]:
    """The seed lexicon, with the curated irregulars, prunings, derivations and places applied in this order."""
    out: dict[tuple[str, str], Root] = {}
    for r in _rows("roots.tsv"):
        out[r["form"], r["class"]] = Root(r["form"], r["class"], int(r["frequency"] or 0), bool(r["soften"]), tuple(x for x in (r["variants"] or "").split(",") if x))
    for r in _rows("irregulars.tsv"):
        key = r["form"], r["class"]
        old = out.get(key, Root(*key))
        out[key] = Root(*key, int(r["frequency"]) if r["frequency"] else old.frequency, old.soften, tuple(x for x in r["variants"].split(",") if x) or old.variants, bool(r["aorist_high"]), old.caus, old.passive, bool(r["pronominal_n"]))
    for form in _lines("prune.txt"):
        out.pop((form, "VERB"), None)
    for r in _rows("derivations.tsv"):
        if old := out.get((r["form"], "VERB")):
            caus, passive = (r["template"], old.passive) if r["voice"] == "caus" else (old.caus, r["template"])
            out[old.form, "VERB"] = Root(old.form, "VERB", old.frequency, old.soften, old.variants, old.aorist_high, caus, passive, old.pronominal_n)
    known = {form for form, _ in out}
    for form in _lines("places.txt"):
        if form not in known:
            out[form, "NOUN"] = Root(form, "NOUN")
    return tuple(out.values())


def suffix_frame(spark: SparkSession, g: Grammar | None = None) -> DataFrame:
    g = g or grammar()
    return spark.createDataFrame([(s.id, s.category, s.template, s.class_in, s.class_out, list(s.rules), s.weight, s.a_deletable, dict(s.feats)) for s in g.suffixes.values()], SUFFIX_SCHEMA)


def state_frame(spark: SparkSession, g: Grammar | None = None) -> DataFrame:
    return spark.createDataFrame(list((g or grammar()).accept.items()), "state string, accept boolean")


def edge_frame(spark: SparkSession, g: Grammar | None = None) -> DataFrame:
    return spark.createDataFrame([(e.state, e.suffix, e.to, e.ord) for e in (g or grammar()).edges], "from_state string, suffix_id string, to_state string, ord int")


def root_frame(spark: SparkSession, given: tuple[Root, ...] | None = None) -> DataFrame:
    """One row per root, with root_id in lexicon order."""
    rows = [(k, r.form, r.cls, r.frequency, r.soften, list(r.variants), r.aorist_high, r.caus, r.passive, r.pronominal_n) for k, r in enumerate(given if given is not None else roots())]
    return spark.createDataFrame(rows, f"root_id bigint, {ROOT_SCHEMA}")


def root_of(row) -> Root:
    return Root(row["form"], row["class"], row["frequency"] or 0, bool(row["soften"]), tuple(row["variants"] or ()), bool(row["aorist_high"]), row["caus_deriv"], row["pass_deriv"], bool(row["pronominal_n"]))


def form_frame(root_df: DataFrame) -> DataFrame:
    """(key, surf, root_id): the folded spellings by which a root is found: its form, its variants, its softened form."""
    from hecespark.functions import chars

    softened = F.when(F.coalesce("soften", F.lit(False)) & chars.ends_in(chars.HARD, "form"), chars.soften_final("form"))
    spellings = F.array_compact(F.array_distinct(F.concat(F.array("form"), F.coalesce("variants", F.array().cast("array<string>")), F.array(softened))))
    return root_df.select("root_id", F.explode(spellings).alias("surf")).select(chars.fold("surf").alias("key"), "surf", "root_id")


# --- files ---------------------------------------------------------------------------------------------------


def load_inventory(spark: SparkSession, path: str) -> Grammar:
    """Suffixes of a JSON file {suffixes: [{id, template, feats, category, rules, class_in, class_out, a_deletable}]}, without edges. A row with
    _section is a heading. Missing id or template, a second row of an id, a bad template and an unknown rule raise ValueError."""
    schema = "suffixes array<struct<_section:string, id:string, template:string, feats:map<string,string>, category:string, rules:array<string>, class_in:string, class_out:string, a_deletable:boolean>>"
    out: dict[str, Suffix] = {}
    for r in spark.read.schema(schema).json(path, multiLine=True).select(F.inline("suffixes")).collect():
        if r["_section"] is not None and r["id"] is None:
            continue
        if r["id"] is None or r["template"] is None:
            raise ValueError(f"a suffix without id or template: {r}")
        if r["id"] in out:
            raise ValueError(f"{r['id']} is there twice")
        out[r["id"]] = make_suffix(r["id"], r["template"], r["category"] or "", r["class_in"], r["class_out"], r["rules"] or (), "", r["a_deletable"], r["feats"] or {})
    return Grammar(out, {}, [])


def load_graph(spark: SparkSession, path: str, suffixes: dict[str, Suffix]) -> Grammar:
    """States and transitions of a JSON file {start: {class: state}, states: [{id, accept}], transitions: [{via, from: [...], to}]}; every from must be a list with something in it."""
    schema = "start map<string,string>, states array<struct<id:string, accept:boolean>>, transitions array<struct<via:string, from:array<string>, to:string>>"
    r = spark.read.schema(schema).json(path, multiLine=True).first()
    edges, ord_ = [], {}
    for t in r["transitions"] or []:
        if not t["from"] or t["via"] is None or t["to"] is None:
            raise ValueError(f"a transition without via, from or to: {t}")
        for s in t["from"]:
            edges.append(Edge(s, t["via"], t["to"], ord_.setdefault(s, 0)))
            ord_[s] += 1
    return Grammar(suffixes, {s["id"]: bool(s["accept"]) for s in r["states"] or []}, edges, dict(r["start"] or START))


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Roots of a JSON file {entries: [...]}, in the columns of ROOT_SCHEMA with root_id in file order; form and class are required."""
    fields = ", ".join(f"{n}:{t}" for n, t in (x.strip().split(" ", 1) for x in ROOT_SCHEMA.split(", ")))
    rows = spark.read.schema(f"entries array<struct<{fields}>>").json(path, multiLine=True).select(F.posexplode("entries").alias("root_id", "e"))
    need = F.when(F.col("e.form").isNull() | F.col("e.class").isNull(), F.raise_error(F.lit("an entry without form or class")).cast("bigint")).otherwise(F.col("root_id").cast("bigint"))
    return rows.select(need.alias("root_id"), "e.*").fillna({"frequency": 0, "soften": False, "aorist_high": False, "pronominal_n": False})


def load_overrides(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(changes, gone) of a JSON file {additions: [{form, class, ...}], prune: [{form, class}]}: entries with form and class; headings (_section) and comments are passed over.
    changes have the columns of ROOT_SCHEMA, null where the file says nothing."""
    fields = ", ".join(f"{n}:{t}" for n, t in (x.strip().split(" ", 1) for x in ROOT_SCHEMA.split(", ")))
    entry = f"array<struct<_section:string, {fields}>>"
    rows = spark.read.schema(f"additions {entry}, prune {entry}").json(path, multiLine=True)
    listed = lambda name: rows.select(F.explode(name).alias("e")).where("e._section is null and e.form is not null and e.class is not null").select("e.*").drop("_section")
    return listed("additions"), listed("prune").select("form", "class")


def load_headwords(spark: SparkSession, path: str) -> DataFrame:
    """(word, meanings) of a dictionary: a JSON array of {word, meanings}, or one such object a line. Entries without a word are passed over; lexicon.headwords() takes the rest."""
    rows = spark.read.schema("word string, meanings array<string>").json(path, multiLine=True)
    return rows.where("word is not null and word <> ''")


def save_lexicon(root_df: DataFrame, path: str) -> None:
    """Entries as JSON lines, a directory of them."""
    root_df.drop("root_id").write.mode("overwrite").json(path)
