"""Queries over the reference operators, each over its whole tables, and the SQL that gives the same rows.

Where SQL can't say what an operator does (analyses of arbitrary words), the query either has golden words as literals, with the expected rows as
its SQL, or none, and tests hold it against a brute-force version.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hecespark.functions import chars
from hecespark.operators import api, clitic, correct, evaluate, feats, fertility, fuzzy, generate, graph, normalize, parse, text
from hecespark.plans.sql import CHUNK, KIND, TOKENS, WORD, applied, quoted, values
from hecespark.runtime import cut, scratch, table
from hecespark.sources import dims, lexicon
from hecespark.streaming import lines

WEIGHTS = parse.Weights()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | Callable[[], str] | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql if isinstance(sql, str) else sql()
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def distinct_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.distinct_tokens(documents(spark, sf_dir))


# --- text ---


@query(f"SELECT token, count(*) AS n FROM ({TOKENS}) GROUP BY token ORDER BY n DESC, token LIMIT 100")
def top_tokens(spark, sf_dir):
    return text.top_tokens(documents(spark, sf_dir))


@query(f"""
WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, {quoted(CHUNK)})) AS chunk FROM documents),
k AS (SELECT doc_id, {KIND} AS kind, chunk FROM c)
SELECT doc_id, kind, count(*) AS n, sum(length(chunk))::BIGINT AS n_chars FROM k GROUP BY doc_id, kind""")
def split_text_kinds(spark, sf_dir):
    return text.split_text(documents(spark, sf_dir)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("chunk")).alias("n_chars"))


@query("SELECT doc_id, text FROM documents WHERE text <> ''")
def rebuild_text(spark, sf_dir):
    return text.rebuild_text(text.split_text(documents(spark, sf_dir)))


def _translated(source: str, target: str) -> str:
    return f"translate(text, {quoted(source)}, {quoted(target)})"


@query(f"""SELECT doc_id, {_translated(chars.CAPITAL, chars.SMALL)} AS lower, {_translated(chars.SMALL, chars.CAPITAL)} AS upper,
{_translated(chars.CIRCUMFLEX, chars.PLAIN)} AS folded, lower(translate(text, 'İI', 'iı')) AS etl FROM documents""")
def case_and_diacritics(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", chars.tr_lower(t).alias("lower"), chars.tr_upper(t).alias("upper"), chars.fold(t).alias("folded"), chars.etl_lower(t).alias("etl"))


_CLASSES = {"vowel": chars.VOWELS, "consonant": chars.CONSONANTS, "back": chars.BACK, "front": chars.FRONT, "rounded": chars.ROUNDED, "high": chars.HIGH, "voiceless": chars.VOICELESS}


@query(f"""SELECT c, count(*) AS n, {', '.join(f"contains({quoted(s)}, c) AS {k}" for k, s in _CLASSES.items())}
FROM (SELECT unnest(string_split(lower(text), '')) AS c FROM documents) WHERE c <> '' GROUP BY c""")
def char_classes(spark, sf_dir):
    c = documents(spark, sf_dir).select(F.explode(F.split(F.lower("text"), "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
    return c.select("c", "n", *(chars.one_of(s, "c").alias(k) for k, s in _CLASSES.items()))


_LAST = f"nullif(regexp_extract(token, '(?s).*([{chars.VOWELS}])', 1), '')"
_H = f"CASE WHEN v IN ('a','ı') THEN 'ı' WHEN v IN ('o','u') THEN 'u' WHEN v IN ('ö','ü') THEN 'ü' ELSE 'i' END"


def _end(source: str, target: str) -> str:
    return f"left(token, greatest(length(token) - 1, 0)) || translate(right(token, 1), '{source}', '{target}')"


@query(f"""
WITH t AS (SELECT DISTINCT token FROM ({TOKENS})), w AS (SELECT token, {_LAST} AS v, right(token, 1) AS l FROM t)
SELECT token, v AS last_vowel, l AS last_letter, length(regexp_replace(token, '[^{chars.VOWELS}]', '', 'g'))::INTEGER AS syllables,
length(regexp_replace(token, '[^{chars.VOWELS}]', '', 'g')) = 1 AS monosyllabic, contains('{chars.VOWELS}', l) AS ends_in_vowel,
CASE WHEN v IN ('a','ı','o','u') THEN 'a' ELSE 'e' END AS a, {_H} AS h, CASE WHEN contains('{chars.VOICELESS}', l) THEN 't' ELSE 'd' END AS d,
CASE WHEN contains('{chars.VOICELESS}', l) THEN 'ç' ELSE 'c' END AS c, CASE WHEN contains('{chars.VOICELESS}', l) THEN 'k' ELSE 'g' END AS g,
{_end(chars.HARD, chars.SOFT)} AS softened, {_end(chars.SOFT, chars.HARD)} AS hardened FROM w""")
def word_phonology(spark, sf_dir):
    t = "token"
    return distinct_tokens(spark, sf_dir).select(
        t, chars.last_vowel(t).alias("last_vowel"), chars.last_letter(t).alias("last_letter"), chars.syllables(t).alias("syllables"), chars.monosyllabic(t).alias("monosyllabic"), chars.ends_in_vowel(t).alias("ends_in_vowel"),
        chars.resolve_a(t).alias("a"), chars.resolve_h(t).alias("h"), chars.resolve_d(t).alias("d"), chars.resolve_c(t).alias("c"), chars.resolve_g(t).alias("g"), chars.soften_final(t).alias("softened"), chars.harden_final(t).alias("hardened"),
    )


TEMPLATES = ("lAr", "DA", "DAn", "(y)A", "(y)H", "(s)H", "(n)Hn", "Hm", "DHm", "(y)AcAk", "CH", "GHn")


@query(lambda: applied(f"SELECT DISTINCT token AS stem FROM ({TOKENS})", TEMPLATES))
def apply_suffix_fixed(spark, sf_dir):
    t = distinct_tokens(spark, sf_dir).select(F.col("token").alias("stem"))
    each = t.select("stem", F.explode(F.array(*(F.struct(F.lit(x).alias("template"), chars.apply_suffix("stem", F.lit(x)).alias("surface")) for x in TEMPLATES))).alias("x"))
    return each.select("stem", "x.template", "x.surface")


FLAGS = ("1", "true", "YES", " on ", "t", "0", "False", "no", "off", "f", "", "maybe", None)


@query(lambda: f"SELECT v, CASE WHEN lower(trim(v)) IN ('1','true','yes','on','t') THEN true WHEN lower(trim(v)) IN ('0','false','no','off','f','') THEN false END AS flag FROM ({values([(f,) for f in FLAGS], 'v')})")
def to_bool(spark, sf_dir):
    return spark.createDataFrame([(f,) for f in FLAGS], "v string").select("v", chars.to_bool("v").alias("flag"))


# --- tables of the engine ---


def _suffixes(columns: str) -> str:
    g = dims.grammar()
    return values([(s.id, s.category, s.template, s.class_out, s.weight) for s in g.suffixes.values()], "id, category, template, class_out, weight")


def _edges() -> str:
    return values([(e.state, e.suffix, e.to) for e in dims.grammar().edges], "from_state, suffix_id, to_state")


def _roots() -> str:
    return values([(k, r.form, r.cls, r.frequency) for k, r in enumerate(dims.roots())], "root_id, form, class, frequency")


def _templates() -> tuple[str, ...]:
    return tuple(sorted({s.template for s in dims.grammar().suffixes.values() if s.template}))


@query(lambda: applied(f"SELECT DISTINCT form AS stem FROM ({_roots()})", _templates()))
def apply_suffix_all(spark, sf_dir):
    """Every template of the inventory on every root."""
    stems = dims.root_frame(spark).select(F.col("form").alias("stem")).distinct()
    each = stems.withColumn("template", F.explode(F.array(*map(F.lit, _templates()))))
    return each.select("stem", "template", chars.apply_suffix("stem", F.col("template")).alias("surface"))


def _forms() -> str:
    rows = []
    for k, r in enumerate(dims.roots()):
        soft = [r.form[:-1] + dict(zip(chars.HARD, chars.SOFT))[r.form[-1]]] if r.soften and r.form[-1] in chars.HARD else []
        rows += [(k, s) for s in dict.fromkeys([r.form, *r.variants, *soft])]
    return f"SELECT root_id, translate(surf, '{chars.CIRCUMFLEX}', '{chars.PLAIN}') AS key, surf FROM ({values(rows, 'root_id, surf')})"


@query(lambda: f"SELECT category, count(*) AS n, count(class_out) AS deriving, min(template) AS first_template FROM ({_suffixes('')}) GROUP BY category")
def inventory_by_category(spark, sf_dir):
    return dims.suffix_frame(spark).groupBy("category").agg(F.count("*").alias("n"), F.count("class_out").alias("deriving"), F.min("template").alias("first_template"))


@query(lambda: f"SELECT from_state, to_state, count(*) AS n FROM ({_edges()}) GROUP BY from_state, to_state")
def graph_edges_by_state(spark, sf_dir):
    return dims.edge_frame(spark).groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


@query(lambda: f"""
WITH RECURSIVE e AS (SELECT DISTINCT from_state, to_state FROM ({_edges()})),
r(start, state) AS (SELECT x, x FROM (VALUES ('NOUN_ROOT'), ('VERB_ROOT'), ('ADJ_ROOT')) AS s(x) UNION SELECT r.start, e.to_state FROM r JOIN e ON e.from_state = r.state)
SELECT start, state FROM r""")
def graph_reachability(spark, sf_dir):
    return graph.reachable(dims.edge_frame(spark), list(dims.START.values()))


#: Edges of a suffix, and to and from states, that aren't there.
LOST = (("NOUN_ROOT", "NO_SUCH_SUFFIX", "NOUN_NUM"), ("NOUN_ROOT", "PLUR", "NO_SUCH_STATE"), ("NO_SUCH_STATE", "PLUR", "NOUN_NUM"))


@query(lambda: f"""
WITH e AS ({_edges()} UNION ALL {values(list(LOST), 'from_state, suffix_id, to_state')}), s AS ({values([(x,) for x in dims.grammar().accept], 'state')})
SELECT DISTINCT suffix_id, from_state, to_state FROM e
WHERE suffix_id NOT IN (SELECT id FROM ({_suffixes('')})) OR from_state NOT IN (SELECT state FROM s) OR to_state NOT IN (SELECT state FROM s)""")
def dangling_refs(spark, sf_dir):
    """The packaged graph's edges with three more that lead nowhere: those alone are found."""
    more = spark.createDataFrame([(*e, 0) for e in LOST], "from_state string, suffix_id string, to_state string, ord int")
    return graph.dangling(dims.edge_frame(spark).unionByName(more), dims.suffix_frame(spark), dims.state_frame(spark)).select("suffix_id", "from_state", "to_state")


@query(lambda: f"SELECT id, regexp_full_match(template, '(?:[a-zçğıöşüAHDCG]|\\([a-zçğıöşüAHDCG]\\))*') AS valid FROM ({_suffixes('')})")
def template_valid(spark, sf_dir):
    return dims.suffix_frame(spark).select("id", F.col("template").rlike(dims.TEMPLATE).alias("valid"))


# --- joins with the lexicon ---


@query(lambda: f"""
WITH t AS (SELECT DISTINCT token FROM ({TOKENS})), f AS ({_forms()})
SELECT token, root_id, surf, length(key)::INTEGER AS size FROM t JOIN f ON starts_with(token, key)""")
def lexicon_prefix_match(spark, sf_dir):
    return graph.prefix_match(distinct_tokens(spark, sf_dir), "token", dims.form_frame(dims.root_frame(spark)))


@query(lambda: f"""
WITH t AS (SELECT DISTINCT token FROM ({TOKENS})), f AS (SELECT f.*, r.class FROM ({_forms()}) f JOIN ({_roots()}) r USING (root_id)),
c AS (SELECT token, unnest(generate_series(2, least(12, length(token)) - 1)) AS pos FROM t WHERE length(token) > 2),
s AS (SELECT token, pos, left(token, pos) || x AS key FROM c, (VALUES ('a'), ('e')) AS v(x))
SELECT s.token, s.pos::INTEGER AS pos, f.root_id FROM s JOIN f ON f.key = s.key WHERE f.class = 'VERB'""")
def prog_truncation_seed(spark, sf_dir):
    roots = dims.root_frame(spark)
    forms = dims.form_frame(roots).join(roots.where("class = 'VERB'").select("root_id"), "root_id")
    t = distinct_tokens(spark, sf_dir).where(F.length("token") > 2)
    cut = t.select("token", F.explode(F.sequence(F.lit(2), F.least(F.lit(12), F.length("token")) - 1)).alias("pos"))
    keys = cut.select("token", "pos", F.explode(F.array(*(F.concat(F.substring(F.col("token"), F.lit(1), F.col("pos")), F.lit(x)) for x in "ae"))).alias("key"))
    return keys.join(F.broadcast(forms.select("key", "root_id")), "key").select("token", "pos", "root_id")  # a lexicon of fixed size


@query(f"""
WITH t AS (SELECT DISTINCT token FROM ({TOKENS})), c AS (SELECT token, unnest(generate_series(1, least(12, length(token)))) AS pos FROM t)
SELECT pos::INTEGER AS pos, class, count(*) AS n, round(-50 + 0.35 * pos, 6)::DOUBLE AS score FROM c, (VALUES ('NOUN'), ('VERB'), ('ADJ')) AS v(class) GROUP BY pos, class""")
def oov_seed(spark, sf_dir):
    c = distinct_tokens(spark, sf_dir).select(F.explode(F.sequence(F.lit(1), F.least(F.lit(12), F.length("token")))).alias("pos"))
    c = c.groupBy("pos").agg(F.count("*").alias("n")).withColumn("class", F.explode(F.array(*map(F.lit, dims.START))))
    return c.select("pos", "class", "n", F.round(F.lit(WEIGHTS.oov) + F.lit(WEIGHTS.oov_letter) * F.col("pos"), 6).alias("score"))


@query(lambda: f"SELECT form, class, round(ln(1 + greatest(frequency, 0)), 9) AS score FROM ({_roots()})")
def frequency_score(spark, sf_dir):
    return dims.root_frame(spark).select("form", "class", F.round(F.log1p(F.greatest("frequency", F.lit(0)).cast("double")), 9).alias("score"))


def _vocabulary_sql() -> str:
    return f"SELECT translate(form, '{chars.CIRCUMFLEX}', '{chars.PLAIN}') AS term, max(frequency) AS freq FROM ({_roots()}) GROUP BY 1"


def _vocabulary(spark) -> DataFrame:
    return fuzzy.index(dims.root_frame(spark).select(chars.fold("form").alias("term"), F.col("frequency").alias("freq")))


def _ascii(c: str) -> str:
    """In the other engine distances count bytes: letters of two bytes become signs that no word has."""
    return f"translate({c}, 'çğıöşüÇĞİÖŞÜâîûêôÂÎÛÊÔ’', '!#$%&()*+,-./:;<=>?@[]^')"


@query(lambda: f"""
WITH t AS (SELECT DISTINCT token FROM ({TOKENS})), v AS ({_vocabulary_sql()})
SELECT token AS word, term, freq, levenshtein({_ascii("token")}, {_ascii("term")})::INTEGER AS distance
FROM t JOIN v ON abs(length(token) - length(term)) <= 2 WHERE levenshtein({_ascii("token")}, {_ascii("term")}) <= 2""")
def fuzzy_candidates(spark, sf_dir):
    return fuzzy.candidates(distinct_tokens(spark, sf_dir).withColumnRenamed("token", "word"), _vocabulary(spark), 2)


@query()
def fuzzy_topk(spark, sf_dir):
    return fuzzy.nearest(distinct_tokens(spark, sf_dir).withColumnRenamed("token", "word"), _vocabulary(spark), 2, 5)


_LETTERS = ", ".join(f"('{c}')" for c in fuzzy.ALPHABET)


@query(lambda: f"""
WITH w AS (SELECT DISTINCT form AS w FROM ({_roots()})), l(c) AS (VALUES {_LETTERS}),
i AS (SELECT w, unnest(generate_series(0, length(w))) AS i FROM w),
e AS (
SELECT w, left(w, i) || substr(w, i + 2) AS x FROM i WHERE i < length(w)
UNION SELECT w, left(w, i) || substr(w, i + 2, 1) || substr(w, i + 1, 1) || substr(w, i + 3) FROM i WHERE i < length(w) - 1
UNION SELECT w, left(w, i) || c || substr(w, i + 2) FROM i, l WHERE i < length(w)
UNION SELECT w, left(w, i) || c || substr(w, i + 1) FROM i, l)
SELECT w AS word, x AS edit FROM e WHERE x <> w""")
def edits1(spark, sf_dir):
    w = dims.root_frame(spark).select(F.col("form").alias("word")).distinct()
    return w.select("word", F.explode(fuzzy.edits1("word")).alias("edit"))


@query()
def typos(spark, sf_dir):
    return fuzzy.typos(parse.spread(distinct_tokens(spark, sf_dir).withColumnRenamed("token", "word"), "word"), 1)


@query()
def suggest_roots(spark, sf_dir):
    return correct.suggest(text.tokens(table(spark, sf_dir, "benchmark")).select(F.col("token").alias("word")))


# --- building lexicons ---

#: Treebank rows made of all documents' words: the lemma is the word without its ending, the class by its length.
_TREEBANK = f"""SELECT word AS form, CASE WHEN length(word) > 5 THEN left(word, length(word) - 2) ELSE word END AS lemma,
CASE length(word) % 4 WHEN 0 THEN 'NOUN' WHEN 1 THEN 'VERB' WHEN 2 THEN 'PROPN' ELSE 'ADV' END AS upos
FROM (SELECT unnest(regexp_extract_all(text, '[{WORD}]+')) AS word FROM documents)"""


def treebank(counts: DataFrame) -> DataFrame:
    """Rows of text.word_counts(), n: how often each is there."""
    w = counts.withColumnRenamed("word", "form")
    n = F.length("form")
    return w.select("n", "form", F.when(n > 5, F.left("form", n - 2)).otherwise(F.col("form")).alias("lemma"), F.when(n % 4 == 0, "NOUN").when(n % 4 == 1, "VERB").when(n % 4 == 2, "PROPN").otherwise("ADV").alias("upos"))


_SOFT = f"length(word) > length(lemma) AND contains('{chars.HARD}', right(lemma, 1)) AND left(word, length(lemma)) = left(lemma, length(lemma) - 1) || translate(right(lemma, 1), '{chars.HARD}', '{chars.SOFT}')"
_ZERO = f"""CASE WHEN length(lemma) >= 4 AND contains('{chars.HIGH}', substr(lemma, length(lemma) - 1, 1)) AND NOT contains('{chars.VOWELS}', right(lemma, 1))
AND starts_with(word, left(lemma, length(lemma) - 2) || right(lemma, 1)) AND length(word) > length(lemma) - 1 AND NOT starts_with(word, lemma)
AND contains('{chars.VOWELS}y', substr(word, length(lemma), 1)) THEN left(lemma, length(lemma) - 2) || right(lemma, 1) END"""
_EXTRACT = f"""
SELECT lemma AS form, class, count(*) AS frequency, bool_or({_SOFT}) AS soften,
coalesce(array_to_string(list_sort(list_distinct(array_agg({_ZERO}))), ','), '') AS variants
FROM (SELECT lower(lemma) AS lemma, lower(form) AS word, CASE upos WHEN 'PROPN' THEN 'NOUN' ELSE upos END AS class FROM ({_TREEBANK}) WHERE upos <> 'ADV' AND regexp_matches(lemma, '\\p{{L}}'))
WHERE length(lemma) > 1 GROUP BY lemma, class"""


@query(_EXTRACT)
def lexicon_extract(spark, sf_dir):
    return lexicon.extract(treebank(text.word_counts(documents(spark, sf_dir))), "n").withColumn("variants", F.array_join("variants", ","))


_HEADS = f"""
SELECT DISTINCT CASE WHEN verb THEN left(word, length(word) - 3) ELSE word END AS form, CASE WHEN verb THEN 'VERB' ELSE 'NOUN' END AS class
FROM (SELECT word, regexp_matches(word, 'm[ae]k$') AS verb FROM (SELECT DISTINCT lower(translate(word, 'İI', 'iı')) AS word FROM (SELECT unnest(regexp_extract_all(text, '[{WORD}]+')) AS word FROM documents))
WHERE regexp_full_match(word, '[a-zçğıöşüâîû]{{2,20}}')) WHERE NOT (verb AND length(word) <= 3)"""


@query(f"""
WITH w AS (SELECT DISTINCT lower(translate(word, 'İI', 'iı')) AS word FROM (SELECT unnest(regexp_extract_all(text, '[{WORD}]+')) AS word FROM documents)
WHERE regexp_full_match(lower(translate(word, 'İI', 'iı')), '[a-zçğıöşüâîû]{{2,20}}')), h AS ({_HEADS})
SELECT form, class, class = 'NOUN' AND contains('{chars.HARD}', right(form, 1)) AND left(form, length(form) - 1) || translate(right(form, 1), '{chars.HARD}', '{chars.SOFT}') IN (SELECT word FROM w) AS soften FROM h""")
def lexicon_headwords(spark, sf_dir):
    return lexicon.headwords(documents(spark, sf_dir).select(F.explode(text.words_of("text")).alias("word")))


@query(lambda: f"""
WITH r AS (SELECT form, class, max(frequency) AS frequency FROM ({_roots()}) WHERE length(form) <> 3 GROUP BY form, class)
SELECT form, class, CASE WHEN length(form) % 2 = 0 THEN 7000 + length(form) ELSE frequency END AS frequency FROM r UNION ALL SELECT 'zonk', 'NOUN', NULL""")
def lexicon_overrides(spark, sf_dir):
    """Roots of three letters pruned; of an even number of letters, given another frequency; and a new one without any."""
    roots = dims.root_frame(spark).groupBy("form", "class").agg(F.max("frequency").alias("frequency"))
    n = F.length("form")
    kept = lexicon.pruned(roots, roots.where(n == 3).select("form", "class"))
    changes = kept.where(n % 2 == 0).select("form", "class", (7000 + n).cast("bigint").alias("frequency"))
    return lexicon.overridden(kept, changes.unionByName(spark.createDataFrame([("zonk", "NOUN", None)], changes.schema)))


@query(f"""
WITH u AS (SELECT form, class, frequency FROM ({_EXTRACT})), h AS ({_HEADS})
SELECT form, class, frequency FROM u UNION ALL SELECT form, class, 0 FROM h WHERE form NOT IN (SELECT form FROM u)""")
def lexicon_merge(spark, sf_dir):
    words = cut(text.word_counts(documents(spark, sf_dir)))
    return lexicon.merged(lexicon.extract(treebank(words), "n"), lexicon.headwords(words)).select("form", "class", "frequency")


@query(lambda: f"""
WITH r AS (SELECT form, class, frequency FROM ({_roots()}))
SELECT form, class, frequency FROM r UNION ALL SELECT token, 'NOUN', n FROM (SELECT token, count(*) AS n FROM ({TOKENS}) GROUP BY token) WHERE token NOT IN (SELECT form FROM r)""")
def lexicon_additions(spark, sf_dir):
    found = text.tokens(documents(spark, sf_dir)).groupBy("token").agg(F.count("*").alias("frequency")).select(F.col("token").alias("form"), F.lit("NOUN").alias("class"), "frequency")
    return lexicon.with_additions(dims.root_frame(spark).select("form", "class", "frequency"), found)


@query(lambda: f"SELECT class, count(*) AS n, count(*) FILTER (WHERE soften) AS softening FROM ({_EXTRACT}) GROUP BY class")
def lexicon_summary(spark, sf_dir):
    return lexicon.summary(lexicon.extract(treebank(text.word_counts(documents(spark, sf_dir))), "n"))


# --- morphology ---


def goldens() -> list[tuple[str, str]]:
    with (dims.DATA / "goldens.tsv").open(encoding="utf-8") as f:
        return [(r["word"], r["chain"]) for r in csv.DictReader(f, delimiter="\t")]


CHAINS = (
    ("gel", "PROG 1SG_Z", "VERB", False, "geliyorum"), ("gel", "FUT 1SG_Z", "VERB", True, "geleceğim"), ("gel", "NEG AOR 1SG_Z", "VERB", False, "gelmem"), ("yap", "NEG AOR 1PL_Z", "VERB", False, "yapmayız"),
    ("gel", "POT NEG PAST", "VERB", False, "gelemedi"), ("oku", "PASS", "VERB", False, "okun"), ("otur", "CAUS", "VERB", False, "oturt"), ("tuz", "VBZ_LA PROG", "NOUN", False, "tuzluyor"),
    ("ev", "POSS_3SG LOC", "NOUN", True, "evinde"), ("kitap", "POSS_1SG", "NOUN", True, "kitabım"), ("araba", "PLUR POSS_1PL", "NOUN", True, "arabalarımız"), ("görüş", "OPT OPT_1PL", "VERB", False, "görüşelim"),
)


@query(lambda: values([(s, c.replace(" ", "+"), x) for s, c, _, _, x in CHAINS], "stem, chain, surface"))
def generate_chains(spark, sf_dir):
    cases = spark.createDataFrame([(s, c.split(), w, f) for s, c, w, f, _ in CHAINS], "stem string, chain array<string>, word_class string, soften boolean")
    return generate.generate(cases).select("stem", F.array_join("chain", "+").alias("chain"), "surface")


def golden_words(spark) -> DataFrame:
    return spark.createDataFrame([(w,) for w, _ in goldens()], "word string")


@query(lambda: values(goldens(), "word, chain"))
def parse_top(spark, sf_dir):
    return parse.best(golden_words(spark)).select("word", feats.chain().alias("chain"))


@query()
def parse_all_ranked(spark, sf_dir):
    a = parse.analyses(golden_words(spark), return_all=True)
    return a.select("word", "rank", "oov", F.round("score", 6).alias("score"), feats.chain().alias("chain"), feats.split().alias("split"), feats.tagged().alias("tagged"))


@query()
def parse_tokens(spark, sf_dir):
    """The first analysis of every distinct word of all documents."""
    a = parse.best(distinct_tokens(spark, sf_dir).withColumnRenamed("token", "word"))
    return a.select("word", "root", "root_class", "final_class", "oov", F.round("score", 6).alias("score"), feats.chain().alias("chain"))


UD = (
    ("yazmak", "Aspect=Perf|Case=Nom|Mood=Ind|Polarity=Pos|Tense=Pres|VerbForm=Vnoun"),
    ("geldi", "Aspect=Perf|Mood=Ind|Number=Sing|Person=3|Polarity=Pos|Tense=Past"),
    ("yaptırıldı", "Aspect=Perf|Mood=Ind|Number=Sing|Person=3|Polarity=Pos|Tense=Past|Voice=CauPass"),
    ("evde", "Case=Loc|Number=Sing|Person=3"),
)


@query(lambda: values(list(UD), "word, ud"))
def ud_features(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w, _ in UD], "word string")
    return feats.with_ud(parse.best(words)).select("word", feats.pairs("ud").alias("ud"))


PARTED = "gelecek|mi gelecek|misin geldi|mi güzel|mi evde|mi okudun|mu geliyor|mu kitap|mı resmi ölümü kalemi kitabımı geldim mi mu am ev okumuşsun görmüşsün gelmişsin kalemim".split()


@query(lambda: values([(p.replace("|", ""), p) for p in PARTED], "word, pieces"))
def clitic_split(spark, sf_dir):
    words = spark.createDataFrame([(p.replace("|", ""),) for p in PARTED], "word string")
    return clitic.split_clitics(words).select("word", F.array_join("pieces", "|").alias("pieces"))


@query()
def clitic_split_tokens(spark, sf_dir):
    return clitic.split_clitics(distinct_tokens(spark, sf_dir).withColumnRenamed("token", "word")).select("word", F.array_join("pieces", "|").alias("pieces"))


MISSPELT = (("kitebımı", "kitabımı", "kitap"), ("arabba", "araba", "araba"))


@query(lambda: values(list(MISSPELT), "word, corrected, lemma"))
def correct_words(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w, _, _ in MISSPELT], "word string")
    return correct.correct(words).where("rank = 1").select("word", "corrected", "lemma")


@query()
def api_responses(spark, sf_dir):
    asked = [(k, w) for k, (w, _) in enumerate(goldens())] + [(1000, None), (1001, "  "), (1002, "a" * 50_001)]
    return api.responses(spark.createDataFrame(asked, "request_id bigint, word string"))


# --- corpora ---


@query(f"SELECT doc_id, CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN '' ELSE {_translated(chars.CIRCUMFLEX, chars.PLAIN)} END AS line FROM documents")
def fold_surface(spark, sf_dir):
    """Surfaces with particles left where they are: what SQL can say of normalising."""
    return normalize.surface(documents(spark, sf_dir), fold=True, clitics=False)


@query()
def normalize_surface(spark, sf_dir):
    return normalize.surface(documents(spark, sf_dir), fold=True)


@query()
def normalize_lemma(spark, sf_dir):
    return normalize.lemmas(documents(spark, sf_dir))


@query()
def normalize_morphemes(spark, sf_dir):
    return normalize.morphemes(documents(spark, sf_dir))


@query()
def normalize_jsonl(spark, sf_dir):
    return normalize.jsonl(documents(spark, sf_dir))


@query()
def normalize_summary(spark, sf_dir):
    return normalize.summary(documents(spark, sf_dir))


#: Lines and what each mode makes of them.
LINES = (
    (1, "Yarın gelecekmisin?", "Yarın gelecek misin?", "yarın gel mi", "yarın gel▁ecek mi▁sin"),
    (2, "kitabımı okudum.", "kitabımı okudum.", "kitap oku", "kitab▁ım▁ı oku▁du▁m"),
    (3, "mekân, evde!", "mekan, evde!", "mekân ev", "mekan ev▁de"),
    (4, "", "", "", ""),
    (None, "evde", "evde", "ev", "ev▁de"),
    (None, "   ", "", "", ""),
    (2, "geldimi", "geldi mi", "gel mi", "gel▁di mi"),
)


@query(lambda: " UNION ALL ".join(f"SELECT doc_id, '{mode}' AS mode, line FROM ({values([(r[0], r[2 + k]) for r in LINES], 'doc_id, line')})" for k, mode in enumerate(("surface", "lemma", "morphemes"))))
def normalize_golden(spark, sf_dir):
    df = spark.createDataFrame([r[:2] for r in LINES], "doc_id int, text string")
    modes = [normalize.lines(df, m, fold=m == "surface").select("doc_id", F.lit(m).alias("mode"), "line") for m in ("surface", "lemma", "morphemes")]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


@query()
def tokenize_text(spark, sf_dir):
    """All chunks of all documents with their analyses."""
    return api.tokenize_text(documents(spark, sf_dir))


TEXTS = (("Kitabımı gördüm.", "word:Kitabımı=kitap space: word:gördüm=gör punct:."), ("Yarın gelecekmisin?", "word:Yarın=yarın space: word:gelecek=gel word:misin=mi punct:?"), ("Sen de gelecekmisin?", "word:Sen=sen space: word:de=de space: word:gelecek=gel word:misin=mi punct:?"), ("", ""))


@query(lambda: values(list(TEXTS), "text, tokens"))
def tokenize_text_golden(spark, sf_dir):
    df = spark.createDataFrame([(t,) for t, _ in TEXTS], "text string")
    shown = lambda t: F.concat(t["kind"], F.lit(":"), F.trim(t["surface"]), F.coalesce(F.concat(F.lit("="), t["analysis"]["root"]), F.lit("")))
    return api.tokenize_text(df, keep=("text",)).select("text", F.array_join(F.transform("tokens", shown), " ").alias("tokens"))


@query(lambda: values([(1, 200), (2, 400), (3, 400), (4, 400), (5, 200), (6, 400)], "request_id, status"))
def text_responses(spark, sf_dir):
    bodies = ['{"text": "evdemi", "options": {"split_clitics": "no"}}', "{", '{"text": "  "}', json.dumps({"text": "a" * 50_001}), '{"text": " evde "}', None]
    return api.text_responses(spark.createDataFrame(list(enumerate(bodies, 1)), "request_id int, body string")).select("request_id", "status")


_SPLIT_WORDS = f"SELECT lower(unnest(regexp_extract_all(text, '[{WORD}]+'))) AS w FROM documents"


@query(f"SELECT count(*) AS words, count(*) AS tokens, 1.0::DOUBLE AS fertility, 1.0::DOUBLE AS single_share FROM ({_SPLIT_WORDS})")
def fertility_whitespace(spark, sf_dir):
    return fertility.basics(documents(spark, sf_dir), "whitespace")


@query(f"""SELECT count(*) AS words, sum(length(w))::BIGINT AS tokens, round(sum(length(w)) / count(*)::DOUBLE, 9) AS fertility,
round(count(*) FILTER (WHERE length(w) = 1) / count(*)::DOUBLE, 9) AS single_share FROM ({_SPLIT_WORDS})""")
def fertility_char(spark, sf_dir):
    return fertility.basics(documents(spark, sf_dir), "char")


@query()
def fertility_morphemes(spark, sf_dir):
    return fertility.score(documents(spark, sf_dir), "char")


#: Gold and predicted tokens made of all documents: class by language, features by length; one in five predictions is missing.
_GOLD_FEATS = "[('Case', CASE n_chars % 3 WHEN 0 THEN 'Nom' WHEN 1 THEN 'Acc' ELSE 'Loc' END), ('Number', CASE n_chars % 2 WHEN 0 THEN 'Sing' ELSE 'Plur' END)]"
_PRED_FEATS = "[('Case', CASE n_chars % 4 WHEN 0 THEN 'Nom' WHEN 1 THEN 'Acc' ELSE 'Loc' END), ('Person', '3')]"
_EVAL = f"""
WITH b AS (SELECT doc_id, source AS lemma, CASE lang WHEN 'en' THEN 'NOUN' WHEN 'de' THEN 'VERB' ELSE 'ADJ' END AS upos, CASE WHEN n_chars % 7 = 0 THEN 'x' ELSE source END AS root,
CASE WHEN n_chars % 6 = 0 THEN 'NOUN' WHEN lang = 'en' THEN 'NOUN' WHEN lang = 'de' THEN 'VERB' ELSE 'ADJ' END AS cls, doc_id % 5 <> 0 AS there,
CASE WHEN n_chars % 11 = 0 THEN [] ELSE {_GOLD_FEATS} END AS g, CASE WHEN doc_id % 5 = 0 THEN [] WHEN n_chars % 11 = 0 THEN [] ELSE {_PRED_FEATS} END AS p FROM documents),
c AS (SELECT upos, there::BIGINT AS parsed, (there AND lemma = root)::BIGINT AS root, (there AND upos = cls)::BIGINT AS cls,
len(list_intersect(g, p))::BIGINT AS tp, (len(p) - len(list_intersect(g, p)))::BIGINT AS fp, (len(g) - len(list_intersect(g, p)))::BIGINT AS fn, (there AND len(p) = len(g) AND len(list_intersect(g, p)) = len(g))::BIGINT AS exact, g, p FROM b)"""


def judged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d, n = documents(spark, sf_dir), F.col("n_chars")
    entries = lambda *kv: F.create_map(*(x for k, v in kv for x in (F.lit(k), v)))
    empty = F.create_map().cast("map<string,string>")
    case = lambda by: F.when(n % by == 0, "Nom").when(n % by == 1, "Acc").otherwise("Loc")
    upos = F.when(F.col("lang") == "en", "NOUN").when(F.col("lang") == "de", "VERB").otherwise("ADJ")
    g = d.select(F.col("doc_id").alias("id"), F.col("source").alias("lemma"), upos.alias("upos"), F.when(n % 11 == 0, empty).otherwise(entries(("Case", case(3)), ("Number", F.when(n % 2 == 0, "Sing").otherwise("Plur")))).alias("feats"))
    p = d.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), F.when(n % 7 == 0, "x").otherwise(F.col("source")).alias("root"), F.when(n % 6 == 0, "NOUN").otherwise(upos).alias("root_class"), F.when(n % 11 == 0, empty).otherwise(entries(("Case", case(4)), ("Person", F.lit("3")))).alias("feats"))
    return g, p


_PCT = ", ".join(f"round(100.0 * sum({c}) / count(*), 6)::DOUBLE AS {n}_pct" for n, c in (("parsed", "parsed"), ("root", "root"), ("class", "cls"), ("exact", "exact")))


@query(f"""{_EVAL} SELECT upos, count(*) AS n, sum(parsed)::BIGINT AS parsed, sum(root)::BIGINT AS root, sum(cls)::BIGINT AS class, sum(exact)::BIGINT AS exact, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, {_PCT},
round(coalesce(2.0 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0), 6)::DOUBLE AS f1 FROM c GROUP BY GROUPING SETS ((), (upos))""")
def eval_counters(spark, sf_dir):
    return evaluate.counters(*judged(spark, sf_dir))


@query(f"""{_EVAL}, e AS (
SELECT unnest(list_intersect(g, p)) AS f, 'tp' AS k FROM c UNION ALL SELECT unnest(list_filter(p, lambda x: NOT list_contains(g, x))), 'fp' FROM c UNION ALL SELECT unnest(list_filter(g, lambda x: NOT list_contains(p, x))), 'fn' FROM c)
SELECT f[1] AS key, count(*) FILTER (WHERE k = 'tp') AS tp, count(*) FILTER (WHERE k = 'fp') AS fp, count(*) FILTER (WHERE k = 'fn') AS fn FROM e GROUP BY 1""")
def eval_feature_keys(spark, sf_dir):
    return evaluate.feature_keys(*judged(spark, sf_dir))


@query(f"{_EVAL} SELECT doc_id AS id, lemma, upos, CASE WHEN there THEN root END AS p_root FROM b WHERE NOT there OR root <> lemma ORDER BY doc_id LIMIT 20")
def eval_root_errors(spark, sf_dir):
    return evaluate.root_errors(*judged(spark, sf_dir))


#: Treebank lines, and what the counters of their first analyses are.
TREEBANK = (
    "# text = Evde", "1\tevde\tev\tNOUN\t_\tCase=Loc|Number=Sing|Person=3\t_", "2\tgeldi\tgel\tVERB\t_\tAspect=Perf|Mood=Ind|Number=Sing|Person=3|Polarity=Pos|Tense=Past\t_", "3\tve\tve\tCCONJ\t_\t_\t_", "",
    "1-2\tx\tx\tNOUN\t_\t_\t_", "1\tyazmak\tyaz\tVERB\t_\tAspect=Perf|Case=Nom|Mood=Ind|Polarity=Pos|Tense=Pres|VerbForm=Vnoun\t_", "2\tqqqq\tzzz\tPROPN\t_\tCase=Nom\t_",
)
COUNTED = ((None, 4, 4, 3, 4, 3, 16, 2, 0, 0.941176), ("NOUN", 2, 2, 1, 2, 1, 4, 2, 0, 0.8), ("VERB", 2, 2, 2, 2, 2, 12, 0, 0, 1.0))


@query(lambda: f"SELECT upos, n, parsed, root, class, exact, tp, fp, fn, f1::DOUBLE AS f1 FROM ({values(list(COUNTED), 'upos, n, parsed, root, class, exact, tp, fp, fn, f1')})")
def eval_treebank(spark, sf_dir):
    bank = spark.createDataFrame([(x,) for x in TREEBANK], "value string")
    return evaluate.counters(*evaluate.treebank(bank)).select("upos", "n", "parsed", "root", "class", "exact", "tp", "fp", "fn", "f1")


@query()
def suggester_bench(spark, sf_dir):
    """Corrections of typos of the documents' words of known roots: a sample is the operator's feature."""
    return evaluate.suggester(distinct_tokens(spark, sf_dir).withColumnRenamed("token", "word"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '[{WORD}]+'))::BIGINT AS words FROM documents")
def stream_word_counts(spark, sf_dir):
    """All documents as a stream, written once each and read again."""
    docs = documents(spark, sf_dir)
    folder = scratch(spark, "stream")
    docs.select("doc_id", F.col("text").alias("value")).write.parquet(f"{folder}/in")
    source = spark.readStream.schema("doc_id bigint, value string").parquet(f"{folder}/in")
    counted = lines.rendered(source, keep=("doc_id",)).select("doc_id", F.col("words").cast("bigint").alias("words"))
    counted.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("doc_id bigint, words bigint").parquet(f"{folder}/out")
