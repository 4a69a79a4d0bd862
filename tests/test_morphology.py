from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hecespark.functions import chars
from hecespark.operators import api, chart, clitic, correct, feats, generate, parse, realize
from hecespark.plans import catalogue
from hecespark.sources import dims


@pytest.fixture(scope="module")
def words(spark):
    return lambda *w: spark.createDataFrame([(x,) for x in w], "word string")


APPLIED = "gel+DHm=geldim git+DHm=gittim oku+DHm=okudum gör+DHk=gördük kitap+Hm=kitabım ağaç+Hm=ağacım ekmek+Hm=ekmeğim ev+(y)A=eve araba+(y)A=arabaya kapı+(s)H=kapısı kanat+(s)H=kanadı okul+DA=okulda kitap+DAn=kitaptan göz+lAr=gözler öl+DHr=öldür gel+=gel +DHm=dim"


def test_apply_suffix(spark):
    cases = [(x.split("+")[0], *x.split("+", 1)[1].split("=")) for x in APPLIED.split()]
    df = spark.createDataFrame(cases, "stem string, template string, want string").withColumn("got", chars.apply_suffix("stem", F.col("template")))
    assert [(r["stem"], r["template"], r["got"]) for r in df.where("not (got <=> want)").collect()] == []
    assert df.select(chars.apply_suffix("stem", F.lit("Hm"), False).alias("x")).where("stem = 'kitap'").first()["x"] == "kitapım"


CHAINS = """gel PROG 3PL geliyorlar|gel FUT gelecek|gel AOR 1SG_Z gelirim high|gel EVID 2SG_Z gelmişsin|gel PAST 2PL_K geldiniz|gel COND 1PL_K gelsek|gel NEG PROG 1SG_Z gelmiyorum|oku PROG okuyor
yap FUT yapacak|başla AOR başlar|yap AOR yapar|çağır AOR çağırır|yap CAUS AOR yaptırır|yap NEG AOR 1SG_Z yapmam|gel NEG AOR 2PL_Z gelmezsiniz|oku OPT OPT_1SG okuyayım|gel NEG IMP_3SG gelmesin|sil PASS silin|gör PASS görül
otur CAUS oturt|aç CAUS açtır|yürü CAUS yürüt|gel POT PAST gelebildi|yap POT NEG PAST yapamadı"""


def test_generation(spark):
    cases = []
    for c in CHAINS.replace("\n", "|").split("|"):
        stem, *chain = c.split()
        high = chain[-1] == "high"
        chain = chain[:-1] if high else chain
        cases.append((stem, chain[:-1], "VERB", False, high, chain[-1]))
    cases += [("geç", ["CAUS_DERIV"], "VERB", False, False, "geçir"), ("araba", ["POSS_3SG", "ABL"], "NOUN", True, False, "arabasından"), ("kitap", ["LOC"], "NOUN", True, False, "kitapta")]
    df = spark.createDataFrame(cases, "stem string, chain array<string>, word_class string, soften boolean, aorist_high boolean, want string")
    df = df.withColumn("caus_deriv", F.when(F.col("stem") == "geç", "Hr"))
    got = generate.generate(df).collect()
    assert [(r["stem"], r["chain"], r["surface"], r["want"]) for r in got if r["surface"] != r["want"]] == []
    by = {r["surface"]: r for r in got}
    assert by["arabasından"]["split"] == "araba-sı-ndan" and by["arabasından"]["tagged"].startswith("araba-sı+POSS_3SG[")


def test_generation_of_what_is_not_allowed(spark):
    df = spark.createDataFrame([("ev", ["PAST_COP", "ACC"], "NOUN")], "stem string, chain array<string>, word_class string")
    r = generate.generate(df, strict=False).first()
    assert r["warning"] == "ACC" and r["surface"]
    with pytest.raises(Exception, match="doesn't allow ACC"):
        generate.generate(df).collect()
    with pytest.raises(Exception, match="no suffix XYZ"):
        generate.generate(spark.createDataFrame([("ev", ["XYZ"])], "stem string, chain array<string>")).collect()
    none = spark.createDataFrame([(None, ["ACC"]), ("ev", None), ("ev", [])], "stem string, chain array<string>")
    assert [r["surface"] for r in generate.generate(none).collect()] == [None, None, "ev"]
    with pytest.raises(ValueError):
        generate.get_forward("no_such_rule")


LONG = ["evi", "kitabımı", "gidiyorum", "gelmezsem", "anlatılmamış", "İstanbul'da", "arabasıyla", "evlerimde", "x", "mekânda"]


def test_kernel_and_joins_agree(words):
    w = words(*LONG)
    columns = ["word", "rank", "root", "root_class", "final_class", "oov", "ids", "chunks", "root_chunk"]
    key = lambda df: sorted((*(str(r[c]) for c in columns), round(r["score"], 9)) for r in df.collect())
    assert key(parse.analyses(w, return_all=True)) == key(parse.analyses_by_joins(w, return_all=True))


def test_roots_and_grammar_of_ones_own(spark, words):
    roots = spark.createDataFrame([(0, "zonk", "NOUN", 5, True, ["zung"], None, None, None, False)], f"root_id bigint, {dims.ROOT_SCHEMA}")
    got = {r["word"]: (r["root"], r["ids"], r["oov"]) for r in parse.best(words("zonğu", "zungda", "evde"), roots=roots).collect()}
    assert got["zonğu"][0] == "zonk" and got["zungda"] == ("zonk", ["LOC"], False) and got["evde"][2]


def test_words_of_all_kinds(words):
    got = {r["word"] for r in parse.analyses(words("", None, "'", "ev", "ev", "a" * 10_000, "123", "日本")).collect()}
    assert got == {"ev", "123", "日本"}
    assert parse.analyses(words().limit(0)).count() == 0
    assert parse.analyses(words("qqqqq"), oov=False).count() == 0


MORE = {"çocuğa": "çocuk+DAT", "ona": "o+DAT", "kime": "kim+DAT", "muyum": "mu+1SG_Z", "miydi": "mi+PAST_COP", "takım": "takım+BARE", "bulundu": "bul+PASS_DERIV+PAST", "dokundu": "doku+PASS_DERIV+PAST"}


def test_further_words(words):
    got = {r["word"]: r["c"] for r in parse.best(words(*MORE)).select("word", feats.chain().alias("c")).collect()}
    assert {k: v for k, v in got.items() if MORE[k] != v} == {}


def test_features_and_renderings(words):
    r = {x["word"]: x for x in feats.wire(parse.best(words("evimde", "geldi", "olduğu", "söylemişti", "qqq"))).collect()}
    assert r["evimde"]["analysis"]["split"] == "ev-im-de" and r["evimde"]["analysis"]["tagged"].startswith("ev+NOUN-im+POSS_1SG[")
    ud = lambda w: dict(p.split("=") for p in r[w]["analysis"]["ud_feats"].split("|"))
    assert ud("geldi") == {"Mood": "Ind", "Polarity": "Pos", "Aspect": "Perf", "Tense": "Past", "Person": "3", "Number": "Sing"}
    assert ud("söylemişti")["Tense"] == "Pqp"
    assert ud("olduğu")["VerbForm"] == "Part" and ud("olduğu")["Mood"] == "Ind" and not {"Case", "Number", "Person"} & set(ud("olduğu"))
    assert r["qqq"]["analysis"]["tagged"] == "qqq+NOUN[UNK]"


def test_alternatives(words):
    every = parse.analyses(words("evi", "gelir"), return_all=True)
    got = feats.alternatives(every, 3).collect()
    assert {r["word"] for r in got if r["chain"] == "ev+ACC"} == {"evi"} and max(r["n"] for r in got) <= 3


def test_clitics(words):
    want = {"aldınmı": ["aldın", "mı"], "hastamısın": ["hasta", "mısın"], "tanımışım": ["tanımışım"], "ölümü": ["ölümü"], "mi": ["mi"], "Geldimi": ["Geldi", "mi"]}
    got = {r["word"]: r["pieces"] for r in clitic.split_clitics(words(*want, None, "")).collect()}
    assert got == want | {"": [""]}


def test_corrections(words):
    got: dict = {}
    for r in correct.correct(words("mektob", "öğretmenn", "xyzqwz", "kitap", "ab", None, "")).orderBy("word", "rank").collect():
        got.setdefault(r["word"], []).append(r["corrected"])
    assert "mektup" in got["mektob"] and got["öğretmenn"][0] == "öğretmen" and not {"xyzqwz", "kitap", "ab", ""} & set(got)
    tail = {r["word"]: r["lemma"] for r in correct.correct(words("evlerimizdne"), tail_repair=True).where("rank = 1").collect()}
    assert tail == {"evlerimizdne": "ev"} and correct.correct(words("evlerimizdne"), tail_repair=False).count() == 0


def test_suggestions(words):
    got = {(r["word"], r["rank"]): r["lemma"] for r in correct.suggest(words("kitp", "Kitp", "z", None)).collect()}
    assert got["kitp", 1] == got["Kitp", 1] == "kitap" and not any(w == "z" for w, _ in got)


def test_responses(spark):
    import json

    df = spark.createDataFrame([(1, "evde"), (2, None), (3, "a" * 50_001), (4, " evde "), (5, "geldimi")], "request_id bigint, word string")
    got = {r["request_id"]: (r["status"], json.loads(r["body"])) for r in api.responses(df).collect()}
    assert {k: s for k, (s, _) in got.items()} == {1: 200, 2: 400, 3: 400, 4: 200, 5: 200}
    assert got[1][1]["analysis"]["root"] == "ev" and got[4][1] == got[1][1] and got[5][1]["segments"] == ["geldi", "mi"]


def test_goldens_without_spark():
    c = chart.packaged()
    for word, chain in catalogue.goldens():
        w = word.translate(str.maketrans(chars.CAPITAL, chars.SMALL))
        a = c.analyses(w, None, w != word, True, False)[0]
        assert "+".join([a[0], *(a[5] or ("BARE",))]) == chain, word


def test_renderings_of_both_kinds_agree(words):
    """What kernels render is what Columns do."""
    c = chart.packaged()
    w = [*(g for g, _ in catalogue.goldens()), "söylemişti", "olduğu", "yaptırıldı", "qqq", "Osman'ın", "güzelce"]
    got = {r["word"]: r["analysis"].asDict(True) for r in feats.wire(parse.best(words(*w))).collect()}
    for x in w:
        assert feats.wire_of(c.best(x), c.book) == got[x], x
    every = parse.analyses(words("evi", "gelir", "yüzü"), return_all=True)
    others: dict = {}
    for r in feats.alternatives(every).orderBy("word", "n").collect():
        others.setdefault(r["word"], []).append(r["chain"])
    for x in ("evi", "gelir", "yüzü"):
        assert feats.alternatives_of(c.all_of(x)) == others.get(x, []), x


def test_endings_of_any_length_agree():
    """A stack takes over where recursion would be deep: the same analyses."""
    c, d = chart.packaged(), chart.Chart(realize._packaged(), list(enumerate(dims.roots())), realize.packaged_bits())
    for w in ("evlerdekilerdekilerde", "kitabımı", "gelmezsem"):
        long = sorted(d.walked(w[2:], "NOUN_ROOT", "NOUN", realize.LOW_AORIST + chart.before("", False), chart.contexts(w)[1], ""))
        assert long == sorted(c.endings(w[2:], "NOUN_ROOT", "NOUN", realize.LOW_AORIST + chart.before("", False), chart.contexts(w)[1], ""))
    assert c.best("ev" + "lerdeki" * 60).ids[:3] == ("PLUR", "LOC", "REL_KI")


def test_weights(words):
    free = parse.Weights(oov=100.0)
    assert parse.best(words("evde"), weights=free).first()["oov"] and not parse.best(words("evde")).first()["oov"]
    assert parse.best(words("abcdefghijkl"), weights=parse.Weights(max_oov=3)).count() == 0


def test_contexts_agree_with_columns(spark):
    df = spark.createDataFrame([(w,) for w in ("kitap", "şöför", "brr", "güler", "a")], "w string")
    for r in df.select("w", F.transform(F.sequence(F.lit(1), F.length("w")), lambda k: realize.context_of(F.col("w").substr(F.lit(1), k))).alias("c")).collect():
        assert r["c"] == chart.contexts(r["w"]), r["w"]


def test_every_suffix_goes_round(spark):
    """Each suffix that a root's state allows is generated on roots of its class, and is among the analyses of what was generated."""
    g = dims.grammar()
    stems = {"NOUN": ["ev", "araba", "kitap"], "VERB": ["gel", "oku", "yap"], "ADJ": ["güzel", "kara"]}
    cases = [(s, [e.suffix], cls) for cls, start in g.start.items() for e in g.edges if e.state == start for s in stems[cls] if "deriv" not in "".join(g.suffixes[e.suffix].rules)]
    cases = [(*case, case[0] == "kitap") for case in cases]
    assert len({c[1][0] for c in cases}) > 55
    df = spark.createDataFrame(cases, "stem string, chain array<string>, word_class string, soften boolean")
    c, missing = chart.packaged(), []
    for r in generate.generate(df, strict=False).collect():
        accepted = g.accept[g.step(g.start[r["word_class"]], r["chain"][0])]
        if accepted and (r["stem"], tuple(r["chain"])) not in {(a.root, a.ids) for a in c.all_of(r["surface"])}:
            missing.append((r["surface"], r["stem"], r["chain"]))
    # a buffer (H) shows as that letter, which a parse never matches: as the engine to match has it
    assert [m for m in missing if m[0] == m[0].lower()] == []


def test_rules_can_be_added():
    name = "only_for_this_test"
    with pytest.raises(ValueError):
        realize.alternatives(dims.Suffix("X", "", "DA", rules=(name,)), "vowel", False, {})

    @realize.expand(name)
    def _(t, b):
        return [("lAr", 0, "")] if b.vowel else [(t, realize.NEG, "")]

    try:
        assert realize.alternatives(dims.Suffix("X", "", "DA", rules=(name,)), "vowel", False, {}) == [("lAr", 0, "")]
        assert realize.alternatives(dims.Suffix("X", "", "DA", rules=(name,)), "r", False, {}) == [("DA", realize.NEG, "")]
        with pytest.raises(ValueError):
            realize.expand(name)(lambda t, b: [])
    finally:
        del realize.EXPAND[name]
    with pytest.raises(ValueError):
        realize.get_inverse("none")
