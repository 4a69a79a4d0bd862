from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from hecespark.operators import api, evaluate, fertility, fuzzy, graph, normalize, text
from hecespark.sources import dims, lexicon
from hecespark.runtime import at_least
from hecespark.streaming import lines


def osa(a: str, b: str) -> float:
    d = {(i, 0): float(i) for i in range(len(a) + 1)} | {(0, j): float(j) for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            kin = any(a[i - 1] in p and b[j - 1] in p for p in fuzzy.PAIRS)
            cost = 0 if a[i - 1] == b[j - 1] else fuzzy.KIN if kin else 1
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + cost)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + fuzzy.SWAP)
    return d[len(a), len(b)]


def plain(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


VOCABULARY = [("kitap", 1200), ("katip", 90), ("kâtip", 5), ("kitaplık", 30), ("kapı", 800), ("kapu", 1), ("mektup", 400), ("araba", 950), ("a", 3), ("kapı", 2), ("", 9), (None, 1), ("ab", 4)]
ASKED = ["kitp", "mektip", "kapi", "xyz", "iktap", "b", "", "arabba", "kitap"]


@pytest.mark.parametrize("d", [1, 2])
def test_nearest_against_brute_force(spark, d):
    q = spark.createDataFrame([(w,) for w in [*ASKED, None, "kitp"]], "word string")
    terms = spark.createDataFrame(VOCABULARY, "term string, freq bigint")
    best = {t: max(f for u, f in VOCABULARY if u == t) for t, _ in VOCABULARY if t}
    want = set()
    for w in ASKED:
        order = sorted((round(osa(w, t), 6), -f, plain(w, t), t) for t, f in best.items() if plain(w, t) <= d and (w or len(t) <= d))
        want |= {(w, k, t, -f, p, x) for k, (x, f, p, t) in enumerate(order[:5], 1)}
    got = {tuple(r) for r in fuzzy.nearest(q, terms, d, 5).collect()}
    assert got == want


def test_edits_by_hand(spark):
    def edits(w):
        out = set()
        for i in range(len(w) + 1):
            if i < len(w):
                out.add(w[:i] + w[i + 1 :])
                out |= {w[:i] + c + w[i + 1 :] for c in fuzzy.ALPHABET}
            if i < len(w) - 1:
                out.add(w[:i] + w[i + 1] + w[i] + w[i + 2 :])
            out |= {w[:i] + c + w[i:] for c in fuzzy.ALPHABET}
        return out - {w}

    words = ["ev", "aa", "", "kitap", "q"]
    got = {r["w"]: r["e"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", fuzzy.edits1("w").alias("e")).collect()}
    assert all(set(got[w]) == edits(w) and len(got[w]) == len(set(got[w])) for w in words)


def test_split_and_rebuild(spark):
    texts = ["", "a", "Bu ev'de\t\n  mi?!  ", "é ß ñ x", " x y", "’tis ok", None, "x" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    parts = text.split_text(df)
    got = {r["doc_id"]: r["text"] for r in text.rebuild_text(parts).collect()}
    assert got == {k: t for k, t in enumerate(texts) if t}
    assert [(r["chunk"], r["kind"]) for r in parts.where("doc_id = 3").orderBy("pos").collect()] == [("é", "punct"), (" ", "space"), ("ß", "punct"), (" ", "space"), ("ñ", "punct"), (" ", "space"), ("x", "word")]


def test_normalising(spark):
    df = spark.createDataFrame([(1, "Yarın gelecekmisin?"), (2, "kitabımı okudum"), (3, ""), (4, None), (5, "  "), (6, "mekân")], "doc_id int, text string")
    line = lambda d: {r["doc_id"]: r["line"] for r in d.collect()}
    got = line(normalize.surface(df))
    assert got[1] == "Yarın gelecek misin?" and got[3] == "" and got[4] == got[5] == "" and got[6] == "mekân"
    assert line(normalize.surface(df, fold=True))[6] == "mekan"
    assert line(normalize.lemmas(df))[2] == "kitap oku"
    assert line(normalize.morphemes(df, separator="|"))[2] == "kitab|ım|ı oku|du|m"
    j = line(normalize.jsonl(df))
    assert [t["lemma"] for t in json.loads(j[2])["tokens"]] == ["kitap", "oku"] and j[3] == "" and j[5] == ""
    assert json.loads(j[2])["tokens"][0] == {"surface": "kitabımı", "lemma": "kitap", "pos": "NOUN", "morphemes": ["kitab", "ım", "ı"], "oov": False}
    s = normalize.summary(df).first()
    assert s["lines"] == 6 and s["words"] == 6


def test_lines_of_rows_with_the_same_id(spark):
    """Rows stay rows where ids repeat or are null, and columns of other names don't matter."""
    rows = [(1, "evde", "x"), (1, "gel", "y"), (None, "kitap ev", "z"), (None, None, "w")]
    df = spark.createDataFrame(rows, "doc_id int, text string, chunk string")
    assert sorted(r["line"] for r in normalize.surface(df).collect()) == ["", "evde", "gel", "kitap ev"]
    assert sorted(r["text"] for r in text.rebuild_text(text.split_text(df)).collect()) == ["evde", "gel", "kitap ev"]
    assert normalize.lemmas(df.limit(0)).count() == 0 and normalize.summary(df.limit(0)).first()["lines"] == 0
    with pytest.raises(ValueError):
        normalize.lines(df, "other")
    tokens = {r["chunk"]: r["tokens"] for r in api.tokenize_text(df, keep=("doc_id", "chunk")).collect()}
    assert [t["surface"] for t in tokens["z"]] == ["kitap", " ", "ev"] and tokens["w"] == [] and tokens["x"][0]["analysis"]["split"] == "ev-de"


def test_text_reconstruction(spark):
    texts = ["Çıkardı, sonra geçirdi.\nYarın da gelecek.", "Sen de gelecekmisin?", "Osman'ın kitabı", "evlerimizdne mektob", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for options in ({}, {"suggest": True, "alternatives": True}):
        got = {r["doc_id"]: r["tokens"] for r in api.tokenize_text(df, **options).collect()}
        assert {k: "".join(t["surface"] for t in v) for k, v in got.items()} == dict(enumerate(texts))
    assert [t["surface"] for t in got[1] if t["kind"] == "word"] == ["Sen", "de", "gelecek", "misin"]
    assert "evlerimizden" in got[3][0]["suggestions"] and "mektup" in got[3][2]["suggestions"] and got[1][0]["suggestions"] == []
    plain = api.tokenize_text(df, clitics=False).where("doc_id = 1").first()["tokens"]
    assert [t["surface"] for t in plain if t["kind"] == "word"] == ["Sen", "de", "gelecekmisin"]


def test_kernels_use_all_cores(spark):
    """A kernel's partitions aren't coalesced by their few bytes."""
    from hecespark.operators import parse

    df = spark.range(3000).selectExpr("'ev' || char(97 + id % 26) || char(97 + id % 7) as word")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = parse.best(df).select(F.spark_partition_id().alias("p")).distinct().count()
    assert found == parts
    cores = spark.sparkContext.defaultParallelism
    assert at_least(spark.range(10).coalesce(1)).rdd.getNumPartitions() == cores
    assert "Exchange" not in at_least(spark.range(10, numPartitions=cores + 1))._jdf.queryExecution().executedPlan().toString()


def test_fertility(spark):
    df = spark.createDataFrame([("kitabımı okudum",), (None,), ("",)], "text string")
    w = fertility.score(df, "whitespace").first()
    assert w["words"] == 2 and w["fertility"] == 1.0 and w["single_share"] == 1.0 and w["morphemes"] == 6
    c = fertility.score(df, "char").first()
    assert c["recall"] == 1.0 and c["tokens"] == 14 and 0 < c["precision"] < 1
    assert fertility.basics(df.limit(0)).first()["words"] == 0
    pieces = spark.createDataFrame([("kitap", ["ki", "tap"]), ("kitap", ["▁ki", "tap"]), ("kitap", ["kitap"]), ("kitap", ["xy", "z"]), ("kitap", ["##ki", "tap</w>"])], "w string, p array<string>")
    assert [r[0] for r in pieces.select(fertility.inner(F.col("w"), F.col("p"))).collect()] == [[2], [2], [], None, [2]]
    chunks = spark.createDataFrame([("kitab", ["ım", "", "ı"])], "r string, c array<string>")
    assert chunks.select(fertility.morpheme_boundaries(F.col("r"), F.col("c"))).first()[0] == [5, 7]


def test_evaluation(spark):
    gold = spark.createDataFrame([(1, "ev", "NOUN", {"Case": "Loc", "Number": "Sing"}), (2, "gel", "VERB", {"Tense": "Past"}), (3, "iyi", "ADJ", None)], "id int, lemma string, upos string, feats map<string,string>")
    pred = spark.createDataFrame([(1, "ev", "NOUN", {"Case": "Loc", "Number": "Plur"}), (3, "iyi", "NOUN", {})], "id int, root string, root_class string, feats map<string,string>")
    got = {r["upos"]: r for r in evaluate.counters(gold, pred).collect()}
    assert (got[None]["n"], got[None]["parsed"], got[None]["root"], got[None]["class"], got[None]["exact"]) == (3, 2, 2, 1, 1)
    assert (got[None]["tp"], got[None]["fp"], got[None]["fn"]) == (1, 1, 2) and got["VERB"]["fn"] == 1 and got["ADJ"]["f1"] == 0
    keys = [(r["key"], r["fp"] + r["fn"]) for r in evaluate.feature_keys(gold, pred, 2).collect()]
    assert keys == [("Number", 2), ("Tense", 1)]
    assert [r["id"] for r in evaluate.root_errors(gold, pred).collect()] == [2]


def test_treebank_and_lexicon(spark):
    value = ["# comment", "", "1-2\tx\tx\tNOUN\t_\t_", "1.1\tx\tx\tNOUN\t_\t_", "1\tkitabı\tkitap\tNOUN\t_\tCase=Acc|Bad|=x|A=b=c", "2\tburnu\tburun\tNOUN\t_\t_", "3\tAli\tAli\tPROPN\t_\t_", "4\t_\t_\tNOUN\t_\t_", "5\tshort\tx", "6\tve\tve\tCCONJ\t_\t_", "7\tkitap\tkitap\tNOUN\t_\t_"]
    rows = lexicon.conllu(spark.createDataFrame([(v,) for v in value], "value string"))
    gold = {r["form"]: r for r in lexicon.gold(rows).collect()}
    assert gold["kitabı"]["feats"] == {"Case": "Acc", "A": "b=c"} and gold["Ali"]["upos"] == "NOUN" and set(gold) == {"kitabı", "burnu", "Ali", "kitap"}
    roots = lexicon.extract(rows)
    got = {(r["form"], r["class"]): (r["frequency"], r["soften"], r["variants"]) for r in roots.collect()}
    assert got == {("kitap", "NOUN"): (2, True, []), ("burun", "NOUN"): (1, False, ["burn"]), ("ali", "NOUN"): (1, False, [])}
    heads = lexicon.headwords(spark.createDataFrame([(w,) for w in ("gelmek", "mek", "KİTAP", "kanat", "kanad", "iki söz", "x", None, "crème", "gelmek")], "word string"))
    assert {tuple(r) for r in heads.collect()} == {("gel", "VERB", False), ("kitap", "NOUN", False), ("kanat", "NOUN", True), ("kanad", "NOUN", False)}
    merged = lexicon.merged(roots, heads)
    assert {r["form"] for r in merged.collect()} == {"kitap", "burun", "ali", "gel", "kanat", "kanad"} and merged.count() == 6
    changes = spark.createDataFrame([("kitap", "NOUN", 99), ("ol", "VERB", None)], "form string, class string, frequency bigint")
    over = {r["form"]: r["frequency"] for r in lexicon.overridden(roots, changes).collect()}
    assert over == {"kitap": 99, "ol": None, "burun": 1, "ali": 1}
    assert lexicon.pruned(roots, spark.createDataFrame([("ali", "NOUN"), ("kitap", "VERB")], "form string, class string")).count() == 2
    more = spark.createDataFrame([("su", "NOUN", 1), ("su", "NOUN", 1), ("kitap", "VERB", 1), (None, "NOUN", 1)], "form string, class string, frequency bigint")
    once = lexicon.with_additions(roots, more)
    assert once.count() == 4 and lexicon.with_additions(once, more).count() == 4
    assert [r["root_id"] for r in lexicon.ranked(roots).orderBy("root_id").collect()] == [0, 1, 2]


def test_files_of_the_grammar(spark, tmp_path):
    good = {"suffixes": [{"_section": "x"}, {"id": "LOC", "template": "DA", "feats": {"Case": "Loc", "_x": "y"}, "category": "CASE"}]}
    path = tmp_path / "s.json"
    path.write_text(json.dumps(good))
    g = dims.load_inventory(spark, str(path))
    assert g.suffixes["LOC"].feats == (("Case", "Loc"),)
    for bad in ({"id": "A"}, {"id": "A", "template": "D A"}, {"id": "A", "template": "DA", "rules": ["no"]}, {"id": "LOC", "template": "DA"}):
        path.write_text(json.dumps({"suffixes": [*good["suffixes"], bad]}))
        with pytest.raises(ValueError):
            dims.load_inventory(spark, str(path))
    graph_file = tmp_path / "g.json"
    graph_file.write_text(json.dumps({"start": {"NOUN": "N"}, "states": [{"id": "N", "accept": True}], "transitions": [{"via": "LOC", "from": ["N"], "to": "N"}]}))
    assert dims.load_graph(spark, str(graph_file), g.suffixes).step("N", "LOC") == "N"
    graph_file.write_text(json.dumps({"start": {}, "states": [{"id": "N", "accept": True}], "transitions": [{"via": "LOC", "from": [], "to": "N"}]}))
    with pytest.raises(ValueError):
        dims.load_graph(spark, str(graph_file), g.suffixes)
    roots = tmp_path / "r.json"
    roots.write_text(json.dumps({"entries": [{"form": "ev", "class": "NOUN", "frequency": 3}, {"form": "gel", "class": "VERB"}]}))
    loaded = dims.load_lexicon(spark, str(roots))
    assert [(r["root_id"], r["form"], r["frequency"]) for r in loaded.orderBy("root_id").collect()] == [(0, "ev", 3), (1, "gel", 0)]
    dims.save_lexicon(loaded, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert graph.dangling(dims.edge_frame(spark), dims.suffix_frame(spark), dims.state_frame(spark)).count() == 0


def test_stream_of_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("mekân güzel\n\nev\n")
    stream = lines.read(spark, str(tmp_path / "in"))
    lines.write(stream, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["", "ev", "mekân güzel"]
    for mode, want in (("lemma", {"mekân güzel", "", "ev"}), ("morphemes", {"mekan güzel", "", "ev"}), ("jsonl", None)):
        lines.write(stream, str(tmp_path / mode), str(tmp_path / f"{mode}-log"), mode).awaitTermination()
        got = [r["value"] for r in spark.read.text(str(tmp_path / mode)).collect()]
        assert set(got) == want if want else sum(x.startswith('{"text"') for x in got) == 2
    table = spark.read.text(str(tmp_path / "in"))
    assert lines.summary(table).first().asDict() == {"lines": 3, "words": 3}
    assert {r["line"] for r in lines.rendered(table, fold=True).collect()} == {"", "ev", "mekan güzel"}
    query = lines.summary(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("counts").first().asDict() == {"lines": 3, "words": 3}


def test_jobs(spark, tmp_path):
    from hecespark import jobs
    from hecespark.plans import catalogue

    (tmp_path / "lines.txt").write_text("kitabımı okudum\n\nevdemi\n")
    total = jobs.normalise(spark, str(tmp_path / "lines.txt"), str(tmp_path / "out"), "lemma").first()
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["", "ev mi", "kitap oku"] and total["words"] == 4
    (tmp_path / "bank.conllu").write_text("\n".join(catalogue.TREEBANK))
    counted, keys, errors = jobs.evaluated(spark, str(tmp_path / "bank.conllu"))
    assert {r["upos"]: r["n"] for r in counted.collect()} == {None: 4, "NOUN": 2, "VERB": 2} and [r["lemma"] for r in errors.collect()] == ["zzz"] and keys.count() > 0
    (tmp_path / "words.json").write_text(json.dumps([{"word": "kanat", "meanings": ["x"]}, {"word": "kanad"}, {"word": ""}, {"meanings": []}, {"word": "gelmek"}]))
    (tmp_path / "over.json").write_text(json.dumps({"additions": [{"_section": "s"}, {"form": "su", "class": "NOUN", "frequency": 9}, {"form": "x"}], "prune": [{"form": "ev", "class": "NOUN"}]}))
    made = {r["class"]: r["n"] for r in jobs.build_lexicon(spark, str(tmp_path / "bank.conllu"), str(tmp_path / "lexicon"), str(tmp_path / "words.json"), str(tmp_path / "over.json")).collect()}
    forms = {r["form"] for r in spark.read.json(str(tmp_path / "lexicon")).collect()}
    assert forms == {"gel", "yaz", "zzz", "kanat", "kanad", "su"} and made == {"NOUN": 4, "VERB": 2}
    assert jobs.fertilities(spark, str(tmp_path / "lines.txt"))["char"].first()["words"] == 3


def test_loaded_models(spark):
    from pathlib import Path

    paths = [p for p in Path("/opt/tokenizers").glob("*") if p.suffix in (".model", ".json", ".tiktoken")]
    if not paths:
        pytest.skip("no models here")
    df = spark.createDataFrame([("kitap evde kitap",), (None,)], "text string")
    for path in paths[:4]:
        if path.suffix == ".json" and "model" not in json.loads(path.read_text()):
            continue
        r = fertility.score(df, fertility.model(str(path))).first()
        assert r["words"] == 3 and r["tokens"] >= 3, path
    with pytest.raises(ValueError):
        fertility.loaded("x.unknown")


def test_typos_and_suggester(spark):
    df = spark.createDataFrame([(w,) for w in ("kitap", "evlerde", "gelmezsem", "a", "", None)], "word string")
    for seed in range(12):
        for r in df.select("word", fuzzy.typo("word", seed).alias("t")).collect():
            w, t = r["word"], r["t"]["typo"]
            if t is None:
                assert w in ("a", "", None) or r["t"]["kind"] in ("substitute", "transpose")
                continue
            size = {"delete": -1, "insert": 1}.get(r["t"]["kind"], 0)
            assert t != w and len(t) == len(w) + size and t[: r["t"]["at"]] == w[: r["t"]["at"]]
    words = spark.createDataFrame([(w,) for w in ("kitabımı", "evlerde", "okudum", "gözlerde", "qqqq", "x1y2")], "word string")
    got = {r["by"]: r for r in evaluate.suggester(words, sample=10).collect()}
    assert 0 < got[None]["n"] <= 4 and got[None]["top1"] <= got[None]["top3"] <= got[None]["fired"] <= got[None]["n"]
    assert sum(r["n"] for k, r in got.items() if k in fuzzy.KINDS) == got[None]["n"] == sum(got[k]["n"] for k in ("stem", "tail") if k in got)


def test_numbering_over_ranges(spark):
    df = spark.range(1000).selectExpr("'f' || id as form", "'NOUN' as class", "id % 7 as frequency")
    got = [(r["root_id"], r["frequency"], r["form"]) for r in lexicon.ranked(df).orderBy("root_id").collect()]
    assert [g[0] for g in got] == list(range(1000)) and got == sorted(got, key=lambda g: (-g[1], g[2]))
    assert lexicon.ranked(df.limit(0)).count() == 0
