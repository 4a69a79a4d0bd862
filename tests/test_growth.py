"""What large inputs need: inputs read once, rows joined before they are shuffled, bounded batches, and words that are made once."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hecespark.operators import api, chart, evaluate, fertility, fuzzy, normalize, text
from hecespark.plans import catalogue
from hecespark.sources import lexicon


def counted(df):
    """df, and how often its rows have been read."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(count, df.schema), seen


def words_of(n: int) -> list[str]:
    draw = random.Random(5)
    return ["".join(draw.choice("abdegiklmnorstuyz") for _ in range(draw.randint(3, 9))) for _ in range(n)]


def test_lines_come_in_bounded_batches():
    """a line of JSON is many times its text; a batch of them was made whole."""
    line = "evde kitabımı okudum " * 200
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([line] * 99 + [None])], names=["doc_id", "text"])
    out = list(normalize.line_kernel(iter([batch]), None, "text", ["doc_id"], "jsonl", False, True, "▁"))
    longest = max(len(x) for b in out for x in b.column("line").to_pylist())
    assert len(out) > 1 and all(sum(map(len, b.column("line").to_pylist())) < normalize.BATCH_CHARS + longest for b in out)
    assert [k for b in out for k in b.column("doc_id").to_pylist()] == list(range(100))


@pytest.mark.parametrize("mode", normalize.MODES)
def test_frequent_words_are_kept(monkeypatch, mode):
    """what was kept was all forgotten at a bound, frequent words too."""
    monkeypatch.setattr(chart, "KEPT_WORDS", 50)
    monkeypatch.setattr(chart, "KEPT_ANALYSES", 50)
    c = chart.Chart([], [], {})
    made = []
    monkeypatch.setattr(normalize.clitic, "pieces", lambda c, w: made.append(w) or [w])
    render = normalize.renderer(c, mode, False, True, "▁")
    others = words_of(500)
    for w in others:
        assert w in render(f"{w} gelecekmisin")
    assert made.count("gelecekmisin") == 1
    assert max(len(k) + len(k.older) for k in c.shown.values()) <= 100 and len(c.words) <= 50


def test_kept_endings_are_bounded_by_their_ways(monkeypatch):
    """the bound was of endings, whatever number of ways each held."""
    monkeypatch.setattr(chart, "KEPT_ENDINGS", 200)
    p = chart.packaged()
    c = chart.Chart(chart.realize._packaged(), list(enumerate(chart.dims.roots())), chart.realize.packaged_bits())
    begun = 0
    for w in ("evlerimizdekilerden", "gelebileceklerdi", "kitaplarımızdan", "okuyabileceklerimizdendi") * 2:
        before = c.ways
        assert c.all_of(w) == p.all_of(w)
        assert c.ways == sum(1 + len(x) for x in c.known.values())
        begun += c.ways < before
    assert begun


def test_a_token_is_made_once(monkeypatch):
    """each token was converted by itself."""
    asked = []
    answer = api._answer
    monkeypatch.setattr(api, "_answer", lambda c, w, others: asked.append(w) or answer(c, w, others))
    monkeypatch.setattr(chart, "_charts", {})
    kind = pa.struct([("kind", pa.string()), ("surface", pa.string()), ("analysis", pa.struct([("root", pa.string()), ("oov", pa.bool_())])), ("alternatives", pa.list_(pa.string())), ("suggestions", pa.list_(pa.string()))])
    lines = ["Yarın gelecekmisin?", None, "", "gelecekmisin evde, evde"] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(lines)], names=["doc_id", "text"])
    for bounds in ((api.BATCH_TOKENS, api.KEPT_TOKENS), (3, 4)):
        monkeypatch.setattr(api, "BATCH_TOKENS", bounds[0])
        monkeypatch.setattr(api, "KEPT_TOKENS", bounds[1])
        asked.clear()
        out = list(api.text_kernel(iter([batch, batch]), None, pa.list_(kind), "text", ["doc_id"], False, True))
        assert bounds[0] == 3 or sorted(asked) == ["Yarın", "evde", "gelecek", "misin"]
        rows = [r for b in out for r in b.to_pylist()]
        assert [r["doc_id"] for r in rows] == [*range(20)] * 2
        assert {tuple(t["surface"] for t in r["tokens"]) for r in rows} == {("Yarın", " ", "gelecek", "misin", "?"), (), ("gelecek", "misin", " ", "evde", ",", " ", "evde")}
        assert all((t["kind"] == "word") == (t["analysis"] is not None) and t["alternatives"] == t["suggestions"] == [] for r in rows for t in r["tokens"])


def test_runs_of_chunks_are_joined(spark):
    """each chunk was shuffled by itself."""
    rows = [("a", 1, 0, "ev"), ("a", 1, 1, None), ("a", 1, 2, "ğ"), ("a", 1, 4, "z"), ("a", 2, 5, "x"), (None, 2, 6, "y"), (None, 2, 7, ""), (None, 2, 9, "w")]
    names = ["doc_id", "row", "pos", "chunk"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
    for b in (batch, pa.concat_batches([batch, batch]).slice(8)):
        got = [tuple(r.values()) for out in text.run_kernel(iter([b]), ["doc_id"]) for r in out.to_pylist()]
        assert got == [("a", 1, 0, "evğ"), ("a", 1, 4, "z"), ("a", 2, 5, "x"), (None, 2, 6, "y"), (None, 2, 9, "w")]
    texts = [" ".join(words_of(50)) + "ş  !" for _ in range(40)] + ["", None, "é"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("key", F.array("doc_id"))
    parts = text.split_text(df, keep=("doc_id", "key"))
    for given in (parts, parts.orderBy(F.xxhash64("pos", "row"))):
        got = {r["doc_id"]: r["text"] for r in text.rebuild_text(given, ("doc_id", "key")).collect()}
        assert got == {k: t for k, t in enumerate(texts) if t}


def test_headwords_and_fertility_read_their_input_once(spark):
    """F3, F8, F13: the words were split from the texts again for each branch."""
    df, seen = counted(spark.createDataFrame([(w,) for w in ("gelmek", "kanat", "kanad", "Kanat", "KANAT")], "word string"))
    assert {tuple(r) for r in lexicon.headwords(df).collect()} == {("gel", "VERB", False), ("kanat", "NOUN", True), ("kanad", "NOUN", False)} and seen.value == 5
    df, seen = counted(spark.createDataFrame([("evde kitap",), ("Evde",)], "text string"))
    assert fertility.score(df).first()["words"] == 3 and seen.value == 2


def test_merge_reads_documents_once(spark, monkeypatch):
    df, seen = counted(spark.createDataFrame([(1, "kitabı kitabı gelmek Evde"), (2, None)], "doc_id int, text string"))
    monkeypatch.setattr(catalogue, "documents", lambda spark, sf_dir: df)
    got = {(r["form"], r["class"]): r["frequency"] for r in catalogue.QUERIES["lexicon_merge"](spark, "").collect()}
    assert got == {("kita", "NOUN"): 2, ("gelm", "NOUN"): 1, ("evde", "NOUN"): 1, ("kitabı", "NOUN"): 0, ("gel", "VERB"): 0} and seen.value == 2


def test_extract_counts_rows(spark):
    rows = spark.createDataFrame([("kitabı", "kitap", "NOUN", 3), ("kitap", "kitap", "PROPN", 4), ("burnu", "burun", "NOUN", 1), ("x", "_", "NOUN", 9), ("ve", "ve", "CCONJ", 9)], "form string, lemma string, upos string, n int")
    got = {r["form"]: (r["frequency"], r["soften"], r["variants"]) for r in lexicon.extract(rows, "n").collect()}
    assert got == {"kitap": (7, True, []), "burun": (1, False, ["burn"])}


def test_suggester_reads_its_words_once(spark):
    """gold words were found three times."""
    df, seen = counted(spark.createDataFrame([("kitabımı",), ("evlerde",), ("qqqq",)], "word string"))
    assert evaluate.suggester(df, sample=1).where("by is null").first()["n"] == 1 and seen.value == 3


def test_typos_of_strings(spark):
    """the strings' typos are those of the expressions."""
    words = ["", "a", "q", "aa", "ev", "kitap", "İşçi’", "😀é", *words_of(30), None]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for seed in (1, 7):
        want = sorted(map(tuple, df.select("word", fuzzy.make_typo("word", seed)).collect()), key=str)
        assert sorted(map(tuple, fuzzy.typos(df, seed).collect()), key=str) == want


def test_tokens_of_whole_texts(spark):
    df = spark.createDataFrame([("İSTANBUL’da ISI Mekân QX ısı mekan",), (None,), ("",)], "text string")
    want = ["istanbul’da", "ısı", "mekan", "QX", "ısı", "mekan"]
    assert [r["token"] for r in text.tokens(df).collect()] == want
    assert sorted(r["token"] for r in text.distinct_tokens(df).collect()) == sorted(set(want))
