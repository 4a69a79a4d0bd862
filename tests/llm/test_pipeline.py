from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hecespark.llm import bpe, registry, secrets

BAD, GOOD = "vile scum filth trash vermin", "kind bright calm gentle warm"
HEX = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


@pytest.fixture(scope="module")
def sf_dir(spark, make, prose, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rows = [(k, f"{prose(60, k)} {BAD if k % 4 == 0 else GOOD} {prose(60, 500 + k)}", f"s{k % 3}") for k in range(200)]
    rows += [(1000 + k, rows[k + 1][1], "s0") for k in range(0, 40, 4)] + [(2000, f'{prose(100, 7)} {GOOD} token = "{HEX}" {prose(30, 8)}', "s1"), (2001, None, None), (2002, "", "s1")]
    make(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(160)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_each_stage_on_its_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    by = dict(corpus_pipeline.STAGES)
    clean = by["toxicity"](spark, docs, sf_dir).cache()
    ids = {r["doc_id"] for r in clean.collect()}
    assert clean.schema == docs.schema
    assert not ids & set(range(0, 200, 4)) and {k for k in range(200) if k % 4} | {2000, 2001, 2002} <= ids
    unique = by["near_duplicates"](spark, clean, sf_dir).cache()
    assert unique.schema == docs.schema
    assert {r["doc_id"] for r in unique.collect()} == ids - set(range(1000, 1040))
    masked = by["secrets"](spark, unique, sf_dir).cache()
    assert masked.schema == docs.schema and masked.count() == unique.count()
    changed = masked.alias("m").join(unique.alias("u"), "doc_id").where("m.text <> u.text").select("doc_id", F.col("m.text").alias("t")).collect()
    assert [r["doc_id"] for r in changed] == [2000] and secrets.MASK in changed[0]["t"] and HEX not in changed[0]["t"]
    mixed = by["mixing"](spark, masked, sf_dir).cache()
    assert mixed.columns == docs.columns and mixed.count() > 0
    coded = by["tokens"](spark, mixed, sf_dir)
    assert coded.count() == mixed.count() and coded.where("not lossless").count() == 0
    back = bpe.decode(coded).join(mixed.withColumnRenamed("text", "want"), "doc_id")
    assert back.where("text <> want").count() == 0


def test_run_is_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, sf_dir)
    key = lambda df: sorted((r["doc_id"], r["source"], tuple(r["tokens"])) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(docs)


def test_run_against_brute_force(spark, sf_dir):
    """The whole run held against what plain Python makes of the documents: which stay, masked, laid end to end and cut, and tokens by another encoder."""
    import base64
    from collections import Counter, defaultdict

    tiktoken = pytest.importorskip("tiktoken")
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
    other = tiktoken.Encoding("other", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    kept, seen = [], []
    for i, text, source in sorted(rows):
        words = set((text or "").lower().split())
        if set(BAD.split()) <= words:
            continue
        if words and any(len(words & w) >= 0.85 * max(len(words), len(w)) for w in seen):
            continue
        seen += [words] if words else []
        kept.append((i, (text or "").replace(HEX, secrets.MASK), source))
    frame = spark.createDataFrame([k for k in kept if k[1].split()], "doc_id bigint, text string, source string")
    place = {r["doc_id"]: r["p"] % (1 << 64) for r in frame.select("doc_id", F.xxhash64(F.lit(0), "doc_id", "text").alias("p")).collect()}
    laid = defaultdict(list)
    for i, text, source in sorted((k for k in kept if k[1].split()), key=lambda k: place[k[0]]):
        laid[source] += text.split()
    blocks = {s: [tuple(w[k : k + 1024]) for k in range(0, len(w), 1024)] for s, w in laid.items()}
    got = corpus_pipeline.run(spark, sf_dir)
    out = got.join(bpe.decode(got).select("doc_id", "text"), "doc_id").collect()
    assert len(out) == got.count() == sum(map(len, blocks.values()))
    drawn = defaultdict(Counter)
    for r in out:
        drawn[r["source"]][tuple(r["text"].split())] += 1
        assert list(r["tokens"]) == other.encode_ordinary(r["text"])
    for s, counts in drawn.items():  # blocks of the source alone, each drawn as often as the others or once more
        assert set(counts) <= set(blocks[s])
        assert max(counts.values()) - min(counts[b] for b in blocks[s]) <= 1


def test_empty_documents(spark, make, tmp_path):
    make([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nulls_repeats_and_clashing_columns(spark, make, prose, tmp_path):
    """Null ids, repeated ids and rows, null and empty texts, and further columns whose names operators use: no crash, and no clean document lost."""
    text = f"{prose(80, 3)} {GOOD}"
    rows = [(None, text, "a"), (None, None, "a"), (1, text, "a"), (1, text, "a"), (1, f"{prose(80, 4)} {GOOD}", None), (2, "", None), (3, None, "b"), (4, f"{prose(90, 5)} {GOOD} key: {HEX}", "b"), (5, f"{prose(90, 6)} {BAD}", "b")]
    rows += [(100 + k, f"{prose(60, 900 + k)} {BAD if k % 2 else GOOD}", "c") for k in range(40)]
    make(rows, True).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100 + k, 1, k % 2) for k in range(30)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path)).cache()
        if name != "tokens":
            assert docs.dtypes == before.dtypes, name
        if name == "secrets":
            kept = {(r["doc_id"], r["text"] is None) for r in docs.collect()}
            assert {(None, False), (None, True), (1, False), (2, False), (3, True), (4, False)} <= kept and (5, False) not in kept
            assert docs.where("doc_id = 1").count() == 2 and not docs.where(F.contains("text", F.lit(HEX))).count()
    assert docs.count() > 0 and docs.where("not lossless").count() == 0


@pytest.mark.parametrize("name", ["op1_warc", "op5_top_k"])
def test_sql_gives_the_same(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(registry.ORACLE_SQL[name]).fetchall()
    columns = [d[0] for d in con.sql(registry.ORACLE_SQL[name]).description]
    got = registry.QUERIES[name](spark, sf).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
