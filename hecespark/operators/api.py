"""Requests and responses as rows: what a service over the engine would answer."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from hecespark.functions import chars
from hecespark.operators import chart, clitic, correct, feats, parse, text
from hecespark.runtime import at_least, bind, values

LONGEST = 50_000
WORDS = f"word string, segments array<string>, analysis {feats.WIRE}, alternatives array<string>"
TOKENS = f"array<struct<kind:string,surface:string,analysis:{feats.WIRE},alternatives:array<string>,suggestions:array<string>>>"
#: Tokens that are sent at once, or one text's; different ones that a worker keeps, beyond that it starts again.
BATCH_TOKENS, KEPT_TOKENS = 50_000, 150_000


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(_parse_datatype_string(ddl))


def _answer(c: chart.Chart, word: str, alternatives: bool) -> tuple[dict | None, list[str]]:
    """The best analysis of a word as clients get it, and others."""
    every = c.all_of(word) if alternatives else [a for a in (c.best(word),) if a is not None]
    return (feats.wire_of(every[0], c.book) if every else None), feats.alternatives_of(every) if alternatives and every else []


def word_kernel(batches: Iterator[pa.RecordBatch], payload, schema: pa.Schema, alternatives: bool, clitics: bool) -> Iterator[pa.RecordBatch]:
    c = chart.of(payload)
    for batch in batches:
        words = batch.column("word").to_pylist()
        answers = [_answer(c, w, alternatives) for w in words]
        columns = [words, [clitic.pieces(c, w) if clitics else [w] for w in words], [a for a, _ in answers], [x for _, x in answers]]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)


class Tokens:
    """Tokens of chunks as places in an Arrow array, in which each different chunk is made once while it is kept."""

    def __init__(self, c: chart.Chart, kind: pa.DataType, alternatives: bool, clitics: bool):
        self.c, self.kind, self.alternatives, self.clitics = c, kind, alternatives, clitics
        self.begin()

    def begin(self) -> None:
        self.made, self.new, self.places = pa.array([], self.kind), [], chart.Kept(self.placed, sys.maxsize)

    def placed(self, chunk: str) -> range:
        first = len(self.made) + len(self.new)
        if text.WORDS.match(chunk):
            for p in clitic.pieces(self.c, chunk) if self.clitics else (chunk,):
                analysis, others = _answer(self.c, p, self.alternatives)
                self.new.append({"kind": "word", "surface": p, "analysis": analysis, "alternatives": others, "suggestions": []})
        else:
            self.new.append({"kind": text.split(chunk)[0][1], "surface": chunk, "analysis": None, "alternatives": [], "suggestions": []})
        return range(first, len(self.made) + len(self.new))

    def array(self, places: list[int]) -> pa.Array:
        if self.new:
            self.made, self.new = pa.concat_arrays([self.made, pa.array(self.new, self.kind)]), []
        out = self.made.take(pa.array(places, pa.int64()))
        if len(self.made) > KEPT_TOKENS:
            self.begin()
        return out


def text_kernel(batches: Iterator[pa.RecordBatch], payload, kind: pa.DataType, column: str, keep: list[str], alternatives: bool, clitics: bool) -> Iterator[pa.RecordBatch]:
    c = chart.of(payload)
    tokens = c.shared(("tokens", alternatives, clitics), lambda: Tokens(c, kind.value_type, alternatives, clitics))
    for batch in batches:
        places, ends, at = [], [0], 0
        for k, x in enumerate(values(batch.column(column)), 1):
            for found in map(tokens.places.__getitem__, text.CHUNKS.findall(x or "")):
                places += found
            ends.append(len(places))
            if len(places) >= BATCH_TOKENS or k == batch.num_rows:
                part = batch.slice(at, k - at)
                made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens.array(places), type=kind)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), made], names=[*keep, "tokens"])
                places, ends, at = [], [0], k


def suggestions(words: DataFrame, tail_repair: bool = True, **options) -> DataFrame:
    """(word, suggestions) of distinct words of no known root: corrections, or else roots nearby. Words without either have no row."""
    lists = lambda df, c: df.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(c).alias("x")))).alias("p")).select("word", F.col("p.x").alias(f"by_{c}"))
    near = {k: v for k, v in options.items() if k == "roots"}
    both = lists(correct.correct(words, tail_repair, **options), "corrected").join(lists(correct.suggest(words, **near), "lemma"), "word", "full")
    return both.select("word", F.coalesce("by_corrected", "by_lemma").alias("suggestions"))


def tokenize(words: DataFrame, suggest: bool = True, alternatives: bool = True, clitics: bool = True, tail_repair: bool = True, **options) -> DataFrame:
    """(word, parsed, error, segments, analysis, suggestions, alternatives) of distinct words, trimmed. An empty one has the error 'empty input', one that
    nothing explains 'no parse'. A word with a particle has its segments. Suggestions are for words of no known root: see suggestions()."""
    given = parse.spread(words.select(F.trim("word").alias("word")).where("word is not null").distinct(), "word")
    out = given.mapInArrow(bind(__name__, "word_kernel", parse.held(words.sparkSession, **options), _arrow(WORDS), alternatives, clitics), WORDS)
    empty = F.array().cast("array<string>")
    if suggest:
        out = out.join(suggestions(out.where("analysis is null or analysis.oov").select("word"), tail_repair, **options), "word", "left")
        out = out.withColumn("suggestions", F.coalesce("suggestions", empty))
    else:
        out = out.withColumn("suggestions", empty)
    error = F.when(F.col("word") == "", "empty input").when(F.col("analysis").isNull(), "no parse")
    return out.select("word", F.col("analysis").isNotNull().alias("parsed"), error.alias("error"), "segments", "analysis", "suggestions", "alternatives")


def tokenize_text(texts: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), suggest: bool = False, alternatives: bool = False, clitics: bool = True, tail_repair: bool = True, **options) -> DataFrame:
    """keep, tokens: all chunks of each row's text in their order, as structs (kind, surface, analysis, alternatives, suggestions).

    Surfaces put together are the text; words with a particle are two tokens. analysis is null for what is no word and for words that nothing
    explains; a null or empty text has no tokens. Rows stay rows, whatever their ids. Without ``suggest`` texts are read where they are;
    with it distinct unknown words are looked up in one shuffle and joined to the texts that have them.
    """
    if "tokens" in {k.lower() for k in keep}:
        raise ValueError("a column named tokens can't be kept: it is the result")
    given = at_least(texts.select(*keep, *([text] if text not in keep else [])))
    kept = "".join(f"`{c}` {texts.schema[c].dataType.simpleString()}, " for c in keep)
    out = given.mapInArrow(bind(__name__, "text_kernel", parse.held(texts.sparkSession, **options), _arrow(f"tokens {TOKENS}")[0].type, text, list(keep), alternatives, clitics), f"{kept}tokens {TOKENS}")
    empty = F.array().cast("array<string>")
    if not suggest:
        return out
    # equal rows have equal suggestions: a row's own columns and a hash of its surfaces stand for it
    row = F.xxhash64(*(F.col(k) for k in keep), F.col("tokens.surface"))
    out = out.withColumn("_row", row)
    unknown = F.array_distinct(F.filter("tokens", lambda t: (t["kind"] == "word") & (t["analysis"].isNull() | t["analysis"]["oov"]))["surface"])
    asked = out.select("_row", F.explode(unknown).alias("word")).distinct()
    found = asked.join(suggestions(asked.select("word"), tail_repair, **options), "word").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("word", "suggestions"))).alias("_found"))
    joined = out.join(found, "_row", "left")
    look = lambda t: F.when(t["kind"] == "word", F.coalesce(F.try_element_at("_found", t["surface"]), empty)).otherwise(empty)
    return joined.select(*keep, F.transform("tokens", lambda t: t.withField("suggestions", look(t))).alias("tokens"))


def responses(requests: DataFrame, **options) -> DataFrame:
    """(request_id, status, body) of requests (request_id, word): 400 where the word is missing or longer than LONGEST, else 200 with the analysis as JSON."""
    bad = F.col("word").isNull() | (F.trim("word") == "")
    long = F.coalesce(F.length(F.trim("word")) > LONGEST, F.lit(False))
    r = requests.select("request_id", F.trim("word").alias("word"), F.when(bad, "missing word").when(long, "too long").alias("fault"))
    answers = tokenize(r.where("fault is null").select("word"), **options)
    j = r.join(answers.withColumnRenamed("word", "key"), r["word"] == F.col("key"), "left")
    body = F.when(F.col("fault").isNotNull(), F.to_json(F.struct(F.col("fault").alias("error")))).otherwise(F.to_json(F.struct("word", "parsed", "error", "segments", "analysis", "suggestions", "alternatives")))
    return j.select("request_id", F.when(F.col("fault").isNotNull(), 400).otherwise(200).alias("status"), body.alias("body"))


def text_responses(requests: DataFrame, longest: int = LONGEST, **options) -> DataFrame:
    """(request_id, status, body) of requests (request_id, body: {"text", "options"} as JSON): 400 where the body is no JSON, has no text or one of
    more than ``longest`` characters; else 200 with the text and its tokens. Of its options split_clitics and alternatives are followed, in whatever
    spelling chars.to_bool() knows; those that are absent are as in ``options``. Rows stay rows, whatever their ids."""
    parsed = F.from_json("body", "text string, options map<string,string>, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    r = requests.select("request_id", (F.col("body").isNotNull() & (F.trim("body") != "")).alias("there"), parsed.alias("b"))
    text = F.trim(F.coalesce("b.text", F.lit("")))
    fault = F.when(F.col("there") & F.col("b._bad").isNotNull(), "invalid JSON body").when(text == "", "missing 'text' field").when(F.length(text) > longest, f"text too long (max {longest} chars)")
    wanted = lambda name, default: F.coalesce(chars.to_bool(F.try_element_at(F.col("b.options"), F.lit(name))), F.lit(default))
    r = r.select("request_id", fault.alias("fault"), text.alias("text"), wanted("split_clitics", options.pop("clitics", True)).alias("clitics"), wanted("alternatives", options.pop("alternatives", False)).alias("others"))
    out = r.where("fault is not null").select("request_id", F.lit(400).alias("status"), F.to_json(F.struct(F.col("fault").alias("error"))).alias("body"))
    for clitics in (True, False):
        for others in (True, False):
            asked = r.where(F.col("fault").isNull() & (F.col("clitics") == clitics) & (F.col("others") == others))
            made = tokenize_text(asked, keep=("request_id", "text"), clitics=clitics, alternatives=others, **options)
            out = out.unionByName(made.select("request_id", F.lit(200).alias("status"), F.to_json(F.struct("text", "tokens")).alias("body")))
    return out
