"""Splitting text into words, white space and the rest, and putting it together again."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hecespark.functions import chars
from hecespark.runtime import bind

#: Classes of characters, without their brackets. White space is written out: engines don't agree on \s.
WORD = "A-Za-z0-9çğıöşüÇĞİÖŞÜâîûêôÂÎÛÊÔ'’"
SPACE = "\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = f"[{WORD}]+|[{SPACE}]+|[^{WORD}{SPACE}]+"


def chunks(text) -> Column:
    """The text as runs of one class each; together they are the text. A null text has null."""
    return F.regexp_extract_all(chars._c(text), F.lit(CHUNK), F.lit(0))


def kind(chunk) -> Column:
    c = chars._c(chunk)
    return F.when(c.rlike(f"\\A[{WORD}]"), "word").when(c.rlike(f"\\A[{SPACE}]"), "space").otherwise("punct")


CHUNKS = re.compile(CHUNK)
WORDS = re.compile(f"[{WORD}]+")
_WORD, _SPACE = re.compile(f"[{WORD}]"), re.compile(f"[{SPACE}]")


def split(text: str) -> list[tuple[str, str]]:
    """(chunk, kind) of a string, as split_text() has them."""
    return [(c, "word" if _WORD.match(c) else "space" if _SPACE.match(c) else "punct") for c in CHUNKS.findall(text)]


def split_text(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, row, pos (from 0), chunk, kind: a row for each chunk; row numbers the rows of df, whose other columns may be null or repeat. Null and empty texts have none."""
    numbered = df.select(*keep, F.monotonically_increasing_id().alias("row"), chunks(text).alias("chunks"))
    return numbered.select(*keep, "row", F.posexplode("chunks").alias("pos", "chunk")).withColumn("kind", kind("chunk"))


def words_of(text) -> Column:
    return F.regexp_extract_all(chars._c(text), F.lit(f"[{WORD}]+"), F.lit(0))


def tokens(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, token: a row for each word, in small letters without circumflex. The text is translated whole: letters of words become letters of words."""
    return df.select(*keep, F.explode(words_of(chars.fold(chars.tr_lower(text)))).alias("token"))


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): the distinct words as written, and how often each occurs."""
    return df.select(F.explode(words_of(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def distinct_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """The distinct rows of tokens(); only distinct words are translated."""
    return df.select(F.explode(words_of(text)).alias("word")).distinct().select(chars.fold(chars.tr_lower("word")).alias("token")).distinct()


def top_tokens(df: DataFrame, k: int = 100, text: str = "text") -> DataFrame:
    """(token, n): the k most frequent words, ties by token."""
    return tokens(df, text).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(k)


def run_kernel(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    """keep, row, pos, chunk of runs of rows whose pos follow each other: the first pos, and the chunks as one, which they are in Arrow's memory."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        pos = batch.column("pos")
        joined = pc.fill_null(pc.equal(pc.subtract(pos.slice(1), pos.slice(0, n - 1)), 1), False)
        for c in (batch.column(k) for k in (*keep, "row")):
            a, b = c.slice(0, n - 1), c.slice(1)
            same = pc.is_null(a) if pa.types.is_nested(c.type) else pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
            joined = pc.and_(joined, pc.and_(same, pc.is_null(b)) if pa.types.is_nested(c.type) else same)
        starts = np.flatnonzero(np.concatenate(([True], ~joined.to_numpy(zero_copy_only=False))))
        chunk = pc.fill_null(batch.column("chunk").cast(pa.string()), "")
        ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + n + 1]
        runs = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(ends[starts], ends[n])), chunk.buffers()[2])
        first = batch.take(pa.array(starts))
        yield pa.RecordBatch.from_arrays([*(first.column(k) for k in (*keep, "row", "pos")), runs], names=[*keep, "row", "pos", "chunk"])


def rebuild_text(parts: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, text: the chunks of each row in the order of pos, of which a row has each once. Chunks that come one after the other are joined before they are shuffled."""
    given = parts.select(*keep, "row", "pos", "chunk")
    runs = given.mapInArrow(bind(__name__, "run_kernel", list(keep)), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema))
    return runs.groupBy(*keep, "row").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk"))).alias("p")).select(*keep, F.array_join("p.chunk", "").alias("text"))
