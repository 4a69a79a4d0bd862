"""Mixing sources to target weights.

Documents of a source are laid end to end, in the order of a hash of each, and cut into blocks of a fixed number of
tokens. Where a document begins is a sum over those before it, taken level by level over the leading bits of the hash: no task sees all
of a source, however ids are spread and however many are null. Each output shard draws from a multinomial how many of its slots each source gets. The j-th slot that a
source gets over all shards takes the block at place j of a pseudorandom permutation of the source's block
numbers; a source that is drawn beyond its blocks starts another epoch with another permutation. Slots then
meet blocks in one equi-join. Nothing is sorted globally and no block is moved twice.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hecespark.llm.arrow import mixed
from hecespark.runtime import bind, cut

#: A token is a word with the white space before it; the last of a text also takes that after it.
TOKEN = r"\s*\S+(?:\s+\z)?"
BLOCK_TOKENS, SHARD_SLOTS, SEED = 1024, 512, 20240501
#: Without given weights, a source weighs its share of the tokens to this power.
TEMPER = 0.5
#: Bits of a level: a task sums 2 ** LEVEL buckets of a source at most. Two levels of them part a source's documents.
LEVEL = 12


def before(df: DataFrame, by: tuple[str, ...], order: str, value: str) -> Column:
    """The sum of value over the rows before this one: a column for df, whose rows of one ``by`` are at most 2 ** LEVEL."""
    return F.sum(value).over(Window.partitionBy(*by).orderBy(order)) - F.col(value)


def pack(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Blocks (key, block, n_tokens, lang, doc_ids, text), and (key, total) sums of tokens over buckets of documents.

    ``key`` is the source with a 1 before it, or 0 for documents without one. Texts that are null or have no
    word add nothing; repeated rows each count; null ids are like others. Pieces of different documents in a block are
    parted by a line break. A source's last block holds what is left, so that no token is lost.
    """
    key = F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("source")))
    rows = docs.select(key.alias("key"), F.col("doc_id").alias("id"), F.xxhash64(F.lit(0), "doc_id", "text").alias("place"), F.col("lang").alias("lang"), F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("n"), F.col("text").alias("text")).where("n > 0")
    rows = rows.withColumns({"high": F.shiftrightunsigned("place", 64 - LEVEL), "low": F.shiftrightunsigned("place", 64 - 2 * LEVEL).bitwiseAND((1 << LEVEL) - 1)})
    sums = cut(rows.groupBy("key", "high", "low").agg(F.sum("n").alias("total")))  # as many rows as there are documents at most, without their texts
    above = sums.groupBy("key", "high").agg(F.sum("total").alias("whole"))
    above = above.select("key", "high", before(above, ("key",), "high", "whole").alias("above"))
    starts = sums.withColumn("inner", before(sums, ("key", "high"), "low", "total")).join(above, ["key", "high"]).select("key", "high", "low", (F.col("above") + F.col("inner")).alias("before"))
    within = Window.partitionBy("key", "high", "low").orderBy("place", "id", "text").rowsBetween(Window.unboundedPreceding, 0)
    # starts grow with the documents: no broadcast but by their measured size; the documents are partitioned for the window already
    placed = rows.withColumn("at", F.sum("n").over(within) - F.col("n")).join(starts.hint("shuffle_hash"), ["key", "high", "low"])
    start = F.col("before") + F.col("at")
    b = F.lit(block_tokens).cast("long")
    placed = placed.select("key", "id", "lang", "n", start.alias("start"), F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("tokens"))

    def piece(block):
        low = F.greatest(block * b - F.col("start"), F.lit(0).cast("long"))
        high = F.least((block + 1) * b - F.col("start"), F.col("n"))
        return F.struct(block.alias("block"), (F.col("start") + low - block * b).alias("at"), (high - low).alias("n"), F.array_join(F.slice("tokens", (low + 1).cast("int"), (high - low).cast("int")), "").alias("text"))

    spans = F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("n") - 1) / b))
    pieces = placed.select("key", "id", "lang", F.explode(F.transform(spans, piece)).alias("p"))
    pieces = pieces.select("key", F.col("p.block").alias("block"), F.struct("p.at", "id", "lang", "p.n", "p.text").alias("p"))
    blocks = pieces.groupBy("key", "block").agg(F.sort_array(F.collect_list("p")).alias("p"))
    blocks = blocks.select("key", "block", F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n_tokens"), F.col("p")[0]["lang"].alias("lang"), F.array_compact(F.transform("p", lambda x: x["id"])).alias("doc_ids"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    return blocks, sums


def permute(x: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The image of each x in a pseudorandom permutation of 0 .. n-1, by its seed: four Feistel rounds, walked until within n."""
    n = n.astype(np.int64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.astype(np.uint64), np.arange(len(x))
    while len(todo):
        h, m, s = half[todo], mask[todo], seed[todo].astype(np.uint64)
        left, right = out[todo] >> h, out[todo] & m
        for k in range(4):
            left, right = right, left ^ (mixed(right + s * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def draw_kernel(batches: Iterator[pa.RecordBatch], keys: list[str], weights: list[float], slots: int, total: int, seed: int) -> Iterator[pa.RecordBatch]:
    """For each shard, how many of its slots each source gets, and the first of them in the order of the sources."""
    p = np.array(weights) / np.sum(weights)
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        counts = np.array([np.random.default_rng([seed, s]).multinomial(min(slots, total - s * slots), p) for s in shards.tolist()], np.int64).reshape(len(shards), len(keys))
        first = np.cumsum(counts, axis=1) - counts
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(shards, len(keys))), pa.array(keys * len(shards), pa.string()), pa.array(counts.ravel()), pa.array(first.ravel()), pa.array(np.repeat(counts.sum(axis=1), len(keys)))], names=["shard", "key", "drawn", "first", "size"])


def slot_kernel(batches: Iterator[pa.RecordBatch], n_blocks: dict[str, int], seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shard, j, place, size = (batch.column(c).to_numpy() for c in ("shard", "j", "place", "size"))
        keys = batch.column("key").dictionary_encode()
        known = keys.dictionary.to_pylist()
        n = np.array([n_blocks[k] for k in known], np.int64)[keys.indices.to_numpy()]
        crc = np.array([zlib.crc32(k.encode()) for k in known], np.int64)[keys.indices.to_numpy()]
        epoch = j // n
        block = permute(j % n, n, mixed((crc + (epoch << 32) + seed).astype(np.uint64)))
        slot = permute(place, size, mixed((shard + (seed << 20)).astype(np.uint64)))
        yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(slot), batch.column("key"), pa.array(epoch), pa.array(block)], names=["shard", "slot", "key", "epoch", "block"])


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_tokens: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, seed: int = SEED, total_slots: int | None = None) -> DataFrame:
    """Rows (shard, slot, source, block, epoch, n_tokens, lang, doc_ids, text): as many slots as there are blocks, or total_slots.

    ``weights`` maps sources (None: documents without one) to target weights, which needn't add up to 1; a source that is not in it, or
    weighs 0, is left out. Slots are shuffled within a shard. Only the sums per source reach the driver. No
    documents with words, or no weight for any of them: no rows. Of docs only doc_id, source, lang and text are read.
    """
    spark = docs.sparkSession
    blocks, sums = pack(docs, block_tokens)
    have = {r["key"]: r["t"] for r in sums.groupBy("key").agg(F.sum("total").alias("t")).collect()}
    if weights is None:
        wanted = {k: t**TEMPER for k, t in have.items()}
    else:
        named = {"0" if s is None else "1" + s: w for s, w in weights.items()}
        wanted = {k: float(named[k]) for k in have if named.get(k, 0) > 0}
    n_blocks = {k: -(-have[k] // block_tokens) for k in wanted}
    keys = sorted(wanted)
    total = (total_slots if total_slots is not None else sum(n_blocks.values())) if keys else 0
    shards = -(-total // shard_slots)
    drawn = spark.range(shards).withColumnRenamed("id", "shard").mapInArrow(bind(__name__, "draw_kernel", keys or ["0"], [wanted[k] for k in keys] or [1.0], shard_slots, total, seed), "shard bigint, key string, drawn bigint, first bigint, size bigint")
    drawn = drawn.where("drawn > 0").withColumn("group", F.shiftright("shard", LEVEL))
    groups = drawn.groupBy("key", "group").agg(F.sum("drawn").alias("whole"))
    groups = groups.select("key", "group", before(groups, ("key",), "group", "whole").alias("above"))
    drawn = drawn.withColumn("inner", before(drawn, ("key", "group"), "shard", "drawn")).join(groups, ["key", "group"]).withColumn("base", F.col("above") + F.col("inner"))
    slots = drawn.select("shard", "key", "base", "first", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("drawn") - 1)).alias("k"))
    slots = slots.select("shard", "key", "size", (F.col("base") + F.col("k")).alias("j"), (F.col("first") + F.col("k")).alias("place"))
    slots = slots.mapInArrow(bind(__name__, "slot_kernel", n_blocks, seed), "shard bigint, slot bigint, key string, epoch bigint, block bigint")
    source = F.when(F.col("key") != "0", F.expr("substring(key, 2)"))
    # slots grow with the input, while the planner takes them for small: no broadcast. Blocks are partitioned by the key already, and aren't sorted.
    return blocks.join(slots.hint("shuffle_hash"), ["key", "block"]).select("shard", "slot", source.alias("source"), "block", "epoch", "n_tokens", "lang", "doc_ids", "text")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The slots of mix() with the columns of docs: doc_id numbers them over all shards, lang is that of a
    block's first piece, n_chars the length of its text; columns of other names are null. Which documents a block is made of, mix() tells."""
    slots = options.get("shard_slots", SHARD_SLOTS)
    out = mix(docs, **options)
    made = {"doc_id": F.col("shard") * slots + F.col("slot"), "text": F.col("text"), "lang": F.col("lang"), "source": F.col("source"), "n_chars": F.length("text")}
    return out.select(*(made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in docs.schema))
