"""Exact top-k search among binary codes by incremental multi-index hashing.

A code is 64 bits in segments, about as many that a segment has as many values as there are codes. The index has a row for each code and
segment, by the segment's value. Round r looks up, for each query that is still open, all values at distance r of its own in each segment; what
meets is verified by its full distance. After round r no code at distance segments * (r + 1) - 1 or less can have been missed: a query whose k-th
verified distance is at most that is done, and leaves. Equal codes are one row of the index that holds their k + 1 smallest ids: ties go by id, so
that no others can be among the k nearest, and a code that a third of all rows share costs what any other does. Where a radius has more
values than there are codes, the queries that are still open (far from all others, or with few others) are held against every code instead.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hecespark.runtime import bind, cut

BITS, K = 64, 10
#: Queries that are sent to all codes together, and codes below which that is always cheap.
QUERY_BLOCK, FEWEST = 1 << 15, 1 << 10
#: Queries are the rows whose id is divisible by this.
EVERY = 50


def codes_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc

    for batch in batches:
        e = batch.column("embedding")
        fine = pc.fill_null(pc.equal(pc.list_value_length(e), BITS), False)
        kept = batch.filter(fine)
        values = np.nan_to_num(kept.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, BITS)
        code = np.packbits(values > 0, axis=1).view(">u8").astype(np.uint64).view(np.int64).ravel() if len(values) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([kept.column("vec_id"), pa.array(code)], names=["vec_id", "code"])


def codes(embeddings: DataFrame) -> DataFrame:
    """(vec_id, code): the sign bit of each of 64 dimensions (1 where it is above 0; a null or NaN isn't). Rows without an id or with
    another number of dimensions have none; of rows that share a vec_id the smallest code counts."""
    return embeddings.select("vec_id", "embedding").where("vec_id is not null and embedding is not null").mapInArrow(bind(__name__, "codes_kernel"), "vec_id bigint, code bigint").groupBy("vec_id").agg(F.min("code").alias("code"))


def segments_for(n: int) -> int:
    """How many segments suit n codes: a power of two from 2 to 8, with about log2(n) bits in each."""
    bits = np.log2(max(n, 2))
    return min((2, 4, 8), key=lambda m: abs(BITS / m - bits))


@cache
def masks(radius: int, bits: int) -> list[int]:
    return [sum(1 << b for b in c) for c in itertools.combinations(range(bits), radius)]


def segment(code: Column, s: int, bits: int) -> Column:
    return F.shiftrightunsigned(code, s * bits).bitwiseAND((1 << bits) - 1)


def probe_kernel(batches: Iterator[pa.RecordBatch], radius: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, query, bound, s, value): all values at the distance of each segment's own, a few at a time."""
    flips = np.array(masks(radius, bits), np.int64)
    low = np.uint64((1 << bits) - 1)
    for batch in batches:
        step = max(1, (1 << 18) // len(flips))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            code = part.column("query").to_numpy().view(np.uint64)
            take = pa.array(np.repeat(np.arange(len(code)), len(flips)))
            for s in range(BITS // bits):
                value = ((code >> np.uint64(s * bits)) & low).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("vec_id").take(take), part.column("query").take(take), part.column("bound").take(take), pa.array(np.full(len(take), s, np.int32)), pa.array((value[:, None] ^ flips[None, :]).ravel())], names=["vec_id", "query", "bound", "s", "value"])


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY, segments: int | None = None) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): for every coded row whose id is divisible by ``every`` its k nearest others by Hamming distance, ties by neighbor_id.

    All coded rows are searched. A row with fewer than k others has fewer; a lone row has none. See codes() for rows that are not coded.
    """
    spark = embeddings.sparkSession
    base = cut(codes(embeddings))
    total = base.count()
    m = segments or segments_for(total)
    bits = BITS // m
    smallest = F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))
    index = base.withColumn("n", smallest).where(F.col("n") <= k + 1).groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("s"), segment(F.col("code"), s, bits).alias("value")) for s in range(m))))
    index = cut(index.select("code", "ids", each.alias("x")).select("x.s", "x.value", "code", "ids"))
    queries = base.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", F.col("code").alias("query"))
    open_ = queries.withColumn("bound", F.lit(BITS))
    best = spark.createDataFrame([], "vec_id bigint, neighbor_id bigint, distance int")
    nearest = F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "neighbor_id"))
    ranked = lambda found: cut(found.withColumn("n", nearest).where(F.col("n") <= k).drop("n"))
    n_codes = index.count() // m
    for radius in range(bits + 1):
        if math.comb(bits, radius) > max(n_codes, FEWEST):
            best = ranked(best.join(open_, "vec_id", "left_anti").unionByName(scanned(open_, index.where("s = 0"), k)))
            break
        probes = open_.select("vec_id", "query", "bound").mapInArrow(bind(__name__, "probe_kernel", radius, bits), "vec_id bigint, query bigint, bound int, s int, value bigint")
        met = probes.join(index, ["s", "value"])
        x = F.col("query").bitwiseXOR(F.col("code"))
        met = met.select("vec_id", "bound", "s", "ids", x.alias("x"), F.bit_count(x).alias("distance")).where("distance <= bound")
        # a pair counts where it first turns up: at this radius in no segment before, at smaller ones in none
        for t in range(m):
            apart = F.bit_count(segment(F.col("x"), t, bits))
            met = met.where((F.col("s") == t) | (apart > F.lit(radius) - (F.col("s") < t).cast("int")))
        found = met.select("vec_id", "distance", F.explode("ids").alias("neighbor_id")).where("neighbor_id <> vec_id").select("vec_id", "neighbor_id", "distance")
        best = ranked(best.unionByName(found))
        state = best.groupBy("vec_id").agg(F.count("*").alias("n"), F.max("distance").alias("reach"))
        left = queries.join(state, "vec_id", "left").withColumn("bound", F.when(F.col("n") >= k, F.col("reach")).otherwise(F.lit(BITS)))
        open_ = cut(left.where((F.col("bound") > m * (radius + 1) - 1) & (F.coalesce("n", F.lit(0)) < total - 1)).select("vec_id", "query", "bound"))
        if open_.isEmpty():
            break
    return best.withColumn("rank", nearest).select("vec_id", "rank", "neighbor_id", "distance")


def scan_kernel(batches: Iterator[pa.RecordBatch], queries: np.ndarray, asked: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest of each query among a batch's codes."""
    for batch in batches:
        ids = batch.column("ids")
        each = np.repeat(batch.column("code").to_numpy().view(np.uint64), np.diff(ids.offsets.to_numpy()))
        flat = ids.flatten().to_numpy()
        order = np.argsort(flat)  # so that a stable sort by distance leaves ties by id
        flat, each = flat[order], each[order]
        step = max(1, (1 << 22) // max(1, len(flat)))
        for at in range(0, len(queries), step):
            d = np.bitwise_count(asked[at : at + step, None] ^ each[None, :])
            d[queries[at : at + step, None] == flat[None, :]] = BITS + 1
            first = np.argsort(d, axis=1, kind="stable")[:, :k]
            near = np.take_along_axis(d, first, axis=1)
            row, column = np.nonzero(near <= BITS)
            yield pa.RecordBatch.from_arrays([pa.array(queries[at : at + step][row]), pa.array(flat[first[row, column]]), pa.array(near[row, column].astype(np.int32))], names=["vec_id", "neighbor_id", "distance"])


def scanned(open_: DataFrame, codes: DataFrame, k: int) -> DataFrame:
    """Candidates (vec_id, neighbor_id, distance) of queries for which a look at every code is less than another radius: QUERY_BLOCK of them at a time are sent to all codes."""
    n = open_.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    out = None
    for b in range(blocks):
        block = open_.where(part == b).select("vec_id", "query").toPandas()
        found = codes.mapInArrow(bind(__name__, "scan_kernel", block["vec_id"].to_numpy(np.int64), block["query"].to_numpy(np.int64).view(np.uint64), k), "vec_id bigint, neighbor_id bigint, distance int")
        out = found if out is None else out.unionByName(found)
    return out


SQL = f"""
WITH c AS (
  SELECT vec_id, list_transform(embedding, lambda x: coalesce(x > 0 AND NOT isnan(x), false)) AS bits FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = {BITS}),
u AS (SELECT vec_id, list_sum(list_transform(bits, lambda b, i: CASE WHEN b THEN 1::HUGEINT << ({BITS} - i) ELSE 0::HUGEINT END))::HUGEINT AS code FROM c),
d AS (SELECT a.vec_id, b.vec_id AS neighbor_id, bit_count(xor(a.code, b.code))::INTEGER AS distance FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id)::INTEGER AS rank FROM d)
SELECT vec_id, rank, neighbor_id, distance FROM r WHERE rank <= {K}
"""
