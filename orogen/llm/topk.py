"""Exact top-k inner products: block-at-a-time pruning over ranges of similar vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orogen.llm.common import cut

BLOCK = 512  # vectors of a block: a document range with its forward index and the extremes of every term
QUERY_BLOCK = 512
SHARD = 64  # blocks that one task searches for some blocks of queries
QUERY_SHARD = 8  # blocks of queries that go to a shard together: the whole index is sent once for so many
PIVOTS = 64  # vectors that order the ranges; any choice gives the same result
_EXACT = 2.0**53


def _pack(ids: np.ndarray, matrix: np.ndarray) -> dict:
    return {"ids": ids.astype("<i8").tobytes(), "width": matrix.shape[1], "terms": matrix.astype("<i8" if max(matrix.max(initial=0), -1 - matrix.min(initial=0)) >= 1 << 15 else "<i2").tobytes(), "high": matrix.max(axis=0).astype("<i8").tobytes(), "low": matrix.min(axis=0).astype("<i8").tobytes()}


def _unpack(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    raw = row["terms"]
    kind = "<i2" if len(raw) == 2 * len(ids) * row["width"] else "<i8"
    return ids, np.frombuffer(raw, kind).astype(np.int64).reshape(len(ids), row["width"])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows: in double precision where every partial sum fits it, else in 64-bit integers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if np.abs(a.astype(np.float64)).max(initial=0) * np.abs(b.astype(np.float64)).max(initial=0) * max(1, width) < _EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For every query and block, no less than the sum over terms of the most that the block's range of the term can give.

    The sum is in double precision; what rounding can take from it is in proportion to the sum of the terms' absolute values, not to the sum itself, and is added. Where sums can pass
    the 64-bit range scores wrap, and the bound is infinite.
    """
    width = min(queries.shape[1], high.shape[1])
    q, high, low = queries[:, :width].astype(np.float64), high[:, :width].astype(np.float64), low[:, :width].astype(np.float64)
    size = np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T
    return np.where(size < 2.0**62, np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T + size * (width + 8) * 2.0**-52, np.inf)


def integers(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, terms array<long>): floor(scale * component), at the ends of the 64-bit range where it passes them; rows with a null id, a null vector, or null or non-finite components are left out."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * scale))
    fine = F.forall(F.col("embedding").cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long"), v.alias("terms"))


def blocks(rows: DataFrame, size: int, pivots: np.ndarray | None = None) -> DataFrame:
    """Blocks of up to size rows: block id, ids, width, terms, high, low. With pivots, ranges follow the nearest pivot."""
    fields = [("block", pa.int64()), ("width", pa.int64()), ("ids", pa.binary()), ("terms", pa.binary()), ("high", pa.binary()), ("low", pa.binary())]
    schema = pa.schema(fields)

    def place(batches):
        for b in batches:
            own = b.column(1).to_pylist()
            at = np.zeros(len(own), np.int64)
            if pivots is not None and len(pivots):
                for width in {len(v) for v in own}:
                    pick = [i for i, v in enumerate(own) if len(v) == width]
                    at[pick] = products(np.array([own[i] for i in pick], np.int64).reshape(len(pick), width), pivots).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at)], ["vec_id", "terms", "place"])

    def pack(batches):
        from pyspark import TaskContext

        n, ids, terms = 0, [], []
        base = TaskContext.get().partitionId() << 32

        def out():
            nonlocal n, ids, terms
            for width in sorted({len(v) for v in terms}):
                pick = [i for i, v in enumerate(terms) if len(v) == width]
                p = _pack(np.array([ids[i] for i in pick]), np.array([terms[i] for i in pick], np.int64).reshape(len(pick), width))
                yield pa.RecordBatch.from_pydict({"block": [base + n], **{k: [p[k]] for k in schema.names[1:]}}, schema)
                n += 1
            ids, terms = [], []

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                terms.append(v)
                if len(ids) == size:
                    yield from out()
        yield from out()

    placed = rows.mapInArrow(place, "vec_id long, terms array<bigint>, place long")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = placed.repartitionByRange(parts, "place", "vec_id").sortWithinPartitions("place", "vec_id").select("vec_id", "terms")
    return ranged.mapInArrow(pack, "block long, width long, ids binary, terms binary, high binary, low binary")


def search_shard(queries: np.ndarray, query_ids: np.ndarray, own: list, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The k best rows of a shard's blocks for every query of a block.

    Blocks come in the order of the summed extremes of their terms; a query's search ends at the first block whose bound is below its kth score.
    """
    bounds = _bounds(queries, np.stack([np.frombuffer(r["high"], "<i8") for r in own]), np.stack([np.frombuffer(r["low"], "<i8") for r in own]))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in query_ids]
    order = np.argsort(-bounds, axis=1, kind="stable")
    floor = np.full(len(query_ids), -np.inf)
    decoded = [_unpack(r) for r in own]
    for step in range(len(own)):
        at = order[:, step]
        live = bounds[np.arange(len(at)), at] >= floor
        if not live.any():
            break
        for block in np.unique(at[live]):
            who = np.flatnonzero(live & (at == block))
            ids, terms = decoded[block]
            scores = products(queries[who], terms)
            for row, q in enumerate(who):
                take = (scores[row] >= floor[q]) & (ids != query_ids[q])
                if take.any():
                    found[q] = best(np.concatenate([found[q][0], ids[take]]), np.concatenate([found[q][1], scores[row][take]]), k)
                    if len(found[q][0]) == k:
                        floor[q] = found[q][1][-1]
    return found


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by every, the k others with the largest inner product.

    Components are floor(64 * x); ties go to the smaller vec_id. A query with no other row has no result. Vectors that are null or
    hold null or non-finite components take no part. Of vectors of different lengths the common beginning counts. Repeated ids
    are candidates row by row (the query's own id never), and a repeated query id is searched with its smallest vector. Scores are 64-bit integers; where one would pass that range it wraps. An empty table gives an empty result.
    """
    rows = integers(vectors)
    spark = rows.sparkSession
    ordered = rows.orderBy(F.xxhash64("vec_id", "terms"), "vec_id").limit(PIVOTS).collect()
    width = max((len(r.terms) for r in ordered), default=0)
    pivots = np.array([[*r.terms, *[0] * (width - len(r.terms))] for r in ordered], np.int64).reshape(len(ordered), width)
    docs = cut(blocks(rows, BLOCK, pivots), "blocks")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("terms").alias("terms"))
    asks = cut(blocks(asked, QUERY_BLOCK), "queries").select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("width").alias("q_width"), F.col("terms").alias("q_terms"))

    shards = docs.withColumn("shard", F.concat_ws("-", "width", F.shiftright("block", 32), F.floor(F.col("block").bitwiseAND(F.lit((1 << 32) - 1)) / SHARD)))
    own_shard = lambda block, size: F.concat_ws("-", F.shiftright(block, 32), F.floor(F.col(block).bitwiseAND(F.lit((1 << 32) - 1)) / size))
    asks = asks.withColumn("a", own_shard("q_block", QUERY_SHARD))
    cells = asks.select("a").distinct().crossJoin(shards.select(F.col("shard").alias("b")).distinct())  # blocks of a stated query set against blocks of all rows
    work = cells.join(asks, "a").select("a", "b", "q_ids", "q_width", "q_terms")
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("query_id", "vec_id", "score")])

    def search(key, left, right):
        own, found, ids = right.to_dict("records"), [], []
        for q in left.itertuples() if own else ():
            query_ids, queries = _unpack({"ids": q.q_ids, "width": q.q_width, "terms": q.q_terms})
            found += search_shard(queries, query_ids, own, k)
            ids.append(query_ids)
        none = np.zeros(0, np.int64)
        return pd.DataFrame({"query_id": np.repeat(np.concatenate([none, *ids]), [len(f[0]) for f in found]), "vec_id": np.concatenate([none, *(f[0] for f in found)]), "score": np.concatenate([none, *(f[1] for f in found)])})

    replicated = cells.join(shards, cells["b"] == shards["shard"]).select(F.col("a").alias("c"), F.col("b").alias("d"), "ids", "width", "terms", "high", "low")
    hits = work.groupBy("a", "b").cogroup(replicated.groupBy("c", "d")).applyInPandas(search, schema)
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))  # Spark keeps k rows a query before the shuffle
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
