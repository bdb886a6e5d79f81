"""Exact top-k search by inner product: tiles of a matrix product, partial selection, tree merging.

Queries and vectors are dealt to blocks by a hash of their id; blocks have so many vectors as ``QUERY_BYTES`` and
``SHARD_BYTES`` hold. Every pair of a query block and a shard is a cell and one task's work: queries go through in
tiles, one matrix product per tile in double precision, a partial selection (not a sort) of the k best of each query,
and only those leave the task. The lists of a query are merged eight at a time until one is left, so no task holds more
than eight lists per query. A vector is copied once for each query block, a query once for each shard.

``queries`` says which rows ask, all by default; every row answers. A row is no answer to itself. Equal scores go to
the smaller id.

Cases: rows with a null id, or with a vector that is null, empty or has a null, NaN or infinite element, neither
ask nor answer; ``left_out`` counts them. A query is answered by vectors of its own length, since others have no product
with it. Of rows with the same id and length the one with the least vector counts. A query with fewer than
k others gets all of them. Empty tables give empty results; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

K = 10
#: A task holds a block of queries, a shard, and one tile of scores.
QUERY_BYTES, SHARD_BYTES, TILE_ROWS = 64 << 20, 16 << 20, 512
#: The set of queries of ``op9_topk``.
EVERY = 50
FAN_IN = 8


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the k best (score, id), best first, equal scores by the smaller id; exact under ties."""
    n = scores.shape[1]
    if n > k:
        cut = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        row, col = np.nonzero(scores >= cut[:, None])  # more than k where the last score is tied
    else:
        row, col = np.nonzero(scores > -np.inf)
    s, i = scores[row, col], ids[col]
    ok = s > -np.inf
    row, s, i = row[ok], s[ok], i[ok]
    order = np.lexsort((i, -s, row))
    row, s, i = row[order], s[order], i[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    best_s, best_i = np.full((len(scores), k), -np.inf), np.full((len(scores), k), -1, np.int64)
    top = rank < k
    best_s[row[top], rank[top]], best_i[row[top], rank[top]] = s[top], i[top]
    return best_s, best_i


def _vectors(t: pa.Table, names: tuple[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block, each id once with its least vector."""
    ids, col = t.column(names[0]).to_numpy(), t.column(names[1]).combine_chunks()
    x = np.asarray(col.flatten(), dtype=np.float64).reshape(len(col), -1)
    if len(np.unique(ids)) < len(ids):
        order = np.lexsort((*x.T[::-1], ids))
        order = order[np.r_[True, ids[order[1:]] != ids[order[:-1]]]]
        ids, x = ids[order], x[order]
    return ids, x


def _cell(k: int):
    kind = pa.list_(pa.struct([("s", pa.float64()), ("id", pa.int64())]))

    def cell(queries: pa.Table, shard: pa.Table) -> pa.Table:
        if not queries.num_rows or not shard.num_rows:  # a side without rows comes without columns
            return pa.table({"vec_id": pa.array([], pa.int64()), "part": pa.array([], pa.int64()), "best": pa.array([], kind)})
        asks, q = _vectors(queries, ("vec_id", "embedding"))
        ids, x = _vectors(shard, ("other", "vector"))
        out_s, out_i = [], []
        for lo in range(0, len(asks), TILE_ROWS):
            scores = q[lo : lo + TILE_ROWS] @ x.T
            own, at = np.nonzero(asks[lo : lo + TILE_ROWS, None] == ids[None])
            scores[own, at] = -np.inf
            s, i = select(scores, ids, k)
            out_s.append(s)
            out_i.append(i)
        s, i = np.concatenate(out_s), np.concatenate(out_i)
        some = s > -np.inf
        offsets = np.concatenate([[0], np.cumsum(some.sum(axis=1))]).astype(np.int32)
        best = pa.StructArray.from_arrays([pa.array(-s[some]), pa.array(i[some].astype(np.int64))], names=["s", "id"])
        part = np.full(len(asks), queries.column("part")[0].as_py(), np.int64)
        return pa.table({"vec_id": pa.array(asks), "part": pa.array(part), "best": pa.ListArray.from_arrays(pa.array(offsets), best).cast(kind)})

    return cell


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of a batch with the same id (and length) the one with the least vector, so no id fills a block."""
    for batch in batches:
        ids = batch.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        again = np.zeros(len(ids), bool)
        same = ids[order[1:]] == ids[order[:-1]]
        again[order[1:][same]] = again[order[:-1][same]] = True
        best: dict[tuple, tuple[list, int]] = {}
        for i in np.flatnonzero(again).tolist():
            key = tuple(batch.column(x)[i].as_py() for x in ("vec_id", "_asks", "d"))
            best[key] = min(best.get(key, ([float("inf")], -1)), (batch.column("embedding")[i].as_py(), i))
        again[[i for _, i in best.values()]] = False
        yield batch.filter(pa.array(~again)) if best else batch


_SOUND = "coalesce(vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')), false)"


def left_out(vectors: DataFrame) -> DataFrame:
    """n: how many rows neither ask nor answer."""
    return vectors.agg(F.count_if(~F.expr(_SOUND)).alias("n"))


def nearest(vectors: DataFrame, k: int = K, *, queries: Column | None = None, query_bytes: int = QUERY_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """vec_id, rank (from 1), neighbour, score: the k largest inner products of every row that asks."""
    exact = vectors.schema["embedding"].dataType.elementType.typeName() in ("float", "double")
    rows = vectors.withColumn("_asks", F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))).where(_SOUND)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding") if exact else F.col("embedding").cast("array<double>").alias("embedding"), "_asks", F.size("embedding").alias("d"))
    rows = rows.mapInArrow(_least, rows.schema)
    # One row a length: as many blocks as its vectors need.
    blocks = lambda n, most: F.greatest(F.ceil(n * F.col("d") * 8 / F.lit(most)), F.lit(1)).cast("long")
    sizes = rows.groupBy("d").agg(blocks(F.count_if("_asks"), query_bytes).alias("g"), blocks(F.count("*"), shard_bytes).alias("n"))
    rows = rows.join(sizes, "d")
    block = lambda of: F.pmod(F.xxhash64("vec_id"), F.col(of))
    each = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    asks = rows.where("_asks").select("d", "vec_id", "embedding", block("g").alias("b"), each("n").alias("part"))
    # Names of their own: columns that both sides have from one table would be pruned from the second.
    shards = rows.select(F.col("d").alias("d2"), F.col("vec_id").alias("other"), F.col("embedding").alias("vector"), block("n").alias("part2"), each("g").alias("b2"))
    lists = asks.groupBy("d", "b", "part").cogroup(shards.groupBy("d2", "b2", "part2")).applyInArrow(_cell(k), "vec_id long, part long, best array<struct<s:double,id:long>>")
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")
    most = sizes.agg(F.max("n")).first()[0] or 1
    while True:  # once at least: an id may ask with vectors of two lengths
        lists = lists.groupBy("vec_id", F.floor(F.col("part") / FAN_IN).alias("part")).agg(merged)
        most = -(-most // FAN_IN)
        if most <= 1:
            break
    out = lists.select("vec_id", F.posexplode("best").alias("rank", "b"))
    return out.select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("b.id").alias("neighbour"), F.round(-F.col("b.s"), 6).alias("score"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % EVERY == 0)


SQL = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS neighbour, list_inner_product(a.v, b.v) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, neighbour) AS rank FROM p)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbour, round(s, 6) AS score FROM r WHERE rank <= 10
"""
