"""Packing documents into windows of fixed capacity as a cutting-stock problem, by column generation.

Lengths are counted in a histogram of ``bins`` classes (rounded up to ``capacity / bins``). The linear program
"least number of windows that holds every class's demand" is solved over patterns (how many pieces of each class
one window holds): a revised simplex keeps the basis, and an unbounded-knapsack dynamic program prices the next
pattern from the dual values until none has a value over one (Gilmore and Gomory, 1961). Pattern counts are
rounded down; what is left of the demand, under one window per pattern, is packed first-fit decreasing. Then the
pieces of each class are ranked and rank intervals are dealt to the patterns' windows. Only the histogram comes
to the driver and only the list of intervals, bounded by the square of the number of classes, goes back.

A document longer than ``capacity`` is cut into full windows and one rest, so whole texts are packed and nothing
is dropped. The length of a text is an estimate of its tokens, four UTF-8 bytes each; another count can be given
as a Column in ``length``.

Cases: a null or empty text has no piece; it needs no room. Equal lengths are ranked by (hash of id and text modulo
``SHARDS``, doc_id, hash of the text, piece), null ids first; rows that repeat id and text are ranked side by side and each gets its own place.
An empty table gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

CAPACITY, BINS = 2048, 256
#: Parts in which each class is ranked, so that no task ranks a whole class; part of the order, so the same at every size.
SHARDS = 256


def price(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: the most valuable pattern of classes 1..capacity within ``capacity``."""
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for c in range(1, capacity + 1):
        v = best[c - 1 :: -1] + values[:c]  # class i + 1 leaves c - i - 1
        k = int(np.argmax(v))
        if v[k] > best[c - 1] + 1e-15:
            best[c], pick[c] = v[k], k + 1
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(capacity, int), capacity
    while c > 0:
        if pick[c]:
            pattern[pick[c] - 1] += 1
            c -= pick[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def solve(demand: np.ndarray, limit: int = 20_000, gap: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (rows), how often each is used (fractional), and the linear program's lower bound on windows.

    ``demand[i]`` pieces have class i + 1; a window holds ``len(demand)`` units. The bound is Farley's, valid
    even though the search ends at a relative ``gap`` to it, or after ``limit`` patterns if that is not reached: the
    patterns so far hold all of the demand in any case, so a limit costs windows at most, never pieces.
    """
    n = len(demand)
    rows = np.flatnonzero(demand)
    m = len(rows)
    patterns = np.zeros((m, n), int)
    patterns[np.arange(m), rows] = n // (rows + 1)
    basis = patterns[:, rows].T.astype(float)  # columns are patterns
    inverse = np.diag(1 / np.diag(basis)) if m else np.zeros((0, 0))
    x = inverse @ demand[rows]
    bound = 0.0
    for step in range(limit):
        dual = inverse.sum(axis=0)
        values = np.zeros(n)
        values[rows] = np.maximum(dual, 0)
        value, pattern = price(values, n)
        bound = max(bound, float(values[rows] @ demand[rows]) / max(value, 1e-12)) if m else 0.0
        if value <= 1 + 1e-9 or bound >= x.sum() * (1 - gap):
            break
        d = np.einsum("ij,j->i", inverse, pattern[rows].astype(float))  # not BLAS, whose threads fight the JVM's
        ratio = np.where(d > 1e-10, x / np.where(d > 1e-10, d, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        t = ratio[out]
        x = np.maximum(x - t * d, 0)
        x[out] = t
        patterns[out] = pattern
        row = inverse[out] / d[out]
        inverse -= np.outer(d, row)
        inverse[out] = row
        if step % 500 == 499:
            inverse = np.linalg.inv(patterns[:, rows].T.astype(float))
            x = np.maximum(inverse @ demand[rows], 0)
    return patterns, x, bound


def plan(demand: np.ndarray) -> tuple[list[tuple[int, int, int, int, int]], int, float]:
    """Intervals (class, first rank, last rank + 1, first window, pieces per window), windows, and the lower bound."""
    patterns, x, bound = solve(demand)
    use = np.floor(x + 1e-9).astype(np.int64)
    left, done = demand.astype(np.int64).copy(), np.zeros(len(demand), np.int64)
    out: list[tuple[int, int, int, int, int]] = []
    base = 0
    for pattern, k in zip(patterns, use):
        # A pattern may hold more of a class than is left of its demand: then its last windows stay emptier.
        if not k:
            continue
        for i in np.flatnonzero(pattern):
            take = int(min(left[i], pattern[i] * k))
            if take:
                out.append((int(i) + 1, int(done[i]), int(done[i]) + take, base, int(pattern[i])))
                done[i] += take
                left[i] -= take
        base += int(k)
    # The rest, at most one window's worth a pattern, first-fit decreasing over identical runs.
    room: list[int] = []
    for i in range(len(demand) - 1, -1, -1):
        w, at = i + 1, 0
        while left[i]:
            while at < len(room) and room[at] < w:
                at += 1
            if at == len(room):
                room.append(len(demand))
            n = int(min(left[i], room[at] // w))
            out.append((w, int(done[i]), int(done[i]) + n, base + at, n))
            done[i] += n
            left[i] -= n
            room[at] -= n * w
    return out, base + len(room), bound


def pieces(docs: DataFrame, capacity: int, bins: int, length: Column | None = None) -> DataFrame:
    """doc_id, h, piece, start, length, bin: every document cut to at most ``capacity``."""
    size = length if length is not None else F.ceil(F.octet_length("text") / 4)
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("h"), size.cast("long").alias("size")).where("size > 0")
    rows = rows.select("doc_id", "h", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / capacity))).alias("piece"))
    rows = rows.withColumn("start", F.col("piece") * capacity).withColumn("length", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("start")).cast("int"))
    return rows.withColumn("bin", F.ceil(F.col("length") * bins / capacity).cast("int")).select("doc_id", "h", "piece", "start", "length", "bin")


def packed(docs: DataFrame, *, capacity: int = CAPACITY, bins: int = BINS, length: Column | None = None) -> DataFrame:
    """pack_id, doc_id, piece, start, length, offset: each piece's window and its place in it."""
    if capacity % bins:
        raise ValueError("capacity must be a multiple of bins")
    rows = written(pieces(docs, capacity, bins, length), "pieces")
    demand = np.zeros(bins, np.int64)
    for r in rows.groupBy("bin").count().collect():
        demand[r["bin"] - 1] = r["count"]
    intervals, _, _ = plan(demand)
    # Ranks: within shards first, then shifted by the sizes of the shards before.
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "h"), F.lit(SHARDS)).cast("int"))
    inside = Window.partitionBy("bin", "shard").orderBy("doc_id", "h", "piece")
    rows = rows.withColumn("rank", F.row_number().over(inside).cast("long") - 1)
    before = rows.groupBy("bin", "shard").agg(F.count("*").alias("n"))
    before = before.withColumn("shift", F.sum("n").over(Window.partitionBy("bin").orderBy("shard")) - F.col("n")).drop("n")
    rows = rows.join(before, ["bin", "shard"]).withColumn("rank", F.col("rank") + F.col("shift"))
    start = np.array([(b << 48) + lo for b, lo, *_ in intervals], np.int64)
    order = np.argsort(start)
    start = start[order]
    first, base, per = (np.array([i[k] for i in intervals], np.int64)[order] for k in (1, 3, 4))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            key = (batch.column("bin").to_numpy().astype(np.int64) << 48) + rank
            at = np.searchsorted(start, key, side="right") - 1
            pack = base[at] + (rank - first[at]) // per[at]
            yield pa.RecordBatch.from_arrays([pa.array(pack), *(batch.column(x) for x in ("doc_id", "piece", "start", "length"))], names=["pack_id", "doc_id", "piece", "start", "length"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = rows.select("bin", "rank", "doc_id", "piece", "start", "length").mapInArrow(deal, f"pack_id long, doc_id {id_type}, piece long, start long, length int")
    along = Window.partitionBy("pack_id").orderBy(F.desc("length"), "doc_id", "piece")
    return out.withColumn("offset", (F.sum("length").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).cast("int"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
