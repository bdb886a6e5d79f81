"""Quality classifier: random Fourier features, partition-summed normal equations, isotonic calibration.

A Gaussian kernel over document statistics is approximated by ``D`` random cosines (Rahimi and Recht, 2007);
ridge regression on them needs only ``Z'Z`` and ``Z'y``, which every partition sums for itself and which are
then added up in two levels. Scores become probabilities by pool-adjacent-violators over held-out rows.

Cases: a null, empty or blank text has no statistics; its score is null, its probability 0 and it is rejected.
Labels whose ``quality`` or ``doc_id`` is null are ignored; a document with several labels counts with their mean.
Without labelled rows of both classes there is no model: every text with a word is kept, with a null score and
probability 1. Repeated rows get equal results. Columns of other names, also clashing ones, are left alone.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, begin, discard, free_name, sliced, table, written

#: At most so many labelled documents (those of least hash) fit and calibrate the model. 0: all of them.
FIT_ROWS = 40_000
#: Labels that are sent to all tasks, at most: 24 MB.
BROADCAST_ROWS = 1_000_000
FEATURES = 384
RIDGE = 1e-3
BINS = 512
THRESHOLD = 0.5

_SYMBOLS = b"$%&*#|~^<>{}[]\\/@_=+"


def _classes() -> np.ndarray:
    m = np.zeros((256, 9))
    for b in range(256):
        c = chr(b)
        if b < 128:
            m[b, 0] = c.islower()
            m[b, 1] = c.isupper()
            m[b, 2] = c.isdigit()
            m[b, 3] = c in " \t\r"
            m[b, 4] = c == "\n"
            m[b, 5] = b in _SYMBOLS
            m[b, 6] = c in "!?"
            m[b, 7] = c in ".,;:'\"()-"
        else:
            m[b, 8] = 1
    return m


_CLASSES = _classes()
N_STATS = 9 + 7


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of statistics for each text, over the whole of it; NaN where it has no word."""
    counts = np.zeros((len(texts), 256))
    rest = np.full((len(texts), 7), np.nan)
    for i, text in enumerate(texts):
        words = text.split() if text else []
        if not words:
            continue
        raw = text.encode("utf-8", "replace")
        counts[i] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        n = len(words)
        lines = [x for x in text.split("\n") if x.strip()]
        rest[i] = (
            np.log1p(n),
            len(raw) / n,
            len(set(words)) / n**0.8,
            sum(map(operator.eq, words, words[1:])) / n,
            1 - len(set(lines)) / len(lines),
            len(zlib.compress(raw, 1)) / (len(raw) + 60),
            np.log1p(n / len(lines)),
        )
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return np.hstack([np.sqrt(counts @ _CLASSES / total), rest])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        z = np.cos(x @ self.omega + self.phase) * np.sqrt(2 / self.omega.shape[1])
        return np.hstack([z, np.ones((len(z), 1))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        # In slices: a batch of rows would take hundreds of times the memory of its statistics.
        parts = [self.features(stats[lo : lo + ROWS_AT_ONCE]) @ self.weights for lo in range(0, len(stats), ROWS_AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def probability(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.knots, self.levels)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit to y, with weights w, in the order of x (sorted)."""
    level: list[float] = []
    weight: list[float] = []
    size: list[int] = []
    for v, c in zip(y, w):
        level.append(float(v))
        weight.append(float(c))
        size.append(1)
        while len(level) > 1 and level[-2] >= level[-1]:
            v2, c2, s2 = level.pop(), weight.pop(), size.pop()
            level[-1] = (level[-1] * weight[-1] + v2 * c2) / (weight[-1] + c2)
            weight[-1] += c2
            size[-1] += s2
    return np.repeat(level, size)


def _sums(model: Model):
    width = len(model.phase) + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 1))
        begin("quality")
        for batch in sliced(batches):
            stats = np.array(batch.column("stats").to_pylist(), float)
            if len(stats):
                z = model.features(stats)
                y = batch.column("y").to_numpy(zero_copy_only=False)
                total += z.T @ np.hstack([z, y[:, None]])
        yield pa.RecordBatch.from_pydict({"part": pa.array([0], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    return add


def _added(width: int):
    def add(sums: pa.Table) -> pa.Table:
        total = np.zeros((width, width + 1))
        for raw in sums.column("sums").to_pylist():
            total += np.frombuffer(raw).reshape(total.shape)
        return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})

    return add


def labelled(labels: DataFrame, fit_rows: int) -> DataFrame:
    """Documents' mean labels, at most ``fit_rows`` of them: those whose id has the least hash."""
    mean = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    mean = mean.select("doc_id", "y", F.xxhash64("doc_id").alias("h"))
    return mean.orderBy("h", "doc_id").limit(fit_rows) if fit_rows else mean


def fit(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, features: int = FEATURES, ridge: float = RIDGE, bins: int = BINS, seed: int = 7) -> Model | None:
    """Fit on labelled documents: four fifths (by hash) fit the ridge scores, one fifth the calibration."""

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("quality")
        for batch in sliced(batches):
            x = statistics(batch.column("text").to_pylist())
            ok = ~np.isnan(x[:, -1])
            h = batch.column("h").to_numpy(zero_copy_only=False)[ok]
            yield pa.RecordBatch.from_pydict(
                {"stats": pa.array(list(x[ok]), pa.list_(pa.float64())), "y": pa.array(batch.column("y").to_numpy(zero_copy_only=False)[ok]), "held": pa.array(np.abs(h >> 7) % 5 == 0), "h": pa.array(h)}
            )

    chosen = labelled(labels, fit_rows)
    chosen = F.broadcast(chosen) if 0 < fit_rows <= BROADCAST_ROWS else chosen  # else left to the optimizer
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "y", "h")
    rows = written(rows.mapInArrow(stats, "stats array<double>, y double, held boolean, h long"), "quality-fit")
    n, ones = rows.agg(F.count("*"), F.sum("y")).first()
    if not n or not 0 < ones < n:
        discard(rows)
        return None
    moments = rows.agg(*[f(F.col("stats")[i]) for i in range(N_STATS) for f in (F.avg, F.stddev_pop)]).first()
    mean, scale = np.array(moments[0::2], float), np.array(moments[1::2], float)
    rng = np.random.default_rng(seed)
    model = Model(mean, np.where(scale > 1e-9, scale, 1), rng.normal(size=(N_STATS, features)) / np.sqrt(N_STATS / 2), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.zeros(1), np.ones(1))
    width = features + 1
    part = rows.where("not held").mapInArrow(_sums(model), "part int, sums binary")
    groups = max(1, min(16, int(part.rdd.getNumPartitions() ** 0.5))) if part.rdd.getNumPartitions() > 16 else 1
    part = part.withColumn("part", F.spark_partition_id() % groups)
    total = sum(np.frombuffer(r.sums).reshape(width, width + 1) for r in part.groupBy("part").applyInArrow(_added(width), "sums binary").collect())
    reg = np.full(width, ridge * max(total[-1, width - 1], 1))
    reg[-1] = 1e-9
    weights = np.linalg.solve(total[:, :width] + np.diag(reg), total[:, width])
    model = Model(**{**model.__dict__, "weights": weights})

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("stats").to_pylist(), float).reshape(-1, N_STATS)
            yield pa.RecordBatch.from_pydict({"s": pa.array(model.score(x)), "y": batch.column("y")})

    # Calibration works on score bins, so what the driver gets is bounded whatever the number of labels.
    held = rows.where("held").mapInArrow(scored, "s double, y double")
    table_ = held.groupBy(F.round(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), "s")) * bins).alias("b")).agg(F.avg("s").alias("s"), F.avg("y").alias("y"), F.count("*").alias("w"))
    got = sorted((r.s, r.y, r.w) for r in table_.collect())
    discard(rows)
    if not got:
        got = [(0.0, 0.0, 1), (1.0, 1.0, 1)]
    x, y, w = map(np.array, zip(*got))
    return Model(**{**model.__dict__, "knots": x, "levels": isotonic(x, y, w)})


def judge(model: Model | None, threshold: float = THRESHOLD):
    """An Arrow UDF: text to struct(score, probability, keep)."""
    kind = pa.struct([("score", pa.float64()), ("probability", pa.float64()), ("keep", pa.bool_())])

    @F.arrow_udf("struct<score:double,probability:double,keep:boolean>")
    def verdict(text: pa.Array) -> pa.Array:
        begin("quality")
        x = np.vstack([statistics(text.slice(lo, ROWS_AT_ONCE).to_pylist()) for lo in range(0, max(1, len(text)), ROWS_AT_ONCE)])
        none = np.isnan(x[:, -1])
        if model is None:
            score, p, unknown = np.zeros(len(x)), np.where(none, 0.0, 1.0), np.ones(len(x), bool)
        else:
            score = model.score(np.nan_to_num(x))
            p, unknown = np.where(none, 0.0, model.probability(score)), none
        return pa.StructArray.from_arrays([pa.array(score, mask=unknown), pa.array(p), pa.array((p >= threshold) & ~none)], fields=list(kind))

    return verdict


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, score, probability and keep for every row of ``docs``."""
    verdict = judge(fit(docs, labels, **options))
    return docs.select("doc_id", verdict("text").alias("v")).select("doc_id", "v.score", "v.probability", "v.keep")


def kept(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    verdict = judge(fit(docs, labels, **options))
    name = free_name(docs, "verdict")
    return docs.withColumn(name, verdict(F.col("text"))).where(F.col(name)["keep"]).drop(name)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
