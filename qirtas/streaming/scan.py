"""Scans over streams. Detection keeps no state; what arrives is scanned as it would be in a batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.guard import Guard, write_audit
from ..operators.scan import findings


def read_stream(like: DataFrame, path: str, **options) -> DataFrame:
    """A stream of a Parquet file, or of the Parquet files of a folder, with the columns of ``like``."""
    path = path.rstrip("/")
    if not any(c in path for c in "*?[{"):
        path = f"{path[:-1]}[{path[-1]}]"  # a pattern of one name: a stream takes a single file no other way
    return like.sparkSession.readStream.schema(like.schema).options(**options).parquet(path)


def stream_findings(stream: DataFrame, keys: Sequence[str], column: str = "text", **options) -> DataFrame:
    """One row per finding, as from a batch."""
    return findings(stream, keys, column, **options)


def without_replays(rows: DataFrame, keys: Sequence[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Findings that arrive twice within ``delay`` once."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([*keys, "start", "end", "entity_type"])


def windowed_counts(rows: DataFrame, time: str, size: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Findings by time window and type, late ones up to ``delay`` included."""
    out = rows.withWatermark(time, delay).groupBy(F.window(time, size).alias("w"), "entity_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), "entity_type", "n")


def guarded(stream: DataFrame, guard: Guard, audit_path: str, sink: Callable[[DataFrame, int], None], checkpoint: str, column: str = "text", destination: str | None = None, **trigger) -> StreamingQuery:
    """Protect a stream: audits are appended to ``audit_path``, and ``sink(batch, id)`` gets the rows that aren't blocked."""

    def each(batch: DataFrame, number: int) -> None:
        safe = guard.protect(batch, column, destination).persist()
        write_audit(safe, audit_path)
        sink(safe.where("not blocked").select(*[c for c in batch.columns if c != column], F.col("safe_text").alias(column), "vault"), number)
        safe.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
