"""Text files in, findings out."""

from __future__ import annotations

import io
import os
import sys
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import S

#: Files of a folder that count as text.
SUFFIXES = (".txt", ".md", ".csv", ".tsv", ".json", ".jsonl", ".log", ".xml", ".html", ".htm", ".yaml", ".yml", ".text")
TEXTS = "source string, text string"
#: Bytes of a file that still fit a row; larger ones are for ``read_chunks``.
MOST = 1 << 30


def unified(text: Column) -> Column:
    """Line ends as text mode gives them."""
    return F.regexp_replace(text, "\r\n?", "\n")


def texts_of(content: Column) -> Column:
    """Bytes as UTF-8; what isn't becomes the replacement character."""
    return unified(F.make_valid_utf8(content.cast("string")))


def _glob(suffixes: Sequence[str]) -> str:
    """A pattern of names that end so in any case; files that don't match are never opened."""
    return "*{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes) + "}"


def _sorted(paths: Sequence[str], stdin=None) -> tuple[list[str], list[str], list[tuple[str, str]]]:
    """Folders, files and what came by the standard input; what can't be read is said on the standard error and left out."""
    folders, files, typed = [], [], []
    for p in paths or ["-"]:
        if p in ("-", ""):
            typed.append(("-", (stdin or sys.stdin).read()))
        elif os.path.isdir(p) or "://" in p and not os.path.splitext(p)[1]:
            folders.append(p)
        elif "://" in p or os.access(p, os.R_OK):
            files.append(p)
        else:
            print(f"can't read {p}", file=sys.stderr)
    return folders, files, typed


def _listed(spark: SparkSession, folders: Sequence[str], files: Sequence[str], suffixes: Sequence[str]) -> list[DataFrame]:
    read = spark.read.format("binaryFile")
    out = [read.option("recursiveFileLookup", True).option("pathGlobFilter", _glob(suffixes)).load(list(folders))] if folders else []
    return out + ([spark.read.format("binaryFile").load(list(files))] if files else [])


_NAME = "regexp_replace(path, '^file:/+', '/')"


def read_texts(spark: SparkSession, paths: Sequence[str] = (), suffixes: Sequence[str] = SUFFIXES, stdin=None) -> DataFrame:
    """source, text: one row for each file. Folders are walked for files with one of ``suffixes``; no path, or ``-``, is the
    standard input. Files of more than ``MOST`` bytes are left to ``read_chunks`` and named on the standard error.
    """
    folders, files, typed = _sorted(paths, stdin)
    out = spark.createDataFrame(typed, TEXTS).select("source", unified(F.col("text")).alias("text"))
    for raw in _listed(spark, folders, files, suffixes):
        for r in raw.where(F.col("length") > MOST).select(F.expr(_NAME).alias("source")).toLocalIterator():
            print(f"too long for a row: {r.source}; scan it in chunks", file=sys.stderr)
        out = out.unionByName(raw.where(F.col("length") <= MOST).select(F.expr(_NAME).alias("source"), texts_of(F.col("content")).alias("text")))
    return out


def _pieces(read, chunk: int, margin: int) -> Iterator[tuple[int, int, str]]:
    """Number, first character and text of each chunk, with margins, of what ``read(n)`` gives; a bounded part is held."""
    held, lo, k = read(chunk + margin), 0, 0
    while held:
        yield k, lo, held[: (k + 1) * chunk + margin - lo]
        k += 1
        keep = max(k * chunk - margin, 0)
        held, lo = held[keep - lo :] + read(chunk), keep
        if len(held) + lo <= k * chunk:
            return


def read_chunks(spark: SparkSession, paths: Sequence[str] = (), suffixes: Sequence[str] = SUFFIXES, stdin=None, *, chunk: int = 1 << 20, margin: int = 512) -> DataFrame:
    """source, _qirtas_k, _qirtas_lo, text: files of any size in chunks, for ``chunk_findings``.

    A task reads its file a chunk at a time; then the chunks are dealt to all tasks.
    """
    folders, files, typed = _sorted(paths, stdin)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for source, path in zip(batch.column("source").to_pylist(), batch.column("path").to_pylist()):
                where, at = fs.FileSystem.from_uri(path)
                with where.open_input_stream(at, compression=None) as raw, io.TextIOWrapper(io.BufferedReader(raw), encoding="utf-8", errors="replace", newline=None) as text:
                    for k, lo, part in _pieces(text.read, chunk, margin):
                        yield pa.RecordBatch.from_pydict({"source": pa.array([source]), "_qirtas_k": pa.array([k], pa.int32()), "_qirtas_lo": pa.array([lo], pa.int64()), "text": pa.array([part])})

    schema = "source string, _qirtas_k int, _qirtas_lo long, text string"
    rows = [(s, k, lo, part) for s, t in typed for k, lo, part in _pieces(io.StringIO(t, newline=None).read, chunk, margin)]
    out = spark.createDataFrame(rows, schema)
    for raw in _listed(spark, folders, files, suffixes):
        names = raw.select(F.expr(_NAME).alias("source"), F.regexp_replace("path", "^file:/+", "file:///").alias("path"))
        out = out.union(names.mapInArrow(cut, schema).repartition("source", "_qirtas_k"))
    return out


def watchlist(spark: SparkSession, path: str) -> DataFrame:
    """target: the lines of a file, stripped, but for empty ones and those that begin with #."""
    lines = spark.read.text(path)
    return lines.where(~F.col("value").startswith("#")).select(F.regexp_replace("value", f"^[{S}]+|[{S}]+$", "").alias("target")).where("target <> ''")


def table_lines(rows: DataFrame, values: bool = True) -> DataFrame:
    """value: one tab-separated line for each finding (source and the finding's fields)."""
    place = F.concat(F.col("source"), F.lit(":"), F.col("start"), F.lit("-"), F.col("end"))
    return rows.select(F.concat_ws("\t", place, "entity_type", "confidence", "category", *(["value"] if values else [])).alias("value"))


def scan_json(df: DataFrame) -> DataFrame:
    """value: one object for each source, with its matches."""
    return df.select(F.to_json(F.struct("source", F.col("findings").alias("matches"))).alias("value"))


def redaction_json(df: DataFrame, redaction: str = "redaction") -> DataFrame:
    r = F.col(redaction)
    return df.select(F.to_json(F.struct(r["text"].alias("text"), F.size(r["items"]).alias("count"), r["items"].alias("items"), r["vault"].alias("vault"), "source")).alias("value"))


def domain_lines(rows: DataFrame) -> DataFrame:
    place = F.concat(F.col("source"), F.lit(":"), F.col("start"), F.lit("-"), F.col("end"))
    to = F.when(F.col("target").isNotNull(), F.concat(F.lit("-> "), F.col("target")))
    return rows.select(F.concat_ws("\t", place, "domain", "reason", "confidence", to, "detail").alias("value"))


def found_any(rows: DataFrame) -> bool:
    return not rows.isEmpty()


def printed(rows: DataFrame, to=None) -> None:
    """Lines to a stream, a partition at a time."""
    lines: Iterable = rows.toLocalIterator()
    for r in lines:
        print(r.value, file=to or sys.stdout)
