"""What the operators of this subpackage share: scratch tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts that become Python objects at once: an Arrow batch has more, and its copy would double a worker's memory.
ROWS_AT_ONCE = 1000
#: Rows of an Arrow batch, at most.
ARROW_ROWS, _ARROW = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bits of a bitmap that is sent to the tasks, at most (64 MB), and of what one task makes of it.
MAX_BITS, _SLICE = 1 << 29, 1 << 20

_LOCAL: list[str] = []
_CACHES: dict[str, Callable[[], object]] = {}


def cache_of(operator: str, clear: Callable[[], object]) -> None:
    """``clear`` empties what an operator keeps in a worker between its tasks."""
    _CACHES[operator] = clear


def begin(operator: str) -> None:
    """To be called as an operator's task begins: a worker that served another operator before gives its memory back."""
    for name, clear in _CACHES.items():
        if name != operator:
            clear()
    give_back()


def give_back() -> None:
    """What allocators hold without use, back to the system: executors have several workers, busy and idle."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(lo, ROWS_AT_ONCE)


def _forget() -> None:
    for path in _LOCAL:
        shutil.rmtree(path, ignore_errors=True)


atexit.register(_forget)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent a folder is made only for a one-process session (tests); on a cluster its
    absence is an error, since a machine-local folder would not survive a lost executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="qirtas-"))
    return f"file://{_LOCAL[0]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut and later jobs survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove what ``written`` made, once all that reads it has been written or collected itself."""
    for df in tables:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        path = jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _slice_bits(rows: pa.Table) -> pa.Table:
    bits = np.zeros(_SLICE, bool)
    bits[rows.column("bit").to_numpy() % _SLICE] = True
    return pa.table({"slice": rows.column("slice").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A bitmap of some hashes (a column ``bit``), by their low bits: at most ``MAX_BITS`` bits, so it may be broadcast.

    It has a hash for certain if that is among them; another one by chance, the more often the fuller it is.
    """
    size = min(MAX_BITS, max(_SLICE, 1 << (32 * hashes.count()).bit_length()))
    low = F.col("bit").bitwiseAND(F.lit(size - 1))
    # Bits are made distinct before they meet, so a slice has a bounded number.
    slices = hashes.select(low.alias("bit")).distinct().withColumn("slice", (F.col("bit") / F.lit(_SLICE)).cast("int"))
    out = np.zeros(size // 8, np.uint8)
    for r in slices.groupBy("slice").applyInArrow(_slice_bits, "slice int, bits binary").toLocalIterator():
        out[r.slice * _SLICE // 8 : (r.slice + 1) * _SLICE // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` a bitmap has."""
    low = hashes & np.int64(8 * len(bits) - 1)
    return (bits[low >> 3] >> (7 - (low & 7)).astype(np.uint8) & 1).astype(bool)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, whatever case its names are in."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Rows hold whole texts here, so at most ``ARROW_ROWS`` of them go to Python at once: the session's
    setting is lowered to that where it is higher, since both an executor and its workers hold such a batch."""
    if int(spark.conf.get(_ARROW, "10000")) > ARROW_ROWS or int(spark.conf.get(_ARROW, "10000")) <= 0:
        spark.conf.set(_ARROW, str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
