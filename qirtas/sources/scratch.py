"""A folder for what queries write on their way."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_LOCAL: list[str] = []


@atexit.register
def _forget() -> None:
    for path in _LOCAL:
        shutil.rmtree(path, ignore_errors=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that all executors share, as ``spark.checkpoint.dir`` names it; one that is removed at
    the end only for a session of one process, where the setting is absent."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="qirtas-"))
        base = f"file://{_LOCAL[0]}"
    return f"{base.rstrip('/')}/{name}-{os.urandom(8).hex()}"
