"""Hand this package to the executors, and hold the memory of their Python workers."""

from __future__ import annotations

import ctypes
import hashlib
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bounds of one Arrow batch between the JVM and Python: both hold a few of them for each task.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 4000

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _trim() -> None:
    """Give freed memory back to the system, where its allocators can."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def trimmed(run: Batches) -> Batches:
    """``run``, after whose last batch the worker gives back what it has freed: it stays, idle, beside those of later stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _trim()

    return whole


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per Spark context, from wherever the driver has it.

    Also lowers the session's Arrow batch bounds, so that a task's memory doesn't
    grow with the length of the texts.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if getattr(context, "_ratingloom_shipped", False):
        return
    top = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:
        packed = f"{folder}/{top.name}.zip"
        with zipfile.ZipFile(packed, "w") as z:
            for source in sorted(top.rglob("*.py")):
                z.write(source, source.relative_to(top.parent))
        with open(packed, "rb") as f:
            name = f"{top.name}-{hashlib.md5(f.read()).hexdigest()[:12]}.zip"
        kept = os.path.join(tempfile.mkdtemp(), name)
        shutil.copy(packed, kept)
    context.addPyFile(kept)
    context._ratingloom_shipped = True
