"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import remove, work_dir

HEX52 = 4503599627370496.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table by Spark's reader, so any store Spark knows will do."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts; the same in any engine."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    digest = F.md5(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in cols]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(HEX52)


def remainder_of_id(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


#: Rows of a few numbers each that may be broadcast once they are counted: some megabytes.
MAX_BROADCAST_ROWS = 200_000

#: The tables written since the innermost ``scratch`` began.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def merged(df: DataFrame, rows: int, per_task: int = 100_000) -> DataFrame:
    """``df`` in partitions of ``per_task`` rows, if it has the stated rows at most; partitions are only merged."""
    return df.coalesce(max(1, -(-rows // per_task)))


def materialise(df: DataFrame, label: str, rows: int | None = None, per_task: int = 100_000) -> DataFrame:
    """Cut the lineage: write Parquet in the shared folder and read it back.

    Where a bound of the rows is known, a task is given ``per_task`` of them, so a
    small table isn't written by hundreds of tasks.  On a local file system each
    writing task starts three processes (``chmod`` of its folder, file and checksum).
    """
    spark = df.sparkSession
    path = work_dir(spark, label)
    if rows is not None:
        df = merged(df, rows, per_task)
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables materialised inside are removed at the end, but for those handed to the yielded function."""
    mine: list[str] = []
    kept: list[str] = []
    outer = _WRITTEN.set(mine)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._written_at)
        return df

    try:
        yield keep
    finally:
        _WRITTEN.reset(outer)
        if (around := _WRITTEN.get()) is not None:
            around.extend(kept)
        for path in mine:
            if path not in kept:
                remove(spark, path)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be broadcast if its counted rows are within the bound, else as it is."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df
