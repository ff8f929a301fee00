"""Bootstrap over clusters: matches are drawn with replacement, all their rows come along.

Rows are first reduced to one row of sums per cluster.  How often resample ``b``
draws a cluster is a Poisson number with mean one, hashed from (seed, cluster, b):
the limit of drawing with replacement, without numbering the clusters or knowing
how many there are.  So every task adds up its own clusters in vectors as long as
the resamples, and only those vectors meet; results don't depend on partitioning,
and DuckDB finds the same draws.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import brier, log_loss
from .simulate import DRAW_STEP, mix32, mix32_sql

#: 32-bit hashes from these on mean 1, 2, ... draws.
LEVELS = [int(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]
#: Clusters whose draws are held at once.
STEP = 512


def draw_counts(keys: np.ndarray, draws: int) -> np.ndarray:
    """[clusters, draws]: how often each resample draws each cluster."""
    steps = np.arange(draws, dtype=np.uint64) * np.uint64(DRAW_STEP) & np.uint64(2**32 - 1)
    return np.searchsorted(np.array(LEVELS, np.uint64), mix32(keys[:, None] ^ steps[None]), "right")


def draw_count_sql(key: str, draw: str) -> str:
    """``draw_counts`` as a DuckDB expression over the cluster's key and the resample's number."""
    hashed = mix32_sql(f"xor({key}, {draw}::ubigint * {DRAW_STEP}::ubigint & 4294967295::ubigint)")
    return f"len(list_filter({LEVELS}, lambda x: x <= ({hashed})::bigint))"


def cluster_key_sql(seed: int, cluster: str) -> str:
    return f"(('0x' || substr(md5('{seed}|' || {cluster}::varchar), 1, 8))::bigint)::ubigint"


def cluster_sums(rows: DataFrame, cluster: str, sums: dict[str, Column], by: list[str] = ()) -> DataFrame:
    """One row per cluster (and stratum): the sums and its number of rows."""
    return rows.groupBy(*by, cluster).agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(c).alias(n) for n, c in sums.items()])


def resample(clusters: DataFrame, cluster: str, sums: list[str], draws: int, seed: int, by: list[str] = ()) -> DataFrame:
    """``b`` and, of each resample, the totals of the drawn clusters."""
    by, names = list(by), ["n_rows", *sums]
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(cluster).cast("string")))
    keyed = clusters.select(*by, F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("__key"), *[F.col(c).cast("double").alias(c) for c in names])
    kinds = [clusters.schema[c].dataType.simpleString() for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            strata = list(zip(*(batch.column(i).to_pylist() for i in range(len(by))), strict=True)) if by else [()] * batch.num_rows
            keys = batch.column(len(by)).to_numpy().astype(np.uint64)
            values = np.stack([batch.column(len(by) + 1 + i).to_numpy(zero_copy_only=False) for i in range(len(names))])
            for stratum in dict.fromkeys(strata):
                rows = np.array([i for i, x in enumerate(strata) if x == stratum]) if by else np.arange(batch.num_rows)
                total = totals.setdefault(stratum, np.zeros((len(names), draws)))
                for low in range(0, len(rows), STEP):
                    some = rows[low : low + STEP]
                    total += values[:, some] @ draw_counts(keys[some], draws)
        for stratum, total in totals.items():
            columns = [pa.array([x] * draws) for x in stratum] + [pa.array(np.arange(draws)), *(pa.array(t) for t in total)]
            yield pa.RecordBatch.from_arrays(columns, names=[*by, "b", *names])

    schema = ", ".join([*(f"`{c}` {k}" for c, k in zip(by, kinds, strict=True)), "b long", *(f"`{c}` double" for c in names)])
    return keyed.mapInArrow(run, schema).groupBy(*by, "b").agg(*[F.sum(c).alias(c) for c in names])


def interval(resampled: DataFrame, value: Column, by: list[str] = (), low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Interpolated quantiles of the value over the resamples."""
    v = resampled.withColumn("__v", value)
    return v.groupBy(*by).agg(F.count(F.lit(1)).alias("n_draws"), F.percentile("__v", F.lit(low)).alias("ci_low"), F.percentile("__v", F.lit(high)).alias("ci_high"))


def ratio_interval(rows: DataFrame, cluster: str, value: Column, draws: int = 1000, seed: int = 20260917, by: list[str] = ()) -> DataFrame:
    """Mean of the value over rows with its interval: ``mean, ci_low, ci_high``."""
    sums = cluster_sums(rows, cluster, {"total": value}, by)
    point = sums.groupBy(*by).agg((F.sum("total") / F.sum("n_rows")).alias("mean"))
    ci = interval(resample(sums, cluster, ["total"], draws, seed, by), F.col("total") / F.col("n_rows"), by)
    return point.join(ci, list(by)) if by else point.withColumn("__one", F.lit(1)).join(ci.withColumn("__one", F.lit(1)), "__one").drop("__one")


def paired_guardrail(rows: DataFrame, cluster: str, new_loss: Column, old_loss: Column, draws: int = 5000, seed: int = 20260917) -> DataFrame:
    """Mean loss difference, its interval, and ``accepted``: the whole interval is below 0."""
    return ratio_interval(rows, cluster, new_loss - old_loss, draws, seed).withColumn("accepted", F.col("ci_high") < 0)


def metric_intervals(rows: DataFrame, cluster: str, y: str, p: str, stratum: Column, draws: int = 5000, seed: int = 20260917) -> DataFrame:
    """Rows, clusters, accuracy, log loss and Brier score of each stratum with their intervals, from one set of draws."""
    y_, p_ = F.col(y), F.col(p)
    values = {"accuracy": ((p_ >= 0.5).cast("int") == y_).cast("double"), "log_loss": log_loss(y_, p_), "brier": brier(y_, p_)}
    sums = cluster_sums(rows.withColumn("stratum", stratum), cluster, values, ["stratum"])
    point = sums.groupBy("stratum").agg(F.sum("n_rows").alias("rows"), F.count(F.lit(1)).alias("clusters"), *[(F.sum(m) / F.sum("n_rows")).alias(m) for m in values])
    drawn = resample(sums, cluster, list(values), draws, seed, ["stratum"])
    ends = [F.percentile(F.col(m) / F.col("n_rows"), F.lit(q)).alias(f"{m}_{name}") for m in values for name, q in (("low", 0.025), ("high", 0.975))]
    return point.join(drawn.groupBy("stratum").agg(*ends), "stratum")
