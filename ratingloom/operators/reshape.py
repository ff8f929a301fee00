"""Splits, mirrored copies, pivots, codes, distinct rows and top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .filters import ContractError


def chronological_split(df: DataFrame, train_until: str, validation_until: str, time: str = "datetime") -> DataFrame:
    """``split``: train, validation or test by half-open intervals."""
    if train_until >= validation_until:
        raise ContractError("split boundaries out of order")
    t, kind = F.col(time), df.schema[time].dataType
    label = F.when(t < F.lit(train_until).cast(kind), "train").when(t < F.lit(validation_until).cast(kind), "validation").otherwise("test")
    return df.withColumn("split", label)


def split_counts(df: DataFrame) -> DataFrame:
    """Rows and their share for each of the three splits, in that order, also for empty ones."""
    names = df.sparkSession.createDataFrame([(i, n) for i, n in enumerate(("train", "validation", "test"))], "position int, split string")
    counted = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    out = names.join(counted, "split", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def split_overlap(df: DataFrame, key: str) -> DataFrame:
    """Keys that lie in more than one split."""
    return df.groupBy(key).agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def mirror(df: DataFrame, swaps: list[tuple[str, str]], negate: list[str] = (), complement: list[str] = (), flag: str = "is_mirrored") -> DataFrame:
    """The rows and their copies from the other side.

    Pairs of columns are swapped, differences negated, probabilities and the
    target complemented.  One scan: both copies come from one row.
    """
    swapped = {a: F.col(b) for a, b in swaps} | {b: F.col(a) for a, b in swaps}
    swapped |= {c: -F.col(c) for c in negate} | {c: 1 - F.col(c) for c in complement}
    same = F.struct(*[F.col(c) for c in df.columns], F.lit(False).alias(flag))
    other = F.struct(*[swapped.get(c, F.col(c)).cast(df.schema[c].dataType).alias(c) for c in df.columns], F.lit(True).alias(flag))
    return df.select(F.explode(F.array(same, other)).alias("r")).select("r.*")


def mirror_by_name(df: DataFrame, complement: tuple[str, ...] = ("team1_win",)) -> DataFrame:
    """``mirror`` with its columns found by their names: team1/team2 pairs, ``*_diff``, ``raw_*_prob*``."""
    columns = df.columns
    swaps = [(c, c.replace("team1", "team2", 1)) for c in columns if "team1" in c and c.replace("team1", "team2", 1) in columns]
    negate = [c for c in columns if "_diff" in c and not any(c in s for s in swaps)]
    probabilities = [c for c in columns if c.startswith("raw_") and "prob" in c]
    return mirror(df, swaps, negate, [*probabilities, *[c for c in complement if c in columns]])


def antisymmetry_breaks(mirrored: DataFrame, keys: list[str], differences: list[str], eps: float = 1e-9) -> DataFrame:
    """Rows whose mirrored copy isn't their negative (nulls must match)."""
    sums = [F.sum(c).alias(c) for c in differences]
    nulls = [F.count(c).alias(f"n_{c}") for c in differences]
    bad = F.lit(False)
    for c in differences:
        bad = bad | (F.abs(F.coalesce(F.col(c), F.lit(0.0))) > eps) | (F.col(f"n_{c}") == 1)
    return mirrored.groupBy(*keys).agg(*sums, *nulls).where(bad)


def differences(df: DataFrame, names: dict[str, tuple[str, str]]) -> DataFrame:
    return df.withColumns({n: F.col(a) - F.col(b) for n, (a, b) in names.items()})


def side_pivot(sides: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per key with ``team1_<value>`` and ``team2_<value>``."""
    picks = [F.max(F.when(F.col("side") == s, F.col(v))).alias(f"team{s}_{v}") for s in (1, 2) for v in values]
    return sides.groupBy(*keys).agg(*picks)


def unpivot_roster(df: DataFrame, keys: list[str], sides: int = 2, slots: int = 5) -> DataFrame:
    """Wide columns ``team<s>_player<k>`` and ``..._id`` to rows ``side, slot, player, player_id``."""
    cells = [F.struct(F.lit(s).alias("side"), F.lit(k).alias("slot"), F.col(f"team{s}_player{k}").alias("player"), F.col(f"team{s}_player{k}_id").alias("player_id")) for s in range(1, sides + 1) for k in range(1, slots + 1)]
    return df.select(*keys, F.explode(F.array(*cells)).alias("cell")).select(*keys, "cell.*")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in a stated total order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def codes(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """Codes 0, 1, ... of the values in sorted order; null is -1.  Only the distinct values meet in one place."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    numbered = values.withColumn(name, (F.row_number().over(W.orderBy(column)) - 1).cast("int"))
    return df.join(numbered, column, "left").withColumn(name, F.coalesce(name, F.lit(-1)))


def top_k(counts: DataFrame, k: int, first_seen: str) -> DataFrame:
    return counts.orderBy(F.desc("n"), first_seen).limit(k)


def best_row(df: DataFrame, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(1)


def matrix(players: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One array of the players' values for each map, by side and slot."""
    cells = F.array_sort(F.collect_list(F.struct("side", "slot", value)))
    return players.groupBy(*keys).agg(cells[value].alias("values"))
