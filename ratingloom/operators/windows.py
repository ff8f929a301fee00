"""Strictly-prior features as windows: nothing here sees its own row's outcome.

The order of contests is (datetime, match_id, game_id).  Each window is
partitioned by its entity, so work spreads over teams, players, lineups or pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import Z_EPSILON, gap_days

ORDER = ("datetime", "match_id", "game_id")


def row_ids(df: DataFrame, order: tuple[str, ...] = ORDER, name: str = "row_id") -> DataFrame:
    """Consecutive ids from 0 in the total order, without bringing all rows into one task.

    Rows are numbered inside their day; a day starts at the number of rows of the
    days before it.  Only the counts by day meet in one place.
    """
    day = F.to_date(order[0])
    counts = df.groupBy(day.alias("__day")).agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(W.orderBy("__day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    numbered = df.withColumn("__day", day).withColumn("__at", F.row_number().over(W.partitionBy("__day").orderBy(*order)))
    return numbered.join(starts, "__day").withColumn(name, (F.col("__start") + F.col("__at") - 1).cast("long")).drop("__day", "__start", "__at")


def both_sides(df: DataFrame, keep: tuple[str, ...] = (*ORDER, "map_name")) -> DataFrame:
    """Each contest twice, once from each team: ``side, team, opponent, won, margin``."""

    def of(side: int, team: str, opponent: str, won: Column, margin: Column) -> Column:
        return F.struct(F.lit(side).alias("side"), F.col(team).alias("team"), F.col(opponent).alias("opponent"), won.cast("long").alias("won"), margin.cast("long").alias("margin"))

    y, m = F.col("team1_win"), F.col("score1_game") - F.col("score2_game")
    sides = F.array(of(1, "key1", "key2", y, m), of(2, "key2", "key1", 1 - y, -m))
    return df.select(*keep, F.explode(sides).alias("s")).select(*keep, "s.*")


def map_position(df: DataFrame) -> DataFrame:
    """``map_position``: 1, 2, ... inside the match."""
    return df.withColumn("map_position", F.row_number().over(W.partitionBy("match_id").orderBy("datetime", "game_id")))


def h2h_prior(sides: DataFrame) -> DataFrame:
    """``h2h_wins``: the team's wins against the opponent in earlier matches.

    All maps of a match are peers of one frame, and the match's own wins are taken off.
    """
    pair = W.partitionBy("team", "opponent")
    so_far = F.sum("won").over(pair.orderBy("datetime", "match_id"))
    own = F.sum("won").over(W.partitionBy("team", "opponent", "datetime", "match_id"))
    return sides.withColumn("h2h_wins", so_far - own)


def form_prior(sides: DataFrame, length: int = 5) -> DataFrame:
    """``roll_win_pct, roll_round_diff`` over the team's last maps of earlier matches.

    The frame is read at the first map of a match and holds for all its maps.
    """
    in_order = W.partitionBy("team").orderBy(*ORDER, "side")
    last = in_order.rowsBetween(-length, -1)
    by_score = F.when(F.col("margin") > 0, 1).otherwise(0)
    at_map = sides.withColumns(
        {
            "__n": F.count(F.lit(1)).over(last),
            "__won": F.coalesce(F.sum(by_score).over(last), F.lit(0)),
            "__margin": F.coalesce(F.sum("margin").over(last), F.lit(0)),
        }
    )
    first = W.partitionBy("team", "datetime", "match_id").orderBy("game_id", "side").rowsBetween(W.unboundedPreceding, 0)
    n, won, margin = (F.first(c).over(first) for c in ("__n", "__won", "__margin"))
    return at_map.withColumns({"roll_win_pct": F.when(n > 0, won / n).otherwise(F.lit(0.0)), "roll_round_diff": margin.cast("double")}).drop("__n", "__won", "__margin")


def games_prior(rows: DataFrame, entity: list[str], name: str = "prior_games", order: tuple[str, ...] = ORDER) -> DataFrame:
    """How often the entity appeared before."""
    return rows.withColumn(name, (F.row_number().over(W.partitionBy(*entity).orderBy(*order)) - 1).cast("long"))


def prior_true(rows: DataFrame, entity: list[str], flag: Column, name: str, order: tuple[str, ...] = ORDER) -> DataFrame:
    """How often the flag held for the entity before."""
    w = W.partitionBy(*entity).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(flag.cast("long")).over(w), F.lit(0)))


def gaps(rows: DataFrame, entity: list[str], name: str = "gap_days", order: tuple[str, ...] = ORDER) -> DataFrame:
    """Days since the entity's last appearance; 0 at its first."""
    return rows.withColumn(name, gap_days(F.col("datetime"), F.lag("datetime").over(W.partitionBy(*entity).orderBy(*order))))


def lineups(players: DataFrame) -> DataFrame:
    """One row per map and side with its ``lineup``: the sorted player keys."""
    return players.groupBy(*ORDER, "side").agg(F.array_join(F.array_sort(F.collect_list("player_key")), "+").alias("lineup"))


def safe_z(column: str, within: list[str]) -> Column:
    """Score against the group's mean and population deviation; 0 for all when that is null or about 0."""
    w = W.partitionBy(*within)
    deviation = F.stddev_pop(column).over(w)
    return F.when(deviation.isNull() | (deviation <= Z_EPSILON), F.lit(0.0)).otherwise((F.col(column) - F.avg(column).over(w)) / deviation)


def impact_score(players: DataFrame, columns: tuple[str, ...], within: list[str]) -> DataFrame:
    """``z_<column>`` and their sum ``impact``; a row without any z has 0."""
    out = players.withColumns({f"z_{c}": safe_z(c, within) for c in columns})
    zs = [F.col(f"z_{c}") for c in columns]
    return out.withColumn("impact", sum((F.coalesce(z, F.lit(0.0)) for z in zs), F.lit(0.0)))


def is_final_map(rows: DataFrame, name: str = "is_final_map") -> DataFrame:
    """Whether the row belongs to the last map of its match."""
    last = F.max(F.struct("datetime", "game_id")).over(W.partitionBy("match_id"))
    return rows.withColumn(name, F.struct("datetime", "game_id") == last)


def rich_impact(players: DataFrame, plus: tuple[str, ...], minus: tuple[str, ...], within: list[str], name: str = "rich_impact") -> DataFrame:
    """Sum of the scores in ``plus`` less those in ``minus``: only on a match's final map and only if all are there, else 0."""
    whole = F.lit(True)
    for c in (*plus, *minus):
        whole = whole & F.col(c).isNotNull()
    total = sum((safe_z(c, within) for c in plus), F.lit(0.0)) - sum((safe_z(c, within) for c in minus), F.lit(0.0))
    flagged = is_final_map(players, "__final")
    return flagged.withColumn(name, F.when(F.col("__final") & whole, total).otherwise(F.lit(0.0))).drop("__final")


def centred(players: DataFrame, column: str, within: list[str], name: str = "relative") -> DataFrame:
    """The column, nulls filled by the group's median, else 0, minus the group's mean: sums to 0."""
    w = W.partitionBy(*within)
    filled = players.withColumn("__filled", F.coalesce(F.col(column), F.median(column).over(w), F.lit(0.0)))
    return filled.withColumn(name, F.col("__filled") - F.avg("__filled").over(w)).drop("__filled")


def rank_by_count(counts: DataFrame, first_seen: str, name: str = "place") -> DataFrame:
    """Place by count, largest first, equal counts by first appearance."""
    return counts.withColumn(name, F.row_number().over(W.orderBy(F.desc("n"), first_seen)))
