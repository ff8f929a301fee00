"""Names to keys: aliases, the best candidate of an alias, entity status, resolution reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import fold_text


def alias_index(rows: DataFrame, alias: Column, key: str, time: str = "datetime") -> DataFrame:
    """``alias, key, n_maps, last_seen`` of every key that an alias was seen with."""
    named = rows.select(alias.alias("alias"), F.col(key).alias("key"), F.col(time).alias("time")).where("alias <> ''")
    return named.groupBy("alias", "key").agg(F.count(F.lit(1)).alias("n_maps"), F.max("time").alias("last_seen"))


def resolve(requests: DataFrame, index: DataFrame, prefix: str = "") -> DataFrame:
    """``alias`` of each request with its ``key``: most maps, then latest, then largest key; unknown: the alias itself."""
    best = index.groupBy("alias").agg(F.max_by("key", F.struct("n_maps", "last_seen", "key")).alias("key"))
    return requests.join(best, "alias", "left").withColumn("key", F.coalesce("key", F.concat(F.lit(prefix), F.col("alias"))))


def status(keys: DataFrame, rows: DataFrame, key: str, time: str = "datetime") -> DataFrame:
    """``key, n_games, last_seen, cold_start`` of each asked key."""
    seen = rows.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n_games"), F.max(time).alias("last_seen"))
    out = keys.join(seen, "key", "left").withColumn("n_games", F.coalesce("n_games", F.lit(0)))
    return out.withColumn("cold_start", F.col("n_games") == 0)


def resolution_report(rosters: DataFrame, index: DataFrame, rows: DataFrame) -> DataFrame:
    """Rosters (``team``, ``players`` array) to one row per slot: the player's key and status."""
    slots = rosters.select("team", F.posexplode("players").alias("slot", "player")).withColumn("alias", fold_text(F.col("player")))
    resolved = resolve(slots, index, "name:")
    return status(resolved, rows, "player_key").select("team", "slot", "player", "key", "n_games", "last_seen", "cold_start")


def close_aliases(requests: DataFrame, index: DataFrame, least: float = 0.9) -> DataFrame:
    """For aliases without an exact match, known ones of the same first letter and similar length by edit distance."""
    known = index.select(F.col("alias").alias("known")).distinct()
    missing = requests.select("alias").distinct().join(known, F.col("alias") == F.col("known"), "left_anti")
    size = F.greatest(F.length("alias"), F.length("known"))
    blocked = missing.withColumn("block", F.substring("alias", 1, 1)).join(known.withColumn("block", F.substring("known", 1, 1)), "block")
    close = blocked.withColumn("similarity", 1 - F.levenshtein("alias", "known") / size)
    return close.where(F.col("similarity") >= least).select("alias", "known", "similarity")
