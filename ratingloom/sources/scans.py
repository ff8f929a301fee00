"""Scans: CSV and Parquet with declared schemas, split partitions, configuration, lookups."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampNTZType

from ..operators.filters import ContractError, require_columns

CONTEST_SCHEMA = StructType(
    [
        StructField("match_id", LongType()),
        StructField("game_id", LongType()),
        StructField("datetime", TimestampNTZType()),
        StructField("map_name", StringType()),
        StructField("is_total", StringType()),
        StructField("bestOf", StringType()),
        StructField("score1_game", StringType()),
        StructField("score2_game", StringType()),
        StructField("team1_id", LongType()),
        StructField("team2_id", LongType()),
        StructField("team1_join_key", StringType()),
        StructField("team2_join_key", StringType()),
        StructField("team1_win", LongType()),
    ]
)
PLAYERS_SCHEMA = StructType([StructField("player_id", LongType()), StructField("player_name", StringType())])
TOURNAMENTS_SCHEMA = StructType([StructField("tournament", StringType())])
CONFIG_SCHEMA = "tournament string, as_of_date string, opening_matchups array<array<string>>, teams map<string, struct<entry_method: string, players: array<string>, roster_verified: boolean>>"


def scan_csv(spark: SparkSession, path: str, schema: StructType, columns: list[str] | None = None) -> DataFrame:
    """A CSV with a header, its names checked against the schema; only the asked columns are parsed."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.select(*columns) if columns else df


def scan_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = require_columns(df, columns).select(*columns) if columns else df
    return df.orderBy(*order) if order else df


def scan_split(spark: SparkSession, path: str, splits: list[str]) -> DataFrame:
    """Only the asked splits of a table partitioned by ``split``: files of other splits are never opened."""
    known = {"val": "validation"}
    return spark.read.parquet(path).where(F.col("split").isin([known.get(s, s) for s in splits]))


def redacted_text(text: str, member: str) -> str:
    """JSON text without one top-level object member, removed before anything is parsed."""
    pattern = re.compile(r',?\s*"' + re.escape(member) + r'"\s*:\s*(?:\{[^{}]*\}|"[^"]*"|\[[^\[\]]*\]|[^,}\]]+)')
    out, n = pattern.subn("", text)
    if n != 1:
        raise ContractError(f"{member} must be there exactly once, found {n}")
    return re.sub(r"\{\s*,", "{", out)


def scan_config(spark: SparkSession, path: str, hidden: str = "confirmed_result") -> DataFrame:
    """A tournament's configuration as one row; the outcome member is cut out before parsing."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    plain = redacted_text(text, hidden) if f'"{hidden}"' in text else text
    return spark.createDataFrame([(plain,)], "raw string").select(F.from_json("raw", CONFIG_SCHEMA).alias("c")).select("c.*")


def load_outcome(path: str, member: str, exported: bool) -> object:
    """The outcome member, only once the forecast's exports exist."""
    if not exported:
        raise ContractError("the forecast isn't exported yet")
    with open(path) as f:
        return json.load(f)[member]


def validate_rosters(config: dict, teams: int = 8, players: int = 5) -> None:
    """All faults of a roster file at once."""
    faults = []
    found = config.get("teams") or {}
    if len(found) != teams:
        faults.append(f"{len(found)} teams instead of {teams}")
    named = {t for pair in config.get("opening_matchups") or [] for t in pair}
    faults += [f"{t}: not among the openings" for t in sorted(set(found) - named)] + [f"{t}: no roster" for t in sorted(named - set(found))]
    for name, entry in sorted(found.items()):
        roster = entry.get("players") or []
        if len(roster) != players or any(not str(p or "").strip() for p in roster):
            faults.append(f"{name}: needs {players} named players")
        if entry.get("roster_verified") is not True:
            faults.append(f"{name}: roster isn't verified")
    if faults:
        raise ContractError("; ".join(faults))


