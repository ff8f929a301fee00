"""Filters, coercions, contracts and audits.

Row-level checks are one aggregate with a counter for each rule, so a contract
costs a single pass whatever the number of rules.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import is_boolean_text, loose_number, strict_boolean

# What a pre-event table may hold, and parts of names that betray the outcome.
IDENTIFIERS = ("match_id", "game_id", "tournament", "team1_id", "team1", "team2_id", "team2", "map_id", "team1_join_key", "team2_join_key")
CONTEXT = ("datetime", "map_name", "team1_win")
PROFILE_RATES = ("pistol_round_win_rate", "ct_win_rate", "t_win_rate")
PROFILE_COUNTS = ("n_pistol_rounds", "n_ct_rounds", "n_t_rounds")
PROFILE = (
    "team1_pistol_round_win_rate", "team1_n_pistol_rounds", "team1_ct_win_rate", "team1_n_ct_rounds", "team1_t_win_rate", "team1_n_t_rounds",
    "team2_pistol_round_win_rate", "team2_n_pistol_rounds", "team2_ct_win_rate", "team2_n_ct_rounds", "team2_t_win_rate", "team2_n_t_rounds",
)
LEAK_TOKENS = ("score", "kills", "deaths", "assists", "adr", "kast", "kddiff", "games_played", "player1", "player2", "player3", "player4", "player5")
MODEL_LEAK_TOKENS = ("impact", "relative_performance", "rich_stats_final_map")


class ContractError(ValueError):
    """A table breaks its contract."""


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError(f"missing columns: {missing}")
    return df


def allowlist(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only the allowed columns, in the order allowed."""
    return require_columns(df, columns).select(*columns)


def leaking_columns(columns: list[str], tokens: tuple[str, ...] = LEAK_TOKENS, keep: tuple[str, ...] = ("team1_win",)) -> list[str]:
    return sorted(c for c in columns if c not in keep and any(t in c.lower() for t in tokens))


def assert_no_leaks(df: DataFrame, tokens: tuple[str, ...] = LEAK_TOKENS) -> DataFrame:
    found = leaking_columns(df.columns, tokens)
    if found:
        raise ContractError(f"columns known only after the event: {found}")
    return df


def coerce_contests(df: DataFrame) -> DataFrame:
    """Adds ``total`` (strict boolean of ``is_total``) and ``bo`` (loose number of ``bestOf`` or ``best_of``)."""
    length = "bestOf" if "bestOf" in df.columns else "best_of"
    return df.withColumns({"total": strict_boolean(F.col("is_total")), "bo": loose_number(F.col(length))})


def is_valid() -> Column:
    """A named map that isn't a series total (a best-of-one total is its map) with a positive score."""
    one = F.coalesce(F.col("bo") == 1, F.lit(False))
    scored = F.coalesce(loose_number(F.col("score1_game")) + loose_number(F.col("score2_game")) > 0, F.lit(False))
    return F.col("map_name").isNotNull() & (~F.col("total") | one) & scored


def valid_contests(df: DataFrame) -> DataFrame:
    return df.where(is_valid())


def filter_audit(df: DataFrame) -> DataFrame:
    """One row of counters; a row counts for the first rule that it breaks."""
    named = F.col("map_name").isNotNull()
    one = F.coalesce(F.col("bo") == 1, F.lit(False))
    phantom = named & F.col("total") & ~one
    scored = F.coalesce(loose_number(F.col("score1_game")) + loose_number(F.col("score2_game")) > 0, F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~named).alias("n_missing_map"),
        F.count_if(phantom).alias("n_phantom"),
        F.count_if(named & ~phantom & ~scored).alias("n_non_positive"),
        F.count_if(is_valid()).alias("n_valid"),
    )


def boolean_spellings(df: DataFrame, column: str) -> DataFrame:
    """How often each spelling occurs, whether it can be read, and as what."""
    counted = df.groupBy(F.col(column).alias("spelling")).agg(F.count(F.lit(1)).alias("n"))
    c = F.col("spelling")
    read = F.when(c.isNull(), F.lit(False)).when(is_boolean_text(c), F.lower(F.trim(c)).isin("true", "1"))
    return counted.withColumns({"readable": is_boolean_text(c), "as_boolean": read})


def before(df: DataFrame, cutoff: str, column: str = "datetime") -> DataFrame:
    """Rows strictly before the cutoff; the comparison is pushed to the scan."""
    return df.where(F.col(column) < F.lit(cutoff).cast(df.schema[column].dataType))


def mentions(column: str, text: str, year: int | None = None, time: str = "datetime") -> Column:
    """The column contains the text in any case (null: no), in the given year."""
    hit = F.coalesce(F.contains(F.lower(F.col(column)), F.lit(text.lower())), F.lit(False))
    return hit & (F.year(time) == year) if year else hit


def is_pair(a: str, b: str, x, y) -> Column:
    return ((F.col(a) == x) & (F.col(b) == y)) | ((F.col(a) == y) & (F.col(b) == x))


def in_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def presence(df: DataFrame, flags: dict[str, list[str]]) -> DataFrame:
    """A flag for each set of columns that are all there."""
    out = {}
    for name, columns in flags.items():
        there = F.lit(True)
        for c in columns:
            there = there & F.col(c).isNotNull()
        out[name] = there
    return df.withColumns(out)


def finite(columns: list[str]) -> Column:
    good = F.lit(True)
    for c in columns:
        x = F.col(c).cast("double")
        good = good & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return good


@dataclass
class Contract:
    """Columns and rules of a table, checked in one aggregate and one pass for each key."""

    columns: list[str]
    rules: dict[str, Column] = field(default_factory=dict)  # name: what every row must satisfy
    unique: list[list[str]] = field(default_factory=list)
    determines: list[tuple[str, str]] = field(default_factory=list)  # (key, the one value it has)
    ordered_by: list[str] = field(default_factory=list)  # (group, position, column that never falls), or none

    def violations(self, df: DataFrame) -> DataFrame:
        """``rule, n`` for every rule; 0 where it holds."""
        require_columns(df, self.columns)
        counts = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in self.rules.items()]
        parts = []
        if counts:
            one = df.agg(*counts)
            parts.append(one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in self.rules])).alias("r")).select("r.*"))
        for key in self.unique:
            twice = df.groupBy(*key).agg(F.count(F.lit(1)).alias("k")).where("k > 1")
            parts.append(twice.agg(F.count(F.lit(1)).alias("n")).select(F.lit("unique:" + ",".join(key)).alias("rule"), "n"))
        for key, value in self.determines:
            many = df.groupBy(key).agg(F.countDistinct(value).alias("k")).where("k > 1")
            parts.append(many.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"one:{key}->{value}").alias("rule"), "n"))
        if self.ordered_by:
            group, position, column = self.ordered_by
            falls = order_breaks(df, position, column, [group])
            parts.append(falls.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"ordered:{column}").alias("rule"), "n"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def enforce(self, df: DataFrame) -> DataFrame:
        bad = self.violations(df).where("n > 0").orderBy("rule").collect()
        if bad:
            raise ContractError("; ".join(f"{r['rule']}: {r['n']}" for r in bad))
        return df


def contest_contract() -> Contract:
    return Contract(
        columns=["match_id", "game_id", "datetime", "map_name", "is_total", "score1_game", "score2_game", "team1_id", "team2_id", "team1_win"],
        rules={
            "no_tie": F.col("score1_game") != F.col("score2_game"),
            "binary_target": F.col("team1_win").isin(0, 1),
            "ids_present": F.col("match_id").isNotNull() & F.col("game_id").isNotNull() & F.col("team1_id").isNotNull() & F.col("team2_id").isNotNull(),
            "two_teams": F.col("team1_id") != F.col("team2_id"),
            "has_time": F.col("datetime").isNotNull(),
            "score_agrees": (F.col("score1_game") > F.col("score2_game")).cast("int") == F.col("team1_win"),
            "counts_not_negative": (F.col("score1_game") >= 0) & (F.col("score2_game") >= 0),
        },
        unique=[["match_id", "game_id"]],
        determines=[("match_id", "datetime")],
        ordered_by=["match_id", "game_id", "datetime"],
    )


def rates_out_of_range(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, n``: of each rate, the rows where it is there but not in [0, 1]."""
    counts = df.agg(*[F.count_if(~F.col(c).between(0.0, 1.0)).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns])).alias("r")).select("r.*")


def group_sizes_wrong(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != size)


def group_sums_off(df: DataFrame, keys: list[str], column: str, tolerance: float = 1e-10) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(column).alias("total")).where(F.abs("total") > tolerance)


def order_breaks(df: DataFrame, position: str, column: str, within: list[str]) -> DataFrame:
    """Rows whose value is below that of the row before, in each group."""
    prior = F.lag(column).over(W.partitionBy(*within).orderBy(position))
    return df.withColumn("prior", prior).where(F.col("prior") > F.col(column))
