"""A forecast from snapshots and a tournament configuration, gated, exported, and only then compared.

Without ``full`` it stops after the gates and the opening probabilities.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, analytics, joins, replay, simulate
from ..operators.filters import ContractError
from ..sources import scans, sinks

# The two seeds of a run and the largest difference between them that is accepted.
SEEDS = (42, 99)
STABLE = 0.005


def opening_inputs(spark: SparkSession, config: dict, teams: DataFrame, people: DataFrame, lineups: DataFrame, scale: float) -> DataFrame:
    """Nine inputs of the four opening matchups."""
    pairs = spark.createDataFrame([tuple(p) for p in config["opening_matchups"]], "team1 string, team2 string")
    rosters = spark.createDataFrame([(t, p) for t, e in config["teams"].items() for p in e["players"]], "team string, player string")
    return replay.matchup_features(pairs, rosters, teams, people, lineups, config["as_of_date"], scale)


def lineup_state(config: dict, teams: DataFrame, people: DataFrame, lineups: DataFrame, scale: float) -> tuple[list[str], simulate.LineupElo]:
    """The eight teams' state at the tournament's moment, as arrays."""
    names = [t for pair in config["opening_matchups"] for t in pair]
    spark = teams.sparkSession
    pairs = spark.createDataFrame([(t, t) for t in names], "team1 string, team2 string")
    rosters = spark.createDataFrame([(t, p) for t in names for p in config["teams"][t]["players"]], "team string, player string")
    moment = F.lit(config["as_of_date"]).cast("timestamp")
    from ..functions.scalar import INITIAL, PLAYER_HALF_LIFE, TEAM_HALF_LIFE, decay, gap_days

    def now(half_life: float):
        gap = F.when(F.col("last_seen").isNull(), F.lit(0.0)).otherwise(gap_days(moment, F.col("last_seen")))
        return decay(F.coalesce("rating", F.lit(INITIAL)), gap, half_life)

    base = {r["team"]: r["now"] for r in pairs.select(F.col("team1").alias("team")).join(teams, "team", "left").select("team", now(TEAM_HALF_LIFE).alias("now")).collect()}
    own: dict[str, list[float]] = {t: [] for t in names}
    for r in rosters.join(people, "player", "left").select("team", "player", now(PLAYER_HALF_LIFE).alias("now")).orderBy("team", "player").collect():
        own[r["team"]].append(r["now"])
    # A team against itself gives its gap and its cold starts; its lineup count comes from the table.
    cells = {r["team1"]: r for r in replay.matchup_features(pairs, rosters, teams, people, lineups, config["as_of_date"], scale).collect()}
    asked = spark.createDataFrame([(t, "+".join(sorted(config["teams"][t]["players"]))) for t in names], "team string, lineup string")
    together = {r["team"]: float(r["n_maps"] or 0) for r in asked.join(lineups, "lineup", "left").collect()}
    count = [together[t] for t in names]
    return names, simulate.LineupElo(np.array([base[t] for t in names]), np.array([own[t] for t in names]), np.array([cells[t]["team1_gap_days"] for t in names]), np.array(count), np.array([cells[t]["team1_player_cold_starts"] for t in names]), scale)


def forecast(
    spark: SparkSession,
    config_path: str,
    teams: DataFrame,
    people: DataFrame,
    lineups: DataFrame,
    predict: Callable[[np.ndarray], np.ndarray],
    folder: str,
    artifact: str,
    scale: float,
    maps: list[str],
    parity: float = 0.0,
    replayed: tuple[int, int] = (0, 0),
    n_iterations: int = 1_000_000,
    full: bool = False,
    reset: bool = False,
) -> dict:
    """Opening probabilities, and with ``full`` both seeds' simulations, their stability and the exports."""
    config = scans.scan_config(spark, config_path).first().asDict(recursive=True)
    scans.validate_rosters(config)
    inputs = opening_inputs(spark, config, teams, people, lineups, scale).collect()
    x = np.array([[r[c] for c in replay.MODEL_FEATURES] for r in inputs], float)
    out: dict = {"openings": {f"{r['team1']}__vs__{r['team2']}": float(p) for r, p in zip(inputs, predict(x), strict=True)}}
    if not full:
        return out
    cold = int(x[:, -2:].sum())
    analytics.production_gate(cold, parity, *replayed)
    names, state = lineup_state(config, teams, people, lineups, scale)
    rules = simulate.Rules(names, maps, [(0, 1), (2, 3), (4, 5), (6, 7)])
    runs = {s: simulate.simulate_double(spark, rules, state, predict, n_iterations, s, reset) for s in SEEDS}
    kinds = {"champion": analytics.champions, "final": analytics.final_matchups, "runner_up": analytics.runner_ups, "podium": analytics.podiums}
    out["stability"] = {k: joins.max_share_difference(*[f(r).withColumn("total", F.lit(n_iterations)) for r in runs.values()], ["key"]).first()["max_difference"] for k, f in kinds.items()}
    if max(out["stability"].values()) > STABLE:
        raise ContractError(f"seeds differ too much: {out['stability']}")
    out["top_path_is_stable"] = analytics.top_membership(*[analytics.complete_paths(r) for r in runs.values()], 3).first()["is_member"]
    out["exports"] = {}
    for seed, paths in runs.items():
        stages = analytics.reconcile(analytics.stage_counts(paths, names), n_iterations)
        files = sinks.export_results(aggregates.summary_table(stages, n_iterations), folder, "forecast", seed, n_iterations, artifact, [tuple(p) for p in config["opening_matchups"]], {"stability": out["stability"]})
        out["exports"][seed] = {k: str(v) for k, v in files.items()}
    return out


def compare_with_outcome(config_path: str, member: str, exports: dict, champions: DataFrame, complete: DataFrame) -> dict:
    """The champion's place and the matching paths, once every export is there."""
    done = bool(exports) and all(Path(f).exists() for e in exports.values() for f in e.values())
    outcome = scans.load_outcome(config_path, member, done)
    place = analytics.place_of(champions, outcome["champion"]).first()
    same = analytics.matching_paths(complete, outcome.get("series", {}))
    return {"champion_place": place["place"] if place else None, "matching_paths": same.count()}
