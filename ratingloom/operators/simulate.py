"""Monte Carlo series and brackets: arrays of paths instead of one state object per path.

A path's random numbers are a hash of (seed, path, draw), so outcomes depend
neither on batches nor on partitions, and SQL can repeat them.  Paths are a
``spark.range`` dealt over the cluster; counting is left to Spark's aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.scalar import INITIAL, K_TEAM, SCALE
from .filters import ContractError

MASK = np.uint64(0xFFFFFFFF)
# Fixed values of the 32-bit counter hash.
PATH_STEP, SEED_STEP, DRAW_STEP, MIX1, MIX2 = 2654435761, 3266489917, 2246822519, 0x85EBCA6B, 0xC2B2AE35
#: Draw numbers of one series: up to eight outcomes, then the map order's keys.
DRAWS = 32
SLOTS = ("qf1", "qf2", "qf3", "qf4", "ub_sf1", "ub_sf2", "lb_r1a", "lb_r1b", "lb_sfa", "lb_sfb", "ub_final", "lb_r3", "lb_final", "grand_final", "reset")


def mix32(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(16))
    x = (x * np.uint64(MIX1)) & MASK
    x = x ^ (x >> np.uint64(13))
    x = (x * np.uint64(MIX2)) & MASK
    return x ^ (x >> np.uint64(16))


def path_keys(seed: int, paths: np.ndarray) -> np.ndarray:
    return mix32((paths.astype(np.uint64) * np.uint64(PATH_STEP) + np.uint64(seed * SEED_STEP % 2**32)) & MASK)


def uniform(keys: np.ndarray, draw: int) -> np.ndarray:
    return mix32(keys ^ np.uint64(draw * DRAW_STEP % 2**32)).astype(np.float64) / 4294967296.0


def mix32_sql(x: str) -> str:
    """``mix32`` as a DuckDB expression over an unsigned 64-bit one."""
    a = f"xor({x}, {x} >> 16)"
    b = f"(({a}) * {MIX1}::ubigint & 4294967295::ubigint)"
    c = f"xor({b}, {b} >> 13)"
    d = f"(({c}) * {MIX2}::ubigint & 4294967295::ubigint)"
    return f"xor({d}, {d} >> 16)"


def path_key_sql(seed: int, path: str) -> str:
    return mix32_sql(f"(({path}::ubigint * {PATH_STEP}::ubigint + {seed * SEED_STEP % 2**32}::ubigint) & 4294967295::ubigint)")


def uniform_sql(key: str, draw: int) -> str:
    return f"(({mix32_sql(f'xor({key}, {draw * DRAW_STEP % 2**32}::ubigint)')})::double / 4294967296.0::double)"


Predictor = Callable[[np.ndarray], np.ndarray]


def elo_model(features: np.ndarray) -> np.ndarray:
    """Map-win probability from the global ratings (columns 0 and 1)."""
    return 1.0 / (1.0 + 10.0 ** ((features[:, 1] - features[:, 0]) / SCALE))


def coin(features: np.ndarray) -> np.ndarray:
    return np.full(len(features), 0.5)


@dataclass
class TeamElo:
    """Global and per-map ratings of the teams, one row per path.

    ``single`` keeps the state in single precision; ``k = 0`` freezes the ratings.
    """

    ratings: np.ndarray
    on_map: np.ndarray
    k: float = K_TEAM
    single: bool = False

    uses_maps = True

    def start(self, n: int) -> TeamElo:
        kind = np.float32 if self.single else np.float64
        return TeamElo(np.repeat(self.ratings[None].astype(kind), n, 0), np.repeat(self.on_map[None].astype(kind), n, 0), self.k, self.single)

    def features(self, rows: np.ndarray, a: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
        ga, gb, ma, mb = self.ratings[rows, a], self.ratings[rows, b], self.on_map[rows, a, m], self.on_map[rows, b, m]
        return np.stack([ga, gb, ma, mb, ga - gb, ma - mb], 1)

    def update(self, rows: np.ndarray, a: np.ndarray, b: np.ndarray, m: np.ndarray, won: np.ndarray) -> None:
        for table, x, y in ((self.ratings, (rows, a), (rows, b)), (self.on_map, (rows, a, m), (rows, b, m))):
            step = self.k * (won - 1.0 / (1.0 + 10.0 ** ((table[y] - table[x]) / SCALE)))
            table[x] += step
            table[y] -= step


@dataclass
class LineupElo:
    """Team and player ratings, gaps, lineup counts: the nine-feature state.

    The tournament happens at one moment, so a team's gap is 0 after its first
    simulated map and its players are no longer new.
    """

    team: np.ndarray
    players: np.ndarray  # [team, 5]
    gaps: np.ndarray
    lineup_maps: np.ndarray
    cold: np.ndarray
    scale: float = 1.0
    k: float = K_TEAM

    uses_maps = False

    def start(self, n: int) -> LineupElo:
        many = [np.repeat(x[None].astype(float), n, 0) for x in (self.team, self.players, self.gaps, self.lineup_maps, self.cold)]
        return LineupElo(*many, self.scale, self.k)

    def features(self, rows: np.ndarray, a: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
        pa_, pb = self.players[rows, a], self.players[rows, b]
        return np.stack(
            [
                self.team[rows, a] - self.team[rows, b],
                self.scale * (pa_.mean(1) - pb.mean(1)),
                self.gaps[rows, a],
                self.gaps[rows, b],
                self.scale * pa_.std(1),
                self.scale * pb.std(1),
                self.lineup_maps[rows, a] - self.lineup_maps[rows, b],
                self.cold[rows, a],
                self.cold[rows, b],
            ],
            1,
        )

    def update(self, rows: np.ndarray, a: np.ndarray, b: np.ndarray, m: np.ndarray, won: np.ndarray) -> None:
        step = self.k * (won - 1.0 / (1.0 + 10.0 ** ((self.team[rows, b] - self.team[rows, a]) / SCALE)))
        for side, sign in ((a, 1.0), (b, -1.0)):
            self.team[rows, side] += sign * step
            self.players[rows, side] += (sign * step / 5.0)[:, None]
            self.gaps[rows, side] = 0.0
            self.cold[rows, side] = 0.0
            self.lineup_maps[rows, side] += 1


@dataclass
class Rules:
    """Teams by name, maps, known map orders of unordered pairs, and the seeds of the bracket."""

    teams: list[str]
    maps: list[str]
    openings: list[tuple[int, int]]
    orders: dict[frozenset, list[int]] = field(default_factory=dict)

    def check(self) -> None:
        flat = [t for pair in self.openings for t in pair]
        if len(self.openings) != 4 or sorted(flat) != sorted(set(flat)) or len(flat) != 8:
            raise ContractError("a bracket needs four pairs of eight different teams")
        if len(set(self.maps)) < 5:
            raise ContractError("a bracket needs five different maps or more")


def check_series(a: object, b: object, best_of: int, maps: list) -> None:
    if a == b:
        raise ContractError("a team can't play itself")
    if best_of not in (3, 5):
        raise ContractError(f"best of {best_of} is not known")
    if len(maps) < best_of:
        raise ContractError(f"best of {best_of} needs as many maps")


def play(state, keys: np.ndarray, a: np.ndarray, b: np.ndarray, best_of: int, slot: int, rules: Rules, predict: Predictor, order: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(winner, wins of a, wins of b) of one series on every path; the state moves after each map."""
    n, pool = len(keys), len(rules.maps)
    need = best_of // 2 + 1
    wins_a, wins_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if order is not None:
        maps = np.repeat(np.array(order)[None], n, 0)
    elif state.uses_maps:
        keyed = np.stack([uniform(keys, slot * DRAWS + 8 + i) for i in range(pool)], 1)
        maps = np.argsort(keyed, 1, kind="stable")
        for pair, known in rules.orders.items():
            x, y = sorted(pair)
            rows = ((a == x) & (b == y)) | ((a == y) & (b == x))
            maps[rows, : len(known)] = known
    else:
        maps = np.zeros((n, best_of), np.int64)
    active = np.arange(n)
    for i in range(best_of):
        if not len(active):
            break
        x, y, m = a[active], b[active], maps[active, i]
        p = predict(state.features(active, x, y, m))
        if not (np.isfinite(p).all() and ((p >= 0) & (p <= 1)).all()):
            raise ContractError("a probability is not in [0, 1]")
        won = (uniform(keys[active], slot * DRAWS + i) < p).astype(float)
        wins_a[active] += won.astype(np.int64)
        wins_b[active] += 1 - won.astype(np.int64)
        state.update(active, x, y, m, won)
        active = active[(wins_a[active] < need) & (wins_b[active] < need)]
    return np.where(wins_a == need, a, b), wins_a, wins_b


def _other(a: np.ndarray, b: np.ndarray, winner: np.ndarray) -> np.ndarray:
    return np.where(winner == a, b, a)


def double_elimination(state, keys: np.ndarray, rules: Rules, predict: Predictor, reset: bool) -> dict[str, np.ndarray]:
    """Winner of each series on every path, team numbers; one state runs through all series of a path."""
    n = len(keys)
    won: dict[str, np.ndarray] = {}
    lost: dict[str, np.ndarray] = {}

    def series(name: str, a: np.ndarray, b: np.ndarray, best_of: int = 3) -> None:
        won[name] = play(state, keys, a, b, best_of, SLOTS.index(name), rules, predict)[0]
        lost[name] = _other(a, b, won[name])

    for i, (a, b) in enumerate(rules.openings):
        series(f"qf{i + 1}", np.full(n, a), np.full(n, b))
    series("ub_sf1", won["qf1"], won["qf2"])
    series("ub_sf2", won["qf3"], won["qf4"])
    series("lb_r1a", lost["qf1"], lost["qf2"])
    series("lb_r1b", lost["qf3"], lost["qf4"])
    series("lb_sfa", won["lb_r1a"], lost["ub_sf2"])
    series("lb_sfb", won["lb_r1b"], lost["ub_sf1"])
    series("ub_final", won["ub_sf1"], won["ub_sf2"])
    series("lb_r3", won["lb_sfa"], won["lb_sfb"])
    series("lb_final", won["lb_r3"], lost["ub_final"])
    series("grand_final", won["ub_final"], won["lb_final"], 5)
    again = (won["grand_final"] == won["lb_final"]) & reset
    champion = won["grand_final"].copy()
    won["reset"] = np.full(n, -1)
    rows = np.flatnonzero(again)
    if len(rows):
        part = _Rows(state, rows)
        winner = play(part, keys[rows], won["ub_final"][rows], won["lb_final"][rows], 5, SLOTS.index("reset"), rules, predict)[0]
        champion[rows] = winner
        won["reset"][rows] = winner
    won["champion"] = champion
    won["runner_up"] = _other(won["ub_final"], won["lb_final"], champion)
    won["third"] = lost["lb_final"]
    return won


class _Rows:
    """A state seen through some of its paths."""

    def __init__(self, state, rows: np.ndarray):
        self.state, self.rows, self.uses_maps = state, rows, state.uses_maps

    def features(self, rows, a, b, m):
        return self.state.features(self.rows[rows], a, b, m)

    def update(self, rows, a, b, m, won):
        self.state.update(self.rows[rows], a, b, m, won)


def single_elimination(state, keys: np.ndarray, rules: Rules, predict: Predictor) -> dict[str, np.ndarray]:
    """Quarter-finals, semi-finals (best of 3) and a final (best of 5)."""
    n = len(keys)
    won: dict[str, np.ndarray] = {}
    for i, (a, b) in enumerate(rules.openings):
        won[f"qf{i + 1}"] = play(state, keys, np.full(n, a), np.full(n, b), 3, i, rules, predict)[0]
    won["sf1"] = play(state, keys, won["qf1"], won["qf2"], 3, 4, rules, predict)[0]
    won["sf2"] = play(state, keys, won["qf3"], won["qf4"], 3, 5, rules, predict)[0]
    won["champion"] = play(state, keys, won["sf1"], won["sf2"], 5, 6, rules, predict)[0]
    return won


def _paths(spark: SparkSession, n: int, partitions: int | None, schema: str, body: Callable[[np.ndarray], dict[str, np.ndarray]], step: int = 8192) -> DataFrame:
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ContractError("the number of paths must be a positive integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for low in range(0, len(ids), step):
                yield pa.RecordBatch.from_pydict(body(ids[low : low + step]))

    return spark.range(0, n, 1, partitions or spark.sparkContext.defaultParallelism).mapInArrow(run, schema)


def simulate_double(spark: SparkSession, rules: Rules, start, predict: Predictor, n: int, seed: int = 42, reset: bool = False, partitions: int | None = None) -> DataFrame:
    """One row per path: ``path``, the team that wins each series, ``champion, runner_up, third``."""
    rules.check()
    names = np.array([*rules.teams, None], object)
    columns = [*SLOTS, "champion", "runner_up", "third"]

    def body(ids: np.ndarray) -> dict[str, np.ndarray]:
        won = double_elimination(start.start(len(ids)), path_keys(seed, ids), rules, predict, reset)
        return {"path": ids} | {c: pa.array(names[won[c]], pa.string()) for c in columns}

    return _paths(spark, n, partitions, "path long, " + ", ".join(f"{c} string" for c in columns), body)


def simulate_single(spark: SparkSession, rules: Rules, start, predict: Predictor, n: int, seed: int = 42, partitions: int | None = None) -> DataFrame:
    rules.check()
    names = np.array(rules.teams, object)
    columns = ["qf1", "qf2", "qf3", "qf4", "sf1", "sf2", "champion"]

    def body(ids: np.ndarray) -> dict[str, np.ndarray]:
        won = single_elimination(start.start(len(ids)), path_keys(seed, ids), rules, predict)
        return {"path": ids} | {c: pa.array(names[won[c]], pa.string()) for c in columns}

    return _paths(spark, n, partitions, "path long, " + ", ".join(f"{c} string" for c in columns), body)


def simulate_series(spark: SparkSession, ratings: tuple[float, float], best_of: int, n: int, seed: int = 7, on_map: np.ndarray | None = None, predict: Predictor = elo_model, k: float = K_TEAM, maps: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """One row per path of a series in a fixed map order: ``path, wins_a, wins_b``."""
    maps = maps or [f"M{i + 1}" for i in range(best_of)]
    check_series("a", "b", best_of, maps)
    rules = Rules(["a", "b"], maps, [])
    start = TeamElo(np.array(ratings, float), np.full((2, len(maps)), INITIAL) if on_map is None else on_map, k)

    def body(ids: np.ndarray) -> dict[str, np.ndarray]:
        zero = np.zeros(len(ids), np.int64)
        _, wins_a, wins_b = play(start.start(len(ids)), path_keys(seed, ids), zero, zero + 1, best_of, 0, rules, predict, list(range(len(maps))))
        return {"path": ids, "wins_a": wins_a, "wins_b": wins_b}

    return _paths(spark, n, partitions, "path long, wins_a long, wins_b long", body)
