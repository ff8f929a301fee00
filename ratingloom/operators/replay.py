"""Sequential rating replays: a row's ratings are emitted before its outcome moves any state.

Ratings are a strict recurrence, so a league is one ordered stream.  Leagues
(``league`` column; teams of different leagues never meet) are dealt over the
cluster and sorted in place, and each task streams its leagues through Arrow
batches with the ratings as its only state: memory grows with teams, not with
rows, and Spark's sort spills.  Only what the recurrence reads goes through that
stream; its ratings are joined to the rows by their key, in parallel.  Players
never meet but through their teams' changes, so each is a stream of their own.
Everything that isn't a recurrence (counts, gaps, lineups, head-to-head, form) is
a window in ``windows``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.scalar import CLIP, INITIAL, K_PERFORMANCE, K_TEAM, PLAYER_HALF_LIFE, PLAYER_SCALE, SCALE, TEAM_HALF_LIFE, elo_expectation
from ..storage import stored
from . import windows
from .reshape import side_pivot

DAY = 86_400_000_000.0
KEYS = ("datetime", "match_id", "game_id")
ROW = ("match_id", "game_id")


def _stream(df: DataFrame, league: str | None, order: tuple[str, ...]) -> tuple[DataFrame, str]:
    """Rows dealt by league and sorted; without a league column all rows are one."""
    name = league or "__league"
    if not league:
        df = df.withColumn(name, F.lit(""))
    return df.repartition(F.col(name)).sortWithinPartitions(name, *order), name


def _replayed(key: StructType, extra: list[StructField]) -> StructType:
    return StructType([*key.fields, *extra])


def team_replay(contests: DataFrame, k: float = K_TEAM, league: str | None = None, order: tuple[str, ...] = KEYS, row: tuple[str, ...] = ROW) -> DataFrame:
    """The contests with global and per-map ratings before each map.

    Updates show at the next map, also of the same match.  Adds
    ``team{1,2}_elo_global``, ``team{1,2}_elo_map`` and both raw probabilities.
    ``row`` (with the league) identifies a contest; one without it, or without its
    place in the order, has null ratings and moves none.
    """
    key = [*([league] if league else []), *row]
    placed = contests.dropna(subset=[*key, *order]).select(*dict.fromkeys([*key, *order]), "key1", "key2", "map_name", "team1_win")
    dealt, name = _stream(placed, league, order)
    names = dealt.columns
    at = [names.index(c) for c in (name, "key1", "key2", "map_name", "team1_win")]
    kept = [names.index(c) for c in key]
    added = ["team1_elo_global", "team2_elo_global", "team1_elo_map", "team2_elo_map"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = ()
        team: dict = {}
        on_map: dict = {}
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in at), strict=True)
            out = np.empty((4, batch.num_rows))
            for i, (group, a, b, m, y) in enumerate(rows):
                if group != current:
                    current, team, on_map = group, {}, {}
                ga, gb = team.get(a, INITIAL), team.get(b, INITIAL)
                ma, mb = on_map.get((a, m), INITIAL), on_map.get((b, m), INITIAL)
                out[:, i] = ga, gb, ma, mb
                step = k * (y - 1.0 / (1.0 + 10.0 ** ((gb - ga) / SCALE)))
                team[a], team[b] = ga + step, gb - step
                step = k * (y - 1.0 / (1.0 + 10.0 ** ((mb - ma) / SCALE)))
                on_map[a, m], on_map[b, m] = ma + step, mb - step
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *map(pa.array, out)], names=key + added)

    schema = _replayed(dealt.select(*key).schema, [StructField(c, DoubleType()) for c in added])
    rated = contests.join(dealt.mapInArrow(run, schema), key, "left").select(*contests.columns, *added)
    return rated.withColumns(
        {
            "raw_global_elo_prob": elo_expectation(F.col("team1_elo_global"), F.col("team2_elo_global")),
            "raw_map_elo_prob": elo_expectation(F.col("team1_elo_map"), F.col("team2_elo_map")),
        }
    )


def point_in_time_features(contests: DataFrame, league: str | None = None) -> DataFrame:
    """The fourteen pre-map columns: ratings, map games, probabilities, head-to-head wins, form."""
    sides = windows.both_sides(contests)
    sides = windows.form_prior(windows.h2h_prior(sides))
    sides = windows.games_prior(sides, ["team", "map_name"], "map_elo_n_games")
    wide = side_pivot(sides, ["match_id", "game_id"], ["map_elo_n_games", "h2h_wins", "roll_win_pct", "roll_round_diff"])
    names = {f"team{s}_roll_{x}": f"team{s}_roll5_{x}" for s in (1, 2) for x in ("win_pct", "round_diff")}
    return team_replay(contests, league=league).join(wide.withColumnsRenamed(names), ["match_id", "game_id"])


def snapshot(rated: DataFrame, k: float = K_TEAM) -> DataFrame:
    """``team, rating, n_maps, last_seen`` after the last map of each team."""
    step = F.lit(k) * (F.col("team1_win") - F.col("raw_global_elo_prob"))
    sides = F.array(
        F.struct(F.col("key1").alias("team"), (F.col("team1_elo_global") + step).alias("after")),
        F.struct(F.col("key2").alias("team"), (F.col("team2_elo_global") - step).alias("after")),
    )
    long = rated.select(*KEYS, F.explode(sides).alias("s")).select(*KEYS, "s.*")
    return long.groupBy("team").agg(F.max_by("after", F.struct(*KEYS)).alias("rating"), F.count(F.lit(1)).alias("n_maps"), F.max("datetime").alias("last_seen"))


def roster_arrays(players: DataFrame, relative: str = "relative", rich: str | None = None) -> DataFrame:
    """One row per map: ten player keys and relative performances, by side and slot."""
    rich_value = F.col(rich) if rich else F.col(relative)
    cells = F.array_sort(F.collect_list(F.struct("side", "slot", "player_key", F.col(relative).alias("rel"), rich_value.alias("rich"))))
    return players.groupBy("match_id", "game_id").agg(cells.alias("c")).select("match_id", "game_id", F.col("c.player_key").alias("keys"), F.col("c.rel").alias("rel"), F.col("c.rich").alias("rich"))


class _Seen:
    """Entities numbered as they appear, with the time each was last there."""

    def __init__(self) -> None:
        self.codes: dict = {}
        self.last = np.full(64, np.inf)

    def gaps(self, names: list, now: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and days since the last appearance (0 at the first) of ``width`` entities a row, all rows at once."""
        codes = np.array([self.codes.setdefault(x, len(self.codes)) for x in names], np.int64)
        if (more := len(self.codes) - len(self.last)) > 0:
            self.last = np.append(self.last, np.full(max(more, len(self.last)), np.inf))
        at = np.argsort(codes, kind="stable")
        code, time = codes[at], np.repeat(now, width)[at]
        again = np.append(False, code[1:] == code[:-1])
        before = np.where(again, np.append(0.0, time[:-1]), self.last[code])
        days = np.empty(len(codes))
        days[at] = np.maximum(0.0, (time - before) / DAY)
        final = np.append(~again[1:], True)
        self.last[code[final]] = time[final]
        return codes.reshape(-1, width), days.reshape(-1, width)


#: What a map's team change is worth to each of the five players a side.
SHARE = 0.2


class _Teams:
    """One league's state in the lineup replay: team ratings less the initial one."""

    def __init__(self, k: float, half_life: float) -> None:
        self.k, self.half_life = k, half_life
        self.seen, self.rating = _Seen(), []

    def fold(self, now: np.ndarray, pairs: list, won: list) -> tuple[np.ndarray, np.ndarray]:
        """[row, 3] ratings before each row and the row's change, [row, 2] gaps, in order.

        Gaps and their decay don't depend on ratings, so they are found for all rows at once.
        """
        sides, gaps = self.seen.gaps(pairs, now, 2)
        self.rating += [0.0] * (len(self.seen.codes) - len(self.rating))
        rating, out = self.rating, []
        for (a, b), (p, q), y in zip(sides.tolist(), np.exp2(-gaps / self.half_life).tolist(), won, strict=True):
            x, z = rating[a] * p, rating[b] * q
            step = self.k * (y - 1.0 / (1.0 + 10.0 ** ((z - x) / SCALE)))
            rating[a], rating[b] = x + step, z - step
            out.append((INITIAL + x, INITIAL + z, step))
        return np.array(out).reshape(-1, 3), gaps


def _rostered(moved: DataFrame, rosters: DataFrame) -> DataFrame:
    """A row for each of the ten players of a map; another number, a repeated or null player, or a null performance fails."""
    lists = rosters.select(*ROW, F.col("keys").alias("__keys"), F.col("rel").alias("__rel"), F.col("rich").alias("__rich"))
    whole = (F.size("__keys") == 10) & (F.size(F.array_distinct("__keys")) == 10) & (F.size("__rel") == 10) & (F.size("__rich") == 10)
    for c in ("__keys", "__rel", "__rich"):
        whole = whole & ~F.exists(c, lambda x: x.isNull())
    cells = F.arrays_zip("__keys", "__rel", "__rich")
    named = F.concat(F.lit("a map needs ten different players, none null: "), F.coalesce(F.array_join("__keys", ", ", "null"), F.lit("no roster")))
    cells = F.when(F.coalesce(whole, F.lit(False)), cells).otherwise(F.raise_error(named))
    return moved.join(lists, list(ROW)).select(*moved.columns, F.posexplode(cells).alias("__at", "__cell")).select(*moved.columns, "__at", "__cell.*")


TEAM_COLUMNS = ("team1_elo_decay", "team2_elo_decay", "team1_gap_days", "team2_gap_days")


def _moved(contests: DataFrame, rosters: DataFrame, k: float, half_life: float, league: str | None, order: tuple[str, ...], key: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """The league's one stream: key, order and ``carry`` of the maps with a roster, ``TEAM_COLUMNS`` before each and its ``__step``."""
    placed = contests.dropna(subset=[*key, *order]).select(*dict.fromkeys([*key, *order, *carry]), F.unix_micros(F.col("datetime").cast("timestamp")).alias("__now"), "key1", "key2", F.col("team1_win").alias("__won"))
    dealt, name = _stream(placed.join(rosters.select(*ROW), list(ROW), "left_semi"), league, order)
    names = dealt.columns
    at = [names.index(c) for c in (name, "__now", "key1", "key2", "__won")]
    passed = list(dict.fromkeys([*key, *order, *carry, "__now"]))
    kept = [names.index(c) for c in passed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = ()
        state = None
        for batch in batches:
            groups, now, one, two, won = (batch.column(i).to_pylist() for i in at)
            now, pairs = np.array(now, float), [x for pair in zip(one, two, strict=True) for x in pair]
            parts, start = [], 0
            while start < len(groups):
                if groups[start] != current:
                    current, state = groups[start], _Teams(k, half_life)
                end = start + 1
                while end < len(groups) and groups[end] == current:
                    end += 1
                parts.append(state.fold(now[start:end], pairs[2 * start : 2 * end], won[start:end]))
                start = end
            if not parts:
                continue
            ratings, gaps = (np.concatenate(x) for x in zip(*parts, strict=True))
            columns = [pa.array(np.ascontiguousarray(x)) for x in (*ratings[:, :2].T, *gaps.T, ratings[:, 2])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *columns], names=[*passed, *TEAM_COLUMNS, "__step"])

    return dealt.mapInArrow(run, _replayed(dealt.select(*passed).schema, [StructField(c, DoubleType()) for c in (*TEAM_COLUMNS, "__step")]))


def _by_player(moved: DataFrame, rosters: DataFrame, of_map: list[str], whose: list[str], order: tuple[str, ...]) -> DataFrame:
    """The ten players of each map, dealt by player, each player's maps in order; ``of_map`` go with the first as ``__teams``."""
    long = _rostered(moved, rosters).withColumn("__teams", F.when(F.col("__at") == 0, F.struct(*of_map)))
    return long.drop(*(c for c in of_map if c not in order)).repartition(*whose).sortWithinPartitions(*whose, *order)


def lineup_replay(
    contests: DataFrame,
    rosters: DataFrame,
    cutoff: str | None = None,
    k: float = K_TEAM,
    k_performance: float = K_PERFORMANCE,
    team_half_life: float = TEAM_HALF_LIFE,
    player_half_life: float = PLAYER_HALF_LIFE,
    league: str | None = None,
    order: tuple[str, ...] = KEYS,
    row: tuple[str, ...] = ROW,
) -> DataFrame:
    """Decayed team ratings and three player ratings before each map, up to an exclusive cutoff.

    The team's change is shared by its five players; ``basic`` and ``rich`` never
    decay, ``decay`` is drawn back and moves by the rich change.  Adds
    ``team{1,2}_elo_decay``, gaps, and ``basic, rich, decay, player_gaps``: arrays
    of ten.  ``row`` (with the league) identifies a contest; contests without a
    roster, a key or a time are left out.  A roster of other than ten different
    players is an error.

    Only teams meet each other, so only they need a league's one stream: two keys
    and an outcome a map.  A player's rating moves by changes that are known then,
    so players are dealt over the cluster, each a stream of their own maps.
    """
    if cutoff is not None:
        contests = contests.where(F.col("datetime") < F.lit(cutoff).cast(contests.schema["datetime"].dataType))
    scalars, arrays = list(TEAM_COLUMNS), ["basic", "rich_rating", "decay", "player_gaps"]
    key = [*([league] if league else []), *row]
    moved = _moved(contests, rosters, k, team_half_life, league, order, key)
    whose = [*([league] if league else []), "__keys"]
    own = _by_player(moved, rosters, scalars, whose, order)
    owned = own.columns
    out_at = [owned.index(c) for c in (*key, "__at", "__teams")]

    def of_players(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple = ()
        basic = rich = drawn = last = 0.0
        for batch in batches:
            people = zip(*(batch.column(owned.index(c)).to_pylist() for c in whose), strict=True)
            now, side, step, rel, more = (batch.column(owned.index(c)).to_numpy(zero_copy_only=False) for c in ("__now", "__at", "__step", "__rel", "__rich"))
            changes = (step * np.where(side < 5, SHARE, -SHARE)).tolist()
            found = []
            for who, t, change, x, y in zip(people, now.astype(float).tolist(), changes, (k_performance * rel).tolist(), (k_performance * more).tolist(), strict=True):
                if who != current:
                    current, basic, rich, drawn, last = who, 0.0, 0.0, 0.0, t
                gap = max(0.0, (t - last) / DAY)
                drawn *= 2.0 ** (-gap / player_half_life)
                found.append((basic, rich, drawn, gap))
                basic, rich, drawn, last = basic + x + change, rich + y + change, drawn + y + change, t
            values = np.array(found, float).reshape(-1, 4)
            values[:, :3] += INITIAL
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in out_at), *(pa.array(np.ascontiguousarray(v)) for v in values.T)], names=[*key, "__at", "__teams", *arrays])

    of_ten = StructType([*own.select(*key, "__at", "__teams").schema.fields, *[StructField(c, DoubleType()) for c in arrays]])
    ten = own.mapInArrow(of_players, of_ten).groupBy(*key).agg(F.max("__teams").alias("__teams"), F.array_sort(F.collect_list(F.struct("__at", *arrays))).alias("__ten"))
    replayed = ten.select(*key, "__teams.*", *[F.col(f"__ten.{c}").alias(c) for c in arrays])
    return contests.join(replayed, key).select(*contests.columns, *scalars, *arrays)


def _stats(values: Column, prefix: str) -> dict[str, Column]:
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n
    spread = F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
    return {f"{prefix}_mean": mean, f"{prefix}_median": F.element_at(F.array_sort(values), 3), f"{prefix}_min": F.array_min(values), f"{prefix}_max": F.array_max(values), f"{prefix}_std": F.sqrt(spread)}


def lineup_features(replayed: DataFrame, players: DataFrame, rich: Column | None = None) -> DataFrame:
    """The full pre-map table: team block, roster block by windows, player statistics, differences and aliases."""
    out = replayed.withColumns({"raw_team_elo_prob": elo_expectation(F.col("team1_elo_decay"), F.col("team2_elo_decay")), "team_elo_diff": F.col("team1_elo_decay") - F.col("team2_elo_decay")})
    for s in (1, 2):
        for variant, column in (("basic", "basic"), ("rich", "rich_rating"), ("decay", "decay")):
            out = out.withColumns(_stats(F.slice(column, 5 * s - 4, 5), f"team{s}_player_elo_{variant}"))
        gap = F.slice("player_gaps", 5 * s - 4, 5)
        out = out.withColumns({f"team{s}_player_gap_days_mean": F.aggregate(gap, F.lit(0.0), lambda a, x: a + x) / 5, f"team{s}_player_gap_days_max": F.array_max(gap)})
    for variant in ("basic", "rich", "decay"):
        a, b = F.col(f"team1_player_elo_{variant}_mean"), F.col(f"team2_player_elo_{variant}_mean")
        out = out.withColumns({f"raw_player_elo_prob_{variant}": elo_expectation(a, b), f"player_elo_{variant}_mean_diff": a - b, f"player_elo_{variant}_min_diff": F.col(f"team1_player_elo_{variant}_min") - F.col(f"team2_player_elo_{variant}_min")})
    flag = rich if rich is not None else F.lit(False)
    counted = windows.games_prior(players.withColumn("__rich", flag), ["player_key"], "prior")
    counted = windows.prior_true(counted, ["player_key"], F.col("__rich"), "prior_rich")
    roster = counted.groupBy(*KEYS, "side").agg(
        F.avg("prior").alias("player_prior_maps_mean"),
        F.count_if(F.col("prior") == 0).alias("player_cold_starts"),
        F.avg("prior_rich").alias("player_prior_rich_updates_mean"),
        (F.sum("prior_rich") > 0).alias("has_prior_rich_stats"),
        (F.count_if(F.col("__rich")) > 0).alias("rich_stats_final_map"),
        F.count_if(F.col("__rich")).alias("rich_players_final_map"),
        F.array_join(F.array_sort(F.collect_list("player_key")), "+").alias("lineup"),
    )
    roster = windows.games_prior(roster, ["lineup"], "lineup_prior_maps", (*KEYS, "side"))
    names = ["player_prior_maps_mean", "player_cold_starts", "lineup_prior_maps", "player_prior_rich_updates_mean", "has_prior_rich_stats", "rich_stats_final_map", "rich_players_final_map"]
    out = out.join(side_pivot(roster, ["match_id", "game_id"], names), ["match_id", "game_id"])
    aliases = {"raw_player_elo_prob": F.col("raw_player_elo_prob_decay"), "player_elo_mean_diff": F.col("player_elo_decay_mean_diff"), "player_elo_min_diff": F.col("player_elo_decay_min_diff")}
    aliases |= {f"team{s}_player_elo_{x}": F.col(f"team{s}_player_elo_decay_{x}") for s in (1, 2) for x in ("mean", "median", "min", "max", "std")}
    aliases |= {f"team{s}_player_agg_elo": F.col(f"team{s}_player_elo_decay_mean") for s in (1, 2)}
    aliases |= {"player_agg_elo_diff": F.col("team1_player_elo_decay_mean") - F.col("team2_player_elo_decay_mean"), "lineup_prior_maps_diff": F.col("team1_lineup_prior_maps") - F.col("team2_lineup_prior_maps")}
    return out.withColumns(aliases)


def player_snapshot(replayed: DataFrame, rosters: DataFrame, k: float = K_TEAM, k_performance: float = K_PERFORMANCE) -> DataFrame:
    """``player, rating, last_seen, n_maps`` after each player's last map (decaying rating), with the replay's own K."""
    step = F.lit(k) * (F.col("team1_win") - elo_expectation(F.col("team1_elo_decay"), F.col("team2_elo_decay"))) / 5.0
    rows = replayed.join(rosters.select("match_id", "game_id", "keys", "rich"), ["match_id", "game_id"])
    long = rows.select(*KEYS, step.alias("step"), "decay", "rich", F.posexplode("keys").alias("at", "player"))
    share = F.when(F.col("at") < 5, F.col("step")).otherwise(-F.col("step")) + F.lit(k_performance) * F.element_at("rich", F.col("at") + 1)
    return long.withColumn("after", F.element_at("decay", F.col("at") + 1) + share).groupBy("player").agg(F.max_by("after", F.struct(*KEYS)).alias("rating"), F.max("datetime").alias("last_seen"), F.count(F.lit(1)).alias("n_maps"))


def decayed_team_snapshot(replayed: DataFrame, k: float = K_TEAM) -> DataFrame:
    """``team, rating, last_seen`` after each team's last map (decaying rating)."""
    step = F.lit(k) * (F.col("team1_win") - elo_expectation(F.col("team1_elo_decay"), F.col("team2_elo_decay")))
    sides = F.array(
        F.struct(F.col("key1").alias("team"), (F.col("team1_elo_decay") + step).alias("after")),
        F.struct(F.col("key2").alias("team"), (F.col("team2_elo_decay") - step).alias("after")),
    )
    long = replayed.select(*KEYS, F.explode(sides).alias("s")).select(*KEYS, "s.*")
    return long.groupBy("team").agg(F.max_by("after", F.struct(*KEYS)).alias("rating"), F.max("datetime").alias("last_seen"))


def lineup_counts(players: DataFrame) -> DataFrame:
    """``lineup, n_maps``: how often each exact set of five has played."""
    return windows.lineups(players).groupBy("lineup").agg(F.count(F.lit(1)).alias("n_maps"))


def matchup_features(pairs: DataFrame, rosters: DataFrame, teams: DataFrame, people: DataFrame, lineups: DataFrame, moment: str, scale: float = PLAYER_SCALE) -> DataFrame:
    """The nine model inputs of hypothetical matchups at a moment, from snapshots; nothing is changed by asking.

    ``pairs`` has ``team1, team2``; ``rosters`` has ``team, player``, five a team.
    Unknown teams and players count as new: the initial rating, no gap.
    """
    from ..functions.scalar import decay, gap_days

    at = F.lit(moment).cast("timestamp")
    seen = rosters.join(people, "player", "left")
    rating = decay(F.coalesce("rating", F.lit(INITIAL)), F.when(F.col("last_seen").isNull(), F.lit(0.0)).otherwise(gap_days(at, F.col("last_seen"))), PLAYER_HALF_LIFE)
    roster = seen.withColumn("now", rating).groupBy("team").agg(
        F.avg("now").alias("mean"),
        F.stddev_pop("now").alias("std"),
        F.count_if(F.coalesce("n_maps", F.lit(0)) == 0).cast("double").alias("cold"),
        F.array_join(F.array_sort(F.collect_list("player")), "+").alias("lineup"),
    )
    roster = roster.join(lineups.withColumnRenamed("n_maps", "together"), "lineup", "left")
    gap = F.when(F.col("last_seen").isNull(), F.lit(0.0)).otherwise(gap_days(at, F.col("last_seen")))
    state = roster.join(teams, "team", "left").select("team", "mean", "std", "cold", F.coalesce("together", F.lit(0)).cast("double").alias("together"), gap.alias("gap"), decay(F.coalesce("rating", F.lit(INITIAL)), gap, TEAM_HALF_LIFE).alias("base"))
    one, two = (state.select([F.col(c).alias(f"{c}{s}") for c in state.columns]) for s in (1, 2))
    both = pairs.join(one, "team1").join(two, "team2")
    values = {
        "BaseElo_diff": F.col("base1") - F.col("base2"),
        "PlayerAggElo_diff_scaled": scale * (F.col("mean1") - F.col("mean2")),
        "team1_gap_days": F.col("gap1"),
        "team2_gap_days": F.col("gap2"),
        "player_elo_std_A_scaled": scale * F.col("std1"),
        "player_elo_std_B_scaled": scale * F.col("std2"),
        "lineup_prior_maps_diff": F.col("together1") - F.col("together2"),
        "team1_player_cold_starts": F.col("cold1"),
        "team2_player_cold_starts": F.col("cold2"),
    }
    return both.select("team1", "team2", *[values[c].alias(c) for c in MODEL_FEATURES])


def cold_start_audit(entities: DataFrame, rating: str = "rating", n: str = "n_maps") -> DataFrame:
    """How many entities never played, and how many stand at exactly the initial rating."""
    return entities.agg(F.count(F.lit(1)).alias("n_entities"), F.count_if(F.coalesce(F.col(n), F.lit(0)) == 0).alias("n_cold"), F.count_if(F.coalesce(F.col(rating), F.lit(INITIAL)) == INITIAL).alias("n_initial"))


# The model's inputs, in their locked order.
MODEL_FEATURES = ("BaseElo_diff", "PlayerAggElo_diff_scaled", "team1_gap_days", "team2_gap_days", "player_elo_std_A_scaled", "player_elo_std_B_scaled", "lineup_prior_maps_diff", "team1_player_cold_starts", "team2_player_cold_starts")


def model_features(features: DataFrame, scale: float = PLAYER_SCALE, keep: tuple[str, ...] = ("match_id", "game_id", "datetime", "team1_win")) -> DataFrame:
    values = {
        "BaseElo_diff": F.col("team_elo_diff"),
        "PlayerAggElo_diff_scaled": scale * F.col("player_agg_elo_diff"),
        "player_elo_std_A_scaled": scale * F.col("team1_player_elo_std"),
        "player_elo_std_B_scaled": scale * F.col("team2_player_elo_std"),
    }
    return features.select(*keep, *[values.get(c, F.col(c)).cast("double").alias(c) for c in MODEL_FEATURES])


def hybrid(base: Column, player: Column, weight: Column, scale: float) -> Column:
    """Blend of a team rating difference and a scaled player rating difference."""
    return weight * base + (1 - weight) * scale * player


def variance_scale(features: DataFrame, base: str, player: str) -> float:
    """The factor that gives the player difference the deviation of the base difference."""
    a, b = features.agg(F.stddev_pop(base), F.stddev_pop(player)).first()
    return float(a / b) if a is not None and b else 1.0


def weight_sweep(features: DataFrame, base: str, player: str, y: str, scale: float, steps: int = 100) -> DataFrame:
    """Log loss of every blend weight 0, 1/steps, ..., 1: one pass, a vector of sums a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, total, n = np.arange(steps + 1) / steps, np.zeros(steps + 1), 0
        for batch in batches:
            b, x, won = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for w in range(steps + 1):
                q = 1.0 / (1.0 + 10.0 ** (-(weights[w] * b + (1 - weights[w]) * scale * x) / SCALE))
                q = np.clip(np.where(won > 0, q, 1.0 - q), CLIP, 1 - CLIP)
                total[w] -= np.log(q).sum()
            n += len(b)
        yield pa.RecordBatch.from_pydict({"weight": weights, "total": total, "n": np.full(steps + 1, n)})

    rows = features.select(F.col(base).cast("double"), F.col(player).cast("double"), F.col(y).cast("int")).where(F.col(base).isNotNull() & F.col(player).isNotNull() & F.col(y).isNotNull())
    return rows.mapInArrow(run, "weight double, total double, n long").groupBy("weight").agg((F.sum("total") / F.sum("n")).alias("log_loss"))


def half_life_grid(contests: DataFrame, rosters: DataFrame, half_lives: list[float], k_performances: list[float], train_until: str, validation_until: str, chunks: int = 8) -> DataFrame:
    """Player-only probabilities of every (half-life, K) on validation: log loss, correlation, scale.

    A rating is linear in K: the sum of the team's changes and K times the sum of
    the performances, both drawn back.  So players are dealt over the cluster and
    carry two numbers for each half-life, whatever the number of Ks, and the teams'
    stream runs once.  The scale is fitted on the training rows, in a first pass
    over the maps' differences; a second pass over the validation rows scores all
    parameters in vectors, a ``chunks``-th of the grid at a time.  Only a row of
    sums for each of them meets anywhere.  An infinite half-life means no decay.
    """
    halves = list(dict.fromkeys(float(h) for h in half_lives))
    width = len(halves)
    cells = [(halves.index(float(h)), float(h), float(p)) for h in half_lives for p in k_performances]
    parts = [cells[i::chunks] for i in range(chunks) if cells[i::chunks]]
    kind = contests.schema["datetime"].dataType
    rows = contests.where(F.col("datetime") < F.lit(validation_until).cast(kind))
    moved = _moved(rows, rosters, K_TEAM, TEAM_HALF_LIFE, None, KEYS, list(ROW), ("team1_win",))
    moved = moved.withColumns({"base": F.col("team1_elo_decay") - F.col("team2_elo_decay"), "training": F.col("datetime") < F.lit(train_until).cast(kind)}).drop(*TEAM_COLUMNS)
    own = _by_player(moved, rosters, ["base", "training", "team1_win"], ["__keys"], KEYS)
    owned = own.columns
    sums = [f"{x}{i}" for x in "ab" for i in range(width)]

    def of_players(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last, state = None, 0.0, np.zeros((2, width))
        for batch in batches:
            who = batch.column(owned.index("__keys")).to_pylist()
            now, side, step, rich = (batch.column(owned.index(c)).to_numpy(zero_copy_only=False) for c in ("__now", "__at", "__step", "__rich"))
            sign = np.where(side < 5, 1.0, -1.0)
            before = np.append(last, now[:-1])
            keeps = np.exp2(-np.maximum(0.0, (now - before) / DAY)[:, None] / np.array(halves))
            adds = np.stack([step * sign * SHARE, rich], 1)[:, :, None]
            out = np.empty((len(who), 2, width))
            for i, name in enumerate(who):
                if name != current:
                    current = name
                    state[:] = 0.0
                state *= keeps[i]
                out[i] = state
                state += adds[i]
            last = now[-1] if len(now) else last
            out *= (sign / 5.0)[:, None, None]
            kept = [batch.column(owned.index(c)) for c in (*ROW, "__teams")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(np.ascontiguousarray(x)) for x in out.reshape(len(who), -1).T)], names=[*ROW, "__teams", *sums])

    schema = _replayed(own.select(*ROW, "__teams").schema, [StructField(c, DoubleType()) for c in sums])
    maps = own.mapInArrow(of_players, schema).groupBy(*ROW).agg(F.max("__teams").alias("t"), *[F.sum(c).alias(c) for c in sums])
    maps = stored(maps.select("t.*", *sums), "grid")
    totals = ("n", "b", "bb", "x", "xx", "bx", "loss")

    def added(scales: dict[tuple[float, float], float]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(parts), max(map(len, parts)), len(totals)))
            for batch in batches:
                base, won, values = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(float), np.stack([c.to_numpy() for c in batch.columns[2:]])
                for low in range(0, len(base), 4096):
                    b, y, v = base[low : low + 4096], won[low : low + 4096], values[:, low : low + 4096]
                    for part, some in zip(total, parts, strict=True):
                        at, k = np.array([c[0] for c in some]), np.array([c[2] for c in some])[:, None]
                        x = (v[at] + k * v[width + at]) * np.array([scales.get(c[1:], 1.0) for c in some])[:, None]
                        q = np.clip(1.0 / (1.0 + 10.0 ** (-x / SCALE)), CLIP, 1 - CLIP)
                        loss = -np.log(np.where(y > 0, q, 1.0 - q)).sum(1)
                        part[: len(some)] += np.stack([np.full(len(some), len(b)), np.full(len(some), b.sum()), np.full(len(some), (b * b).sum()), x.sum(1), (x * x).sum(1), (x * b).sum(1), loss], 1)
            for part, some in zip(total, parts, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([c[1] for c in some]), pa.array([c[2] for c in some]), *(pa.array(np.ascontiguousarray(x)) for x in part[: len(some)].T)], names=["half_life", "k_performance", *totals])

        read = maps.where("training" if not scales else "not training").select("base", F.col("team1_win").cast("int"), *sums)
        added = read.mapInArrow(run, "half_life double, k_performance double, " + ", ".join(f"{c} double" for c in totals))
        return added.groupBy("half_life", "k_performance").agg(*[F.sum(c).alias(c) for c in totals])

    of_base, of_player = _spread(F.col("bb"), F.col("b")), _spread(F.col("xx"), F.col("x"))
    fitted = added({}).select("half_life", "k_performance", F.when((F.col("n") > 0) & (of_player > 0), of_base / of_player).otherwise(F.lit(1.0)).alias("scale"))
    scales = {(r["half_life"], r["k_performance"]): r["scale"] for r in fitted.collect()} or dict.fromkeys([c[1:] for c in cells], 1.0)
    return grid_scores(added(scales), scales)


def _spread(square: Column, mean: Column) -> Column:
    n = F.greatest(F.lit(1.0), F.col("n"))
    return F.sqrt(F.greatest(F.lit(0.0), square / n - F.pow(mean / n, 2)))


def grid_scores(totals: DataFrame, scales: dict[tuple[float, float], float]) -> DataFrame:
    """Log loss, correlation and scale of each parameter pair from its sums over the validation rows."""
    of_base, of_player = _spread(F.col("bb"), F.col("b")), _spread(F.col("xx"), F.col("x"))
    n = F.greatest(F.lit(1.0), F.col("n"))
    covariance = F.col("bx") / n - F.col("b") / n * F.col("x") / n
    out = totals.join(F.broadcast(_scale_table(totals.sparkSession, scales)), ["half_life", "k_performance"])
    return out.select("half_life", "k_performance", "scale", (F.col("loss") / n).alias("log_loss"), F.when(of_base * of_player > 0, covariance / (of_base * of_player)).otherwise(F.lit(0.0)).alias("correlation"), F.col("n").cast("long").alias("n"))


def _scale_table(spark: SparkSession, scales: dict[tuple[float, float], float]) -> DataFrame:
    """The fitted scale of each parameter pair: as many rows as the grid has."""
    return spark.createDataFrame([(*cell, scale) for cell, scale in scales.items()], "half_life double, k_performance double, scale double")


def best_of_grid(grid: DataFrame) -> DataFrame:
    """The best candidate that beats a coin and correlates with the team rating."""
    return grid.where((F.col("log_loss") < float(np.log(2))) & (F.col("correlation") > 0)).orderBy("log_loss", "half_life", "k_performance").limit(1)
