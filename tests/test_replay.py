import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ratingloom.operators import replay as RP
from ratingloom.operators import windows as W

SCHEMA = "match_id long, game_id long, datetime timestamp_ntz, map_name string, key1 string, key2 string, score1_game long, score2_game long, team1_win int"


def golden(spark):
    d1, d2 = datetime(2024, 1, 1), datetime(2024, 1, 2)
    return spark.createDataFrame([(20, 3, d2, "Nuke", "alpha", "beta", 13, 9, 1), (10, 1, d1, "Nuke", "alpha", "beta", 13, 7, 1), (10, 2, d1, "Mirage", "alpha", "beta", 8, 13, 0)], SCHEMA)


def test_golden_vector(spark):
    rows = {r.game_id: r for r in RP.point_in_time_features(golden(spark)).collect()}
    assert (rows[1].team1_elo_global, rows[1].raw_global_elo_prob, rows[1].team1_h2h_wins, rows[1].team1_roll5_win_pct) == (1500.0, 0.5, 0, 0.0)
    assert (rows[2].team1_elo_global, rows[2].team2_elo_global, rows[2].team1_elo_map, rows[2].team1_h2h_wins) == (1512.0, 1488.0, 1500.0, 0)
    r = rows[3]
    assert (r.team1_h2h_wins, r.team2_h2h_wins, r.team1_roll5_win_pct, r.team2_roll5_win_pct, r.team1_roll5_round_diff, r.team2_roll5_round_diff) == (1, 1, 0.5, 0.5, 1.0, -1.0)
    assert (r.team1_elo_map, r.team1_map_elo_n_games) == (1512.0, 1)


def random_contests(n=120, teams=6, seed=4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b = rng.sample(range(teams), 2)
        s1, s2 = rng.sample(range(14), 2)
        out.append((i // 3, i, datetime(2024, 1, 1) + timedelta(hours=(i // 3) * 7 % 50), f"m{rng.randrange(3)}", f"t{a}", f"t{b}", s1, s2, int(s1 > s2)))
    return out


def test_replay_matches_a_plain_loop(spark):
    data = random_contests()
    got = {(r.match_id, r.game_id): r for r in RP.team_replay(spark.createDataFrame(data, SCHEMA).repartition(5)).collect()}
    team, on_map = {}, {}
    for m, g, _, mp, a, b, s1, s2, y in sorted(data, key=lambda r: (r[2], r[0], r[1])):
        r = got[m, g]
        for table, x, z, pair in ((team, a, b, (r.team1_elo_global, r.team2_elo_global)), (on_map, (a, mp), (b, mp), (r.team1_elo_map, r.team2_elo_map))):
            ra, rb = table.get(x, 1500.0), table.get(z, 1500.0)
            assert pair == (ra, rb)
            step = 24 * (y - 1 / (1 + 10 ** ((rb - ra) / 400)))
            table[x], table[z] = ra + step, rb - step
    assert sum(team.values()) == pytest.approx(1500 * len(team))
    snap = {r.team: r.rating for r in RP.snapshot(RP.team_replay(spark.createDataFrame(data, SCHEMA))).collect()}
    assert snap == pytest.approx(team)


def test_leagues_are_independent(spark):
    data = random_contests()
    one = spark.createDataFrame(data, SCHEMA).withColumn("league", F.lit("x"))
    two = one.unionByName(one.withColumn("league", F.lit("y")))
    rated = RP.team_replay(two, league="league")
    pairs = rated.groupBy("match_id", "game_id").agg(F.countDistinct("team1_elo_global").alias("k"), F.count(F.lit(1)).alias("n"))
    assert pairs.where("k <> 1 or n <> 2").count() == 0


def roster(contests, spark):
    rows = [(m, g, d, s, k, f"{(a if s == 1 else b)}-{k}", float((m * k + s) % 5) - 2) for m, g, d, _, a, b, *_ in contests for s in (1, 2) for k in range(1, 6)]
    df = spark.createDataFrame(rows, "match_id long, game_id long, datetime timestamp_ntz, side int, slot int, player_key string, adr double")
    return W.centred(df, "adr", ["match_id", "game_id", "side"])


def test_lineup_replay_matches_a_plain_loop(spark):
    data = random_contests(60)
    people = roster(data, spark)
    cutoff = "2024-01-02 12:00:00"
    got = {(r.match_id, r.game_id): r for r in RP.lineup_replay(spark.createDataFrame(data, SCHEMA), RP.roster_arrays(people), cutoff, k_performance=0.5).collect()}
    relative = {(r.match_id, r.game_id, r.side, r.slot): r.relative for r in people.collect()}
    team, players, n = {}, {}, 0
    for m, g, now, _, a, b, _, _, y in sorted(data, key=lambda r: (r[2], r[0], r[1])):
        if now >= datetime(2024, 1, 2, 12):
            continue
        n += 1
        r, dec = got[m, g], []
        for key in (a, b):
            rating, last = team.get(key, (1500.0, now))
            dec.append(1500 + (rating - 1500) * 2 ** (-((now - last).total_seconds() / 86400) / 180))
        assert (r.team1_elo_decay, r.team2_elo_decay) == pytest.approx(tuple(dec))
        step = 24 * (y - 1 / (1 + 10 ** ((dec[1] - dec[0]) / 400)))
        team[a], team[b] = (dec[0] + step, now), (dec[1] - step, now)
        for i in range(10):
            side, slot = i // 5 + 1, i % 5 + 1
            key = f"{(a, b)[side - 1]}-{slot}"
            basic, decayed, last = players.get(key, (1500.0, 1500.0, now))
            decayed = 1500 + (decayed - 1500) * 2 ** (-((now - last).total_seconds() / 86400) / 1095)
            assert r.basic[i] == pytest.approx(basic) and r.decay[i] == pytest.approx(decayed)
            move = (step if side == 1 else -step) / 5 + 0.5 * relative[m, g, side, slot]
            players[key] = (basic + move, decayed + move, now)
    assert len(got) == n


@pytest.mark.parametrize("k", [0.0, 0.5])
def test_player_snapshot_is_what_the_next_map_starts_from(spark, k):
    data = random_contests(40)
    last = max(d[2] for d in data)
    later = [(900 + i, 900 + i, last + timedelta(days=30), "m0", f"t{2 * i}", f"t{2 * i + 1}", 3, 1, 1) for i in range(3)]
    rosters = RP.roster_arrays(roster(data + later, spark))
    now = RP.lineup_replay(spark.createDataFrame(data + later, SCHEMA), rosters, k_performance=k).where("match_id >= 900").collect()
    snap = {r.player: r for r in RP.player_snapshot(RP.lineup_replay(spark.createDataFrame(data, SCHEMA), rosters, k_performance=k), rosters, k_performance=k).collect()}
    for r in now:
        for i in range(10):
            s = snap[f"{(r.key1, r.key2)[i // 5]}-{i % 5 + 1}"]
            days = (r.datetime - s.last_seen).total_seconds() / 86400
            assert r.decay[i] == pytest.approx(1500 + (s.rating - 1500) * 2 ** (-days / 1095))


def test_lineup_features_are_complete_and_ordered(spark):
    data = random_contests(40)
    people = roster(data, spark)
    full = RP.lineup_features(RP.lineup_replay(spark.createDataFrame(data, SCHEMA), RP.roster_arrays(people)), people)
    nine = RP.model_features(full)
    assert tuple(nine.columns[4:]) == RP.MODEL_FEATURES
    first = full.orderBy("datetime", "match_id", "game_id").first()
    assert (first.team1_player_cold_starts, first.team1_lineup_prior_maps, first.team1_gap_days, first.raw_team_elo_prob, first.team1_player_elo_std) == (5, 0, 0.0, 0.5, 0.0)
    assert full.count() == 40


def test_same_player_on_both_sides_fails(spark):
    data = random_contests(1)
    people = roster(data, spark).withColumn("player_key", F.lit("x"))
    with pytest.raises(Exception, match="ten different players"):
        RP.lineup_replay(spark.createDataFrame(data, SCHEMA), RP.roster_arrays(people)).collect()


def test_grid_equals_single_replays(spark):
    data = random_contests(90)
    df, rosters = spark.createDataFrame(data, SCHEMA), RP.roster_arrays(roster(data, spark))
    grid = RP.half_life_grid(df, rosters, [30.0, float("inf")], [0.0, 0.3], "2024-01-02 00:00:00", "2024-01-04 00:00:00", chunks=3)
    found = {(r.half_life, r.k_performance): r for r in grid.collect()}
    assert len(found) == 4
    one = RP.lineup_replay(df, rosters, k_performance=0.3, player_half_life=30.0)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / 5
    one = one.select("datetime", (F.col("team1_elo_decay") - F.col("team2_elo_decay")).alias("base"), (mean(F.slice("decay", 1, 5)) - mean(F.slice("decay", 6, 5))).alias("player"))
    scale = RP.variance_scale(one.where("datetime < timestamp_ntz'2024-01-02 00:00:00'"), "base", "player")
    assert found[30.0, 0.3].scale == pytest.approx(scale)
    assert RP.best_of_grid(grid).count() <= 1


def test_day_numbered_row_ids(spark):
    data = random_contests()
    ids = [(r.row_id, r.match_id, r.game_id) for r in W.row_ids(spark.createDataFrame(data, SCHEMA)).orderBy("row_id").collect()]
    assert [(m, g) for _, m, g in ids] == [(r[0], r[1]) for r in sorted(data, key=lambda r: (r[2], r[0], r[1]))]
    assert [i for i, *_ in ids] == list(range(len(data)))


def test_snapshot_matchups(spark):
    data = random_contests(60)
    people = roster(data, spark)
    df, arrays = spark.createDataFrame(data, SCHEMA), RP.roster_arrays(people)
    replayed = RP.lineup_replay(df, arrays)
    teams, players = RP.decayed_team_snapshot(replayed), RP.player_snapshot(replayed, arrays)
    pairs = spark.createDataFrame([("t0", "t1"), ("t0", "new")], "team1 string, team2 string")
    names = [(t, f"{t}-{k}") for t in ("t0", "t1", "new") for k in range(1, 6)]
    asked = spark.createDataFrame(names, "team string, player string")
    moment = "2024-02-01 00:00:00"
    got = {r.team2: r for r in RP.matchup_features(pairs, asked, teams, players, RP.lineup_counts(people), moment, 1.0).collect()}
    # the same by one more map at that moment, whose features are emitted before its outcome
    extra = [*data, (999, 999, datetime(2024, 2, 1), "m0", "t0", "t1", 13, 2, 1)]
    again = roster(extra, spark)
    full = RP.lineup_features(RP.lineup_replay(spark.createDataFrame(extra, SCHEMA), RP.roster_arrays(again)), again)
    want = RP.model_features(full, 1.0).where("match_id = 999").first()
    assert [got["t1"][c] for c in RP.MODEL_FEATURES] == pytest.approx([want[c] for c in RP.MODEL_FEATURES])
    assert got["new"].team2_player_cold_starts == 5 and got["new"].team2_gap_days == 0 and got["new"].player_elo_std_B_scaled == 0
    assert RP.cold_start_audit(players).first().n_cold == 0


def test_rows_without_a_place_keep_null_ratings_and_move_none(spark):
    data = random_contests(30)
    lost = (None, 900, data[5][2], "m0", "t0", "t1", 9, 1, 1)
    got = {r.game_id: r for r in RP.team_replay(spark.createDataFrame([*data, lost], SCHEMA)).collect()}
    alone = {r.game_id: r for r in RP.team_replay(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got.pop(900).team1_elo_global is None and got == alone


def test_rosters_of_another_size_fail(spark):
    data = random_contests(3)
    people = roster(data, spark).where("slot < 5")
    with pytest.raises(Exception, match="ten different players"):
        RP.lineup_replay(spark.createDataFrame(data, SCHEMA), RP.roster_arrays(people)).collect()


def test_replay_streams_carry_only_what_the_recurrence_reads(spark):
    wide = spark.createDataFrame(random_contests(9), SCHEMA).withColumn("payload", F.lit("x"))
    plan = RP.team_replay(wide)._jdf.queryExecution().optimizedPlan().toString()
    stream = plan[plan.index("MapInArrow") :].splitlines()[0]
    assert "payload" not in stream and "score1_game" not in stream


def test_lineup_replay_starts_anew_in_each_league(spark):
    data = random_contests(80)
    people = roster(data, spark)
    one = spark.createDataFrame(data, SCHEMA).withColumn("league", F.when(F.col("match_id") % 2 == 0, "x").otherwise("y"))
    both = RP.lineup_replay(one, RP.roster_arrays(people), k_performance=0.4, league="league")
    got = {r.game_id: r for r in both.collect()}
    assert len(got) == 80
    for league in ("x", "y"):
        alone = RP.lineup_replay(one.where(F.col("league") == league), RP.roster_arrays(people), k_performance=0.4).collect()
        assert alone and all(got[r.game_id] == r for r in alone)
