import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingloom.operators import replay as RP
from ratingloom.operators import simulate as SIM
from ratingloom.operators import windows as W
from ratingloom.operators.filters import ContractError
from ratingloom.plans import build, run_forecast

HEADER = "match_id,game_id,datetime,map_name,is_total,bestOf,score1_game,score2_game,team1_id,team2_id,team1,team2,team1_join_key,team2_join_key,tournament,team1_win,team1_ct_win_rate,team2_ct_win_rate,team1_n_ct_rounds,team2_n_ct_rounds"


def source(path, n=90):
    lines = [HEADER]
    for i in range(n):
        total = "True" if i % 9 == 0 else "False"
        when = datetime(2025, 11, 1) + timedelta(days=2 * i)
        win = i % 2
        lines.append(f"{i // 2},{i},{when - timedelta(days=2 * (i % 2))},m{i % 3},{total},{1 if i % 18 == 0 else 3},{13 if win else 7},{7 if win else 13},{i % 5},{i % 5 + 1},a,b,a,b,cup,{win},0.5,0.4,10,12")
    path.write_text("\n".join(lines) + "\n")


def test_locked_dataset(spark, tmp_path):
    source(tmp_path / "maps.csv")
    out = str(tmp_path / "out")
    build.main(["--input", str(tmp_path / "maps.csv"), "--output-directory", out])
    manifest = json.loads((tmp_path / "out" / "manifest.json").read_text())
    audit = manifest["rules"]["audit"]
    assert audit["n_rows"] == 90 and audit["n_phantom"] == 5 and audit["n_valid"] == 85
    assert sum(manifest["rows"].values()) == 170 and set(manifest["rows"]) == {"train", "validation", "test"}
    rows = spark.read.parquet(f"{out}/maps")
    assert rows.agg(F.avg("team1_win")).first()[0] == 0.5
    assert rows.groupBy("match_id", "game_id").agg(F.sum("ct_win_rate_diff").alias("s")).where("abs(s) > 1e-12").count() == 0
    assert not [c for c in rows.columns if "score" in c]
    with pytest.raises(ContractError, match="locked"):
        build.main(["--input", str(tmp_path / "maps.csv"), "--output-directory", out])
    build.main(["--input", str(tmp_path / "maps.csv"), "--output-directory", out, "--force"])


def test_forecast_run(spark, tmp_path):
    names = [f"t{i}" for i in range(8)]
    maps = [(i, i, datetime(2024, 1, 1) + timedelta(days=i), "m", names[i % 8], names[(i + 1 + i // 8) % 8], 13, 7, 1) for i in range(56) if names[i % 8] != names[(i + 1 + i // 8) % 8]]
    df = spark.createDataFrame(maps, "match_id long, game_id long, datetime timestamp_ntz, map_name string, key1 string, key2 string, score1_game long, score2_game long, team1_win int")
    players = [(m, g, d, s, k, f"{(a if s == 1 else b)}p{k}", 0.0) for m, g, d, _, a, b, *_ in maps for s in (1, 2) for k in range(1, 6)]
    people = W.centred(spark.createDataFrame(players, "match_id long, game_id long, datetime timestamp_ntz, side int, slot int, player_key string, adr double"), "adr", ["match_id", "game_id", "side"])
    rosters = RP.roster_arrays(people)
    replayed = RP.lineup_replay(df, rosters)
    teams, snapshot, lineups = RP.decayed_team_snapshot(replayed), RP.player_snapshot(replayed, rosters), RP.lineup_counts(people)
    config = {"tournament": "Cup", "as_of_date": "2024-04-01 00:00:00", "opening_matchups": [[names[i], names[7 - i]] for i in range(4)], "confirmed_result": {"champion": "t3"}, "teams": {t: {"entry_method": "x", "players": [f"{t}p{k}" for k in range(1, 6)], "roster_verified": True} for t in names}}
    path, artifact = tmp_path / "c.json", tmp_path / "m.bin"
    path.write_text(json.dumps(config))
    artifact.write_bytes(b"model")
    predict = lambda x: 1 / (1 + 10 ** (-x[:, 0] / 400))
    args = (spark, str(path), teams, snapshot, lineups, predict, str(tmp_path / "out"), str(artifact), 1.0, list("abcdefg"))
    short = run_forecast.forecast(*args)
    assert len(short["openings"]) == 4 and not (tmp_path / "out").exists()
    with pytest.raises(ContractError, match="gate"):
        run_forecast.forecast(*args, parity=0.1, replayed=(1, 1), n_iterations=500, full=True)
    # the state that is simulated gives the same opening inputs as the snapshot
    conf = json.loads(path.read_text())
    order, state = run_forecast.lineup_state(conf, teams, snapshot, lineups, 1.0)
    start = state.start(1)
    zero = np.array([0])
    mine = [predict(start.features(zero, np.array([2 * i]), np.array([2 * i + 1]), zero))[0] for i in range(4)]
    assert mine == pytest.approx([short["openings"][f"{order[2 * i]}__vs__{order[2 * i + 1]}"] for i in range(4)])
    run_forecast.STABLE = 0.1
    out = run_forecast.forecast(*args, replayed=(len(maps), len(maps)), n_iterations=4000, full=True)
    assert set(out["exports"]) == {42, 99} and max(out["stability"].values()) < 0.1
    rules = SIM.Rules(order, list("abcdefg"), [(0, 1), (2, 3), (4, 5), (6, 7)])
    paths = SIM.simulate_double(spark, rules, state, predict, 500)
    from ratingloom.operators import analytics as AN

    with pytest.raises(ContractError):
        run_forecast.compare_with_outcome(str(path), "confirmed_result", {}, AN.champions(paths), AN.complete_paths(paths))
    late = run_forecast.compare_with_outcome(str(path), "confirmed_result", out["exports"], AN.champions(paths), AN.complete_paths(paths))
    assert 1 <= late["champion_place"] <= 8 and late["matching_paths"] > 0
