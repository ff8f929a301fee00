"""The replay by spans against the replay by players, and what its queries leave on disk."""

import os
import re
from datetime import datetime, timedelta

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ratingloom.operators import replay as RP
from ratingloom.operators import spans as SP
from ratingloom.plans import fixture, forecast
from tests.conftest import SF
from tests.test_replay import SCHEMA, random_contests


def five_each(c):
    """Five players a team, of whom the last plays for the next team every other day."""
    lineups = np.stack([c["team1"], c["team2"]], 1).astype(np.int64) * 10
    lent = (c["now"] // 86_400_000_000 % 2)[:, None]
    people = np.repeat(lineups[:, :, None], 5, 2) + np.arange(5)
    people[:, :, 4] += 3 * lent
    performed = (people % 7 - 3.0).reshape(-1, 10) if "performed" in c else None
    return people.reshape(-1, 10), lineups + lent, performed


def long_contests():
    """Far more days than a half-life of a week, two spans or more, and a team that pauses over spans."""
    data = [(m, g, datetime(2024, 1, 1) + timedelta(hours=19 * (m % 37), days=m // 4), mp, a, b, s1, s2, y) for m, g, _, mp, a, b, s1, s2, y in random_contests(240)]
    return [r for r in data if "t5" not in (r[4], r[5]) or not 15 < r[2].timetuple().tm_yday < 40]


def packed(spark, data, *more):
    rows = spark.createDataFrame(data, SCHEMA)
    number = [F.substring(f"key{s}", 2, 3).cast("long").alias(f"team{s}") for s in (1, 2)]
    rows = rows.select(F.unix_micros(F.col("datetime").cast("timestamp")).alias("now"), "match_id", "game_id", *number, F.col("team1_win").alias("won"), *more)
    return SP.packed(rows, ("now", "match_id", "game_id"), 10)


def rosters(spark, data):
    rows = []
    for m, g, d, _, a, b, *_ in data:
        now = np.array([int((d - datetime(1970, 1, 1)).total_seconds()) * 1_000_000])
        people, _, performed = five_each({"team1": np.array([int(a[1:])]), "team2": np.array([int(b[1:])]), "now": now, "performed": now})
        rows += [(m, g, d, i // 5 + 1, i % 5 + 1, str(p), float(x)) for i, (p, x) in enumerate(zip(people[0], performed[0], strict=True))]
    return spark.createDataFrame(rows, "match_id long, game_id long, datetime timestamp_ntz, side int, slot int, player_key string, relative double")


def test_spans_equal_the_replay_by_players(spark):
    data = long_contests()
    spans = SP.Spans(packed(spark, data), five_each, [float("inf"), 1095.0], maps=40)
    assert len(spans.bounds) > 2
    columns = ("match_id", "game_id")
    got = SP.lineup_features(spans.walked(spans.carried(), lambda: SP.Features(columns), SP.Features.schema(columns)))
    people = rosters(spark, data)
    want = RP.lineup_features(RP.lineup_replay(spark.createDataFrame(data, SCHEMA), RP.roster_arrays(people)), people)
    names = [c for c in got.columns if c in want.columns]
    assert set(forecast.LINEUP_COLUMNS) <= set(names)
    a, b = ({(r.match_id, r.game_id): r.asDict() for r in df.select(*names).collect()} for df in (got, want))
    assert len(a) == len(data) and a.keys() == b.keys()
    for key, row in a.items():
        assert row == pytest.approx(b[key], abs=1e-9), key


def test_grid_by_spans_equals_the_grid_by_players(spark):
    data = long_contests()
    halves, weights = [7.0, 30.0, float("inf")], [0.0, 0.3]
    until, end = datetime(2024, 2, 1), datetime(2024, 3, 1)
    want = RP.half_life_grid(spark.createDataFrame(data, SCHEMA), RP.roster_arrays(rosters(spark, data)), halves, weights, str(until), str(end))
    train = int((until - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    cells = packed(spark, [r for r in data if r[2] < end], F.lit(1).alias("performed"))
    got = SP.half_life_grid(cells, five_each, halves, weights, train)
    a, b = ({(r.half_life, r.k_performance): r.asDict() for r in df.collect()} for df in (got, want))
    assert len(a) == 6 and a.keys() == b.keys()
    for key in a:
        assert a[key] == pytest.approx(b[key], rel=1e-9, abs=1e-12)


def test_snapshots_by_spans_equal_the_replay_by_players(spark):
    data = long_contests()
    teams, people, lineups, latest = SP.snapshots(packed(spark, data), five_each, 1095.0)
    rows, asked = spark.createDataFrame(data, SCHEMA), rosters(spark, data)
    arrays = RP.roster_arrays(asked)
    replayed = RP.lineup_replay(rows, arrays)
    want = {r.player: (r.rating, r.n_maps) for r in RP.player_snapshot(replayed, arrays).collect()}
    assert {str(r.player): (r.rating, r.n_maps) for r in people.collect()} == {k: pytest.approx(v) for k, v in want.items()}
    want = {r.team: r.rating for r in RP.decayed_team_snapshot(replayed).collect()}
    assert {f"t{r.team}": r.rating for r in teams.collect()} == pytest.approx(want)
    assert sorted(r.n_maps for r in lineups.collect()) == sorted(r.n_maps for r in RP.lineup_counts(asked).collect())
    last = {}
    for m, g, d, _, a, b, *_ in sorted(data, key=lambda r: (r[2], r[0], r[1])):
        now = int((d - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
        found = five_each({"team1": np.array([int(a[1:])]), "team2": np.array([int(b[1:])]), "now": np.array([now])})[0][0]
        last[int(a[1:])], last[int(b[1:])] = sorted(found[:5]), sorted(found[5:])
    got = {}
    for r in latest.collect():
        got.setdefault(r.team, []).append(r.player)
    assert {k: sorted(v) for k, v in got.items()} == last


def test_same_player_twice_fails_in_spans(spark):
    spans = SP.Spans(packed(spark, random_contests(3)), lambda c: (np.ones((len(c["now"]), 10), np.int64), np.ones((len(c["now"]), 2), np.int64), None), [30.0])
    with pytest.raises(Exception, match="ten different players"):
        spans.sums().collect()


def unpacked(cells):
    """All maps of the cells, in their order."""
    found = [(r.n, r.first, r.last, SP._load(r.body)) for r in cells.orderBy("cell").collect()]
    assert all((n, first, last) == (len(c["now"]), c["now"][0], c["now"][-1]) for n, first, last, c in found)
    return {name: np.concatenate([c[name].astype(float) for *_, c in found]) for name in found[0][3]}


def test_contests_are_joined_in_parts_and_dealt_packed(spark, monkeypatch):
    """No exchange holds all lines or a row for each contest, and the cells hold the same maps in the same order."""
    whole = unpacked(fixture.cells(spark, SF, "price", "part"))
    plans, real = [], SP.stored
    monkeypatch.setattr(SP, "stored", lambda df, label: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df, label))[1])
    lines = pq.read_metadata(f"{SF}/lineitem.parquet").num_rows
    monkeypatch.setattr(fixture, "PART", -(-lines // 3))
    parts = unpacked(fixture.cells(spark, SF, "price", "part"))
    joins = [p for p in plans if " Join " in p or "Join Inner" in p]
    assert len(joins) == 3 and all("xxhash64" in p for p in joins)
    assert not any(re.search(r"RepartitionByExpression \[[^\]]*ASC", p) for p in plans)
    rows = fixture.contests(spark, SF, lean=True).select("match_id", "game_id", "datetime", "price").orderBy("datetime", "match_id", "game_id").collect()
    assert [(r.match_id, r.game_id, r.price) for r in rows] == list(zip(*(whole[c].tolist() for c in ("match_id", "game_id", "price")), strict=True))
    assert whole.keys() == parts.keys() and all(np.array_equal(whole[c], parts[c]) for c in whole)


QUERIES = ["matchup_features", "player_elo_replay", "halflife_grid", "no_decay_probe", "snapshot_matchups"]


@pytest.mark.parametrize("name", QUERIES)
def test_no_row_for_each_player_of_a_map_is_stored_or_dealt(spark, name):
    """Nothing is exploded, and all that stays in the shared folder has fewer rows than the maps."""
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}
    before = files()
    df = forecast.QUERIES[name](spark, SF)
    assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()
    df.collect()
    assert 0 < sum(pq.read_metadata(f).num_rows for f in files() - before) < pq.read_metadata(f"{SF}/lineitem.parquet").num_rows / 2
