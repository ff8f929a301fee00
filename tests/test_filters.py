import pytest
from pyspark.sql import functions as F

from ratingloom.functions import scalar as S
from ratingloom.operators import filters as FI


def contests(spark, rows):
    return spark.createDataFrame(rows, "match_id long, game_id long, datetime string, map_name string, is_total string, bestOf string, score1_game long, score2_game long, team1_id long, team2_id long, team1_win int").withColumn("datetime", F.to_timestamp_ntz("datetime"))


ROWS = [
    (1, 1, "2024-01-01 00:00:00", "A", "False", "3", 13, 7, 1, 2, 1),
    (1, 2, "2024-01-01 00:00:00", None, "False", "3", 13, 7, 1, 2, 1),
    (1, 3, "2024-01-01 00:00:00", "All", " TRUE ", "3", 2, 0, 1, 2, 1),
    (2, 1, "2024-01-02 00:00:00", "A", "1", "1", 13, 7, 1, 2, 1),
    (3, 1, "2024-01-03 00:00:00", "A", None, "n/a", 0, 0, 1, 2, 0),
]


def test_audit_counts_each_row_once(spark):
    df = FI.coerce_contests(contests(spark, ROWS))
    assert FI.filter_audit(df).first().asDict() == {"n_rows": 5, "n_missing_map": 1, "n_phantom": 1, "n_non_positive": 1, "n_valid": 2}
    assert [(r.match_id, r.game_id) for r in FI.valid_contests(df).orderBy("match_id").collect()] == [(1, 1), (2, 1)]


def test_unreadable_boolean_fails(spark):
    df = contests(spark, [(*ROWS[0][:4], "maybe", *ROWS[0][5:])])
    with pytest.raises(Exception, match="not a boolean"):
        FI.coerce_contests(df).select("total").collect()


def test_contract_names_every_fault(spark):
    df = contests(spark, [ROWS[0], ROWS[0], (1, 9, "2024-05-05 00:00:00", "A", "0", "3", 5, 5, 4, 4, 2)])
    found = {r["rule"]: r["n"] for r in FI.contest_contract().violations(df).collect()}
    assert found == {"no_tie": 1, "binary_target": 1, "ids_present": 0, "two_teams": 1, "has_time": 0, "score_agrees": 1, "unique:match_id,game_id": 1, "one:match_id->datetime": 1, "counts_not_negative": 0, "ordered:datetime": 0}
    falling = contests(spark, [(1, 1, "2024-05-05 00:00:00", "A", "0", "3", 5, -1, 4, 6, 1), (1, 2, "2024-05-04 00:00:00", "A", "0", "3", 5, 4, 4, 6, 1)])
    found = {r["rule"]: r["n"] for r in FI.contest_contract().violations(falling).collect()}
    assert found["ordered:datetime"] == 1 and found["counts_not_negative"] == 1
    with pytest.raises(FI.ContractError, match="no_tie: 1"):
        FI.contest_contract().enforce(df)


def test_leaks_and_missing_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "match_id int, team1_kills int, team1_win int")
    assert FI.leaking_columns(df.columns) == ["team1_kills"]
    with pytest.raises(FI.ContractError):
        FI.assert_no_leaks(df)
    with pytest.raises(FI.ContractError, match="missing"):
        FI.allowlist(df, ["nothing"])


def test_cutoff_is_exclusive_and_pushed(spark, tmp_path):
    contests(spark, ROWS).write.parquet(str(tmp_path / "t"))
    df = FI.before(spark.read.parquet(str(tmp_path / "t")), "2024-01-02 00:00:00")
    assert df.count() == 3
    assert "PushedFilters: [IsNotNull(datetime), LessThan(datetime," in df._jdf.queryExecution().toString()


def test_names():
    assert S.fold("Håvard Nygaard!") == "havardnygaard" and S.fold(None) == "" and S.fold("Straße") == "strae"


def test_name_columns(spark):
    df = spark.createDataFrame([("rain (Håvard Nygaard), NO",), (None,)], "n string")
    assert [r[0] for r in df.select(S.fold_text(S.player_text(F.col("n")))).collect()] == ["rain", ""]
    team = spark.createDataFrame([("Team Líquid Esports",)], "n string").select(S.fold_text(S.team_text(F.col("n")))).first()[0]
    assert team == "liquid"


def test_percent_and_interpolation(spark):
    row = spark.range(1).select(S.percent(F.lit(0.125)), S.interpolate(F.lit(0.5), [(0.0, 0.2), (1.0, 0.8)]), S.interpolate(F.lit(-1.0), [(0.0, 0.2), (1.0, 0.8)]), S.interpolate(F.lit(2.0), [(0.0, 0.2), (1.0, 0.8)])).first()
    assert row[0] == "12.5%" and row[1] == pytest.approx(0.5) and row[2] == 0.2 and row[3] == pytest.approx(0.8)


def test_player_key_precedence(spark):
    df = spark.createDataFrame([("7.0", "ann", "1:1:1"), (None, "ann", "1:1:1"), (None, "", "1:1:2"), ("x", None, "1:1:3")], "i string, n string, u string")
    assert [r[0] for r in df.select(S.player_key(F.col("i"), F.col("n"), F.col("u"))).collect()] == ["id:7", "name:ann", "unknown:1:1:2", "unknown:1:1:3"]
