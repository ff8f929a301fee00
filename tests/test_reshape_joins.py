import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ratingloom.operators import aggregates as A
from ratingloom.operators import identity as ID
from ratingloom.operators import joins as J
from ratingloom.operators import reshape as R
from ratingloom.operators import uncertainty as U
from ratingloom.operators import windows as W
from ratingloom.operators.filters import ContractError


def test_mirror(spark):
    df = spark.createDataFrame([(1, 10.0, 4.0, 6.0, 1, 0.7), (2, 1.0, 3.0, -2.0, 0, 0.4)], "id int, team1_x double, team2_x double, x_diff double, team1_win int, raw_elo_prob double")
    both = R.mirror_by_name(df)
    assert both.count() == 4 and both.agg(F.avg("team1_win")).first()[0] == 0.5
    m = both.where("is_mirrored and id = 1").first()
    assert (m.team1_x, m.team2_x, m.x_diff, m.team1_win) == (4.0, 10.0, -6.0, 0) and m.raw_elo_prob == pytest.approx(0.3)
    assert R.antisymmetry_breaks(both, ["id"], ["x_diff"]).count() == 0
    assert R.antisymmetry_breaks(both.withColumn("x_diff", F.lit(1.0)), ["id"], ["x_diff"]).count() == 2


def test_many_to_one_contract(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    assert sorted((r.k or 0, r.v) for r in J.many_to_one(left, right, ["k"]).collect()) == [(0, None), (1, "a"), (2, None)]
    with pytest.raises(ContractError):
        J.many_to_one(left, right.unionByName(right), ["k"])


def test_greedy_links(spark):
    cand = spark.createDataFrame([("p", 1, 1, 2.0), ("p", 1, 2, 1.0), ("p", 2, 2, 1.5), ("q", 5, 6, 9.0), ("p", 2, 1, 3.0)], "pair string, left_id long, right_id long, gap_hours double")
    assert sorted((r.left_id, r.right_id) for r in J.greedy_links(cand).collect()) == [(1, 2), (2, 1), (5, 6)]


def test_alias_prefers_more_maps_then_latest(spark):
    index = spark.createDataFrame([("x", "k1", 3, 1), ("x", "k2", 3, 2), ("x", "k3", 1, 9)], "alias string, key string, n_maps long, last_seen long")
    asked = spark.createDataFrame([("x",), ("newplayer",)], "alias string")
    assert {r.alias: r.key for r in ID.resolve(asked, index, "name:").collect()} == {"x": "k2", "newplayer": "name:newplayer"}
    close = ID.close_aliases(spark.createDataFrame([("liquidd",), ("x",)], "alias string"), spark.createDataFrame([("liquid",)], "alias string"), 0.8)
    assert [(r.alias, r.known) for r in close.collect()] == [("liquidd", "liquid")]


def test_safe_z_and_centring(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, None), (2, 1.0), (2, 3.0), (2, None), (3, None)], "g int, x double")
    out = df.withColumn("z", W.safe_z("x", ["g"])).collect()
    assert [r.z for r in out if r.g == 1] == [0.0, 0.0, 0.0] and [r.z for r in out if r.g == 3] == [0.0]
    assert sorted((r.z is None, r.z) for r in out if r.g == 2 and r.z is not None) == [(False, -1.0), (False, 1.0)]
    sums = W.centred(df, "x", ["g"]).groupBy("g").agg(F.sum("relative").alias("s")).collect()
    assert all(abs(r.s) < 1e-12 for r in sums)


def test_quantile_bins_keep_ties_together(spark):
    df = spark.createDataFrame([(0.5, i % 2) for i in range(50)] + [(i / 100, 1) for i in range(50)], "p double, y int")
    bins = A.reliability(df, "y", "p").collect()
    assert sum(r.n for r in bins) == 100 and max(r.n for r in bins) >= 50


def test_bootstrap_covers_the_mean(spark):
    rows = spark.range(400).select((F.col("id") % 80).alias("match"), (F.col("id") % 7).cast("double").alias("v"))
    ci = U.ratio_interval(rows, "match", F.col("v"), 200).first()
    assert ci.ci_low < ci["mean"] < ci.ci_high and ci.n_draws == 200
    one = U.ratio_interval(rows, "match", F.col("v"), 200).first()
    assert one == ci
    worse = U.paired_guardrail(rows, "match", F.col("v"), F.col("v") + 1, 100).first()
    assert worse["mean"] == pytest.approx(-1) and worse.accepted
    strata = U.ratio_interval(rows.withColumn("s", F.col("match") % 2), "match", F.col("v"), 50, by=["s"])
    assert strata.count() == 2


def test_weighted_collapse(spark):
    df = spark.createDataFrame([("a", 0.5, 2), ("a", 1.0, 2), ("a", None, 9), ("a", 0.1, 0), ("b", None, 1)], "t string, r double, n long")
    assert {r.t: (r.r, r.n) for r in A.weighted_collapse(df, ["t"], {"r": "n"}).collect()} == {"a": (0.75, 4), "b": (None, 0)}


def test_codes_and_first(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1), (None, 3), ("b", 1)], "k string, v int")
    assert {r.k: r.code for r in R.codes(df, "k").collect()} == {"a": 0, "b": 1, None: -1}
    assert {r.k: r.v for r in R.first_per_key(df, ["k"], ["v"]).collect()} == {"a": 1, "b": 1, None: 3}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k string, v int")
    assert R.codes(empty, "k").count() == 0
    assert A.reliability(spark.createDataFrame([], "p double, y int"), "y", "p").count() == 0


def test_band_join_equals_brute_force_over_a_hot_pair(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [[(i, start + timedelta(minutes=rng.randrange(20_000)) if i % 9 else None, *rng.choice([("a", "b"), ("b", "a"), ("a", "b"), ("c", "d"), ("c", None)])) for i in range(150)] for _ in range(2)]
    rows[1][0] = (150, rows[0][1][1] + timedelta(hours=10), "b", "a")  # exactly at the band
    rows[1][1] = (151, rows[0][1][1] + timedelta(hours=10, microseconds=1), "b", "a")
    rows[0][1] = (1, rows[0][1][1], "a", "b")
    left, right = (spark.createDataFrame(r, "id long, time timestamp_ntz, a string, b string") for r in rows)
    got = sorted((r.left_id, r.right_id) for r in J.band_join(left, right, 10.0).collect())
    near = lambda t, u: t is not None and u is not None and abs(t - u) <= timedelta(hours=10)
    want = sorted((i, j) for i, t, a, b in rows[0] for j, u, c, d in rows[1] if b and d and {a, b} == {c, d} and near(t, u))
    assert got == want and (1, 150) in got and (1, 151) not in got
    assert J.band_join(left.limit(0), right, 10.0).count() == 0
