import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingloom.operators import aggregates as A
from ratingloom.operators import analytics as AN
from ratingloom.operators import simulate as SIM
from ratingloom.operators.filters import ContractError

TEAMS = list("abcdefgh")


def rules():
    return SIM.Rules(TEAMS, [f"M{i}" for i in range(7)], [(0, 1), (2, 3), (4, 5), (6, 7)])


def equal(k=24.0, single=False):
    return SIM.TeamElo(np.full(8, 1500.0), np.full((8, 7), 1500.0), k, single)


@pytest.mark.parametrize("best_of, expected", [(3, {"2-0": 1 / 4, "2-1": 1 / 4, "1-2": 1 / 4, "0-2": 1 / 4}), (5, {"3-0": 1 / 8, "3-1": 3 / 16, "3-2": 3 / 16, "2-3": 3 / 16, "1-3": 3 / 16, "0-3": 1 / 8})])
def test_fair_series_closed_form(spark, best_of, expected):
    n = 40_000
    got = {r.scoreline: r.p for r in AN.scorelines(SIM.simulate_series(spark, (1500.0, 1500.0), best_of, n, predict=SIM.coin), best_of).collect()}
    assert set(got) == set(expected) and sum(got.values()) == pytest.approx(1)
    for s, p in expected.items():
        assert abs(got[s] - p) < 5 * math.sqrt(p * (1 - p) / n)


def test_series_requests(spark):
    for bad in (dict(best_of=7), dict(best_of=3, maps=["x"])):
        with pytest.raises(ContractError):
            SIM.simulate_series(spark, (1500.0, 1500.0), n=10, **bad)
    with pytest.raises(ContractError):
        SIM.check_series("a", "a", 3, ["x"] * 3)
    with pytest.raises(ContractError):
        SIM.simulate_series(spark, (1.0, 1.0), 3, True)


def test_results_do_not_depend_on_partitions(spark):
    runs = [SIM.simulate_double(spark, rules(), equal(), SIM.elo_model, 3000, 42, True, partitions=p).orderBy("path").collect() for p in (1, 7)]
    assert runs[0] == runs[1]


def test_double_elimination_reconciles(spark):
    n = 4000
    for reset in (False, True):
        paths = SIM.simulate_double(spark, rules(), equal(), SIM.coin, n, 5, reset)
        stages = AN.reconcile(AN.stage_counts(paths, TEAMS), n)
        assert all(abs(r.Champion / n - 1 / 8) < 0.03 for r in stages.collect())
        resets = paths.where("reset is not null").count()
        assert (0 < resets < n) if reset else resets == 0
        off = paths.where("champion = runner_up or champion = third or runner_up = third").count()
        assert off == 0
        if reset:  # only where the lower entrant won
            assert paths.where("(reset is not null) <> (grand_final = lb_final)").count() == 0
    podium = AN.podiums(paths).agg(F.sum("n")).first()[0]
    assert podium == n == AN.complete_paths(paths).agg(F.sum("n")).first()[0]


def test_single_elimination(spark):
    n = 2000
    stages = AN.single_stage_counts(SIM.simulate_single(spark, rules(), equal(), SIM.coin, n), TEAMS)
    AN.reconcile(stages, n)


def test_state_is_not_shared_and_conserves(spark):
    start = equal()
    state = start.start(50)
    keys = SIM.path_keys(1, np.arange(50))
    SIM.play(state, keys, np.zeros(50, int), np.ones(50, int), 5, 0, rules(), SIM.elo_model)
    assert (start.ratings == 1500).all()
    assert state.ratings.sum(1) == pytest.approx(np.full(50, 8 * 1500.0))


def test_single_precision_state_stays_close(spark):
    n = 500
    a = SIM.simulate_double(spark, rules(), equal(), SIM.elo_model, n).groupBy("champion").count().collect()
    b = SIM.simulate_double(spark, rules(), equal(single=True), SIM.elo_model, n).groupBy("champion").count().collect()
    assert abs(len(a) - len(b)) <= 1


def test_known_map_order_is_used():
    r = rules()
    r.orders[frozenset((0, 1))] = [6, 5, 4]
    seen = []

    class Watch(SIM.TeamElo):
        def features(self, rows, a, b, m):
            seen.append(set(m.tolist()))
            return super().features(rows, a, b, m)

    state = Watch(np.full((20, 8), 1500.0), np.full((20, 8, 7), 1500.0))
    SIM.play(state, SIM.path_keys(3, np.arange(20)), np.zeros(20, int), np.ones(20, int), 3, 0, r, SIM.coin)
    assert seen[:2] == [{6}, {5}]


def test_lineup_state_features():
    state = SIM.LineupElo(np.array([1600.0, 1500.0]), np.array([[1500.0] * 5, [1500.0] * 4 + [1600.0]]), np.array([3.0, 4.0]), np.array([2.0, 0.0]), np.array([0.0, 1.0]), scale=2.0).start(1)
    zero, one = np.array([0]), np.array([1])
    x = state.features(zero, zero, one, zero)[0]
    assert x == pytest.approx([100, -40, 3, 4, 0, 2 * 40, 2, 0, 1])
    state.update(zero, zero, one, zero, np.array([1.0]))
    y = state.features(zero, zero, one, zero)[0]
    assert y[2] == y[3] == y[7] == y[8] == 0 and y[6] == 2 and y[0] > 100


def test_exact_enumeration_closed_form_and_sampling(spark):
    even = AN.exact_best_of_three(spark, (1500.0, 1500.0), {f"m{i}": (1500.0, 1500.0) for i in range(7)}).first()
    assert even.total == pytest.approx(1) and even.p_a == pytest.approx(0.5)
    live = AN.exact_best_of_three(spark, (1600.0, 1500.0), {f"m{i}": (1500.0, 1500.0) for i in range(4)}, weight=1.0).first().p_a
    n = 40_000
    paths = SIM.simulate_series(spark, (1600.0, 1500.0), 3, n)
    assert abs(paths.where("wins_a = 2").count() / n - live) < 0.012


def test_invalid_probability_fails():
    with pytest.raises(ContractError):
        SIM.play(equal().start(4), SIM.path_keys(1, np.arange(4)), np.zeros(4, int), np.ones(4, int), 3, 0, rules(), lambda x: np.full(len(x), 1.5))


def test_bad_brackets():
    for openings in ([(0, 1)], [(0, 1), (2, 3), (4, 5), (6, 6)]):
        with pytest.raises(ContractError):
            SIM.Rules(TEAMS, ["x"] * 7, openings).check()


def test_draws_are_uniform():
    u = np.concatenate([SIM.uniform(SIM.path_keys(9, np.arange(20000)), d) for d in range(5)])
    assert abs(u.mean() - 0.5) < 0.005 and abs(u.var() - 1 / 12) < 0.002


def test_separation_and_summary(spark):
    counted = spark.createDataFrame([("a", 600, 0), ("b", 300, 1), ("c", 100, 2)], "key string, n long, first_path long")
    row = A.separation(counted, "key", 1000).first()
    assert (row["first"], row["second"], row.separated) == ("a", "b", True)
    assert AN.place_of(counted, "b").first().place == 2
    assert AN.top_membership(counted, counted, 1).first().is_member
    assert AN.same_counts(counted, counted)


def test_gate():
    AN.production_gate(0, 0.0, 5, 5)
    with pytest.raises(ContractError):
        AN.production_gate(1, 0.0, 5, 5)
