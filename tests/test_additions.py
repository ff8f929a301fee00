import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ratingloom import storage
from ratingloom.functions import scalar as S
from ratingloom.operators import aggregates as A
from ratingloom.operators import analytics as AN
from ratingloom.operators import uncertainty as U
from ratingloom.operators.simulate import SLOTS


def test_lenient_boolean_and_strict_time(spark):
    df = spark.createDataFrame([(None,), ("",), ("False",), ("0",), ("x",)], "t string")
    assert [r[0] for r in df.select(S.lenient_boolean(F.col("t"))).collect()] == [False, False, True, True, True]
    good = spark.createDataFrame([("2024-05-06 07:08:09",)], "t string")
    assert str(good.select(S.strict_time(F.col("t"))).first()[0]) == "2024-05-06 07:08:09"
    for bad in (None, "", "2024-13-01 00:00:00"):
        with pytest.raises(PySparkException, match="not a time"):
            spark.createDataFrame([(bad,)], "t string").select(S.strict_time(F.col("t"))).collect()


def test_names_and_sections(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "t string")
    assert [r[0] for r in df.select(S.displayed(F.col("t"), {"a": "Alpha"})).collect()] == ["Alpha", "z", None]
    texts = ["x <!--b-->old<!--e--> y", "<!--e--> <!--b-->", "none", "<!--b-->1<!--e-->2<!--e-->", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(S.replaced_section(F.col("t"), "<!--b-->", "<!--e-->", F.lit("new"))).collect()
    assert [r[0] for r in got] == ["x <!--b-->\nnew\n<!--e--> y", "<!--e--> <!--b-->", "none", "<!--b-->\nnew\n<!--e-->2<!--e-->", None]


def test_importances_by_family(spark):
    rows = spark.createDataFrame([("a", 0.5), ("b", 0.25), ("c", 0.25)], "feature string, importance double")
    assert {(r.family, r.importance, r.n_features) for r in A.by_family(rows, {"a": "x", "b": "x"}).collect()} == {("x", 0.75, 2), ("other", 0.25, 1)}


def test_draws_are_poisson_and_intervals_close_to_drawing_with_replacement(spark):
    k = U.draw_counts(np.arange(4000, dtype=np.uint64) * np.uint64(2654435761) % np.uint64(2**32), 300)
    assert abs(k.mean() - 1) < 0.01 and abs(k.var() - 1) < 0.02
    assert [(k == i).mean() for i in range(4)] == pytest.approx([math.exp(-1) / math.factorial(i) for i in range(4)], abs=0.005)
    rng = np.random.default_rng(3)
    groups = [rng.normal(rng.normal(0, 1), 1, rng.integers(1, 6)) for _ in range(300)]
    rows = spark.createDataFrame([(i, float(v)) for i, g in enumerate(groups) for v in g], "match long, v double")
    got = U.ratio_interval(rows, "match", F.col("v"), 2000).first()
    means = []
    for _ in range(2000):
        some = rng.integers(0, 300, 300)
        means.append(sum(groups[i].sum() for i in some) / sum(len(groups[i]) for i in some))
    assert (got.ci_low, got.ci_high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), abs=0.02)
    assert got.mean == pytest.approx(np.concatenate(groups).mean())
    plan = U.resample(U.cluster_sums(rows, "match", {"total": F.col("v")}), "match", ["total"], 50, 1)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_identities_show_a_broken_bracket(spark):
    names = list("abcdefgh")
    good = {c: "a" for c in SLOTS if c != "reset"} | {"reset": None, "lb_final": "b", "champion": "a", "runner_up": "b", "third": "c"}
    schema = "path long, " + ", ".join(f"{c} string" for c in (*SLOTS, "champion", "runner_up", "third"))
    cells = lambda row, i: (i, *[row[c] for c in (*SLOTS, "champion", "runner_up", "third")])
    fine = spark.createDataFrame([cells(good, 0), cells(good, 1)], schema)
    assert AN.identities(fine, AN.stage_counts(fine, names), 2).where("off <> 0").count() == 0
    broken = spark.createDataFrame([cells(good, 0), cells(good | {"runner_up": "c", "qf1": None}, 1)], schema)
    assert {r.identity for r in AN.identities(broken, AN.stage_counts(broken, names), 2).where("off <> 0").collect()} == {"title_or_second:b", "title_or_second:c", "path_length"}


def test_paths_of_another_length_fail(spark):
    df = spark.createDataFrame([("a__then__b", 2)], "key string, n long")
    assert AN.path_struct(df, ["x", "y"]).select("path.x", "path.y", "n").first() == ("a", "b", 2)
    with pytest.raises(PySparkException, match="another length"):
        AN.path_struct(df, ["x"]).collect()


def test_stored_tables_lie_in_the_shared_folder(spark):
    df = storage.stored(spark.range(5), "numbers")
    assert df.count() == 5 and all(storage.shared_root(spark).removeprefix("file://") in f for f in df.inputFiles())
