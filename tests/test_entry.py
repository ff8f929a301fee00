import ast
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from ratingloom.plans import registry

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"gbt_scores", "isotonic_calibration", "feature_gain", "family_gain"}


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["team", "rating", "n_maps"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - SLOW))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    if name not in registry.oracle_sql():
        assert rows
        return
    relation = duck.sql(registry.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    theirs = sorted((tuple(plain(v) for v in r) for r in relation.select(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)
    assert rows == theirs


def test_nothing_outside_imports_the_training_data_operators():
    top = pathlib.Path(entry.__file__).parent
    for path in [*top.glob("ratingloom/**/*.py"), *top.glob("tests/*.py"), top / "bench.py"]:
        if "llm" in path.relative_to(top).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") or n == "corpus_pipeline" for n in names), path
