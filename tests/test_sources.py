import json
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingloom.operators.filters import ContractError
from ratingloom.operators.reshape import chronological_split
from ratingloom.sources import scans, sinks


def test_csv_projection(spark, tmp_path):
    (tmp_path / "p.csv").write_text('player_id,player_name\n7,"rain (Håvard Nygaard), NO"\n')
    df = scans.scan_csv(spark, str(tmp_path / "p.csv"), scans.PLAYERS_SCHEMA, ["player_name"])
    assert df.columns == ["player_name"] and df.first()[0] == "rain (Håvard Nygaard), NO"


def test_split_scan_opens_one_partition(spark, tmp_path):
    df = spark.range(30).select("id", F.timestamp_seconds(F.col("id") * 86400).cast("timestamp_ntz").alias("datetime"))
    path = str(tmp_path / "s")
    sinks.write_splits(chronological_split(df, "1970-01-11 00:00:00", "1970-01-21 00:00:00"), path)
    val = scans.scan_split(spark, path, ["val"])
    assert val.count() == 10 and "PartitionFilters: [" in val._jdf.queryExecution().toString()
    assert all("split=validation" in r[0] for r in val.select("_metadata.file_path").distinct().collect())
    with pytest.raises(Exception, match="already exists"):
        sinks.write_splits(chronological_split(df, "1970-01-11 00:00:00", "1970-01-21 00:00:00"), path)
    with pytest.raises(ContractError):
        chronological_split(df, "1970-01-21 00:00:00", "1970-01-11 00:00:00")


def test_redaction():
    text = '{"a": 1, "confirmed_result": {"champion": "x"}, "b": 2}'
    assert json.loads(scans.redacted_text(text, "confirmed_result")) == {"a": 1, "b": 2}
    assert json.loads(scans.redacted_text('{"confirmed_result": "x", "b": 2}', "confirmed_result")) == {"b": 2}
    with pytest.raises(ContractError):
        scans.redacted_text('{"a": 1}', "confirmed_result")


def test_config_and_outcome(spark, tmp_path):
    teams = {f"t{i}": {"entry_method": "x", "players": [f"p{i}{k}" for k in range(5)], "roster_verified": True} for i in range(8)}
    config = {"tournament": "Cup", "as_of_date": "2026-09-17", "opening_matchups": [[f"t{2 * i}", f"t{2 * i + 1}"] for i in range(4)], "confirmed_result": {"champion": "t1"}, "teams": teams}
    path = tmp_path / "c.json"
    path.write_text(json.dumps(config))
    row = scans.scan_config(spark, str(path)).first()
    assert row.tournament == "Cup" and len(row.teams) == 8 and "confirmed_result" not in row.asDict()
    with pytest.raises(ContractError):
        scans.load_outcome(str(path), "confirmed_result", exported=False)
    assert scans.load_outcome(str(path), "confirmed_result", exported=True) == {"champion": "t1"}
    scans.validate_rosters(config)
    config["teams"]["t0"]["players"][0] = " "
    config["teams"]["t1"]["roster_verified"] = 1
    with pytest.raises(ContractError, match="t0: needs 5 named players; t1: roster isn't verified"):
        scans.validate_rosters(config)


def test_export_is_whole(spark, tmp_path):
    artifact = tmp_path / "model.bin"
    artifact.write_bytes(b"x" * 3_000_000)
    summary = spark.createDataFrame([("a", "100.0%", "50.0%", "30.0%", "12.5%", "0.10%")], ", ".join(f"`{c}` string" for c in sinks.SUMMARY_COLUMNS))
    now = datetime(2026, 9, 22, 11, 6, 17, tzinfo=timezone.utc)
    files = sinks.export_results(summary, tmp_path / "out", " Cup-1 ", 42, 100, artifact, [("a", "b")], now=now)
    assert all(f.exists() for f in files.values()) and not list((tmp_path / "out").glob("*.tmp"))
    metadata = json.loads(files["metadata"].read_text())
    assert metadata["schema_version"] == "1.0" and len(metadata["artifact_sha256"]) == 64 and files["csv"].name == "cup-1_20260922T110617Z_seed42_n100.csv"
    assert len((tmp_path / "out" / "index.csv").read_text().splitlines()) == 2
    sinks.check_provenance(metadata, seed=42, n_iterations=100)
    with pytest.raises(ContractError):
        sinks.check_provenance(metadata, seed=1)
    for bad in (dict(slug="Ä!"), dict(n_iterations=True), dict(artifact=tmp_path / "none")):
        with pytest.raises(ContractError):
            sinks.export_results(**(dict(summary=summary, folder=tmp_path / "out", slug="cup", seed=42, n_iterations=100, artifact=artifact, openings=[]) | bad))
    with pytest.raises(ContractError, match="already"):
        sinks.export_results(summary, tmp_path / "out", "cup-1", 42, 100, artifact, [("a", "b")], now=now)


def test_json_safe():
    assert sinks.json_safe({1: np.int64(3), "x": (np.float32(0.5), float("nan")), "s": {2, 1}, "t": datetime(2024, 1, 1)}) == {"1": 3, "x": [0.5, None], "s": [1, 2], "t": "2024-01-01T00:00:00"}


def test_index_header_is_enforced(tmp_path):
    (tmp_path / "index.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ContractError):
        sinks.append_index(tmp_path / "index.csv", {})


def test_manifest(spark, tmp_path):
    source = tmp_path / "s.csv"
    source.write_text("x\n")
    df = spark.createDataFrame([("train",), ("train",), ("test",)], "split string")
    assert sinks.split_manifest(df, tmp_path / "m.json", {"rule": "half-open"}, {"raw": str(source)})["rows"] == {"train": 2, "test": 1}
