"""Build the locked dataset: audit, filter, split, mirror, write by split, and a manifest.

    python -m ratingloom.plans.build --input maps.csv --output-directory out [--force]
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, reshape
from ..sources import sinks

# The calendar split, half-open.
TRAIN_UNTIL, VALIDATION_UNTIL = "2026-01-01 00:00:00", "2026-04-01 00:00:00"


def prepare(raw: DataFrame) -> DataFrame:
    """Valid maps with the allowed columns only, in order of time, checked."""
    columns = [c for c in (*filters.IDENTIFIERS, *filters.CONTEXT, *filters.PROFILE) if c in raw.columns]
    rows = filters.valid_contests(filters.coerce_contests(raw))
    flags = {f"team{s}_has_dna": [c for c in filters.PROFILE if c.startswith(f"team{s}_") and c in raw.columns] for s in (1, 2)}
    rows = filters.presence(rows.select(*columns), {k: v for k, v in flags.items() if v})
    checks = filters.Contract(
        columns=["match_id", "game_id", "datetime", "team1_win"],
        rules={"binary_target": F.col("team1_win").isin(0, 1), "has_time": F.col("datetime").isNotNull(), "ids_present": F.col("match_id").isNotNull() & F.col("game_id").isNotNull()},
    )
    return checks.enforce(filters.assert_no_leaks(rows))


def mirrored(rows: DataFrame) -> DataFrame:
    """Both sides of every map, with the profile differences."""
    pairs = [(c, c.replace("team1", "team2", 1)) for c in rows.columns if c.startswith("team1") and c.replace("team1", "team2", 1) in rows.columns and c != "team1_win"]
    names = {f"{c}_diff": (f"team1_{c}", f"team2_{c}") for c in (*filters.PROFILE_RATES, *filters.PROFILE_COUNTS) if f"team1_{c}" in rows.columns}
    both = reshape.mirror(rows, pairs, complement=["team1_win"])
    return reshape.differences(both, names)


def build(spark: SparkSession, raw: DataFrame, folder: str, source: str | None = None, force: bool = False, train_until: str = TRAIN_UNTIL, validation_until: str = VALIDATION_UNTIL) -> dict:
    """Filter, then split, then mirror each split; returns the manifest."""
    target = Path(folder)
    if (target / "manifest.json").exists() and not force:
        raise filters.ContractError(f"{folder} is locked; use force to build it again")
    audit = filters.filter_audit(filters.coerce_contests(raw)).first().asDict()
    rows = prepare(raw)
    split = reshape.chronological_split(rows, train_until, validation_until)
    if not reshape.split_overlap(split, "game_id").isEmpty():
        raise filters.ContractError("a game lies in two splits")
    sinks.write_splits(mirrored(split), f"{folder}/maps", force)
    rules = {"filter": "named map, no series total unless best of one, positive score", "train_until": train_until, "validation_until": validation_until, "order": "filter, split, mirror", "audit": audit}
    return sinks.split_manifest(spark.read.parquet(f"{folder}/maps"), target / "manifest.json", rules, {"source": source} if source else {})


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--input", required=True)
    parser.add_argument("--output-directory", required=True)
    parser.add_argument("--force", action="store_true")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    # The wide source isn't declared column by column: all text, coerced where it is used.
    raw = spark.read.option("header", True).csv(a.input)
    typed = raw.withColumns({"datetime": F.col("datetime").cast("timestamp_ntz"), "team1_win": F.col("team1_win").cast("double").cast("int"), "match_id": F.col("match_id").cast("long"), "game_id": F.col("game_id").cast("long")})
    rates = {c: F.col(c).cast("double") for c in filters.PROFILE if c in raw.columns}
    print(json.dumps(build(spark, typed.withColumns(rates) if rates else typed, a.output_directory, a.input, a.force)))


if __name__ == "__main__":
    main()
