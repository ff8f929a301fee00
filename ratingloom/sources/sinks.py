"""Sinks: Parquet by split, and small result files that appear whole or not at all."""

from __future__ import annotations

import csv
import hashlib
import json
import os
import re
from datetime import date, datetime, timezone
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import ContractError

# The columns of an exported summary, and of the index of exports.
SUMMARY_COLUMNS = ("Team", "P(QF)", "P(SF)", "P(Final)", "P(Champion)", "SE(Champion)")
INDEX_COLUMNS = ("slug", "created_at", "seed", "n_iterations", "csv", "json", "metadata", "sha256")
#: Rows that may be brought to the driver for a single-file export.
MAX_EXPORT_ROWS = 100_000


def write_splits(df: DataFrame, path: str, force: bool = False) -> None:
    """Parquet partitioned by ``split``, one directory for each; Spark's committer makes it appear at once."""
    df.write.mode("overwrite" if force else "errorifexists").partitionBy("split").parquet(path)


def write_parquet(df: DataFrame, path: str, force: bool = False) -> None:
    df.write.mode("overwrite" if force else "errorifexists").parquet(path)


def json_safe(value: object) -> object:
    """NumPy scalars, tuples, sets and times as plain JSON values; NaN as null."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset, np.ndarray)):
        return [json_safe(v) for v in (sorted(value) if isinstance(value, (set, frozenset)) else value)]
    if isinstance(value, np.generic):
        return json_safe(value.item())
    if isinstance(value, float) and not np.isfinite(value):
        return None
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return value


def atomic_text(path: str | Path, text: str) -> None:
    path = Path(path)
    temporary = path.with_name(path.name + ".tmp")
    try:
        temporary.write_text(text)
        os.replace(temporary, path)
    finally:
        temporary.unlink(missing_ok=True)


def few_rows(df: DataFrame) -> list[dict]:
    rows = df.limit(MAX_EXPORT_ROWS + 1).collect()
    if len(rows) > MAX_EXPORT_ROWS:
        raise ContractError(f"more than {MAX_EXPORT_ROWS} rows for a single file; write Parquet instead")
    return [r.asDict(recursive=True) for r in rows]


def atomic_csv(path: str | Path, rows: list[dict], columns: list[str] | tuple[str, ...]) -> None:
    import io

    out = io.StringIO()
    writer = csv.DictWriter(out, columns, lineterminator="\n")
    writer.writeheader()
    writer.writerows(rows)
    atomic_text(path, out.getvalue())


def atomic_json(path: str | Path, value: object) -> None:
    atomic_text(path, json.dumps(json_safe(value), indent=2, ensure_ascii=False) + "\n")


def file_sha256(path: str | Path, chunk: int = 1 << 20) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(chunk):
            digest.update(block)
    return digest.hexdigest()


def content_hashes(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("sha256", F.sha2(F.coalesce(F.col(column).cast("binary"), F.lit("").cast("binary")), 256))


def append_index(path: str | Path, row: dict) -> None:
    """One more row of the index; an index with another header is refused."""
    path, rows = Path(path), []
    if path.exists():
        with path.open(newline="") as f:
            reader = csv.DictReader(f)
            if tuple(reader.fieldnames or ()) != INDEX_COLUMNS:
                raise ContractError(f"index columns are {reader.fieldnames}")
            rows = list(reader)
    atomic_csv(path, [*rows, row], INDEX_COLUMNS)


def export_results(summary: DataFrame, folder: str | Path, slug: str, seed: int, n_iterations: int, artifact: str | Path, openings: list[tuple[str, str]], extra: dict | None = None, now: datetime | None = None) -> dict[str, Path]:
    """CSV, JSON, then metadata (written last, so its presence says the export is whole), then the index."""
    slug = slug.strip().lower()
    if not re.fullmatch(r"[a-z0-9_-]+", slug):
        raise ContractError(f"bad slug: {slug!r}")
    if isinstance(n_iterations, bool) or not isinstance(n_iterations, int) or n_iterations < 1:
        raise ContractError("the number of iterations must be positive")
    if not Path(artifact).is_file():
        raise ContractError(f"no artifact at {artifact}")
    if tuple(summary.columns) != SUMMARY_COLUMNS:
        raise ContractError(f"summary columns are {summary.columns}")
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    moment = (now or datetime.now(timezone.utc)).astimezone(timezone.utc)
    stem = f"{slug}_{moment:%Y%m%dT%H%M%SZ}_seed{seed}_n{n_iterations}"
    files = {k: folder / f"{stem}{e}" for k, e in (("csv", ".csv"), ("json", ".json"), ("metadata", "_metadata.json"))}
    if any(f.exists() for f in files.values()):
        raise ContractError(f"{stem} is there already")
    rows = few_rows(summary)
    atomic_csv(files["csv"], rows, SUMMARY_COLUMNS)
    atomic_json(files["json"], rows)
    digest = file_sha256(artifact)
    metadata = {"schema_version": "1.0", "slug": slug, "created_at": f"{moment:%Y-%m-%dT%H:%M:%SZ}", "seed": seed, "n_iterations": n_iterations, "opening_matchups": [list(p) for p in openings], "artifact_sha256": digest, "files": {k: f.name for k, f in files.items()}}
    atomic_json(files["metadata"], metadata | (extra or {}))
    append_index(folder / "index.csv", {"slug": slug, "created_at": metadata["created_at"], "seed": seed, "n_iterations": n_iterations, "csv": files["csv"].name, "json": files["json"].name, "metadata": files["metadata"].name, "sha256": digest})
    return files


def check_provenance(metadata: dict, **expected: object) -> dict:
    """The metadata, if every expected value is in it."""
    wrong = {k: (metadata.get(k), v) for k, v in expected.items() if metadata.get(k) != v}
    if wrong:
        raise ContractError(f"provenance differs: {wrong}")
    return metadata


def split_manifest(df: DataFrame, path: str | Path, rules: dict, sources: dict[str, str]) -> dict:
    """Counts by split, the rules, and hashes of the source files, as a JSON next to the data."""
    counts = {r["split"]: r["n"] for r in df.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    manifest = {"rows": counts, "rules": rules, "sources": {k: file_sha256(v) for k, v in sources.items()}}
    atomic_json(path, manifest)
    return manifest


def resolution_export(df: DataFrame, path: str | Path) -> None:
    """A resolution report as JSON records, times in ISO form, nulls kept."""
    atomic_json(path, few_rows(df))
