"""The training-corpus pipeline: five stages, each on all that its predecessor kept.

1.  ``language``: documents without letters, or unlike every learned language, go.
2.  ``near_dedup``: of each near-duplicate class the document with the smallest id stays.
3.  ``decontaminate``: documents that hold a benchmark passage go.
4.  ``secrets``: secrets are masked in the texts; every document stays.
5.  ``mix``: the documents are replicated towards source weights and shuffled.

Each function takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes each stage's result as Parquet in the shared folder and reads it back as
the next one's input.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.llm import decontam, langid, mixing, neardup, secrets
from ratingloom.llm.common import materialise, remove, ship, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in a language learned from this stage's own labelled rows."""
    ship(spark)
    return langid.reject_unknown(docs, langid.learn(docs, F.lit(True)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each near-duplicate class.

    Documents are told apart by their texts, so the texts of a repeated id are
    documents each and null ids, the last to be chosen, are compared like others.
    Rows of one id and one text are one, blank texts too.
    """
    ship(spark)
    return neardup.first_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no benchmark item."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in every text."""
    ship(spark)
    return secrets.redact(docs, path_col="source" if "source" in docs.columns else None)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicate and shuffle; adds ``copy`` and ``mix_key``."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", mask_secrets),
    ("mix", mix),
]

#: The stages are models, sketches and alignments that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if (path := getattr(before, "_written_at", None)) is not None:
            remove(spark, path)
    return docs
