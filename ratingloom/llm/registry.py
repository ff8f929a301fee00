"""The queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, html, langid, mixing, neardup, quality, secrets, sql, tokens
from .common import remainder_of_id, table

#: What conversation -1 says in both of its turns.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op1_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret candidate of every whole text with the forest's verdict."""
    return secrets.scan(table(spark, sf_dir, "documents"), path_col="source")


def op2_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector, by inner product."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document: five-word shingles, similarity 0.8 or more."""
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("is_representative", F.col("doc_id") == F.col("class_id"))


def op4_seed_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item that a document holds, with its alignment."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from two thirds of the labels."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder_of_id("doc_id", 3) != 1)
    rows = docs.select("doc_id", "text", (remainder_of_id("doc_id", 3) == 1).alias("held_out"))
    return quality.score(rows, *model).select("doc_id", "held_out", "score", "predicted")


def op6_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = remainder_of_id("doc_id", 4) == 2
    profiles = langid.learn(docs, ~held_out)
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return langid.predict(rows, profiles).select("doc_id", "held_out", "lang_pred", "score")


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations plus conversation -1, formatted in windows and read back."""
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.conversation_digest(chat.chat_windows(turns))


def op8_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.main_text(table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text under piece_bpe_32k.model."""
    counted = tokens.count_tokens(table(spark, sf_dir, "documents"), tokens.tokenizer_path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents replicated towards source weights n ** 0.7 and shuffled globally."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_forest_secrets": op1_forest_secrets,
        "op2_additive_quantisation": op2_additive_quantisation,
        "op3_prob_minhash": op3_prob_minhash,
        "op4_seed_align": op4_seed_align,
        "op5_random_indexing": op5_random_indexing,
        "op6_rank_order": op6_rank_order,
        "op7_chat_windows": op7_chat_windows,
        "op8_template_text": op8_template_text,
        "op9_token_counts": op9_token_counts,
        "op10_poisson_mix": op10_poisson_mix,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_chat_windows": sql.CHAT, "op10_poisson_mix": sql.MIXING}
