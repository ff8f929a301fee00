"""Chat formatting in budgeted windows.  DataFrame functions only.

Prefix sums of the turns' tokens choose turn-aligned spans.  Let ``B`` be the
budget, ``S`` the tokens of the system turn and ``H`` those allowed for
repeated history.  A turn that ends at prefix sum ``e`` belongs to the span
``floor((e - 1) / half)`` with ``half = (B - S - H) / 2``; a turn longer than
``half`` stands alone.  So no span is longer than ``B - S - H`` unless one turn
is, and that window is marked ``over_budget`` rather than cut.

A window holds the system turn, then the last turns of the span before it that
fit in ``H`` tokens, then its span.  The loss mask covers the texts of the
span's assistant turns only, so a target that is repeated as history is masked
there and trained on once.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``.  A ``<`` followed by
backslashes and ``|`` gets one more backslash, which is reversible and leaves no
control string in a text.  Roles also have ``%`` and line feeds percent-coded.

Defined results: null texts and roles are empty; null ids form one conversation;
turns are in the order (turn, role, text) with nulls first, so ties and repeated
rows have one order; other columns are ignored; no rows give no windows.
The window functions and both groupings share one exchange by conversation and
sort with spill; a group that is collected into a row is one budgeted window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def chat_windows(turns: DataFrame, budget: int = 2048, history: int = 256, chars_per_token: float = 4.0) -> DataFrame:
    """One row per window.

    ``conv_id, window`` (from 0), ``formatted``, ``n_context`` (leading turns that
    are repeated), ``n_turns`` (all turns in it), ``loss_spans`` (array of
    start, length in code points of ``formatted``), ``n_tokens``, ``over_budget``.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = turns.select("conv_id", F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    segment = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END + "\n"))
    in_order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = in_order.rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("conv_id")
    base = (
        base.withColumn("segment", segment)
        .withColumn("tokens", F.ceil(F.length("segment") / F.lit(float(chars_per_token))).cast("bigint"))
        .withColumn("pos", F.row_number().over(in_order))
        .withColumn("ends", F.sum("tokens").over(so_far))
        .withColumn("sys_seen", F.sum(F.when(F.col("role") == "system", 1).otherwise(0)).over(so_far))
        .withColumn("is_system", (F.col("role") == "system") & (F.col("sys_seen") == 1))
        .withColumn("sys_tokens", F.coalesce(F.max(F.when(F.col("is_system"), F.col("tokens"))).over(whole), F.lit(0)))
    )
    half = F.greatest(F.lit(1), F.floor((F.lit(budget - history) - F.col("sys_tokens")) / 2))
    base = (
        base.withColumn("half", half)
        .withColumn("long", F.col("tokens") > F.col("half"))
        .withColumn("key", F.struct(F.floor((F.col("ends") - 1) / F.col("half")).alias("at"), (~F.col("long")).cast("int").alias("rest")))
        .withColumn("opens", F.coalesce((F.col("key") != F.lag("key").over(in_order)) | F.lag("long").over(in_order) | F.col("long"), F.lit(False)))
        .withColumn("window", F.sum(F.col("opens").cast("int")).over(so_far))
        .withColumn("window_ends", F.max("ends").over(W.partitionBy("conv_id", "window")))
        .withColumn("last_window", F.max("window").over(whole))
    )
    nxt = F.col("window") + 1
    has_next = nxt <= F.col("last_window")
    repeated = has_next & (F.col("window_ends") - F.col("ends") + F.col("tokens") <= F.lit(history))
    targets = (
        F.when(F.col("is_system") & has_next, F.sequence(F.col("window"), F.col("last_window")))
        .when(repeated, F.array(F.col("window"), nxt))
        .otherwise(F.array(F.col("window")))
    )
    placed = base.withColumn("own", F.col("window")).withColumn("window", F.explode(targets)).withColumn("is_new", F.col("own") == F.col("window"))
    in_window = W.partitionBy("conv_id", "window").orderBy("pos")
    before = F.coalesce(F.sum(F.length("segment")).over(in_window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lead = F.length(F.lit(START)) + F.length(escape_role(F.col("role"))) + 1
    body = F.length("segment") - lead - F.length(F.lit(END)) - 1
    span = F.when(F.col("is_new") & (F.col("role") == "assistant"), F.struct((before + lead).cast("bigint").alias("start"), body.cast("bigint").alias("length")))
    parts = F.array_sort(F.collect_list(F.struct("pos", "segment", "span")))
    return (
        placed.withColumn("span", span)
        .groupBy("conv_id", "window")
        .agg(
            parts.alias("parts"),
            F.sum((~F.col("is_new")).cast("int")).alias("n_context"),
            F.count(F.lit(1)).alias("n_turns"),
            F.sum("tokens").alias("n_tokens"),
        )
        .select(
            "conv_id",
            F.col("window").cast("int").alias("window"),
            F.array_join(F.col("parts.segment"), "").alias("formatted"),
            F.col("n_context").cast("int").alias("n_context"),
            "n_turns",
            F.filter(F.col("parts.span"), lambda s: s.isNotNull()).alias("loss_spans"),
            "n_tokens",
            (F.col("n_tokens") > budget).alias("over_budget"),
        )
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Parse the formatted windows: one row per window with its new turns and its loss text."""
    pieces = F.split(F.col("formatted"), F.lit(r"<\|im_end\|>\n"), -1)
    fresh = F.slice(pieces, F.col("n_context") + 1, F.greatest(F.lit(0), F.size(pieces) - 1 - F.col("n_context")))
    opened = F.transform(fresh, lambda p: F.substring(p, len(START) + 1, 2147483647))
    turns = F.transform(
        opened,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2)).alias("text"),
        ),
    )
    losses = F.transform(F.col("loss_spans"), lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return windows.select("conv_id", "window", turns.alias("turns"), losses.alias("losses"), F.length("formatted").alias("n_formatted"))


def conversation_digest(windows: DataFrame) -> DataFrame:
    """One row per conversation from its windows read back."""
    back = read_back(windows)
    said = F.array_join(F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per = back.select("conv_id", "window", F.size("turns").alias("n"), said.alias("said"), F.array_join("losses", "").alias("loss"), "n_formatted")
    rows = per.groupBy("conv_id").agg(
        F.sum("n").cast("bigint").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("parts"),
        F.sum("n_formatted").cast("bigint").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_windows"),
    )
    said, loss = F.array_join(F.col("parts.said"), ""), F.array_join(F.col("parts.loss"), "")
    return rows.select(
        "conv_id",
        "n_turns",
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )
