"""Mixing sources to target weights by Poisson replication.  DataFrame functions only.

Each source has a mean repetition rate ``lam = epochs * N * share / n``: ``share``
is its part of the target weights, ``n`` its documents, ``N`` all documents.  A
document's copies are the inverse of the Poisson distribution with that mean at
a number hashed from the seed, the id and the text, so a rerun, another partitioning or a
lost executor gives the same copies.  Copies are then dealt over the whole
cluster by a hashed key and sorted by it inside each partition: a global shuffle
without a sampling pass.

Defined results: a null source is a source of its own; a null id or text hashes as
''; so rows of a null or repeated id are told apart by their texts, and rows that
repeat both get the same number of copies each; an empty table gives an empty result; input columns named ``copy`` or ``mix_key`` are replaced.
Weights that are missing, null or negative count as ``default_weight`` and 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, unit_hash

#: Sources whose statistics may be broadcast; beyond it the join is salted.
MAX_BROADCAST_SOURCES = 10_000
SALTS = 32


def source_rates(docs: DataFrame, weights: dict | None = None, alpha: float = 0.7, epochs: float = 1.0, default_weight: float = 1.0, source_col: str = "source") -> DataFrame:
    """One row per source: its documents ``n_docs``, target ``share`` and mean ``lam``.

    Without ``weights`` a source weighs ``n_docs ** alpha``.
    """
    counts = docs.groupBy(F.col(source_col).alias("src")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        weight = F.pow(F.col("n_docs").cast("double"), F.lit(float(alpha)))
    else:
        weight = F.lit(float(default_weight))
        for name, value in weights.items():
            value = max(0.0, float(value or 0.0))
            weight = F.when(F.col("src").eqNullSafe(F.lit(name)), F.lit(value)).otherwise(weight)
    weighed = materialise(counts.withColumn("weight", weight), "sources")  # documents are counted once
    w_all, n_all = weighed.agg(F.sum("weight"), F.sum("n_docs")).first()
    share = F.col("weight") / F.lit(w_all) if w_all else F.lit(0.0)
    return weighed.withColumn("share", share).withColumn("lam", F.lit(float(epochs)) * F.lit(float(n_all or 0)) * F.col("share") / F.col("n_docs")).select("src", "n_docs", "share", "lam")


def poisson_table(lam: Column) -> Column:
    """struct(first, cdf): the distribution at ``first``, ``first + 1``, ... in double precision.

    The table covers twelve standard deviations and 30 counts on both sides, in
    logarithms, so a large mean neither underflows nor needs a long table.
    """
    spread = F.lit(12.0) * F.sqrt(lam) + 30
    low = F.floor(lam - spread)
    first = F.when(low < 20, F.lit(0).cast("bigint")).otherwise(low)
    k = first.cast("double")
    stirling = k * F.log(k) - k + 0.5 * F.log(2 * F.lit(3.141592653589793) * k) + 1 / (12 * k) - 1 / (360 * k * k * k)
    log_factorial = F.when(first == 0, F.lit(0.0)).otherwise(stirling)
    start = -lam + F.when(first == 0, F.lit(0.0)).otherwise(k * F.log(lam)) - log_factorial
    steps = F.sequence(first, F.ceil(lam + spread))
    logs = F.aggregate(
        F.slice(steps, 2, F.size(steps)),
        F.struct(start.alias("log_p"), F.exp(start).alias("total"), F.array(F.exp(start)).alias("cdf")),
        lambda acc, i: F.struct(
            (acc["log_p"] + F.log(lam) - F.log(i.cast("double"))).alias("log_p"),
            (acc["total"] + F.exp(acc["log_p"] + F.log(lam) - F.log(i.cast("double")))).alias("total"),
            F.concat(acc["cdf"], F.array(acc["total"] + F.exp(acc["log_p"] + F.log(lam) - F.log(i.cast("double"))))).alias("cdf"),
        ),
    )
    table = F.struct(first.alias("first"), logs["cdf"].alias("cdf"))
    return F.when(lam > 0, table)


def mix_sources(docs: DataFrame, weights: dict | None = None, alpha: float = 0.7, epochs: float = 1.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", default_weight: float = 1.0, text_col: str = "text") -> DataFrame:
    """The documents, each as often as its Poisson count says, in a global random order.

    Adds ``copy`` (from 1) and ``mix_key`` (the hashed order).
    """
    docs = docs.drop("copy", "mix_key")
    rates = source_rates(docs, weights, alpha, epochs, default_weight, source_col)
    few = rates.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES
    rates = rates.select(F.col("src").alias("__src"), poisson_table(F.col("lam")).alias("__poisson"))
    content = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    if few:
        joined = docs.join(F.broadcast(rates), F.col(source_col).eqNullSafe(F.col("__src")), "left")
    else:
        salted = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = docs.withColumn("__of", F.pmod(F.hash(F.col(id_col), F.col(text_col)), F.lit(SALTS)))
        joined = dealt.join(salted, F.col(source_col).eqNullSafe(F.col("__src")) & (F.col("__of") == F.col("__salt")), "left").drop("__of", "__salt")
    u = unit_hash(str(seed), F.col(id_col), F.col("__content"))
    below = F.size(F.filter(F.col("__poisson.cdf"), lambda c: c <= F.col("__u")))
    copies = F.when(F.col("__poisson").isNull(), F.lit(0)).otherwise(F.col("__poisson.first").cast("int") + below)
    counted = joined.withColumn("__content", content).withColumn("__u", u).withColumn("__copies", copies).where("__copies > 0").drop("__src", "__poisson", "__u")
    exploded = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__copies")
    key = F.md5(F.concat_ws("|", F.lit(f"order{seed}"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("__content"), F.col("copy").cast("string")))
    return exploded.withColumn("mix_key", key).drop("__content").repartition(F.col("mix_key")).sortWithinPartitions("mix_key")
