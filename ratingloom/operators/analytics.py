"""Counts of simulated paths: stages, finals, podiums, paths, stability and reconciliation."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import K_TEAM, elo_expectation
from .filters import ContractError
from .simulate import SLOTS

STAGES = ("QF", "SF", "Final", "Champion")


def scorelines(paths: DataFrame, best_of: int) -> DataFrame:
    """Every possible scoreline with its count and share, zeros included."""
    need = best_of // 2 + 1
    domain = [f"{need}-{i}" for i in range(need)] + [f"{i}-{need}" for i in range(need)]
    names = paths.sparkSession.createDataFrame([(d,) for d in domain], "scoreline string")
    counted = paths.groupBy(F.concat_ws("-", F.col("wins_a").cast("string"), F.col("wins_b").cast("string")).alias("scoreline")).agg(F.count(F.lit(1)).alias("n"))
    out = names.join(counted, "scoreline", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy()))


def stage_counts(paths: DataFrame, teams: list[str]) -> DataFrame:
    """How often each team reached each stage of a double elimination, one row per team."""
    reached = F.array(
        *[F.struct(F.lit(t).alias("team"), F.lit("QF").alias("stage")) for t in teams],
        *[F.struct(F.col(c).alias("team"), F.lit("SF").alias("stage")) for c in ("ub_sf1", "ub_sf2", "lb_sfa", "lb_sfb")],
        *[F.struct(F.col(c).alias("team"), F.lit("Final").alias("stage")) for c in ("ub_final", "lb_final")],
        F.struct(F.col("champion").alias("team"), F.lit("Champion").alias("stage")),
    )
    long = paths.select(F.explode(reached).alias("r")).select("r.*").groupBy("team", "stage").agg(F.count(F.lit(1)).alias("n"))
    return long.groupBy("team").pivot("stage", list(STAGES)).sum("n").na.fill(0, list(STAGES))


def single_stage_counts(paths: DataFrame, teams: list[str]) -> DataFrame:
    """The same for a single elimination, where SF means the quarter-final was won."""
    reached = F.array(
        *[F.struct(F.lit(t).alias("team"), F.lit("QF").alias("stage")) for t in teams],
        *[F.struct(F.col(c).alias("team"), F.lit("SF").alias("stage")) for c in ("qf1", "qf2", "qf3", "qf4")],
        *[F.struct(F.col(c).alias("team"), F.lit("Final").alias("stage")) for c in ("sf1", "sf2")],
        F.struct(F.col("champion").alias("team"), F.lit("Champion").alias("stage")),
    )
    long = paths.select(F.explode(reached).alias("r")).select("r.*").groupBy("team", "stage").agg(F.count(F.lit(1)).alias("n"))
    return long.groupBy("team").pivot("stage", list(STAGES)).sum("n").na.fill(0, list(STAGES))


def path_text() -> Column:
    """``label:team|label:team|...`` of all series played."""
    return F.concat_ws("|", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}:"), F.col(c))) for c in SLOTS])


def counts(paths: DataFrame, key: Column, total: int | None = None) -> DataFrame:
    """``key, n, first_path`` (and ``total``): ties are ordered by the first path that shows the key."""
    out = paths.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))
    return out.withColumn("total", F.lit(total)) if total else out


def final_matchups(paths: DataFrame) -> DataFrame:
    return counts(paths, F.array_join(F.array_sort(F.array("ub_final", "lb_final")), "__vs__"))


def podiums(paths: DataFrame) -> DataFrame:
    return counts(paths, F.concat_ws(">", "champion", "runner_up", "third"))


def runner_ups(paths: DataFrame) -> DataFrame:
    return counts(paths, F.col("runner_up"))


def champions(paths: DataFrame) -> DataFrame:
    return counts(paths, F.col("champion"))


def complete_paths(paths: DataFrame) -> DataFrame:
    return counts(paths, path_text())


def cinderella(paths: DataFrame, total: int, below: float = 0.10) -> DataFrame:
    """Finalists that are champion in less than the given share of paths (strictly), with their finals."""
    finals = paths.select("path", F.explode(F.array("ub_final", "lb_final")).alias("key"))
    reached = finals.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))
    won = champions(paths).select("key", F.col("n").alias("won"))
    return reached.join(won, "key", "left").where(F.coalesce("won", F.lit(0)) / total < below).select("key", "n", "first_path")


def serialise(counted: DataFrame, total: int, k: int) -> DataFrame:
    """The k most frequent keys with their shares and places."""
    top = counted.orderBy(F.desc("n"), "first_path").limit(k)
    return top.withColumns({"probability": F.col("n") / total, "place": F.row_number().over(W.orderBy(F.desc("n"), "first_path"))}).select("place", "key", "n", "probability")


def place_of(counted: DataFrame, key: str) -> DataFrame:
    ranked = counted.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "first_path")))
    return ranked.where(F.col("key") == key).select("key", "place", "n")


def matching_paths(counted: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Complete paths in which the named series were won by the given teams."""
    parsed = counted.withColumn("won", F.str_to_map("key", F.lit(r"\|"), F.lit(":")))
    hit = F.lit(True)
    for series, team in wanted.items():
        hit = hit & (F.col("won")[series] == team)
    return parsed.where(F.coalesce(hit, F.lit(False))).drop("won")


def top_membership(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Whether the most frequent key of one run is among the k most frequent of another."""
    top = b.orderBy(F.desc("n"), "first_path").limit(k).select("key", F.lit(True).alias("found"))
    best = a.orderBy(F.desc("n"), "first_path").limit(1).select("key")
    return best.join(top, "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("is_member"))


def same_counts(a: DataFrame, b: DataFrame) -> bool:
    x, y = a.select("key", "n"), b.select("key", "n")
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def reconcile(stages: DataFrame, total: int, double: bool = True) -> DataFrame:
    """The stage table, if its totals add up and stages only shrink; else an error."""
    sums = stages.agg(*[F.sum(s).alias(s) for s in STAGES], F.count_if((F.col("QF") < F.col("SF")) | (F.col("SF") < F.col("Final")) | (F.col("Final") < F.col("Champion"))).alias("bad")).first()
    wanted = {"QF": 8 * total, "SF": 4 * total, "Final": 2 * total, "Champion": total}
    wrong = {s: sums[s] for s, n in wanted.items() if sums[s] != n}
    if wrong or sums["bad"]:
        raise ContractError(f"stages don't reconcile: {wrong}, {sums['bad']} teams out of order")
    return stages


def identities(paths: DataFrame, stages: DataFrame, total: int) -> DataFrame:
    """``identity, off``: how far each sum of the analytics is from what the bracket implies; 0 where it holds.

    Six totals (finals, runner-ups, podiums, appearances in finals, complete and
    bracket paths), the length of complete paths, and of each team its finals and
    its finals less titles and second places.
    """
    def off(name: str, counted: DataFrame, wanted: int) -> DataFrame:
        return counted.agg((F.coalesce(F.sum("n"), F.lit(0)) - wanted).cast("long").alias("off")).select(F.lit(name).alias("identity"), "off")

    finals = paths.select(F.explode(F.array("ub_final", "lb_final")).alias("team")).groupBy("team").agg(F.count(F.lit(1)).alias("n"))
    played = [c for c in SLOTS if c != "reset"]
    short = paths.agg(F.count_if(F.size(F.filter(F.array(*played), lambda t: t.isNotNull())) != len(played)).cast("long").alias("off")).select(F.lit("path_length").alias("identity"), "off")
    totals = [
        off("final_matchups", final_matchups(paths), total),
        off("runner_ups", runner_ups(paths), total),
        off("podiums", podiums(paths), total),
        off("final_appearances", finals, 2 * total),
        off("complete_paths", complete_paths(paths), total),
        off("bracket_paths", counts(paths, F.concat_ws("__then__", *played)), total),
        short,
    ]
    second = runner_ups(paths).select(F.col("key").alias("team"), F.col("n").alias("second"))
    per = stages.join(finals, "team", "left").join(second, "team", "left").na.fill(0, ["n", "second"])
    pairs = F.array(
        F.struct(F.concat(F.lit("appearances:"), F.col("team")).alias("identity"), (F.col("n") - F.col("Final")).cast("long").alias("off")),
        F.struct(F.concat(F.lit("title_or_second:"), F.col("team")).alias("identity"), (F.col("second") + F.col("Champion") - F.col("Final")).cast("long").alias("off")),
    )
    out = per.select(F.explode(pairs).alias("p")).select("p.*")
    for part in totals:
        out = out.unionByName(part)
    return out


def path_struct(counted: DataFrame, schema: tuple[str, ...] | list[str], separator: str = "__then__") -> DataFrame:
    """Keys of positional winners as structs with the schema's names; a key of another length fails the query."""
    cells = F.split("key", F.lit(separator.replace("|", r"\|")), -1)
    right = F.assert_true(F.size(cells) == len(schema), F.lit("a path has another length than its schema"))
    named = F.struct(*[F.element_at(cells, i + 1).alias(c) for i, c in enumerate(schema)])
    return counted.withColumns({"__ok": right, "path": named}).where(F.col("__ok").isNull()).drop("__ok")


def bracket_paths(paths: DataFrame) -> DataFrame:
    """Counts of the winners of all series in their order, joined by ``__then__``."""
    return counts(paths, F.concat_ws("__then__", *[c for c in SLOTS if c != "reset"]))


def seed_stability(a: DataFrame, b: DataFrame, total: int) -> DataFrame:
    """``distribution, max_difference``: champions, finals, runner-ups, podiums and outsiders of two runs of paths."""
    from .joins import max_share_difference

    kinds = {"champion": champions, "final_matchup": final_matchups, "runner_up": runner_ups, "podium": podiums, "cinderella": lambda p: cinderella(p, total)}
    out = None
    for name, f in kinds.items():
        pair = [f(p).withColumn("total", F.lit(total)) for p in (a, b)]
        one = max_share_difference(*pair, ["key"]).select(F.lit(name).alias("distribution"), F.coalesce("max_difference", F.lit(0.0)).alias("max_difference"), "n_keys")
        out = one if out is None else out.unionByName(one)
    return out


def production_gate(cold_starts: int, parity: float, replayed: int, expected: int) -> None:
    """Fails unless nobody is unknown, the replay drifted by nothing and has all its rows."""
    if cold_starts or parity != 0.0 or replayed != expected:
        raise ContractError(f"gate: {cold_starts} cold starts, drift {parity}, {replayed} of {expected} rows")


def exact_best_of_three(spark: SparkSession, ratings: tuple[float, float], on_map: dict[str, tuple[float, float]], weight: float = 0.5, k: float = K_TEAM) -> DataFrame:
    """P(a wins) of a best of three over all ordered map triples and outcomes, ratings live.

    The map's probability blends the global and the map rating's expectations.
    """
    triples = list(permutations(on_map, 3))
    n = len(triples)
    cells = [tuple(float(x) for m in t for x in on_map[m]) for t in triples]
    rows = spark.createDataFrame(cells, ", ".join(f"ma{i} double, mb{i} double" for i in (1, 2, 3)))
    state = rows.select("*", F.lit(float(ratings[0])).alias("ga"), F.lit(float(ratings[1])).alias("gb"), F.lit(1.0 / n).alias("w"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    for i in (1, 2, 3):
        g = elo_expectation(F.col("ga"), F.col("gb"))
        p = weight * g + (1 - weight) * elo_expectation(F.col(f"ma{i}"), F.col(f"mb{i}"))
        live = (F.col("a") < 2) & (F.col("b") < 2)
        state = state.withColumns({"g": g, "p": p, "y": F.explode(F.when(live, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(-1))))})
        moved = F.when(F.col("y") >= 0, k * (F.col("y") - F.col("g"))).otherwise(0.0)
        state = state.withColumns(
            {
                "w": F.when(F.col("y") == 1, F.col("w") * F.col("p")).when(F.col("y") == 0, F.col("w") * (1 - F.col("p"))).otherwise(F.col("w")),
                "ga": F.col("ga") + moved,
                "gb": F.col("gb") - moved,
                "a": F.col("a") + (F.col("y") == 1).cast("int"),
                "b": F.col("b") + (F.col("y") == 0).cast("int"),
            }
        )
    return state.agg(F.sum(F.when(F.col("a") == 2, F.col("w")).otherwise(0.0)).alias("p_a"), F.sum("w").alias("total"))


