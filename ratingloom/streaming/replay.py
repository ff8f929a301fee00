"""Ratings over a stream of contests: state by league, emitted before each outcome moves it."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.scalar import INITIAL, K_TEAM, SCALE

OUTPUT = "league string, match_id long, game_id long, team1_elo double, team2_elo double, raw_prob double, is_late boolean"


def streaming_replay(contests: DataFrame, k: float = K_TEAM) -> DataFrame:
    """Team ratings before each contest of a stream with ``league`` and the contest columns.

    Each trigger's rows of a league are sorted and folded into its state.  A row
    earlier than what its league has already seen can't be replayed in order: it
    is returned marked ``is_late`` with the ratings of now, and moves nothing.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ratings, seen = (json.loads(state.get[0]), state.get[1]) if state.exists else ({}, -(2**63))
        rows = pd.concat(batches).sort_values(["micros", "match_id", "game_id"], kind="stable")
        out = []
        for micros, match, game, a, b, y in zip(rows.micros, rows.match_id, rows.game_id, rows.key1, rows.key2, rows.team1_win, strict=True):
            ra, rb = ratings.get(a, INITIAL), ratings.get(b, INITIAL)
            p = 1.0 / (1.0 + 10.0 ** ((rb - ra) / SCALE))
            late = bool(micros < seen)
            out.append((key[0], match, game, ra, rb, p, late))
            if not late:
                ratings[a], ratings[b], seen = ra + k * (y - p), rb - k * (y - p), int(micros)
        state.update((json.dumps(ratings), seen))
        yield pd.DataFrame(out, columns=["league", "match_id", "game_id", "team1_elo", "team2_elo", "raw_prob", "is_late"])

    rows = contests.select("league", F.unix_micros(F.col("datetime").cast("timestamp")).alias("micros"), "match_id", "game_id", "key1", "key2", F.col("team1_win").cast("int").alias("team1_win"))
    return rows.groupBy("league").applyInPandasWithState(fold, OUTPUT, "ratings string, seen long", "append", GroupStateTimeout.NoTimeout)


def event_rates(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by type in tumbling windows, rows later than the watermark left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, each input once; ends when what is there now is done."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
