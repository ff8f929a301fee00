"""Lineup replays over spans of time: contests move packed, players' rows never.

A player's rating is a sum of changes that are drawn back over time, so it can be
found span by span: what a span adds to each of its players doesn't depend on
what was before it.  Contests (narrow, all columns numbers) are packed where they
are found and dealt by time into cells, each one row of compressed bytes.

1. One stream over all cells carries the teams' ratings, the only recurrence. It
   leaves the state of a cell's teams at the cell's start, so that any task can
   repeat the cell.
2. Each span adds up its players and lineups: a row for each bucket of them.
3. Each bucket is carried over the spans: the state of a span's players at its start.
4. Each span is walked again from there; ratings, gaps and counts before every map.

Exchanges carry packed cells and a state for each player of a span, not a row for
each player of a map.  One league; entities are whole numbers.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import CLIP, INITIAL, K_TEAM, SCALE, TEAM_HALF_LIFE, elo_expectation
from ..storage import remove, stored
from .replay import DAY, SHARE, grid_scores

#: Most maps of a cell, and about the maps of a span.
CELL, SPAN = 250_000, 1_000_000
#: Rows that a task packs at once, and about the rows from which the ends of ranges are found.
HELD, SAMPLE = 500_000, 20_000
#: Buckets of players and lineups that are carried over the spans.
BUCKETS = 24
#: Numbers of one array of players' ratings in a task, about.
VALUES = 1_500_000
#: What a row of a span's stream holds, in the order of the stream.
PEOPLE, LINEUPS, TEAMS, MAPS = range(4)
STREAM = "span int, cell long, kind int, body binary"

Arrays = dict[str, np.ndarray]


def _dump(arrays: Arrays) -> bytes:
    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    raw = buffer.getvalue()
    return struct.pack("<q", len(raw)) + pa.Codec("zstd").compress(raw, asbytes=True)


def _load(body: bytes) -> Arrays:
    raw = pa.Codec("zstd").decompress(body[8:], struct.unpack("<q", body[:8])[0], asbytes=True)
    with np.load(io.BytesIO(raw), allow_pickle=False) as found:
        return {name: found[name] for name in found.files}


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them all."""
    if x.dtype.kind not in "iu" or not len(x):
        return x
    low, high = int(x.min()), int(x.max())
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def kept(df: DataFrame, label: str) -> DataFrame:
    """``stored``, with the exchanges that led to it removed once the rows are written."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return stored(df, label)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def range_ends(keys: DataFrame, n: int) -> list[tuple[int, int]]:
    """At most ``n - 1`` rising pairs that cut the pairs of ``keys`` into about equal ranges, by a hashed sample of them."""
    one, two = keys.columns
    keys = keys.dropna()
    some = keys.where(F.pmod(F.xxhash64(one, two), F.lit(max(1, keys.count() // SAMPLE))) == 0).limit(4 * SAMPLE)
    found = sorted(tuple(r) for r in some.collect())
    return sorted({found[i * len(found) // n] for i in range(1, n)}) if found else []


def packed(rows: DataFrame | list[DataFrame], order: tuple[str, str, str], most: int = CELL, ends: list[tuple[int, int]] | None = None) -> DataFrame:
    """``cell, n, first, last, body``: the rows in order, at most ``most`` a cell; cells rise in that order.

    All columns are numbers; ``now`` is first in the order.  Rows without a place in the order are left out.
    Several tables, the parts of one, are taken one after the other, so that only one of them is
    exchanged at a time.  Rows are packed where they lie, a body for each range of the order's first
    two columns between ``ends``, and only bodies are dealt.
    """
    parts = [part.dropna(subset=list(order)) for part in (rows if isinstance(rows, list) else [rows])]
    spark, names = parts[0].sparkSession, parts[0].columns
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if ends is None:
        keys = reduce(DataFrame.unionByName, [part.select(*order[:2]) for part in parts])
        ends = range_ends(keys, n)

    def in_order(held: list[Arrays]) -> Arrays:
        arrays = {name: np.concatenate([x[name] for x in held]) for name in names}
        at = np.lexsort([arrays[name] for name in reversed(order)])
        return {name: x[at] for name, x in arrays.items()}

    def body(arrays: Arrays, part: slice) -> bytes:
        return _dump({name: _narrow(x[part]) for name, x in arrays.items()})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bodies(held: list[Arrays]) -> Iterator[pa.RecordBatch]:
            arrays = in_order(held)
            one, two, low = arrays[order[0]], arrays[order[1]], 0
            for place, end in enumerate([*ends, None]):
                high = len(one)
                if end is not None:
                    first, last = np.searchsorted(one, end[0]), np.searchsorted(one, end[0], "right")
                    high = int(first + np.searchsorted(two[first:last], end[1], "right"))
                if high > low:
                    yield _stream([("place", pa.int64()), ("body", pa.binary())], [(place, body(arrays, slice(low, high)))])
                low = high

        held, count = [], 0
        for batch in batches:
            held.append({name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(names)})
            count += batch.num_rows
            if count >= HELD:
                yield from bodies(held)
                held, count = [], 0
        if count:
            yield from bodies(held)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells(place: int, held: list[Arrays]) -> Iterator[pa.RecordBatch]:
            arrays = in_order(held)
            now = arrays[order[0]]
            for made, low in enumerate(range(0, len(now), most)):
                part = slice(low, low + most)
                yield _stream(_CELL, [((place << 24) + made, len(now[part]), int(now[part][0]), int(now[part][-1]), body(arrays, part))])

        current, held = None, []
        for place, found in _rows(batches):
            if place != current and held:
                yield from cells(current, held)
                held = []
            current = place
            held.append(_load(found))
        if held:
            yield from cells(current, held)

    stores = [kept(part.mapInArrow(cut, "place long, body binary"), "ranges") for part in parts]
    dealt = reduce(DataFrame.unionByName, stores).repartition(max(n, len(ends) + 1), "place").sortWithinPartitions("place")
    found = kept(dealt.mapInArrow(joined, "cell long, n long, first long, last long, body binary"), "cells")
    for store in stores:
        remove(spark, store._written_at)
    return found


def _stream(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(schema)], names=[c for c, _ in schema])


_CELL = [("cell", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("body", pa.binary())]
_OUT = [("span", pa.int32()), ("cell", pa.int64()), ("kind", pa.int32()), ("body", pa.binary())]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """One row at a time, so that only one body is a Python value."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def _fold(rating: np.ndarray, last: np.ndarray, a: np.ndarray, b: np.ndarray, now: np.ndarray, won: np.ndarray, k: float, half_life: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """[row, 3] the two ratings (less the initial one) before each row and its change, [row, 2] gaps, then the teams' ratings and last times."""
    sides = np.stack([a, b], 1)
    at = np.argsort(sides.ravel(), kind="stable")
    code, time = sides.ravel()[at], np.repeat(now, 2)[at].astype(float)
    again = np.append(False, code[1:] == code[:-1])[: len(code)]
    days = np.empty(len(code))
    days[at] = np.maximum(0.0, (time - np.where(again, np.append(0.0, time[:-1])[: len(code)], last[code])) / DAY)
    gaps, state, last = days.reshape(-1, 2), rating.tolist(), last.copy()
    out = np.empty((len(now), 3))
    for i, (x, z, (p, q), y) in enumerate(zip(a.tolist(), b.tolist(), np.exp2(-gaps / half_life).tolist(), won.tolist(), strict=True)):
        one, two = state[x] * p, state[z] * q
        step = k * (y - 1.0 / (1.0 + 10.0 ** ((two - one) / SCALE)))
        state[x], state[z] = one + step, two - step
        out[i] = one, two, step
    final = np.append(code[1:] != code[:-1], True)[: len(code)]
    last[code[final]] = time[final]
    return out, gaps, np.array(state), last


def team_starts(cells: DataFrame, k: float = K_TEAM, half_life: float = TEAM_HALF_LIFE, final: bool = False) -> DataFrame:
    """``cell, body``: each cell's teams with their ratings and last times at its start; ``final``: all teams at the end."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, body in _rows(batches):
            c = _load(body)
            teams, at = np.unique(np.stack([c["team1"], c["team2"]], 1).astype(np.int64), return_inverse=True)
            at = at.reshape(-1, 2).astype(np.int32)
            yield _stream([("cell", pa.int64()), ("body", pa.binary())], [(cell, _dump({"teams": teams, "a": at[:, 0], "b": at[:, 1], "now": c["now"], "won": c["won"]}))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, int] = {}
        rating, last = np.zeros(1024), np.full(1024, np.inf)
        for cell, body in _rows(batches):
            c = _load(body)
            at = np.array([codes.setdefault(t, len(codes)) for t in c["teams"].tolist()], np.int64)
            if (more := len(codes) - len(rating)) > 0:
                more = max(more, len(rating))
                rating, last = np.append(rating, np.zeros(more)), np.append(last, np.full(more, np.inf))
            if not final:
                yield _stream([("cell", pa.int64()), ("body", pa.binary())], [(cell, _dump({"teams": c["teams"], "rating": rating[at], "last": last[at]}))])
            _, _, rating[at], last[at] = _fold(rating[at], last[at], c["a"], c["b"], c["now"], c["won"], k, half_life)
        if final and codes:
            n = len(codes)
            yield _stream([("cell", pa.int64()), ("body", pa.binary())], [(-1, _dump({"teams": np.array(list(codes), np.int64), "rating": rating[:n], "last": last[:n]}))])

    stream = cells.select("cell", "body").mapInArrow(thin, "cell long, body binary").repartition(1).sortWithinPartitions("cell")
    return stream.mapInArrow(run, "cell long, body binary")


class _Seen:
    """Entities by number, ascending: drawn sums by channel and half-life, last time, maps."""

    def __init__(self, channels: int, halves: np.ndarray) -> None:
        self.halves = halves
        self.keys, self.last, self.n = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.sums = np.zeros((0, channels, len(halves)))

    def add(self, keys: np.ndarray) -> None:
        new = np.setdiff1d(keys, self.keys)
        if not len(new):
            return
        merged = np.sort(np.append(self.keys, new))
        at = np.searchsorted(merged, self.keys)
        last, n, sums = np.zeros(len(merged)), np.zeros(len(merged), np.int64), np.zeros((len(merged), *self.sums.shape[1:]))
        last[at], n[at], sums[at] = self.last, self.n, self.sums
        self.keys, self.last, self.n, self.sums = merged, last, n, sums

    def part(self, which: np.ndarray) -> Arrays:
        return {"keys": self.keys[which], "last": self.last[which], "n": self.n[which], "sums": self.sums[which]}

    def known(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        within = at < len(self.keys)
        return at[within][self.keys[at[within]] == keys[within]]

    def absorb(self, more: Arrays) -> None:
        """What came later, itself begun from nothing."""
        self.add(more["keys"])
        at = np.searchsorted(self.keys, more["keys"])
        gap = np.where(self.n[at] > 0, np.maximum(0.0, more["last"] - self.last[at]) / DAY, 0.0)
        self.sums[at] = self.sums[at] * np.exp2(-gap[:, None] / self.halves)[:, None, :] + more["sums"]
        self.last[at] = more["last"]
        self.n[at] += more["n"]

    def walk(self, ids: np.ndarray, now: np.ndarray, adds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """[row, channel, half-life] sums before each row, drawn to its time, then its gap and earlier maps; rows in order.

        The first rows of all entities move at once, then the second ones, and so on.
        """
        self.add(np.unique(ids))
        code = np.searchsorted(self.keys, ids)
        order = np.argsort(code, kind="stable")
        ranked = code[order]
        start = np.maximum.accumulate(np.where(np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)], np.arange(len(ranked)), 0))
        nth = np.arange(len(ranked)) - start
        turns = np.argsort(nth, kind="stable")
        order = order[turns]
        bounds = np.append(0, np.cumsum(np.bincount(nth))) if len(nth) else np.zeros(1, np.int64)
        code, time, adds = code[order], now[order].astype(float), adds[order][:, :, None]
        sums, gaps, maps = np.empty((len(ids), *self.sums.shape[1:])), np.empty(len(ids)), np.empty(len(ids), np.int64)
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            who, t, to = code[low:high], time[low:high], order[low:high]
            n = self.n[who]
            gap = np.where(n > 0, np.maximum(0.0, t - self.last[who]) / DAY, 0.0)
            drawn = self.sums[who]
            if drawn.size:
                drawn *= np.exp2(-gap[:, None] / self.halves)[:, None, :]
            sums[to], gaps[to], maps[to] = drawn, gap, n
            self.sums[who], self.last[who], self.n[who] = drawn + adds[low:high], t, n + 1
        return sums, gaps, maps


Roster = Callable[[Arrays], tuple[np.ndarray, np.ndarray, np.ndarray | None]]


class Spans:
    """Packed contests, dealt into spans, with the teams' starts of their cells.

    Cells have ``now, team1, team2, won`` beside what ``roster`` reads: it gives
    [map, 10] players by side and slot, [map, 2] lineups and, where performances
    count, [map, 10] performances.  ``halves`` are half-lives in days; infinite: none.
    """

    def __init__(self, cells: DataFrame, roster: Roster, halves: list[float], channels: int = 1, maps: int = SPAN, starts: DataFrame | None = None) -> None:
        self.cells, self.roster, self.halves, self.channels = cells, roster, np.array(halves, float), channels
        spark = cells.sparkSession
        # a row for each cell: at least as many maps as rows of it, or a partition of the exchange
        listed = sorted(tuple(r) for r in cells.select("cell", "n", "first", "last").collect())
        total = sum(r[1] for r in listed)
        size = max(1, min(maps, -(-total // max(1, min(len(listed), spark.sparkContext.defaultParallelism)))))
        self.of_cell, self.bounds, before = [], {}, 0
        for cell, n, first, last in listed:
            span = before // size
            self.of_cell.append((cell, span))
            low, _ = self.bounds.get(span, (first, last))
            self.bounds[span] = (low, last)
            before += n
        self.starts = starts if starts is not None else kept(team_starts(cells), "team-starts")
        spans = F.broadcast(spark.createDataFrame(self.of_cell, "cell long, span int"))  # ten numbers a cell at most
        both = self.starts.withColumn("kind", F.lit(TEAMS)).unionByName(cells.select("cell", "body", F.lit(MAPS).alias("kind")))
        self.stream = both.join(spans, "cell").select("span", "cell", "kind", "body")

    def walked(self, extra: DataFrame | None, visit: Callable[[], object], schema: str, spans: list[int] | None = None) -> DataFrame:
        """Every span in order through a fresh ``visit()``: its ``maps`` gets each piece, its ``end`` the span's state; both yield batches."""
        stream = self.stream if extra is None else self.stream.unionByName(extra)
        if spans is not None:
            stream = stream.where(F.col("span").isin(spans))
        roster, halves, channels = self.roster, self.halves, self.channels
        n = len(self.bounds)  # more partitions than spans: else their hashes put several spans into one task
        dealt = stream.repartition(max(1, n, min(8 * n, 400)), "span").sortWithinPartitions("span", "cell", "kind")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, guest = None, None
            state: dict[int, _Seen] = {}
            teams: Arrays = {}
            for span, _, kind, body in _rows(batches):
                if span != current:
                    if guest is not None:
                        yield from guest.end(current, state)
                    current, guest = span, visit()
                    state = {PEOPLE: _Seen(channels, halves), LINEUPS: _Seen(0, halves)}
                found = _load(body)
                if kind in state:
                    state[kind].absorb(found)
                elif kind == TEAMS:
                    teams = found
                else:
                    yield from _pieces(found, teams, state, roster, channels, guest)
            if guest is not None:
                yield from guest.end(current, state)

        return dealt.mapInArrow(run, schema)

    def sums(self) -> DataFrame:
        """``kind, bucket, span, body``: what each span adds to its players and lineups."""
        return self.walked(None, _Sums, "kind int, bucket int, span int, body binary")

    def carried(self, final: bool = False, sums: DataFrame | None = None) -> DataFrame:
        """The state of a span's players and lineups at its start, as rows of its stream; ``final``: of all at the end."""
        halves, channels = self.halves, self.channels

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, state = None, None
            for kind, bucket, span, body in _rows(batches):
                if (kind, bucket) != current:
                    if final and current is not None:
                        yield _stream(_OUT, [(-1, -1, current[0], _dump(state.part(slice(None))))])
                    current, state = (kind, bucket), _Seen(channels if kind == PEOPLE else 0, halves)
                more = _load(body)
                if not final and len(at := state.known(more["keys"])):
                    yield _stream(_OUT, [(span, -1, kind, _dump(state.part(at)))])
                state.absorb(more)
            if final and current is not None:
                yield _stream(_OUT, [(-1, -1, current[0], _dump(state.part(slice(None))))])

        sums = self.sums() if sums is None else sums
        return sums.repartition(BUCKETS, "kind", "bucket").sortWithinPartitions("kind", "bucket", "span").mapInArrow(run, STREAM)


def _pieces(c: Arrays, teams: Arrays, state: dict[int, _Seen], roster: Roster, channels: int, guest: object) -> Iterator[pa.RecordBatch]:
    """A cell's maps, as many at once as ``VALUES`` allows, with their ratings before."""
    code = [np.searchsorted(teams["teams"], c[f"team{s}"]) for s in (1, 2)]
    ratings, gaps, _, _ = _fold(teams["rating"], teams["last"], *code, c["now"], c["won"], K_TEAM, TEAM_HALF_LIFE)
    most = max(1000, VALUES // (10 * channels * len(state[PEOPLE].halves)))
    sign = np.where(np.arange(10) < 5, SHARE, -SHARE)
    for low in range(0, len(ratings), most):
        part = slice(low, low + most)
        maps = {name: x[part] for name, x in c.items()}
        people, lineups, performed = roster(maps)
        ordered = np.sort(people, 1)
        if (ordered[:, 1:] == ordered[:, :-1]).any():
            raise ValueError("a map needs ten different players")
        step = ratings[part, 2]
        adds = (step[:, None] * sign).reshape(-1, 1)
        if channels > 1:
            adds = np.stack([adds[:, 0], performed.ravel()], 1)
        sums, days, played = state[PEOPLE].walk(people.ravel(), np.repeat(maps["now"], 10), adds)
        _, _, together = state[LINEUPS].walk(lineups.ravel(), np.repeat(maps["now"], 2), np.zeros((lineups.size, 0)))
        more = {"one": INITIAL + ratings[part, 0], "two": INITIAL + ratings[part, 1], "step": step, "gaps": gaps[part], "people": people, "lineups": lineups}
        yield from guest.maps(maps, more | {"sums": sums.reshape(len(step), 10, *sums.shape[1:]), "days": days.reshape(-1, 10), "played": played.reshape(-1, 10), "together": together.reshape(-1, 2)})


class _Sums:
    def maps(self, maps: Arrays, found: Arrays) -> Iterator[pa.RecordBatch]:
        yield from ()

    def end(self, span: int, state: dict[int, _Seen]) -> Iterator[pa.RecordBatch]:
        schema = [("kind", pa.int32()), ("bucket", pa.int32()), ("span", pa.int32()), ("body", pa.binary())]
        for kind, seen in state.items():
            bucket = seen.keys % BUCKETS
            for b in range(BUCKETS):
                if (bucket == b).any():
                    yield _stream(schema, [(kind, b, span, _dump(seen.part(bucket == b)))])


STATS = ("mean", "median", "min", "max", "std")


class Features:
    """A row for each map: ``columns`` of its cell, team and player ratings, gaps and counts before it; half-lives: none, then the decaying one."""

    def __init__(self, columns: tuple[str, ...]) -> None:
        self.columns = columns

    @staticmethod
    def schema(columns: tuple[str, ...]) -> str:
        return ", ".join([*(f"{c} long" for c in columns), *(f"{c} double" for c in Features.names())])

    @staticmethod
    def names() -> list[str]:
        stats = [f"team{s}_player_elo_{kind}_{x}" for s in (1, 2) for kind in ("basic", "decay") for x in STATS]
        return ["team1_elo_decay", "team2_elo_decay", "team1_gap_days", "team2_gap_days", *stats, *[f"team{s}_{x}" for s in (1, 2) for x in ("player_gap_days_mean", "player_gap_days_max", "player_prior_maps_mean", "player_cold_starts", "lineup_prior_maps")]]

    def maps(self, maps: Arrays, found: Arrays) -> Iterator[pa.RecordBatch]:
        out = [found["one"], found["two"], found["gaps"][:, 0], found["gaps"][:, 1]]
        for s in (0, 5):
            for i in (0, 1):
                x = np.sort(found["sums"][:, s : s + 5, 0, i] + INITIAL, 1)
                out += [x.mean(1), x[:, 2], x[:, 0], x[:, 4], x.std(1)]
        for s in (0, 5):
            days, played = found["days"][:, s : s + 5], found["played"][:, s : s + 5]
            out += [days.mean(1), days.max(1), played.mean(1), (played == 0).sum(1), found["together"][:, s // 5]]
        columns = [*(pa.array(maps[c].astype(np.int64)) for c in self.columns), *(pa.array(np.ascontiguousarray(x, float)) for x in out)]
        batch = pa.RecordBatch.from_arrays(columns, names=[*self.columns, *self.names()])
        for low in range(0, batch.num_rows, 10_000):
            yield batch.slice(low, 10_000)

    def end(self, span: int, state: dict[int, _Seen]) -> Iterator[pa.RecordBatch]:
        yield from ()


def lineup_features(rows: DataFrame) -> DataFrame:
    """``replay.lineup_features`` from the rows of ``Features``: no performances, so the rich ratings are the basic ones."""
    out = {"raw_team_elo_prob": elo_expectation(F.col("team1_elo_decay"), F.col("team2_elo_decay")), "team_elo_diff": F.col("team1_elo_decay") - F.col("team2_elo_decay")}

    def elo(s: int, kind: str, x: str) -> Column:
        return F.col(f"team{s}_player_elo_{kind}_{x}")

    for s in (1, 2):
        out |= {f"team{s}_player_elo{name}_{x}": elo(s, kind, x) for name, kind in (("_rich", "basic"), ("", "decay")) for x in STATS}
        out |= {f"team{s}_player_agg_elo": elo(s, "decay", "mean"), f"team{s}_player_prior_rich_updates_mean": F.lit(0.0), f"team{s}_rich_players_final_map": F.lit(0).cast("long")}
        out |= {f"team{s}_{x}": F.lit(False) for x in ("has_prior_rich_stats", "rich_stats_final_map")}
        out |= {f"team{s}_{x}": F.col(f"team{s}_{x}").cast("long") for x in ("player_cold_starts", "lineup_prior_maps")}
    for name, kind in (("_basic", "basic"), ("_rich", "basic"), ("_decay", "decay"), ("", "decay")):
        out[f"raw_player_elo_prob{name}"] = elo_expectation(elo(1, kind, "mean"), elo(2, kind, "mean"))
        out |= {f"player_elo{name}_{x}_diff": elo(1, kind, x) - elo(2, kind, x) for x in ("mean", "min")}
    out["player_agg_elo_diff"] = elo(1, "decay", "mean") - elo(2, "decay", "mean")
    out["lineup_prior_maps_diff"] = (F.col("team1_lineup_prior_maps") - F.col("team2_lineup_prior_maps")).cast("long")
    return rows.withColumns(out)


def _differences(maps: Arrays, found: Arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """[map] team difference, [map, half-life] player differences by changes and by performances."""
    sign = np.where(np.arange(10) < 5, 0.2, -0.2)
    changes, performed = np.moveaxis(np.einsum("mpch,p->mch", found["sums"], sign), 1, 0)
    return found["one"] - found["two"], changes, performed


MOMENTS = ("n", "b", "bb", "x", "z", "xx", "xz", "zz")
TOTALS = ("n", "b", "bb", "x", "xx", "bx", "loss")


class _Moments:
    """Sums over the maps before ``until``, from which the scale of any weight follows: x of changes, z of performances."""

    def __init__(self, halves: list[float], until: int) -> None:
        self.halves, self.until, self.total = halves, until, np.zeros((len(MOMENTS), len(halves)))

    def maps(self, maps: Arrays, found: Arrays) -> Iterator[pa.RecordBatch]:
        yield from ()
        use = maps["now"] < self.until
        b, x, z = (v[use] for v in _differences(maps, found))
        one = np.ones(len(self.halves))
        self.total += np.stack([one * len(b), one * b.sum(), one * (b * b).sum(), x.sum(0), z.sum(0), (x * x).sum(0), (x * z).sum(0), (z * z).sum(0)])

    def end(self, span: int, state: dict[int, _Seen]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(self.halves, pa.float64()), *map(pa.array, self.total)], names=["half_life", *MOMENTS])


class _Scores:
    """Sums over the maps from ``since`` on, for each half-life and weight with its scale."""

    def __init__(self, halves: list[float], scales: dict[tuple[float, float], float], since: int) -> None:
        self.cells = [(halves.index(h), k, scale) for (h, k), scale in scales.items()]
        self.halves, self.since, self.total = halves, since, np.zeros((len(self.cells), len(TOTALS)))

    def maps(self, maps: Arrays, found: Arrays) -> Iterator[pa.RecordBatch]:
        yield from ()
        use = maps["now"] >= self.since
        b, changes, performed = (v[use] for v in _differences(maps, found))
        won = maps["won"][use] > 0
        for total, (h, k, scale) in zip(self.total, self.cells, strict=True):
            x = (changes[:, h] + k * performed[:, h]) * scale
            q = 1.0 / (1.0 + 10.0 ** (-x / SCALE))
            loss = -np.log(np.clip(np.where(won, q, 1.0 - q), CLIP, 1 - CLIP)).sum()
            total += (len(b), b.sum(), (b * b).sum(), x.sum(), (x * x).sum(), (x * b).sum(), loss)

    def end(self, span: int, state: dict[int, _Seen]) -> Iterator[pa.RecordBatch]:
        names = [pa.array([self.halves[h] for h, *_ in self.cells], pa.float64()), pa.array([float(k) for _, k, _ in self.cells], pa.float64())]
        yield pa.RecordBatch.from_arrays([*names, *(pa.array(np.ascontiguousarray(x)) for x in self.total.T)], names=["half_life", "k_performance", *TOTALS])


#: Half-lives whose numbers a task carries at once, and about the maps of a span then: a state has two numbers for each.
GROUP, GRID_SPAN = 10, 4_000_000


def half_life_grid(cells: DataFrame, roster: Roster, half_lives: list[float], k_performances: list[float], train_until: int) -> DataFrame:
    """``replay.half_life_grid`` over packed contests: maps before ``train_until``, in microseconds, fit the scale, the later ones are validation."""
    halves = list(dict.fromkeys(map(float, half_lives)))
    starts, found = kept(team_starts(cells), "team-starts"), None
    for low in range(0, len(halves), GROUP):
        some = halves[low : low + GROUP]
        spans = Spans(cells, roster, some, 2, GRID_SPAN, starts)
        carried = kept(spans.carried(), "grid-states")
        trained = [s for s, (first, _) in spans.bounds.items() if first < train_until]
        scored = [s for s, (_, last) in spans.bounds.items() if last >= train_until]
        moments = spans.walked(carried, lambda some=some: _Moments(some, train_until), ", ".join(f"{c} double" for c in ("half_life", *MOMENTS)), trained)
        scales = {(h, float(k)): 1.0 for h in some for k in k_performances}
        for r in moments.groupBy("half_life").agg(*[F.sum(c).alias(c) for c in MOMENTS]).collect():
            for k in map(float, k_performances):
                n = max(1.0, r.n)
                of_base = max(0.0, r.bb / n - (r.b / n) ** 2) ** 0.5
                of_player = max(0.0, (r.xx + 2 * k * r.xz + k * k * r.zz) / n - ((r.x + k * r.z) / n) ** 2) ** 0.5
                if r.n > 0 and of_player > 0:
                    scales[r.half_life, k] = of_base / of_player
        totals = spans.walked(carried, lambda some=some, scales=scales: _Scores(some, scales, train_until), ", ".join(f"{c} double" for c in ("half_life", "k_performance", *TOTALS)), scored)
        totals = kept(totals.groupBy("half_life", "k_performance").agg(*[F.sum(c).alias(c) for c in TOTALS]), "grid-totals")
        part = grid_scores(totals, scales)
        found = part if found is None else found.unionByName(part)
    return found


LATEST = 9


class _Latest(_Sums):
    """``_Sums`` and each team's players on its last map of the span."""

    def __init__(self) -> None:
        self.teams, self.people = np.zeros(0, np.int64), np.zeros((0, 5), np.int64)

    def maps(self, maps: Arrays, found: Arrays) -> Iterator[pa.RecordBatch]:
        yield from ()
        teams = np.stack([maps["team1"], maps["team2"]], 1).astype(np.int64).ravel()
        self.teams, self.people = _last_of(np.append(self.teams, teams), np.concatenate([self.people, found["people"].reshape(-1, 5)]))

    def end(self, span: int, state: dict[int, _Seen]) -> Iterator[pa.RecordBatch]:
        yield from super().end(span, state)
        schema = [("kind", pa.int32()), ("bucket", pa.int32()), ("span", pa.int32()), ("body", pa.binary())]
        for b in range(BUCKETS):
            if (use := self.teams % BUCKETS == b).any():
                yield _stream(schema, [(LATEST, b, span, _dump({"teams": self.teams[use], "people": self.people[use]}))])


def _last_of(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with its last value."""
    found, at = np.unique(keys[::-1], return_index=True)
    return found, values[::-1][at]


def snapshots(cells: DataFrame, roster: Roster, half_life: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """After the last map: ``team, rating, last``, ``player, rating, last, n_maps``, ``lineup, n_maps`` and ``team, player`` of its last map."""
    spans = Spans(cells, roster, [half_life])
    sums = kept(spans.walked(None, _Latest, "kind int, bucket int, span int, body binary"), "span-sums")
    ended = kept(spans.carried(True, sums.where(F.col("kind") != LATEST)), "last-states")

    def of_teams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (body,) in _rows(batches):
            c = _load(body)
            yield pa.RecordBatch.from_pydict({"team": c["teams"], "rating": INITIAL + c["rating"], "last": c["last"].astype(np.int64)})

    def of_people(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (body,) in _rows(batches):
            c = _load(body)
            yield pa.RecordBatch.from_pydict({"player": c["keys"], "rating": INITIAL + c["sums"][:, 0, 0], "last": c["last"].astype(np.int64), "n_maps": c["n"]})

    def of_lineups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (body,) in _rows(batches):
            c = _load(body)
            yield pa.RecordBatch.from_pydict({"lineup": c["keys"], "n_maps": c["n"]})

    def of_latest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"team": np.repeat(teams, 5), "player": people.ravel()})

        current, teams, people = None, np.zeros(0, np.int64), np.zeros((0, 5), np.int64)
        for bucket, _, body in _rows(batches):
            if bucket != current and current is not None:
                yield out()
                teams, people = teams[:0], people[:0]
            current, c = bucket, _load(body)
            teams, people = _last_of(np.append(teams, c["teams"]), np.concatenate([people, c["people"]]))
        yield out()

    teams = team_starts(cells, final=True).select("body").mapInArrow(of_teams, "team long, rating double, last long")
    people = ended.where(F.col("kind") == PEOPLE).select("body").mapInArrow(of_people, "player long, rating double, last long, n_maps long")
    lineups = ended.where(F.col("kind") == LINEUPS).select("body").mapInArrow(of_lineups, "lineup long, n_maps long")
    by_bucket = sums.where(F.col("kind") == LATEST).select("bucket", "span", "body").repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "span")
    return teams, people, lineups, by_bucket.mapInArrow(of_latest, "team long, player long")
