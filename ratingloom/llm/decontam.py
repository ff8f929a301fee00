"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1.  The document frequency of every three-word gram of the test items is counted
    over all documents.
2.  Every gram of an item that some document holds becomes a seed, rare or frequent;
    only those of frequency 0 lead nowhere and are dropped.  So an edited copy is met
    as long as it keeps three neighbouring words of the item.
3.  Seeds join documents to items; around a seed the window of the document that
    the item can cover is aligned with it, word by word, by Smith-Waterman (match
    2, mismatch -1, gap -1).  The score is divided by that of an exact copy.  A match
    reaches the least share of it or, whatever the item's length, the score of
    ``PASSAGE_WORDS`` words in a row, so a verbatim part of a long item counts.

Before the alignment two exact shortcuts: a verbatim occurrence has score 1, and a
window with fewer shared words than the least score needs cannot reach it.

Words are lower-cased (ASCII and Latin-1) and split at ASCII punctuation.  Items
are handled in blocks of at most about ``BLOCK_BYTES``, each carried to the
executors in the task; documents are read once for all frequencies and once for
each block, and never shuffled.

Defined results: null or blank texts and items match nothing; repeated documents
and items give repeated rows; an item of one or two words is too short to prove
anything inside a text and matches only documents of just those words; equal
scores take the first window; a null doc_id or item_id is returned as null;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import trimmed
from .common import materialise
from .wordhash import U, Words, pieces

GRAM = 3
MIN_SCORE = 0.35
PASSAGE_WORDS = 13
BLOCK_BYTES = 16_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least and largest bitmap of the benchmark's grams, as powers of two (1 to 64 MB), and the documents' grams that a task holds before it counts them.
BITS = 23, 29
HELD = 2_000_000
_FOLD = np.arange(256, dtype=np.uint8)
for _b in range(33, 127):
    if not chr(_b).isalnum():
        _FOLD[_b] = 32
_FOLD[65:91] += 32


def fold(data: np.ndarray) -> np.ndarray:
    """The bytes with case and punctuation folded, each at its place."""
    out = _FOLD[data]
    upper = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    out[upper] += 0x20
    return out


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment (Smith-Waterman, linear gaps): its score and the window's words [start, end)."""
    n = len(window)
    step = np.arange(n + 1) * -GAP
    row = np.zeros(n + 1, np.int64)
    origin = np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        diagonal = row[:-1] + np.where(window == word, MATCH, MISMATCH)
        up = row[1:] + GAP
        top = np.concatenate(([0], np.maximum(np.maximum(diagonal, up), 0)))
        source = np.concatenate(([0], np.where(top[1:] == 0, np.arange(1, n + 1), np.where(diagonal >= up, origin[:-1], origin[1:]))))
        lifted = top + step
        high = np.maximum.accumulate(lifted)
        leader = np.maximum.accumulate(np.where(lifted == high, np.arange(n + 1), 0))
        row, origin = high - step, source[leader]
        at = int(row.argmax())
        if row[at] > best[0]:
            best = (int(row[at]), int(origin[at]), at)
    return best


class Items:
    """Test items as folded word hashes with the grams that lead to them."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        self.words: list[np.ndarray] = []
        grams, owner, place = [], [], []
        for low, _, data, offsets in pieces(pa.array(texts, pa.string())):
            words = Words(fold(data), offsets)
            found, text, first = words.grams(GRAM)
            self.words += [words.hashes[a:b] for a, b in zip(words.at[:-1], words.at[1:], strict=True)]
            grams.append(found)
            owner.append(text + low)
            place.append(first - words.at[text])
        joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (grams, owner, place)]
        self.grams, self.owner, self.place = joined[0].astype(U), joined[1], joined[2]

    def keep(self, rows: np.ndarray) -> None:
        self.grams, self.owner, self.place = self.grams[rows], self.owner[rows], self.place[rows]

    def index(self) -> GramIndex:
        return GramIndex(np.unique(self.grams))


class GramIndex:
    """Which of many grams are among the sorted ones: a bitmap, then a search for those that pass it."""

    BITS = U(2**20 - 1)

    def __init__(self, grams: np.ndarray):
        self.grams = grams
        self.there = np.zeros(2**20, bool)
        self.there[grams & self.BITS] = True

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, positions among the sorted grams) of those that are there."""
        rows = np.flatnonzero(self.there[grams & self.BITS])
        at = np.searchsorted(self.grams, grams[rows])
        hit = at < len(self.grams)
        hit[hit] = self.grams[at[hit]] == grams[rows[hit]]
        return rows[hit], at[hit]

    def has(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams), bool)
        out[self.find(grams)[0]] = True
        return out


def occurring(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """``gram, n``: the benchmark's grams that occur in documents, and in how many.

    One pass over the documents for all items (``size`` bytes).  A bitmap lets pass
    the documents' grams that may be of the benchmark; they are counted where they
    lie, ``HELD`` of them at a time, before the exchange that joins them with the
    benchmark's own.
    """
    bits = 1 << max(BITS[0], min(BITS[1], (64 * size).bit_length()))

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0)):
                yield pa.RecordBatch.from_pydict({"gram": pa.array(np.unique(Words(fold(data), offsets).grams(GRAM)[0]).view(np.int64))})

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.zeros(bits >> 3, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy().view(U) & U(bits - 1)
            np.bitwise_or.at(there, at >> U(3), (U(1) << (at & U(7))).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"bits": pa.array([there.tobytes()], pa.binary())})

    grams = benchmark.select("text").mapInArrow(trimmed(of_items), "gram long").distinct()
    bitmap = np.zeros(bits >> 3, np.uint8)
    for row in grams.coalesce(4).mapInArrow(trimmed(places), "bits binary").toLocalIterator():
        bitmap |= np.frombuffer(row["bits"], np.uint8)

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        waiting = 0

        def counted() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held) if held else np.zeros(0, U), return_counts=True)
            return pa.RecordBatch.from_pydict({"gram": pa.array(found.view(np.int64)), "n": pa.array(n.astype(np.int64))})

        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0)):
                found, text, _ = Words(fold(data), offsets).grams(GRAM)
                at = found & U(bits - 1)
                hit = np.flatnonzero((bitmap[at >> U(3)] >> (at & U(7)).astype(np.uint8)) & np.uint8(1))
                order = hit[np.lexsort((found[hit], text[hit]))]
                once = np.ones(len(order), bool)  # a gram counts once for each text
                once[1:] = (found[order][1:] != found[order][:-1]) | (text[order][1:] != text[order][:-1])
                held.append(found[order][once])
                waiting += len(held[-1])
                if waiting >= HELD:
                    yield counted()
                    held, waiting = [], 0
        yield counted()

    partial = docs.select("text").where("text is not null").mapInArrow(trimmed(of_docs), "gram long, n long")
    return partial.groupBy("gram").agg(F.sum("n").alias("n")).join(grams, "gram", "left_semi")


def choose_seeds(items: Items, occur: np.ndarray) -> None:
    """Keep every gram of an item that occurs in the documents (hashes, rising)."""
    items.keep(np.flatnonzero(GramIndex(occur).has(items.grams)))


def best_match(words: np.ndarray, item: np.ndarray, begins: np.ndarray, least: float) -> tuple[float, int, int] | None:
    """The best alignment of the item near the places where seeds say it begins."""
    m = len(item)
    full = MATCH * m
    needed = min(least * full, MATCH * PASSAGE_WORDS)
    for b in begins:
        if b >= 0 and b + m <= len(words) and np.array_equal(words[b : b + m], item):
            return 1.0, int(b), int(b) + m
    slack = m // 2 + 4
    best = None
    low, high = max(0, int(begins[0]) - slack), 0
    spans = []
    for b in begins:  # rising
        start, end = max(0, int(b) - slack), min(len(words), int(b) + m + slack)
        if start > high and high:
            spans.append((low, high))
            low = start
        high = max(high, end)
    spans.append((low, high))
    for start, end in spans:
        window = words[start:end]
        if MATCH * int(np.isin(item, window).sum()) < needed:
            continue
        score, a, z = align(item, window)
        if score >= needed and (best is None or score / full > best[0]):
            best = (score / full, start + a, start + z)
    return best


def _item_blocks(docs: DataFrame, benchmark: DataFrame, block_bytes: int) -> Iterator[Items]:
    """The items with their seeds, a bounded block at a time."""
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = benchmark.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    seeds = materialise(occurring(docs, benchmark, int(size)), "seeds")
    parts = benchmark.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for k in range(blocks):
        rows = parts.where(F.col("part") == k).toArrow()
        items = Items(rows.column("item_id").to_pylist(), rows.column("text").to_pylist())
        own = docs.sparkSession.createDataFrame(pa.table({"gram": pa.array(np.unique(items.grams).view(np.int64))}))
        occur = seeds.join(own, "gram", "left_semi").select("gram").toArrow() if blocks > 1 else seeds.select("gram").toArrow()
        choose_seeds(items, np.sort(occur.column("gram").to_numpy().view(U)))
        yield items


def matches(items: Items, texts: pa.Array, least: float) -> Iterator[tuple[int, int, float, int, int, int]]:
    """(row of the text, item, score, first byte, last byte, words) of every match."""
    index = items.index()
    order = np.argsort(items.grams, kind="stable")
    firsts = np.searchsorted(items.grams[order], index.grams, "left")
    lasts = np.searchsorted(items.grams[order], index.grams, "right")
    for low, _, data, offsets in pieces(texts):
        words = Words(fold(data), offsets)
        grams, text, first = words.grams(GRAM)
        rows, at = index.find(grams)
        begins: dict[tuple[int, int], list[int]] = {}
        for row, a in zip(rows.tolist(), at.tolist(), strict=True):
            t = int(text[row])
            for o in order[firsts[a] : lasts[a]]:
                begins.setdefault((t, int(items.owner[o])), []).append(int(first[row] - words.at[t] - items.place[o]))
        for (t, i), places in begins.items():
            own = words.hashes[words.at[t] : words.at[t + 1]]
            hit = best_match(own, items.words[i], np.unique(places), least)
            if hit:
                s, a, z = hit
                base, doc = offsets[t], words.at[t]
                yield low + t, i, s, int(words.starts[doc + a] - base), int(words.ends[doc + z - 1] - base), z - a


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = MIN_SCORE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item that it holds.

    ``doc_id, item_id, score`` (share of an exact copy's; below ``least`` where a
    passage of a long item matches), and the passage's UTF-8 bytes
    ``start_byte, end_byte`` and ``n_words`` of the best alignment.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    kinds = {"doc_id": pa.int64(), "item_id": pa.int64(), "score": pa.float64(), "start_byte": pa.int64(), "end_byte": pa.int64(), "n_words": pa.int32()}

    def matcher(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                found = [(ids[row].as_py(), items.ids[i], *rest) for row, i, *rest in matches(items, batch.column(1), least)]
                columns = list(zip(*found, strict=True)) if found else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

        return run

    schema = "doc_id long, item_id long, score double, start_byte long, end_byte long, n_words int"
    parts = [docs.mapInArrow(trimmed(matcher(items)), schema) for items in _item_blocks(docs, benchmark, block_bytes)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, least: float = MIN_SCORE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no test item, judged row by row where they lie."""
    at = docs.columns.index("text")

    def keeper(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                good[[row for row, *_ in matches(items, batch.column(at), least)]] = False
                yield batch.filter(pa.array(good))

        return run

    out = docs
    for items in _item_blocks(docs, benchmark, block_bytes):
        out = out.mapInArrow(trimmed(keeper(items)), docs.schema)
    return out
