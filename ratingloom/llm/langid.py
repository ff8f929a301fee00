"""Language identification by rank-order profiles.

A profile is the ``PROFILE`` most frequent letter n-grams (one to three letters,
with word edges) of a language, most frequent first.  A word is a run of Unicode
letters and of the marks that belong to them; numbers of any kind are no letters.  A document's own most
frequent n-grams are compared with each profile by out-of-place distance: the sum
over the document's n-grams of how far its rank is from the profile's rank, or
``PROFILE`` for an n-gram that the profile lacks.  The smallest distance wins, and
``score`` is one minus that distance over the largest possible one.

Profiles are learned from a bounded sample: about ``per_language`` documents of
each language, chosen by a hash of the id, whole texts, counted where they lie, of
at most ``languages`` languages, those with the most labelled documents (then the
smaller name).  So the driver holds at most ``languages`` times ``PROFILE`` n-grams.
Every whole text is then predicted on its own; nothing but its text is read.

Defined results: a text that is null or has no letters is ``und`` with score 0;
so is every text when nothing was learned.  Equal counts rank by n-gram, equal
distances go to the smaller language name, so ties and repeated rows have one
result.  Rows of null ``lang`` teach nothing.  Other columns are ignored.  Texts
of marks or numbers alone have no letters.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..shipping import trimmed

PROFILE = 400
PER_LANGUAGE = 3000
LANGUAGES = 500
#: Below this score a text resembles none of the learned languages.
MIN_SCORE = 0.2
UNKNOWN = "und"
_EDGE = ord("_")
LETTER, MARK = 1, 2


@cache
def _kinds() -> np.ndarray:
    """Of each code point: a letter, a mark, or neither."""
    groups = (unicodedata.category(chr(i))[0] for i in range(sys.maxunicode + 1))
    return np.fromiter(({"L": LETTER, "M": MARK}.get(g, 0) for g in groups), np.uint8, sys.maxunicode + 1)


def _words(text: str) -> np.ndarray:
    """The code points of the text's words in lower case, an edge before, between and after them; empty without letters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[c]
    if not (kind == LETTER).any():
        return np.zeros(0, np.int64)
    out = np.full(len(c) + 2, _EDGE, np.int64)
    out[1:-1][kind > 0] = c[kind > 0]
    edge = out == _EDGE
    return out[np.concatenate(([True], ~(edge[1:] & edge[:-1])))]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Exact keys (21 bits a character) of the text's letter n-grams, rising, and their counts."""
    c = _words(text)
    if not len(c):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = (c[:-1] << 21) | c[1:]
    triples = (pairs[:-1] << 21) | c[2:]
    keys = np.concatenate((c[c != _EDGE], pairs, triples[c[1:-1] != _EDGE]))
    keys.sort()
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[new], np.diff(np.append(new, len(keys)))


def ranked(keys: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent keys, most frequent first, equal counts by key."""
    if len(keys) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        some = counts >= least
        keys, counts = keys[some], counts[some]
    return keys[np.lexsort((keys, -counts))][:most]


class Profiles:
    """The learned languages as one table of ranks."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.names, self.size = sorted(profiles), size
        self.keys = np.unique(np.array([k for p in profiles.values() for k in p], np.int64))
        self.rank = np.full((len(self.names), len(self.keys) + 1), -1, np.int64)
        for i, name in enumerate(self.names):
            self.rank[i, np.searchsorted(self.keys, profiles[name])] = np.arange(len(profiles[name]))

    def distances(self, text: str) -> np.ndarray | None:
        """Out-of-place distance to each language in [0, 1]; None without letters."""
        own = ranked(*gram_counts(text), self.size)
        if not len(own):
            return None
        at = np.searchsorted(self.keys, own)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != own)] = len(self.keys)
        there = self.rank[:, at]
        off = np.where(there < 0, self.size, np.minimum(np.abs(there - np.arange(len(own))), self.size))
        return off.sum(1) / (self.size * len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.distances(text) if text and self.names else None
        if found is None:
            return UNKNOWN, 0.0
        best = int(np.argmin(found))
        return self.names[best], float(1 - found[best])


def learn(docs: DataFrame, known: Column, size: int = PROFILE, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> Profiles:
    """Profiles from the rows where ``known`` holds and ``lang`` is not null."""
    rows = docs.select("doc_id", "text", "lang", known.alias("known")).where("known and lang is not null and text is not null")
    # All rows of a language, or about per_language of them by a hash of the id.
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, per_language / r["n"])) for r in sizes], "learned string, share double")
    chosen = rows.join(F.broadcast(shares), F.col("lang") == F.col("learned"))
    sample = chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.col("share") * 1_000_003).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, dict[int, int]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = total.setdefault(lang, {})
                for key, n in zip(*(x.tolist() for x in gram_counts(text)), strict=True):
                    own[key] = own.get(key, 0) + n
        for lang, own in total.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(own), "gram": pa.array(own.keys(), pa.int64()), "n": pa.array(own.values(), pa.int64())})

    counts = sample.mapInArrow(trimmed(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = counts.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("place") <= size)
    profiles: dict[str, list[int]] = {}
    for r in first.orderBy("lang", "place").collect():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(profiles, size)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (columns of those names are replaced)."""
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t.as_py()) for t in batch.column(at)]
            names, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, names, scores], names=[*batch.schema.names, "lang_pred", "score"])

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(trimmed(run), schema)


def reject_unknown(docs: DataFrame, profiles: Profiles, least: float = MIN_SCORE) -> DataFrame:
    """The documents with a learned language; those without letters or unlike all profiles go."""
    return predict(docs, profiles).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(docs.columns)
