"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Tokens are runs of word characters or of symbols.  The ``WORDS`` most frequent of
the sample are the vocabulary; any other token is its shape (case, digits,
symbols, length), and a token that repeats the one before it is ``AGAIN``.  Every token has a sparse random index vector made from its
hash; its word vector is the sum of the index vectors of its neighbours over the
sample, scaled to length one, plus its own index vector.  A document is the mean
of its tokens' vectors; a tanh layer and a logistic unit, trained by Adam in
numpy, turn it into a logit, and a temperature fitted on a fifth of the sample
calibrates the probability.

The classifier is fitted on a bounded sample: about ``SAMPLE_ROWS`` labelled ids,
chosen by a hash of the id, twice as many at most.  The fit is one task that streams them
and holds their token numbers; scoring is row by row and covers whole texts.

Defined results: a null or empty text is scored as a document without tokens; a
null label teaches nothing; an id with several labels or texts teaches once, by its
smallest label and that of its texts with the smallest digest; when the sample has one class or none, every score is
the smoothed share of label 1; repeated rows get equal scores.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wordhash import _BYTE, U, _powers, mix, pieces

WORDS = 8192
DIM = 64
HIDDEN = 32
REACH = 2
SAMPLE_ROWS = 8000
SHAPES = 64
SLICE = 1 << 18
#: The token of a word that repeats the word before it.
AGAIN = U(0xA6A1)

_CLASS = np.zeros(256, np.uint8)  # 0 space, 1 word character, 2 symbol
_CLASS[33:128] = 2
_CLASS[128:] = 1
for _c in range(48, 123):
    if chr(_c).isalnum():
        _CLASS[_c] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, shape, text) of the tokens of some texts."""
    n = len(data)
    kind = _CLASS[data]
    edge = np.ones(n, bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], n)
    real = kind[starts] > 0 if n else np.zeros(0, bool)
    starts, ends = starts[real], ends[real]
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    length = ends - starts
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + length.astype(U))
    uppers, digits = np.concatenate(([0], np.cumsum(_UPPER[data]))), np.concatenate(([0], np.cumsum(_DIGIT[data])))
    u, d = uppers[ends] - uppers[starts], digits[ends] - digits[starts]
    case = np.where(u == 0, 0, np.where(u >= np.maximum(2, length // 2), 2, 1))
    size = np.minimum(np.log2(np.maximum(length, 1)).astype(np.int64), 3)
    shape = np.where(kind[starts] == 2, 48 + size, (case * 3 + np.where(d == 0, 0, np.where(d == length, 2, 1))) * 4 + size)
    text = np.searchsorted(offsets, starts, "right") - 1
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])) + 1
    hashes[again], shape[again] = AGAIN, SHAPES - 1
    return hashes, shape, text


def index_vectors(keys: np.ndarray, dim: int = DIM, nonzero: int = 8) -> np.ndarray:
    """Sparse ternary vectors made from the keys."""
    out = np.zeros((len(keys), dim), np.float32)
    rows = np.arange(len(keys))
    for i in range(nonzero):
        h = mix(keys.astype(U) + U((i + 1) * 0x9E3779B97F4A7C15 % 2**64))
        out[rows, (h >> U(8)).astype(np.int64) % dim] += np.where(h & U(1), 1, -1)
    return out / np.sqrt(nonzero).astype(np.float32)


class Vectors:
    """Vocabulary hashes (rising) and the vectors of its words, then of the shapes."""

    def __init__(self, vocabulary: np.ndarray, vectors: np.ndarray):
        self.vocabulary, self.vectors = vocabulary, vectors

    @staticmethod
    def number(vocabulary: np.ndarray, hashes: np.ndarray, shape: np.ndarray) -> np.ndarray:
        at = np.searchsorted(vocabulary, hashes)
        known = at < len(vocabulary)
        known[known] = vocabulary[at[known]] == hashes[known]
        return np.where(known, at, len(vocabulary) + shape)

    @classmethod
    def learn(cls, texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], words: int = WORDS) -> Vectors:
        hashes = np.concatenate([t[0] for t in texts]) if texts else np.zeros(0, U)
        seen, times = np.unique(hashes, return_counts=True)
        vocabulary = np.sort(seen[np.lexsort((seen, -times))[:words]][: int((times > 2).sum())])
        size = len(vocabulary) + SHAPES
        own = index_vectors(np.concatenate((vocabulary, np.arange(SHAPES).astype(U))))
        sums = np.zeros((size, DIM))
        for h, shape, text in texts:
            ids = cls.number(vocabulary, h, shape)
            for step in range(1, REACH + 1):
                same = np.flatnonzero(text[:-step] == text[step:])
                a, b = ids[same], ids[same + step]
                for low in range(0, len(a), 1 << 16):
                    x, y = a[low : low + (1 << 16)], b[low : low + (1 << 16)]
                    for left, right in ((x, y), (y, x)):  # group equal words, then add their neighbours
                        order = np.argsort(left, kind="stable")
                        first = np.flatnonzero(np.diff(left[order], prepend=-1))
                        sums[left[order][first]] += np.add.reduceat(own[right[order]], first, axis=0)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        return cls(vocabulary, (sums / np.maximum(length, 1e-9) + own).astype(np.float32))

    def pool(self, hashes: np.ndarray, shape: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """The mean vector of each of n texts; zero without tokens."""
        out = np.zeros((n, DIM), np.float32)
        if len(hashes):
            ids = self.number(self.vocabulary, hashes, shape)
            first = np.flatnonzero(np.diff(text, prepend=-1))
            there = text[first]
            for i in range(0, len(first), 64):  # so many texts' vectors at once
                low, high = first[i], first[i + 64] if i + 64 < len(first) else len(ids)
                out[there[i : i + 64]] = np.add.reduceat(self.vectors[ids[low:high]], first[i : i + 64] - low, axis=0)
            out[there] /= np.diff(np.append(first, len(ids)))[:, None]
        return out


class Network:
    """Two layers, standardised inputs, and a temperature."""

    def __init__(self, prior: float):
        self.prior = prior
        self.layers: tuple[np.ndarray, ...] = ()
        self.temperature = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, epochs: int = 60, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        train = np.flatnonzero(~calibrate)
        if not len(train) or y[train].min() == y[train].max():
            return self
        self.mean, self.scale = x[train].mean(0), x[train].std(0) + 1e-6
        x = (x - self.mean) / self.scale
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array(np.log(y[train].mean() / (1 - y[train].mean())))]
        m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(epochs):
            order = rng.permutation(train)
            for low in range(0, len(order), 128):
                rows = order[low : low + 128]
                h = np.tanh(x[rows] @ w[0] + w[1])
                p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30)))
                e = (p - y[rows]) / len(rows)
                back = np.outer(e, w[2]) * (1 - h * h)
                t += 1
                for i, g in enumerate((x[rows].T @ back + 1e-4 * w[0], back.sum(0), h.T @ e + 1e-4 * w[2], e.sum())):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    w[i] = w[i] - 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.layers = tuple(w)
        if calibrate.any():
            logit, truth = self._logit((x * self.scale + self.mean)[calibrate]), y[calibrate]
            steps = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
            loss = [np.logaddexp(0, np.where(truth > 0, -1, 1) * logit / s).mean() for s in steps]
            self.temperature = float(steps[int(np.argmin(loss))])
        return self

    def _logit(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh((x - self.mean) / self.scale @ a + b) @ c + d

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._logit(x) / self.temperature, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, known: Column, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> tuple[Vectors, Network]:
    """The classifier of ``label_col``, from the labels whose ids satisfy ``known``."""
    rows = labels.where(known & F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    n = rows.count()
    share = min(1.0, sample_rows / max(1, n))
    place = F.pmod(F.xxhash64("id"), F.lit(1_000_003))
    chosen = rows.where(place < share * 1_000_003).orderBy(place, "id").limit(2 * sample_rows)
    # At most 2 * sample_rows pairs of numbers: a proven bound for the broadcast.
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("id", F.coalesce("text", F.lit("")).alias("text"), "y")
    first = F.min(F.struct(F.md5(F.col("text").cast("binary")).alias("digest"), "text", "y"))
    given = met.groupBy("id").agg(first.alias("f")).select("id", "f.text", "f.y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ys, texts, sizes = [], [], [], []
        for batch in batches:
            for low, high, data, offsets in pieces(batch.column(1), SLICE):
                texts.append(tokens(data, offsets))
                sizes.append(high - low)
            ids += batch.column(0).to_pylist()
            ys += batch.column(2).to_pylist()
        y = np.array(ys, float)
        vectors = Vectors.learn(texts)
        x = np.concatenate([vectors.pool(*t, k) for t, k in zip(texts, sizes, strict=True)]) if texts else np.zeros((0, DIM), np.float32)
        calibrate = mix(np.array(ids, np.int64).astype(U)) % U(5) == 0 if ids else np.zeros(0, bool)
        network = Network((y.sum() + 1) / (len(y) + 2)).fit(x, y, calibrate)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps((vectors, network))], pa.binary())})

    fitted = given.repartition(1).sortWithinPartitions("id", "text", "y").mapInArrow(run, "model binary").collect()
    return pickle.loads(fitted[0]["model"]) if fitted else (Vectors.learn([]), Network(0.5))


def score(docs: DataFrame, vectors: Vectors, network: Network) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (columns of those names are replaced)."""
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    docs = docs.drop("score", "predicted")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [network.probability(vectors.pool(*tokens(data, offsets), high - low)) for low, high, data, offsets in pieces(batch.column(at), SLICE)]
            p = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))
