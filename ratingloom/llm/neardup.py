"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A document is its five-word shingles, each weighted by ``1 + ln(occurrences)``.
Every shingle is a Poisson process whose rate is its weight; its arrivals fall on
random registers, and a register keeps the shingle that arrives first.  Two
registers agree with the probability Jaccard similarity of the weighted sets, and
a shingle stops as soon as its next arrival is later than the last register's
first (early termination).  ``BANDS`` bands of ``ROWS`` registers make candidates;
a pair is linked when its exact probability Jaccard is at least ``threshold``
(on sets without repeated shingles that is the ordinary Jaccard similarity).

Distribution.  Exact copies are one text, told apart from others by the digest of
the whole text and numbered; ids only come in at the end.  In each
bucket all members are verified against one centre, and links are closed into
components.  In the buckets that then still hold several components, the pairs
across components are compared by longer signatures (``SKETCH`` registers, a bit
of each) and those that can reach the threshold are verified too.  So no link
between different texts that share a bucket is lost, while a bucket of one large
group costs a linear number of pairs.  Every list (buckets, pairs, links, labels)
stays distributed, and each round is written to the shared folder, which cuts the
lineage.  Joins have one row per key on one side: that side is broadcast where
its counted rows are few, else both have plain exchanges, so that adaptive
execution splits a hot key.

Limits of exactness: shingle keys have 48 bits, a pair at the threshold shares no
band with probability 6e-5, and one met across components is let go by its
sketches with probability 1.4e-5.

Defined results: texts without words (null, empty, blank) have no shingles and
are classes of their own; a text of one to four words has one shingle; rows that
repeat an id get the class of their own text each; rows with a null id are
compared like others and come back with a null class; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import trimmed
from .common import bounded, materialise, merged, scratch
from .wordhash import U, Words, mix, pieces

BANDS, ROWS = 32, 6
SHINGLE = 5
THRESHOLD = 0.8
#: Registers of the longer signatures of the second round, one bit each.
SKETCH = 2048
_STEP = U(0x9E3779B97F4A7C15)


def weighted_shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, occurrences) of the distinct shingles of each text; keys have 48 bits, rising within a text."""
    grams, text, _ = Words(data, offsets).grams(k)
    n, at, parts = len(offsets) - 1, 0, []
    bounds = np.searchsorted(text, np.arange(0, n + 65535, 65535))
    for i in range(len(bounds) - 1):  # 16 bits for the text
        low, high = bounds[i], bounds[i + 1]
        if low == high:
            continue
        both = np.sort(((text[low:high] - i * 65535).astype(U) << U(48)) | (grams[low:high] >> U(16)))
        new = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
        parts.append(((both[new] >> U(48)).astype(np.int64) + i * 65535, both[new] & U(2**48 - 1), np.diff(np.append(new, len(both)))))
        at += 1
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def weigh(occurrences: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(occurrences)


def prob_minhash(n: int, text: np.ndarray, key: np.ndarray, weight: np.ndarray, m: int) -> np.ndarray:
    """The signatures [n, m] of n weighted sets: of each register the key that arrives first, 0 if none.

    All sets advance together, arrival by arrival; when few elements are left
    they draw several arrivals at once.
    """
    first = np.full(n * m, np.inf)
    winner = np.zeros(n * m, U)
    now = np.zeros(len(key))
    state = mix(key + _STEP)
    draws = 1
    while len(key):
        steps = (np.arange(1, draws + 1).astype(U) * _STEP)[None, :]
        random = mix(state[:, None] + steps)
        gaps = -np.log(((random >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[:, None]
        times = now[:, None] + np.cumsum(gaps, 1)
        register = ((mix(random + _STEP) >> U(32)) * U(m) >> U(32)).astype(np.int64)
        flat = (text[:, None] * m + register).ravel()
        np.minimum.at(first, flat, times.ravel())
        won = np.flatnonzero(first[flat] == times.ravel())
        winner[flat[won]] = key[won // draws]
        last = first.reshape(n, m).max(1)
        now = times[:, -1]
        left = np.flatnonzero(now < last[text])
        text, key, weight, now = text[left], key[left], weight[left], now[left]
        state = state[left] + steps[0, -1]
        draws = max(1, min(64, 20_000 // max(1, len(key))))
    return winner.reshape(n, m)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[n, bands] int64 hashes of the bands, different for each band."""
    s = signatures.reshape(len(signatures), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1).astype(U) * _STEP, s.shape[:2]).copy()
    for r in range(rows):
        out = mix(out + s[:, :, r] * (_STEP | U(1)))
    return out.view(np.int64)


def probability_jaccard(keys_a: np.ndarray, a: np.ndarray, keys_b: np.ndarray, b: np.ndarray) -> float:
    """Exact: sum over shared elements i of 1 / sum over all k of max(a_k / a_i, b_k / b_i)."""
    _, ia, ib = np.intersect1d(keys_a, keys_b, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    only_a, only_b = a.sum() - a[ia].sum(), b.sum() - b[ib].sum()
    pairs, times = np.unique(np.stack([a[ia], b[ib]]), axis=1, return_counts=True)
    x, y = pairs  # few distinct weights, so few distinct pairs
    # max(x_k / x_i, y_k / y_i) is the first where x_k / y_k >= x_i / y_i
    order = np.argsort(x / y, kind="stable")
    x, y, times = x[order], y[order], times[order]
    ratio = x / y
    at = np.searchsorted(ratio, ratio, "left")
    sum_x = np.concatenate(([0.0], np.cumsum(x * times)))
    sum_y = np.concatenate(([0.0], np.cumsum(y * times)))
    total = (sum_x[-1] - sum_x[at] + only_a) / x + (sum_y[at] + only_b) / y
    return float((times / total).sum())


def _digest() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def signatures(docs: DataFrame, bands: int, rows: int, shingle: int) -> DataFrame:
    """``doc_id, digest, bands``: the md5 of the whole text and the hash of each band (none without words)."""
    given = docs.select("doc_id", _digest().alias("digest"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in pieces(batch.column(2)):
                who, key, times = weighted_shingles(data, offsets, shingle)
                n = high - low
                hashes = band_keys(prob_minhash(n, who, key, weigh(times), bands * rows), bands, rows)
                some = np.bincount(who, minlength=n) > 0
                ends = np.concatenate(([0], np.cumsum(some * bands))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[some].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], batch.column(1)[low:high], lists], names=["doc_id", "digest", "bands"])

    return given.mapInArrow(trimmed(run), "doc_id long, digest string, bands array<long>")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, keys, times`` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in pieces(batch.column(1)):
                who, key, times = weighted_shingles(data, offsets, shingle)
                ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(who, minlength=high - low)))).astype(np.int32))
                keys = pa.ListArray.from_arrays(ends, pa.array(key.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], keys, pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32)))], names=["doc_id", "keys", "times"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, keys array<long>, times array<int>")


def verify(pairs: DataFrame, sets: DataFrame, threshold: float, n_pairs: int) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("keys").alias("ka"), F.col("times").alias("ta"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("keys").alias("kb"), F.col("times").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = []
            for c in batch.columns[2:]:
                flat.append((c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)))
            keep = []
            for i in range(batch.num_rows):
                (ka, ta, kb, tb) = (v[o[i] : o[i + 1]] for o, v in flat)
                if min(len(ka), len(kb)) and probability_jaccard(ka, weigh(ta), kb, weigh(tb)) >= threshold - 1e-12:
                    keep.append(i)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], names=["a", "b"])

    both = left.join(bounded(pairs, n_pairs), "a").join(right, "b").select("a", "b", "ka", "ta", "kb", "tb")
    return both.mapInArrow(trimmed(run), "a long, b long")


def sketches(sets: DataFrame) -> DataFrame:
    """``rep, s0, s1, ...``: one bit of each of ``SKETCH`` more registers, 64 to a column."""
    columns = [f"s{i}" for i in range(SKETCH // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                keys, times = part.column(1), part.column(2)
                who = np.repeat(np.arange(part.num_rows), np.diff(keys.offsets.to_numpy()))
                signed = prob_minhash(part.num_rows, who, keys.flatten().to_numpy().astype(U), weigh(times.flatten().to_numpy()), SKETCH)
                bits = np.packbits((mix(signed) & U(1)).astype(np.uint8), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(len(columns)))], names=["rep", *columns])

    return sets.mapInArrow(trimmed(run), "rep long, " + ", ".join(f"{c} long" for c in columns))


def across(entries: DataFrame, sets: DataFrame, tested: DataFrame, n_tested: int, threshold: float) -> DataFrame:
    """The untested pairs (a, b) of one bucket and two labels that may reach the threshold.

    ``entries`` are ``bucket, rep, label, main`` of the mixed buckets, ``main`` being
    the bucket's largest label, whose documents needn't meet each other.  A pair
    comes up in its smallest common bucket only, and only if the bits of its sketches differ
    by no more than a pair at the threshold does with probability 1 - 1.4e-5, which
    is what the banding itself allows (a pair at 0.8 shares none of 32 bands of 6
    with probability 6e-5).
    """
    n_entries = entries.count()
    of_rep = materialise(entries.groupBy("rep").agg(F.array_sort(F.collect_list("bucket")).alias("buckets")), "openreps", n_entries, 100_000)
    n = of_rep.count()
    mine = sets.join(bounded(of_rep.select(F.col("rep").alias("doc_id")), n), "doc_id", "left_semi")
    bits = sketches(mine.coalesce(max(1, -(-n // 250))))
    rows = materialise(entries.join(materialise(bits.join(of_rep, "rep"), "sketches", n, 10_000), "rep"), "open", n_entries, 20_000)
    names = [c for c in rows.columns if c != "bucket"]
    x = rows.where("label <> main").select("bucket", *[F.col(c).alias(f"x_{c}") for c in names])
    y = rows.select("bucket", *[F.col(c).alias(f"y_{c}") for c in names])
    differ = sum((F.bit_count(F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}"))) for c in bits.columns[1:]), F.lit(0))
    rate = (1 - threshold) / 2
    most = SKETCH * rate + 4.2 * (SKETCH * rate * (1 - rate)) ** 0.5
    first = F.element_at(F.array_intersect("x_buckets", "y_buckets"), 1)
    # Two documents beside the largest label meet twice: once is enough.
    once = (F.col("y_label") == F.col("y_main")) | (F.col("x_rep") > F.col("y_rep"))
    pairs = x.join(y, "bucket").where((F.col("x_label") != F.col("y_label")) & once & (differ <= most) & (first == F.col("bucket")))
    fresh = pairs.select(F.greatest("x_rep", "y_rep").alias("a"), F.least("x_rep", "y_rep").alias("b")).distinct().join(bounded(tested, n_tested), ["a", "b"], "left_anti")
    return merged(fresh, n_entries, 5000)


def components(links: DataFrame, n_links: int | None = None) -> DataFrame:
    """``node, label``: the smallest node of each component, by alternating large and small stars.

    Every step is a grouping with partial aggregation and a join; the links end
    as a star around each smallest node.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links", n_links)
    while True:
        n = edges.count()
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = merged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), 2 * n)
        large = materialise(both.join(bounded(least, 2 * n), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "largestar", n)
        # small star: all edges point from u to smaller v
        low = merged(large.groupBy("u").agg(F.min("v").alias("m")), n)
        small = large.join(bounded(low, n), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = materialise(small, "smallstar", 2 * n)
        # Done when every node points to one other and none is pointed to and points itself.
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        bad = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out > 0 and into > 0)")
        if not bad.agg(F.count(F.lit(1))).first()[0]:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def text_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, int]:
    """Classes of the distinct texts of ``docs`` (``doc_id`` long, ``text``).

    Two written tables and the rows of the second: ``doc_id, digest, worded`` of
    every row, and ``digest, first_id, several, label, class_id`` of every distinct
    text with words: its smallest id, whether it has different ids (or ids and null),
    its class's number, and the smallest id of the class.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        found = materialise(signatures(docs, bands, rows, shingle), "signatures")
        n_docs = found.count()
        several = (F.min("doc_id") < F.max("doc_id")) | (F.count("doc_id").between(1, F.count(F.lit(1)) - 1))
        texts = found.where("size(bands) > 0").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.coalesce(several, F.lit(False)).alias("several"), F.min("bands").alias("bands"))
        # A number is fixed once it is written; it only has to be different for each text.
        copies = materialise(texts.withColumn("rep", F.monotonically_increasing_id()), "copies", n_docs, 40_000)
        n_texts = copies.count()
        labels, n_labels = _labels(docs, copies, n_texts, threshold, bands, shingle)
        placed = copies.select("digest", "first_id", "several", "rep").join(bounded(labels, n_labels), copies.rep == labels.node, "left").select("digest", "first_id", "several", F.coalesce("label", "rep").alias("label"), F.col("label").isNotNull().alias("linked"))
        placed = materialise(placed, "placed", n_texts, 400_000)
        names = placed.where("linked").groupBy("label").agg(F.min("first_id").alias("least"))
        classes = placed.join(bounded(names, n_labels), "label", "left").select("digest", "first_id", "several", "label", F.when(F.col("linked"), F.col("least")).otherwise(F.col("first_id")).alias("class_id"))
        classes = keep(materialise(classes, "classes", n_texts, 400_000))
        every = keep(materialise(found.select("doc_id", "digest", (F.size("bands") > 0).alias("worded")), "rows", n_docs, 400_000))
    return every, classes, n_texts


def _labels(docs: DataFrame, copies: DataFrame, n_texts: int, threshold: float, bands: int, shingle: int) -> tuple[DataFrame, int]:
    """``node, label`` of the numbered texts that are linked, and a bound of its rows."""
    n_entries = n_texts * bands
    entries = copies.select("rep", F.explode("bands").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.min("rep").alias("centre"), F.max("rep").alias("other")).where("centre <> other")
    buckets = materialise(buckets.select("bucket", "centre"), "buckets", n_entries, 1_000_000)
    hits = materialise(entries.join(bounded(buckets, buckets.count()), "bucket"), "hits", n_entries, 1_000_000)
    n_hits = hits.count()
    pairs = materialise(hits.where("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct(), "pairs", n_hits)
    n_pairs = pairs.count()
    wanted = materialise(copies.join(hits.select("rep").distinct(), "rep").select("rep", "digest", "first_id"), "wanted", n_hits)
    n_wanted = wanted.count()
    # One row of each wanted text: that of its smallest id, rows that repeat it merged before the exchange.
    own = docs.select("doc_id", "text", _digest().alias("digest"))
    of_first = own.join(bounded(wanted, n_wanted).withColumnRenamed("digest", "of"), (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    texts = of_first.groupBy(F.col("rep").alias("doc_id")).agg(F.min("text").alias("text"))
    sets = materialise(shingle_sets(texts, shingle), "sets", n_wanted, 1000)
    links = materialise(verify(pairs, sets, threshold, n_pairs), "verified", n_pairs, 4000)
    labels = materialise(components(links, n_pairs), "labels", n_pairs)

    # Buckets that still hold several components: the pairs across them that longer signatures let pass.
    placed = hits.join(bounded(labels, 2 * n_pairs), hits.rep == labels.node, "left").select("bucket", "rep", F.coalesce("label", "rep").alias("label"))
    placed = materialise(placed, "placed", n_hits, 400_000)
    sizes = placed.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("k")).where("k > 1").select("bucket", "main")
    mixed = materialise(mixed, "mixed", n_hits, 400_000)
    open_ = materialise(placed.join(bounded(mixed, mixed.count()), "bucket"), "open", n_hits, 400_000)
    crossing = materialise(across(open_, sets, pairs, n_pairs, threshold), "across")
    n_crossing = crossing.count()
    more = materialise(verify(crossing, sets, threshold, n_crossing), "reverified", n_crossing, 4000)
    n_more = more.count()
    if n_more:
        # Only the labels that the new links join are numbered again.
        name = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        joined = more.join(name[0], "a", "left").join(name[1], "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        renamed = materialise(components(joined, n_more), "merged", 2 * n_more).select(F.col("node").alias("old"), F.col("label").alias("new"))
        renamed = bounded(renamed, 2 * n_more)
        kept = labels.join(renamed, labels.label == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label"))
        fresh = renamed.join(labels.select(F.col("node").alias("old")), "old", "left_anti").select(F.col("old").alias("node"), F.col("new").alias("label"))
        labels = materialise(kept.unionByName(fresh), "relabelled", 2 * (n_pairs + n_more))
    return labels, 2 * (n_pairs + n_more)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id`` (the class's smallest id)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    every, classes, n_texts = text_classes(docs, threshold, bands, rows, shingle)
    named = every.where("worded").select("doc_id", "digest").join(bounded(classes.select("digest", "class_id"), n_texts), "digest")
    plain = every.where("not worded").select("doc_id", F.col("doc_id").alias("class_id"))
    return named.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id")).unionByName(plain)


def first_of_each(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """One document of each class: the one with the smallest id (null ids last), then the smallest text digest.

    Documents without words all stay.  Rows that repeat an id and its text are one
    document.  Only texts that have a class with others, or several ids, are looked
    up; all other documents pass where they lie.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every, classes, n_texts = text_classes(slim, threshold, bands, rows, shingle)
    spark = docs.sparkSession
    with scratch(spark) as keep:
        best = classes.groupBy("label").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "digest")).alias("f"), F.count(F.lit(1)).alias("texts"))
        crowd = classes.join(best, "label").where("texts > 1 or several").select(F.col("digest").alias("__of"), F.col("first_id").alias("__first"), (F.col("digest") == F.col("f.digest")).alias("__stays"))
        crowd = keep(materialise(crowd, "crowd", n_texts, 400_000))
        twice = keep(materialise(every.groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__same")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "twice", n_texts, 400_000))
    id_, names = F.col("doc_id").cast("long"), docs.columns
    own = docs.withColumn("__digest", _digest())
    placed = own.join(bounded(crowd, crowd.count()), F.col("__digest") == F.col("__of"), "left")
    stay = placed.where(F.col("__of").isNull() | (F.col("__stays") & id_.eqNullSafe(F.col("__first")))).select(*names, "__digest")
    n_twice = twice.count()
    if not n_twice:
        return stay.select(names)
    repeated = (F.col("__digest") == F.col("__same")) & id_.eqNullSafe(F.col("__id"))
    alone = stay.join(bounded(twice, n_twice), repeated, "left_anti").select(names)
    again = stay.join(bounded(twice, n_twice), repeated, "left_semi").withColumn("__null", F.col("text").isNull()).dropDuplicates(["doc_id", "__digest", "__null"])
    return alone.unionByName(again.select(names))
