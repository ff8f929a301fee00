import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ratingloom.llm import common, decontam, neardup
from ratingloom.llm.wordhash import Words, pieces

from ..conftest import SF


def shingles(text, k=5):
    w = text.split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def classes(texts):
    """Brute force over all pairs: the smallest id of each component of Jaccard 0.8 or more."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in texts if sets[i])
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def test_words_and_grams():
    texts = ["a b  c", "", None, "x a b c", "one", "\n tab\tsep \n"]
    for low, high, data, offsets in pieces(pa.array(texts)):
        w = Words(data, offsets)
        assert np.diff(w.at).tolist() == [len((t or "").split()) for t in texts[low:high]]
        g, owner, _ = w.grams(3)
        assert owner.tolist() == [0, 3, 3, 4, 5] and g[0] == g[2] != g[1]


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(0, 2**48, 300, dtype=np.uint64))
    a, b = keys[:220], keys[60:]
    wa, wb = rng.integers(1, 5, len(a)).astype(float), rng.integers(1, 5, len(b)).astype(float)
    da, db = dict(zip(a.tolist(), wa, strict=True)), dict(zip(b.tolist(), wb, strict=True))
    exact = sum(1 / sum(max(da.get(k, 0) / da[i], db.get(k, 0) / db[i]) for k in set(da) | set(db)) for i in set(da) & set(db))
    assert neardup.probability_jaccard(a, wa, b, wb) == pytest.approx(exact)
    s = neardup.prob_minhash(2, np.repeat([0, 1], [len(a), len(b)]), np.concatenate((a, b)), np.concatenate((wa, wb)), 8192)
    assert abs((s[0] == s[1]).mean() - exact) < 0.03


def test_signature_does_not_depend_on_the_batch():
    texts = pa.array(["a b c d e f g", "one two", "x y z " * 50])
    both = [neardup.prob_minhash(h - lo, *((w, k, neardup.weigh(t))), 64) for lo, h, d, o in pieces(texts) for w, k, t in [neardup.weighted_shingles(d, o)]][0]
    for i in range(3):
        for _, _, d, o in pieces(texts[i : i + 1]):
            w, k, t = neardup.weighted_shingles(d, o)
            assert (neardup.prob_minhash(1, w, k, neardup.weigh(t), 64)[0] == both[i]).all()


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_classes_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for size, edits in ((40, 6), (5, 2), (1, 0), (1, 0), (12, 4)):
        texts += family(rng, [rng.choice(words) for _ in range(120)], size, edits)
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(60)) for _ in range(30)]
    texts += ["short text", "short text", "short texts", texts[0], texts[0], "rep " * 40, "rep " * 40]
    rng.shuffle(texts)
    df = spark.createDataFrame([(i * 3, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, bands string")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert got == classes({i * 3: t for i, t in enumerate(texts)})


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (202, 201)]
    rng.shuffle(links)
    got = {r.node: r.label for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200, 202: 200}


def test_neardup_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a b"), (5, "a b"), (5, "a b"), (None, "a b"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.class_id) for r in neardup.near_duplicates(df).collect())
    assert got == {(1, 1): 1, (2, 2): 1, (3, 3): 1, (4, 4): 1, (5, 4): 2, (None, None): 2}
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_the_texts_of_a_repeated_id_have_their_own_classes(spark):
    text = lambda name, n=40: " ".join(f"{name}{k}" for k in range(n))
    rows = [(1, text("a")), (1, text("b")), (2, text("b") + " more"), (None, text("b") + " more words"), (3, text("c")), (None, text("c")), (3, text("c"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rep": F.lit("clash"), "digest": F.lit(1), "label": F.lit(2)})
    every, classes, _ = neardup.text_classes(df.select("doc_id", "text"))
    named = every.join(classes, "digest").select("doc_id", "class_id", "label").collect()
    assert len({r.label for r in named}) == 3 and len({r.label for r in named if r.class_id == 1}) == 2
    got = Counter((r.doc_id, r.class_id) for r in neardup.near_duplicates(df).collect())
    assert got == {(1, 1): 2, (2, 1): 1, (None, None): 2, (3, 3): 2}
    kept = Counter((r.doc_id, r.text, r.label) for r in neardup.first_of_each(df).collect())
    assert kept == {(1, text("a"), 2): 1, (1, text("b"), 2): 1, (3, text("c"), 2): 1}


def test_wide_broadcasts_are_joins_beyond_their_bound(spark, monkeypatch):
    rng = random.Random(6)
    texts = family(rng, [f"w{rng.randrange(300)}" for _ in range(80)], 30, 4) + ["a b c d e f"] * 12 + [f"lone {i} text" for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = classes(dict(enumerate(texts)))
    monkeypatch.setattr(common, "MAX_BROADCAST_ROWS", 0)
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()} == want
    assert sorted(r.doc_id for r in neardup.first_of_each(df).collect()) == sorted(set(want.values()))


def test_small_tables_are_written_by_few_tasks(spark, monkeypatch):
    """A task that writes starts processes, so no table of a few rows is dealt over all shuffle partitions."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    texts = [t for _ in range(4) for t in family(rng, [rng.choice(words) for _ in range(120)], 30, 12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hold = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in hold}
    for key, value in hold.items():
        spark.conf.set(key, value)
    files, real = {}, neardup.materialise

    def counted(df, label, *a):
        out = real(df, label, *a)
        files.setdefault(label, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(neardup, "materialise", counted)
    try:
        got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert got == classes(dict(enumerate(texts)))
    assert {"open", "across", "reverified"} <= set(files)
    files.pop("signatures")  # as many as the input's partitions
    assert max(max(n) for n in files.values()) <= 3
    assert len(files["smallstar"]) == len(files["largestar"]) and not {"large", "small"} & set(files)


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 14)), rng.integers(0, 4, rng.integers(1, 18))
        score, start, end = decontam.align(a, b)
        assert score == smith_waterman(a, b) and (score == 0 or smith_waterman(a, b[start:end]) == score)


def test_folding_keeps_places():
    raw = "ÀÉ×Öx, (Ab)-c!".encode()
    assert decontam.fold(np.frombuffer(raw, np.uint8)).tobytes().decode() == "àé×öx   ab  c "


def test_planted_passages_are_found_and_others_left(spark):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(3000)]
    items = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(20)] + [None, "", "lone"]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    docs, want = [], set()
    for i in range(20):
        edited = [x if rng.random() > 0.1 else rng.choice(words) for x in items[i].split()]
        del edited[rng.randrange(len(edited))]
        docs.append((i, " ".join(text(100) + [w.upper() + "," for w in edited] + text(300))))
        want.add((i, i))
    docs += [(100 + i, " ".join(text(400))) for i in range(40)] + [(200, None), (201, ""), (None, items[0]), (202, "a lone word"), (203, "Lone!"), (0, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontam.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want | {(None, 0), (203, 22)}
    assert len([r for r in got if r.doc_id == 0]) == 2
    for r in got:
        if r.score == 1.0 and r.doc_id is None:
            assert items[0].encode()[r.start_byte : r.end_byte] == items[0].encode() and r.n_words == 40
    small = {(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench, block_bytes=900).collect()}
    assert small == {(r.doc_id, r.item_id) for r in got}
    kept = {r.doc_id for r in decontam.clean_documents(df, bench).collect()}
    assert kept == {100 + i for i in range(40)} | {200, 201, 202}
    assert decontam.contaminated(df, bench.limit(0)).count() == 0 and decontam.contaminated(df.limit(0), bench).count() == 0


def test_a_lone_edited_copy_of_each_item_is_found(spark):
    rng = random.Random(30)
    words = [f"v{i}" for i in range(3000)]
    items = [[rng.choice(words) for _ in range(rng.randrange(15, 60))] for _ in range(60)]
    edited = [[w if rng.random() >= 0.3 else rng.choice(words) for w in item] for item in items]
    alignable = {i for i, (a, b) in enumerate(zip(items, edited, strict=True)) if smith_waterman(a, b) >= 0.35 * 2 * len(a) and any(a[k : k + 3] == b[k : k + 3] for k in range(len(a) - 2))}
    assert len(alignable) > 50
    pad = lambda: [rng.choice(words) for _ in range(100)]
    df = spark.createDataFrame([(i, " ".join(pad() + e + pad())) for i, e in enumerate(edited)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(item)) for i, item in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench).collect()}
    assert {(i, i) for i in alignable} <= got and all(d == i for d, i in got)


def test_frequencies_of_all_items_in_one_pass(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"v{i}" for i in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))) for _ in range(80)] + [None, ""]
    items = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(9)] + ["not there at all", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "gram long, text string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")

    def grams(texts):
        for _, _, data, offsets in pieces(pa.array(texts, pa.string())):
            found, who, _ = Words(decontam.fold(data), offsets).grams(3)
            return [set(found[who == i].view(np.int64).tolist()) for i in range(len(texts))]

    wanted = set().union(*grams(items))
    want = {g: n for g, n in Counter(g for own in grams(texts) for g in own).items() if g in wanted}
    for held in (2_000_000, 5):
        monkeypatch.setattr(decontam, "HELD", held)
        assert want and {r.gram: r.n for r in decontam.occurring(df, bench.where("text is not null"), 500).collect()} == want


def test_clashing_columns_do_no_harm(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (2, "other words")], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("item_id", "score", "n_words", "part", "gram")})
    bench = spark.createDataFrame([(7, text)], "item_id long, text string").withColumns({c: F.lit("clash") for c in ("doc_id", "score", "part", "gram", "n")})
    assert [(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench).collect()] == [(1, 7)]
    kept = decontam.clean_documents(df, bench).collect()
    assert [tuple(r) for r in kept] == [(2, "other words", *["clash"] * 5)] and decontam.clean_documents(df, bench).columns == df.columns


def test_a_verbatim_part_of_a_long_item_is_found():
    rng = random.Random(13)
    words = [f"v{i}" for i in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [text(59), text(200), text(200)]
    parts = [items[0][30:50], items[1][70:130], items[2][100:112]]
    docs = pa.array([" ".join(text(80) + part + text(80)) for part in parts])
    listed = decontam.Items([0, 1, 2], [" ".join(item) for item in items])
    got = {(row, i): (score, n) for row, i, score, _, _, n in decontam.matches(listed, docs, decontam.MIN_SCORE)}
    assert got == {(0, 0): (pytest.approx(20 / 59), 20), (1, 1): (pytest.approx(0.3), 60)}


def test_verbatim_passages_of_the_tables(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: r.text for r in bench.collect()}
    want = {(d.doc_id, i) for d in docs.collect() for i, t in items.items() if t in d.text}
    assert want <= {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
