"""Every registered query as it is registered: contract columns, types, splits and digests, on whole small tables."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingloom.llm import html, registry, secrets

from ..conftest import SF


def rows(spark, name):
    df = registry.queries()[name](spark, SF)
    return dict(df.dtypes), df.collect()


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def has(kinds, wanted):
    assert {c: kinds.get(c) for c in wanted} == wanted


def test_op1(spark):
    kinds, got = rows(spark, "op1_forest_secrets")
    has(kinds, {"doc_id": "bigint", "start": "bigint", "end": "bigint", "rule": "string", "score": "double", "is_secret": "boolean", "fingerprint": "string"})
    texts = {r.doc_id: r.text for r in table(spark, "documents")}
    assert got and all(hashlib.sha256(texts[r.doc_id][r.start : r.end].encode()).hexdigest() == r.fingerprint for r in got)
    assert {(r.doc_id, r.start, r.end) for r in got} == {(i, a, b) for i, t in texts.items() for a, b, _ in secrets.candidates(t or "")}


def test_op2(spark):
    kinds, got = rows(spark, "op2_additive_quantisation")
    has(kinds, {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"})
    x = {r.vec_id: np.array(r.embedding, float) for r in table(spark, "embeddings") if r.embedding is not None and any(r.embedding)}
    by: dict = {}
    for r in got:
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), abs=1e-12)
        by.setdefault(r.query_id, {})[r.rank] = (-r.score, r.vec_id)
    assert sorted(by) == sorted(i for i in x if i % 20 == 0)
    hits = []
    for q, found in by.items():
        assert sorted(found) == list(range(1, 21)) and [found[k] for k in sorted(found)] == sorted(found.values())
        best = sorted((-float(x[q] @ v), i) for i, v in x.items() if i != q)[:20]
        hits.append(len({i for _, i in best} & {i for _, i in found.values()}) / 20)
    assert np.mean(hits) >= 0.95


def test_op3(spark):
    kinds, got = rows(spark, "op3_prob_minhash")
    has(kinds, {"doc_id": "bigint", "class_id": "bigint"})
    docs = {r.doc_id: r.text for r in table(spark, "documents")}
    classes = {r.doc_id: r.class_id for r in got}
    assert len(got) == len(docs) and set(classes) == set(docs)
    sets = {i: {tuple((t or "").split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))} for i, t in docs.items()}
    ids = sorted(docs)
    for n, i in enumerate(ids):  # every link is inside a class
        for j in ids[:n]:
            if len(sets[i] & sets[j]) > 0.8 * len(sets[i] | sets[j]):
                assert classes[i] == classes[j], (i, j)
    assert all(c <= i and classes[c] == c for i, c in classes.items())


def test_op4(spark):
    kinds, got = rows(spark, "op4_seed_align")
    has(kinds, {"doc_id": "bigint", "item_id": "bigint", "score": "double", "start_byte": "bigint", "end_byte": "bigint", "n_words": "int"})
    docs, items = ({r[0]: r.text for r in table(spark, t)} for t in ("documents", "benchmark"))
    found = {(r.doc_id, r.item_id): r for r in got}
    for i, t in items.items():
        for d, text in docs.items():
            if t in text:
                r = found[d, i]
                assert r.score == 1.0 and len(text.encode()[r.start_byte : r.end_byte].split()) == r.n_words == len(t.split())


@pytest.mark.parametrize("name, remainder, modulus", [("op5_random_indexing", 1, 3), ("op6_rank_order", 2, 4)])
def test_op5_op6(spark, name, remainder, modulus):
    kinds, got = rows(spark, name)
    has(kinds, {"doc_id": "bigint", "held_out": "boolean", "score": "double"} | ({"predicted": "int"} if modulus == 3 else {"lang_pred": "string"}))
    docs = {r.doc_id: r for r in table(spark, "documents")}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder) and 0 <= r.score <= 1 for r in got)
    if modulus == 3:
        truth = {r.doc_id: r.quality for r in table(spark, "labels")}
        assert all(r.predicted == int(r.score >= 0.5) for r in got)
        right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and truth.get(r.doc_id) is not None]
    else:
        right = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out and docs[r.doc_id].lang]
    assert len(right) > 20 and np.mean(right) > 0.93


def test_op7(spark):
    kinds, got = rows(spark, "op7_chat_windows")
    has(kinds, {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"})
    by: dict = {-1: [(0, "user", registry.CONTROL), (1, "assistant", registry.CONTROL)]}
    for r in table(spark, "conversations"):
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    assert {r.conv_id for r in got} == set(by)
    for r in got:
        turns = sorted(by[r.conv_id])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        said = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_op8(spark):
    kinds, got = rows(spark, "op8_template_text")
    has(kinds, {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"})
    pages = {r.page_id: r for r in table(spark, "pages")}
    assert sorted(r.page_id for r in got) == sorted(pages) and all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in got)
    # each page by itself, where only tags can tell the text from its frame
    assert sum(r.text == html.extract([pages[r.page_id].html])[0][0] for r in got) >= 0.95 * len(got)


def test_op9(spark):
    import sentencepiece

    from ratingloom.llm.tokens import tokenizer_path

    kinds, got = rows(spark, "op9_token_counts")
    has(kinds, {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"})
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    docs = {r.doc_id: r.text or "" for r in table(spark, "documents")}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == {i: (len(t.encode()), len(model.encode(t))) for i, t in docs.items()}
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)


def test_op10(spark):
    kinds, got = rows(spark, "op10_poisson_mix")
    has(kinds, {"doc_id": "bigint", "source": "string", "copy": "int", "mix_key": "string"})
    docs = table(spark, "documents")
    sizes = {s: sum(r.source == s for r in docs) for s in {r.source for r in docs}}
    total = sum(n**0.7 for n in sizes.values())
    for s, n in sizes.items():  # within four deviations of the target
        want = len(docs) * n**0.7 / total
        assert abs(sum(r.source == s for r in got) - want) < 4 * want**0.5 + 1


def test_queries_take_any_extra_columns(spark, tmp_path):
    """Whole queries on tables with columns of clashing names and nulls."""
    extra = {c: F.lit("clash") for c in ("score", "rank", "part", "digest", "rep", "label", "bands", "copy", "window", "host", "share", "n")}
    for name in ("documents", "labels", "benchmark", "pages", "conversations", "embeddings"):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        key = df.columns[0]
        some = df.orderBy(key).limit(60)
        nothing = spark.createDataFrame([tuple(None for _ in df.columns)], df.schema)
        some.unionByName(nothing).unionByName(some.limit(3)).withColumns(extra).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in registry.queries().items():
        assert query(spark, str(tmp_path)).collect() is not None, name
