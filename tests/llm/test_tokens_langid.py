import random

import pytest
from pyspark.sql import functions as F

from ratingloom.llm import langid, tokens

from ..conftest import SF

PIECE = tokens.tokenizer_path("piece_bpe_32k.model")


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_overlap_resynchronisation_is_exact(name):
    model = tokens.load(tokens.tokenizer_path(name))
    rng = random.Random(1)
    texts = ["a" * 9000, " " * 9000, "ab " * 3000, "\n" * 9000, "é ü" * 3000, "x  y   " * 1500, "".join(rng.choice("ab \né,😀\t") for _ in range(9000)), "word " * 2000 + "z" * 5000]
    for t in texts:
        assert tokens.count_huge(model, t, 1500, 64)[0] == model.counts([t])[0]


def test_token_rows(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, "", "x"), (3, None, "x"), (None, "é", "x"), (4, "<s> </s>", "x"), (5, "wörd " * 40000, "x")], "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_bytes): r.n_tokens for r in tokens.count_tokens(df, PIECE).collect()}
    model = tokens.load(PIECE)
    assert got == {(1, 3): 2, (2, 0): 0, (3, 0): 0, (None, 2): model.counts(["é"])[0], (4, 8): model.counts(["<s> </s>"])[0], (5, 240000): model.counts(["wörd " * 40000])[0]}
    assert tokens.count_tokens(df.limit(0), PIECE).count() == 0


def test_texts_of_the_tables_are_spliced_and_equal_the_library(spark):
    import sentencepiece

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = {r.doc_id: len(model.encode(r.text)) for r in docs}
    df = spark.createDataFrame([(r.doc_id, r.text) for r in docs], "doc_id long, text string")
    for chunk, overlap, least in ((tokens.CHUNK_CHARS, tokens.OVERLAP_CHARS, 40), (1_000, 64, 500)):
        got = tokens.count_tokens(df, PIECE, chunk=chunk, overlap=overlap).collect()
        assert {r.doc_id: r.n_tokens for r in got} == want
        assert sum(r.n_chunks > 1 for r in got) >= least


def test_out_of_place_by_hand():
    profiles = langid.Profiles({"x": langid.ranked(*langid.gram_counts("aaa aab"), 9).tolist(), "y": langid.ranked(*langid.gram_counts("zzz zzy"), 9).tolist()}, 9)
    own = langid.ranked(*langid.gram_counts("aaa aab"), 9)
    assert profiles.distances("aaa aab")[0] == 0 and profiles.predict("zzz")[0] == "y"
    other = profiles.rank[1][[list(profiles.keys).index(k) for k in own.tolist()]]
    want = sum(9 if o < 0 else min(9, abs(o - i)) for i, o in enumerate(other)) / (9 * len(own))
    assert profiles.distances("aaa aab")[1] == pytest.approx(want)


def test_gram_keys_are_exact():
    keys, counts = langid.gram_counts("Äb 1 b")
    edge, a, b = ord("_"), ord("ä"), ord("b")
    want = {a: 1, b: 2, edge << 21 | a: 1, a << 21 | b: 1, b << 21 | edge: 2, edge << 21 | b: 1, (edge << 42) | (a << 21) | b: 1, (a << 42) | (b << 21) | edge: 1, (edge << 42) | (b << 21) | edge: 1}
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want


def test_letters_and_marks():
    words = lambda t: "".join(map(chr, langid._words(t)))
    assert words("½ ² Ⅷ ① 12 _!") == words("") == words("\u0301 \u093f") == ""
    assert words(" Ab-c_d 1x ") == "_ab_c_d_x_"
    assert words("हिन्दी की") == "_हिन्दी_की_" and words("e\u0301t\u00e9") == "_e\u0301t\u00e9_"
    profiles = langid.Profiles({"x": [ord("a")]}, 3)
    assert profiles.predict("½ ² Ⅷ ①") == ("und", 0.0)


def test_learned_languages_are_bounded(spark):
    rows = [(i, f"l{i % 9}" if i % 3 else "big", f"wörter und {i}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumns({"share": F.lit("clash"), "learned": F.lit(1)})
    assert langid.learn(df, F.lit(True), languages=3).names == ["big", "l1", "l2"]


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.col("doc_id") % 4 == 2
    profiles = langid.learn(docs, ~held)
    got = langid.predict(docs.where(held), profiles)
    assert got.where("lang = lang_pred").count() / got.count() > 0.95
    odd = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "12 !?", "q"), (3, "12 !?", "q"), (None, "the of and", "q")], "doc_id long, text string, score string")
    rows = langid.predict(odd, profiles).collect()
    assert [r.lang_pred for r in rows] == ["und"] * 4 + ["en"] and all(0 <= r.score <= 1 for r in rows)
    assert langid.reject_unknown(odd, profiles).count() == 1
    nothing = langid.learn(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}
    assert langid.predict(odd.limit(0), profiles).count() == 0
