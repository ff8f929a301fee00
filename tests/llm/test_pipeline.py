import resource
from collections import Counter

import corpus_pipeline
from ratingloom import shipping
from ratingloom.llm import decontam, registry
from ratingloom.llm.common import materialise

from ..conftest import SF


def test_every_operator_is_registered():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)


def test_sql_equals_spark(spark):
    import duckdb

    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, SF)
        columns = sorted(df.columns)
        ours = Counter(map(tuple, df.select(*columns).collect()))
        theirs = Counter(duck.sql(sql).select(", ".join(columns)).fetchall())
        assert ours == theirs, name


def test_stages_keep_clean_documents_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kinds = docs.dtypes
    extra = [(90001, None, "en", "src1", 0), (90002, "", "en", "src1", 0), (90003, "12 34 !!", "en", "src1", 8), (90004, 'the of and to in is it token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" on the hill', "en", "src2", 70)]
    start = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, seen = start, {}
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, before, SF), name)
        if name != "mix":
            assert after.dtypes == kinds
            assert ids(after) <= ids(before)
        seen[name] = (before, after)
        before = after
    assert ids(seen["language"][0]) - ids(seen["language"][1]) == {90001, 90002, 90003}
    gone, kept = seen["near_dedup"]
    groups = corpus_pipeline.neardup.near_duplicates(gone)
    assert ids(kept) == {r.class_id for r in groups.collect()} and kept.count() == len(ids(kept))
    leaks = decontam.contaminated(seen["decontaminate"][0], spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(seen["decontaminate"][0]) - ids(seen["decontaminate"][1]) == ids(leaks) != set()
    masked = {r.doc_id: r for r in seen["secrets"][1].collect()}
    assert masked[90004].text.count("[SECRET]") == 1 and masked[90004].n_chars == len(masked[90004].text)
    assert ids(seen["secrets"][0]) == set(masked)
    assert {"copy", "mix_key"} <= set(seen["mix"][1].columns)


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), "empty")
    assert docs.count() == 0


def test_near_dedup_tells_the_texts_of_an_id_apart(spark):
    text = lambda name, n=40: " ".join(f"{name}{k}" for k in range(n))
    rows = [(1, text("a")), (1, text("b")), (1, text("a")), (2, text("b") + " more"), (3, text("c")), (None, text("c")), (None, text("d")), (None, text("d")), (None, text("e")), (4, text("f")), (4, " "), (4, " "), (5, None), (5, "")]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, df, SF).collect())
    assert got == Counter([(1, text("a")), (1, text("b")), (3, text("c")), (None, text("d")), (None, text("e")), (4, text("f")), (4, " "), (5, None), (5, "")])


def _resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * resource.getpagesize()


def test_a_worker_gives_freed_memory_back_after_its_last_batch():
    """Blocks freed between others that stay would be held by the allocator."""
    stay = []

    def holes(batches):
        blocks = [bytes(60_000) for _ in range(4000)]
        stay.extend(blocks[::100])
        del blocks
        yield from batches

    list(holes(iter([])))
    held = _resident()
    assert list(shipping.trimmed(holes)(iter([1, 2]))) == [1, 2]
    assert _resident() < held - 100_000_000


def test_every_stage_with_python_gives_memory_back_and_gets_small_batches(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, real = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **k: (seen.append(f.__qualname__), real(self, f, *a, **k))[1])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen.clear()
        stage(spark, docs, SF)
        assert seen and set(seen) == {"trimmed.<locals>.whole"}, name
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 2 << 20
