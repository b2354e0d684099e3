"""What a Python worker holds while it signs, compares and tokenizes texts, and tables that start no worker at all."""

import tracemalloc

import numpy as np
import pandas as pd

from alphaloom.llm import bpe, near_dedup, packing, quality_rules, storage, wordhash
from alphaloom.llm.storage import BATCH_ROWS, VECTOR_ROWS, settle, small_table

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_VECTOR = "spark.sql.parquet.columnarReaderBatchSize"


def texts(n, words=400, seed=5):
    """Texts of which hardly a word occurs twice."""
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    return [" ".join("".join(letters[rng.integers(0, 26, 7)]) for _ in range(words)) for _ in range(n)]


def peak(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_kept_pretokens_are_bounded_and_ids_are_the_library_s():
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    v, own = bpe.Vocabulary(path), Tokenizer.from_file(path)
    rows = texts(500)
    got = []
    for x, y in bpe.blocks(rows):
        ids, sizes = v.encode(rows[x:y])
        got += [a.tolist() for a in np.split(ids, np.cumsum(sizes)[:-1])]
        assert v.count(rows[x:y]).tolist() == sizes.tolist()
    assert got == [e.ids for e in own.encode_batch(rows, add_special_tokens=False)]
    assert len(v.ids) <= bpe.CACHE_ENTRIES + bpe.BLOCK_CHARS // 4 < 150_000


def test_blocks_are_small_beside_what_a_batch_holds():
    rows = texts(700)  # 2.2 MB
    v = bpe.Vocabulary(bpe.default_vocabulary())
    v.encode(rows[:1])
    batch = pd.DataFrame({"_id": range(len(rows)), "_t": rows})
    pairs = pd.DataFrame({"a": range(len(rows)), "b": range(len(rows)), "ta": rows, "tb": rows})
    assert peak(lambda: [v.encode(rows[x:y]) for x, y in bpe.blocks(rows)]) < 60
    assert peak(lambda: list(near_dedup._sign(iter([batch])))) < 100
    wordhash._powers.clear()
    assert peak(lambda: list(near_dedup._similar(iter([pairs])))) < 40


def test_powers_of_a_long_text_are_not_kept():
    wordhash._powers.clear()
    few = wordhash.powers(1000)
    many = wordhash.powers(wordhash.BLOCK_BYTES + 1_000)
    assert [len(x) for x in many] == [wordhash.BLOCK_BYTES + 1_000] * 2 and all((x[:1000] == y).all() for x, y in zip(many, few, strict=True))
    assert sum(len(x) for x in wordhash._powers) <= 4096
    assert (many[0] * many[1] == 1).all()
    assert [len(x) for x in wordhash.powers(1025)] == [1025] * 2


def test_settled_tables_reach_python_in_small_batches(spark):
    before = spark.conf.get(_BATCH)
    df = spark.range(0, 5 * BATCH_ROWS + 1, 1, 1).mapInPandas(lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches), "n BIGINT")
    sizes = [r[0] for r in settle(df).collect()]
    assert sum(sizes) == 5 * BATCH_ROWS + 1 and max(sizes) <= BATCH_ROWS
    assert spark.conf.get(_BATCH) == before
    spark.conf.set(_BATCH, "7")
    try:
        assert max(r[0] for r in settle(df).collect()) <= 7
    finally:
        spark.conf.set(_BATCH, before)


def test_tables_from_the_driver_start_no_python_workers(spark):
    import pyarrow as pa

    table = small_table(spark, {"a": (pa.int64(), [2, None]), "b": (pa.float64(), [0.5, 1.0])})
    assert table.dtypes == [("a", "bigint"), ("b", "double")] and [tuple(r) for r in table.collect()] == [(2, 0.5), (None, 1.0)]
    assert small_table(spark, {"a": (pa.int32(), [])}).collect() == []
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts(20, 30))], "doc_id long, text string")
    for out in (quality_rules.quality_verdicts(docs), packing.pack_documents(docs)):
        assert out.count() == 20
        assert "ExistingRDD" not in out._jdf.queryExecution().executedPlan().toString()


def test_settled_tables_are_read_in_small_vectors(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(storage, "stage", lambda df: seen.append(int(spark.conf.get(_VECTOR))))
    before = spark.conf.get(_VECTOR)
    settle(spark.range(1))
    assert spark.conf.get(_VECTOR) == before
    spark.conf.set(_VECTOR, "7")
    try:
        settle(spark.range(1))
        assert spark.conf.get(_VECTOR) == "7"
    finally:
        spark.conf.set(_VECTOR, before)
    assert seen == [VECTOR_ROWS, 7] and VECTOR_ROWS < int(before)


def test_texts_that_no_pair_needs_are_not_sorted(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i // 2, i // 2 + 40))) for i in range(400)]  # ids 2k and 2k + 1 are copies
    rows += [(10, "another text of that id"), (11, rows[10][1])]
    own = spark.createDataFrame(rows, "_id long, _t string")
    pairs = spark.createDataFrame([(10, 11), (20, 21), (20, 300), (30, 31), (30, 999)], "a long, b long")
    links = near_dedup.similar_pairs(pairs, own)
    assert sorted(tuple(r) for r in links.collect()) == [(10, 11), (10, 11), (20, 21), (30, 31)]
    plan = links._jdf.queryExecution().sparkPlan().toString()  # before exchanges and sorts are put in
    assert plan.count("ShuffledHashJoin [_id") == 2 and plan.count("LeftSemi, BuildRight") == 2
    alone = near_dedup.texts_of(own, pairs.selectExpr("a AS _id"))
    assert sorted(r[0] for r in alone.collect()) == [10, 10, 20, 30]
    assert "Sort [" not in alone._jdf.queryExecution().executedPlan().toString()
