"""Ids of 64 bits with a null among them keep their values in every operator."""

import pandas as pd
import pytest

from alphaloom.llm import collocations, decontaminate, hmm, near_dedup, ns_clusters, packing, simhash, substring_dedup, token_counts, toxicity, warc_zip
from pyspark.sql import functions as F
from tests.llm.conftest import SHARED

BIG = 2**60
IDS = [BIG + 1, BIG + 3, None, 7, BIG + 5]
TEXTS = [SHARED, "before " + SHARED, SHARED, "something else", None]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(zip(IDS, TEXTS)), "doc_id long, text string").coalesce(1)


def ids(df, column="doc_id"):
    return sorted((r[0] or 0) for r in df.select(column).collect())


WANT = sorted(i or 0 for i in IDS)


def test_op1_ids(docs):
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeated(docs).collect()}
    assert got == {BIG + 1: 0, BIG + 3: 40, None: 0, 7: 0, BIG + 5: 0}


def test_op1_without_a_repeated_window(spark):
    """Documents that share phrases of six words but no window of thirteen."""
    phrases = [" ".join(f"p{k}w{i}" for i in range(6)) for k in range(20)]
    rows = [(i, " ".join(f"{phrases[(i * 7 + j) % 20]} own{i}x{j}" for j in range(8))) for i in range(60)]
    got = substring_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 60 and all(r.n_removed == 0 for r in got)


def test_op3_ids(docs):
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {BIG + 1: BIG + 1, BIG + 3: BIG + 1, None: None, 7: 7, BIG + 5: BIG + 5}


def test_op4_ids(spark):
    rows = [(BIG + 1, "u", "same"), (BIG + 3, "u", "same"), (None, "u", "same"), (None, None, None), (7, "v", "other")]
    got = {(r.page_id, r.payload_bytes): (r.record_type, r.refers_to) for r in warc_zip.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {
        (BIG + 1, 4): ("response", None), (BIG + 3, 4): ("revisit", BIG + 1), (None, 4): ("revisit", BIG + 1), (None, 0): ("response", None), (7, 5): ("response", None),
    }


def test_ids_pass_through_scores_and_counts(spark, docs):
    model = toxicity.fit(["bad zorg", "fine words here"], pd.Series([1.0, 0.0]).to_numpy(), pd.Series([1.0, 1.0]).to_numpy())
    assert ids(toxicity.score(docs, model)) == WANT
    assert ids(token_counts.token_counts(docs)) == WANT
    assert ids(packing.pack_documents(docs)) == WANT
    assert ids(hmm.score(docs, F.lit(True))) == WANT


def test_text_ids_pass_through(spark):
    docs = spark.createDataFrame([("a-1", SHARED), (None, "x y"), ("b", None)], "doc_id string, text string")
    want = ["", "a-1", "b"]
    for out in (token_counts.token_counts(docs), packing.pack_documents(docs), hmm.score(docs, F.lit(True)), simhash.near_duplicates(docs)):
        assert sorted(r[0] or "" for r in out.select("doc_id").collect()) == want


def test_op9_rows_without_id(spark, docs):
    bench = spark.createDataFrame([("i", SHARED)], "item_id string, text string")
    got = {r.doc_id: r.n_hit for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {BIG + 1: 40, BIG + 3: 40, None: 40, 7: 0, BIG + 5: 0}


def test_newer_operators_ids(spark, docs):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got[None] == got[BIG + 1] == BIG + 1 and got[BIG + 5] == BIG + 5 and len(got) == 5
    rows = [(i, [float(k)] * 4) for k, i in enumerate(IDS)]
    assert ids(ns_clusters.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=2, dims=4), "vec_id") == WANT
    assert collocations.collocations(docs.withColumn("lang", F.lit(None).cast("string"))).count() == 0
