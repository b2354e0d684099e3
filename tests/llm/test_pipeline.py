"""Every stage of the corpus pipeline against brute force on what its predecessor kept, and the whole run."""

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from alphaloom.llm import line_dedup, quality_rules
from tests.llm import brute
from tests.llm.conftest import EXTRA, SHARED


@pytest.fixture(scope="module")
def folder(spark, edge_dir, tmp_path_factory):
    """The edge tables with more rows: copies, near copies, a repeated id, rows without id, boilerplate."""
    d = tmp_path_factory.mktemp("pipe")
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    def prose(k, n=160):
        rng = np.random.default_rng(k)
        words = ["".join(rng.choice(list("bdfgklmnprst"), 1)[0] + rng.choice(list("aeiou"), 1)[0] for _ in range(rng.integers(1, 4))) for _ in range(n)]
        return " ".join(" ".join(words[i : i + 9]).capitalize() + "." for i in range(0, n, 9))

    long_prose = prose(1, 400)
    rows = [(20_000 + i, f"{prose(i)}\nFooter of the site.", "site") for i in range(8)]
    rows += [(20_100, long_prose, "a"), (20_101, long_prose, "b"), (20_102, long_prose + " tail", "c"), (20_102, prose(77), "c"), (20_103, prose(78) + " " + SHARED, "c")]
    rows += [(None, prose(79), "c"), (None, prose(79), "c"), (None, prose(80) + " " + SHARED + ".", "c"), (None, long_prose, "c")]
    more = spark.createDataFrame([(i, t, "en", s, len(t), *EXTRA.values()) for i, t, s in rows], docs.schema)
    docs.unionByName(more).repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{edge_dir}/benchmark.parquet").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def table(df, *columns):
    return Counter(tuple(None if pd.isna(v) else v for v in r) for r in df[list(columns)].astype(object).itertuples(index=False))


def visible(line):
    return re.search(r"[^\x20\x09-\x0D]", line)


def without_boilerplate(docs):
    pages, held = Counter(), defaultdict(Counter)
    for s, t in zip(docs.source, docs.text):
        s = None if pd.isna(s) else s
        pages[s] += 1
        held[s].update({x for x in (t or "").split("\n") if visible(x)})
    out = []
    for s, t in zip(docs.source, docs.text):
        s = None if pd.isna(s) else s
        bad = {x for x, n in held[s].items() if n >= line_dedup.MIN_PAGES and n > line_dedup.RATIO * pages[s]}
        out.append(None if t is None else "\n".join(x for x in t.split("\n") if x not in bad))
    return out


def test_stages_and_run(spark, folder):
    items = spark.read.parquet(f"{folder}/benchmark.parquet").toPandas()
    df = spark.read.parquet(f"{folder}/documents.parquet")
    columns = df.columns
    for name, stage in corpus_pipeline.STAGES:
        before, out = df.toPandas(), stage(spark, df, folder)
        path = f"{folder}/out-{name}.parquet"
        out.write.parquet(path)
        df = spark.read.parquet(path)
        after = df.toPandas()
        if name != "packing":
            assert df.columns == columns
        if name == "quality_rules":
            want = quality_rules.quality_verdicts(spark.createDataFrame(before[["doc_id", "text"]].astype(object).where(before[["doc_id", "text"]].notna(), None).values.tolist(), "doc_id double, text string")).toPandas()
            assert len(after) == want.kept.sum() > 50
            assert table(after, "text") <= table(before, "text")
        elif name == "line_dedup":
            kept = before.assign(text=without_boilerplate(before))
            assert table(after, "doc_id", "text", "source") == table(kept, "doc_id", "text", "source")
            assert any(t != u for t, u in zip(before.text, kept.text))
        elif name == "minhash_near_dedup":
            own = before[before.doc_id.notna() & (before.doc_id != 20_102)]  # that id has two texts and is no class's least
            classes = brute.op3(own)
            assert set(after.doc_id.dropna()) - {20_102} == {i for i, c in classes.items() if i == c} and len(after) < len(before)
            none = table(before[before.doc_id.isna()], "text")
            assert table(after[after.doc_id.isna()], "text") == none and sum(none.values()) == 4
        elif name == "decontaminate":
            keyed = before.assign(doc_id=range(len(before)))
            clean = [brute.op9(keyed, items)[i][1] == 0 for i in keyed.doc_id]
            assert table(after, "doc_id", "text") == table(before[clean], "doc_id", "text")
            assert not all(clean) and after.doc_id.isna().sum() == 3
        else:
            pieces = Counter(None if pd.isna(i) else i for i, k in zip(after.doc_id, after.piece) if k == 0)
            assert pieces == Counter(None if pd.isna(i) else i for i in before.doc_id)
            for _, s in after.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
                assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 2048
    whole = corpus_pipeline.run(spark, folder).toPandas()
    assert table(whole, "doc_id", "piece", "start", "length", "ids_crc32") == table(after, "doc_id", "piece", "start", "length", "ids_crc32")


def test_near_dedup_stage_joins_rows_by_a_hash_table_of_ids(spark):
    rows = [(i, f"text number {i // 2} of the table", "s") for i in range(20)] + [(4, "text number 2 of the table", "s"), (None, "a", "s"), (None, "a", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in out.collect()) == [(False, 0)] * 2 + [(True, i) for i in range(0, 20, 2)]
    assert "ShuffledHashJoin [doc_id" in out._jdf.queryExecution().sparkPlan().toString()
