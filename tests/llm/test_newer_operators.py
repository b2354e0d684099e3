"""Clusters, fingerprints and collocations against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from alphaloom.llm import collocations, ns_clusters, simhash
from tests.llm import brute
from tests.llm.conftest import EXTRA, LONG, SHARED

# ---- clusters


def lloyd(ids, x, k, rounds):
    order = sorted(range(len(ids)), key=lambda i: (hashlib.sha256(f"1:{ids[i]}".encode()).hexdigest(), x[i].tolist()))
    centre = x[order[:k]].copy()
    near = lambda: ((x[:, None, :] - centre[None]) ** 2).sum(2)
    for _ in range(rounds):
        own = near().argmin(1)
        for j in range(len(centre)):
            if (own == j).any():
                centre[j] = x[own == j].sum(0) // (own == j).sum()
    d = near()
    return d.argmin(1), d.min(1), centre


@pytest.mark.parametrize("k,rounds", [(5, 3), (16, 6)])
def test_clusters_are_those_of_plain_rounds(spark, k, rounds):
    rng = np.random.default_rng(k)
    centre = rng.normal(0, 1, (7, 8))
    x = centre[rng.integers(0, 7, 600)] + rng.normal(0, 0.3, (600, 8))
    x[50:90] = x[50]  # equal vectors
    rows = [(int(i), [float(v) for v in r], "a") for i, r in enumerate(x.astype(np.float32))]
    odd = [(1000, None, "a"), (1001, [], "a"), (1002, [0.0] * 9, "a"), (1003, [None] + [0.0] * 7, "a"), (1004, [float("nan")] + [0.0] * 7, "a"), (1005, [float("-inf")] + [0.0] * 7, "a"), (1006, [1e30] * 8, "a")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, cluster string").repartition(5)
    got = ns_clusters.clusters(df, k=k, rounds=rounds, dims=8).toPandas().sort_values("vec_id")
    whole = np.floor(64 * x.astype(np.float32).astype(float)).astype(np.int64)
    own, distance, centroid = lloyd(list(range(600)), whole, k, rounds)
    assert got.vec_id.tolist() == list(range(600))
    assert got.cluster.tolist() == own.tolist() and got.distance.tolist() == distance.tolist()
    assert (got.inertia == distance.sum()).all()
    for r in got.itertuples():
        assert r.cluster_inertia == distance[own == r.cluster].sum() and list(r.centroid) == centroid[r.cluster].tolist()


def test_bounds_save_evaluations_and_lose_nothing():
    rng = np.random.default_rng(1)
    centre = rng.integers(-500, 500, (12, 6))
    x = centre[rng.integers(0, 12, 3000)] + rng.integers(-30, 30, (3000, 6))
    history = x[:12][None].copy()
    far, seen, own, looked = np.zeros((3000, 12), np.int64), np.zeros((3000, 12), np.int16), None, []
    for _ in range(8):
        own, n = ns_clusters.evaluate(x, far, seen, history, own)
        looked.append(n)
        d = ((x[:, None, :] - history[-1][None]) ** 2).sum(2)
        assert (own == d.argmin(1)).all()
        new = history[-1].copy()
        for j in range(12):
            if (own == j).any():
                new[j] = x[own == j].sum(0) // (own == j).sum()
        history = np.concatenate([history, new[None]])
    assert looked[0] == 36_000 and looked[-1] < 9_000


def test_clusters_of_few_rows(spark):
    few = spark.createDataFrame([(5, [1.0, 2.0], 1), (None, [1.5, 2.0], 2)], "vec_id long, embedding array<double>, label int")
    got = ns_clusters.clusters(few, k=4, dims=2).toPandas()
    assert len(got) == 2 and set(got.cluster) == {0}
    assert ns_clusters.clusters(few.limit(0), k=4, dims=2).count() == 0


# ---- fingerprints


def fingerprint(text):
    w = brute.words((text or "").encode().translate(brute.LOWER).decode())
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def linked(codes, bound=2):
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i + 1 :] ^ codes[i]) <= bound).tolist():
            a, b = find(i), find(i + 1 + j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def test_fingerprints_and_components(spark, corpus):
    edits = [" ".join(w if i != k else "edit" for i, w in enumerate(LONG.split()[:900])) for k in range(0, 900, 60)]
    more = pd.DataFrame({"doc_id": range(20_000, 20_000 + len(edits)), "text": edits})
    docs = pd.concat([corpus[["doc_id", "text"]], more], ignore_index=True)
    df = spark.createDataFrame([(int(i), t, "x", 1) for i, t in zip(docs.doc_id, docs.text)], "doc_id long, text string, fingerprint string, component_id int")
    got = simhash.near_duplicates(df).toPandas().set_index("doc_id")
    want = [fingerprint(t) for t in docs.text]
    assert [got.loc[i].fingerprint for i in docs.doc_id] == [f"{x:016x}" for x in want]
    root = linked(np.array(want, np.uint64))
    least = {}
    for r, i in zip(root, docs.doc_id):
        least[r] = min(least.get(r, i), i)
    assert [got.loc[i].component_id for i in docs.doc_id] == [least[r] for r in root]


@pytest.mark.parametrize("searches", [simhash.SEARCHES, 50])
def test_links_join_what_brute_force_joins(spark, searches, monkeypatch):
    """Dense clouds of codes, chains between them, and far codes, also with split pieces."""
    monkeypatch.setattr(simhash, "SEARCHES", searches)
    rng = np.random.default_rng(4)
    bit = lambda: np.uint64(1) << np.uint64(rng.integers(0, 64))
    codes = set(rng.integers(0, 2**64, 400, np.uint64).tolist())
    for c in list(codes)[:8]:
        x = np.uint64(c)
        for _ in range(60):
            x = x ^ bit() ^ (bit() if rng.random() < 0.5 else np.uint64(0))
            codes.add(int(x))
    codes = np.array(sorted(codes), np.uint64)
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    links = simhash.neighbour_links(df).toPandas()
    a, b = (links[c].to_numpy(np.int64).view(np.uint64) for c in "ab")
    assert (np.bitwise_count(a ^ b) <= 2).all()
    at = {int(c): i for i, c in enumerate(codes)}
    found = simhash._Components(len(codes))
    found.join(np.array([at[int(x)] for x in a]), np.array([at[int(x)] for x in b]))
    want = linked(codes)
    assert [int(x) for x in pd.factorize(found.flat())[0]] == [int(x) for x in pd.factorize(np.array(want))[0]]


def test_gray_index_search_is_exact():
    rng = np.random.default_rng(5)
    leaves = np.unique(rng.integers(0, 2**20, 900, np.uint64) << np.uint64(7))
    leaves = leaves[np.argsort(simhash.gray_rank(leaves))]
    index = simhash.GrayIndex(leaves, np.full(len(leaves), np.uint64(2**64 - 1)))
    ask = np.concatenate([leaves[:50], rng.integers(0, 2**27, 50, np.uint64)])
    got = {(int(q), int(n)) for qs, ns in index.search(ask, np.full(100, -2), 2) for q, n in zip(qs, ns)}
    assert got == {(q, int(n)) for q in range(100) for n in np.flatnonzero(np.bitwise_count(leaves ^ ask[q]) <= 2)}


# ---- collocations


def phrases(docs, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in zip(docs.lang, docs.text):
        lang = "und" if lang is None or lang != lang else lang
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().translate(brute.LOWER)):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        best = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(100 * b >= 50 * a for q, b in c.items() if len(q) == 3 and b >= least and p in (q[:2], q[1:])):
                continue
            score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, b" ".join(p), a, c[p[:k]], c[p[k:]], score))
        out += [(lang, i + 1, p.decode(), a, x, y, n[lang], s) for i, (_, _, p, a, x, y, s) in enumerate(sorted(best)[:top])]
    return out


def rows(got):
    return sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("block", [collocations.BLOCK, 2000])
def test_collocations(spark, edge_dir, block, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", block)
    monkeypatch.setattr(collocations, "ROUTE_WORDS", 5000)
    df = spark.read.parquet(f"{edge_dir}/documents.parquet")
    df = df.unionByName(df.filter("doc_id >= 10012").withColumn("lang", F.lit(None).cast("string")))  # the given rows may all have a language
    docs = df.select("lang", "text").toPandas()
    want = sorted(phrases(docs))
    assert {"en", "und"} <= {r[0] for r in rows(collocations.collocations(df.withColumn("rank", df["doc_id"]), least=2))} and len(want) > 20
    assert rows(collocations.collocations(df)) == want


@pytest.mark.parametrize("route_words", [collocations.ROUTE_WORDS, 60])
def test_collocations_with_ties_and_hot_words(spark, route_words, monkeypatch):
    monkeypatch.setattr(collocations, "ROUTE_WORDS", route_words)
    rng = np.random.default_rng(6)
    common = ["the"] * 60 + [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(common, 40)) + (". New York city, x" if i % 2 else "; é ß\x1c y") for i in range(80)]
    texts += ["New York city"] * 15 + ["", None, "one", SHARED, " \t ", "a\x0bb\x0cc"] * 3
    docs = pd.DataFrame({"lang": [None if i % 9 == 0 else "en" for i in range(len(texts))], "text": texts})
    df = spark.createDataFrame([(*r, 1) for r in docs.astype(object).itertuples(index=False, name=None)], "lang string, text string, n int")
    assert rows(collocations.collocations(df, top=25)) == sorted(phrases(docs, top=25))


def test_collocations_are_cut_twice_where_there_are_many_routes(spark, monkeypatch):
    monkeypatch.setattr(collocations, "ROUTE_WORDS", 60)
    monkeypatch.setattr(collocations, "FAN", 4)
    rng = np.random.default_rng(16)
    common = ["the"] * 60 + [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(common, 40)) + (". New York city, x" if i % 2 else "; é ß\x1c y") for i in range(120)] + ["", None]
    docs = pd.DataFrame({"lang": [None if i % 9 == 0 else "en" for i in range(len(texts))], "text": texts})
    df = spark.createDataFrame(list(docs.astype(object).itertuples(index=False, name=None)), "lang string, text string").repartition(7)
    assert rows(collocations.collocations(df, top=40)) == sorted(phrases(docs, top=40))


def test_blocks_of_collocations_do_not_grow_in_number_with_batches_or_routes(monkeypatch):
    rng = np.random.default_rng(17)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, 60)) for _ in range(300)]
    langs = [("en", "de", "fr")[i % 3] for i in range(300)]
    batches = [pd.DataFrame({"lang": langs[i : i + 10], "_t": [t.encode() for t in texts[i : i + 10]]}) for i in range(0, 300, 10)]
    together = list(collocations._by_language(iter(batches)))
    assert sorted(lang for lang, _ in together) == ["de", "en", "fr"]
    assert sorted(t.decode() for _, x in together for t in x) == sorted(texts)

    def cut(routes, fan):
        out = []
        for lang, raw in together:
            codes, piece, found = collocations._words(raw)
            out += collocations._route(*collocations.suffixes(codes, piece, len(found)), found, lang, {b"w1", b"w2"}, routes, fan)
        return pd.DataFrame(out, columns=["route", "lang", "kind", "words", "codes", "counts"])

    fine, coarse = cut(3000, 3000), cut(3000, 8)
    assert len(coarse) <= 3 * 3 * 8 < len(fine)
    assert (coarse["route"] < 8).all()
    for joined in (collocations.JOINED, 500):
        monkeypatch.setattr(collocations, "JOINED", joined)
        sorted_ = coarse.sort_values(["route", "lang", "kind"])
        again = pd.concat(collocations._recut(iter([sorted_[:20], sorted_[20:]]), 3000, 8))
        count = lambda b: sorted(collocations._count_route(b, 3).itertuples(index=False, name=None))
        assert set(again["route"]) == set(fine["route"])
        assert all(count(again[again["route"] == r]) == count(fine[fine["route"] == r]) for r in list(set(fine["route"]))[:200])
    monkeypatch.setattr(collocations, "BLOCK", 2000)
    small = list(collocations._by_language(iter(batches)))
    assert len(small) > 20 and all(sum(map(len, x)) <= 2000 for _, x in small) and sum(len(x) for _, x in small) == 300


def test_frequent_prefixes_are_those_counted_one_by_one():
    rng = np.random.default_rng(8)
    keys = rng.zipf(1.6, (4000, 3)).clip(0, 50)
    keys[rng.random(4000) < 0.1, 2] = 0
    weight = rng.integers(1, 5, 4000)
    want = Counter()
    for k, w in zip(keys.tolist(), weight.tolist()):
        for d in (1, 2, 3):
            if k[d - 1] > 0:
                want[tuple(k[:d])] += w
    row, size, n = collocations.frequent(keys, weight, 12)
    got = [(tuple(keys[r, :d].tolist()), int(x)) for r, d, x in zip(row, size, n)]
    assert len(got) == len(set(got)) and dict(got) == {k: w for k, w in want.items() if w >= 12}
    assert all(len(x) == 0 for x in collocations.frequent(keys[:0], weight[:0], 1))


def test_extra_columns_do_not_matter(spark):
    df = spark.createDataFrame([(1, SHARED, "en", *EXTRA.values())], ["doc_id", "text", "lang", *EXTRA])
    assert simhash.near_duplicates(df).columns == ["doc_id", "fingerprint", "component_id"]
    assert collocations.collocations(df, least=1, top=3).count() == 3
