"""Every query of the package against brute force on the small tables with edge rows, and on empty tables."""

import base64
import glob
import hashlib
import io
import math
import zipfile
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from alphaloom.llm import bpe, decontaminate, hmm, line_dedup, near_dedup, packing, quality_rules, substring_dedup, toxicity, warc_zip
from alphaloom.session import scratch_path
from tests.llm import brute
from tests.llm.conftest import SHARED


@pytest.fixture(scope="module")
def docs(spark, edge_dir):
    return spark.read.parquet(f"{edge_dir}/documents.parquet").select("doc_id", "text").toPandas()


@pytest.fixture(scope="module")
def ids(docs):
    tok = Tokenizer.from_file(bpe.default_vocabulary())
    return {i: e.ids for i, e in zip(docs.doc_id, tok.encode_batch(docs.text.fillna("").tolist(), add_special_tokens=False))}


def result(spark, name, folder):
    return entry.queries()[name](spark, folder).toPandas()


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("op") or n == "pipeline"])
def test_empty_tables(spark, empty_dir, name):
    assert len(result(spark, name, empty_dir)) == 0


@pytest.mark.parametrize("busy", [substring_dedup.BUSY_ANCHOR, 1])
def test_op1(spark, edge_dir, docs, busy, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUSY_ANCHOR", busy)
    got = result(spark, "op1_substring_dedup", edge_dir)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got.itertuples()} == brute.op1(docs)


def test_op1_does_not_fail_on_rows_of_one_id(spark):
    df = spark.createDataFrame([(1, SHARED), (1, SHARED), (2, "x " + SHARED), (2, "short " * 14), (None, SHARED), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.remove_repeated(df).collect())
    assert got[:3] == [(0, 40, 0), (1, 40, 0), (1, 40, 0)] and (2, 41, 40) in got and len(got) == 6


def test_fm_index_reports_the_least_owner_of_every_window():
    rng = np.random.default_rng(0)
    segments = [rng.integers(1, 3, rng.integers(4, 30)) for _ in range(60)]
    text = np.concatenate([np.append(s, 0) for s in segments])
    end = np.cumsum([len(s) + 1 for s in segments]) - 1
    start = end - [len(s) for s in segments]
    owner = np.repeat(rng.integers(0, 1000, 60), [len(s) + 1 for s in segments])
    place, least = substring_dedup.FMIndex(text, owner, 13).window_owners(text, start, end)
    want = {}
    spots = [p for a, b in zip(start, end) for p in range(a, b - 12)]
    for p in spots:
        k = tuple(text[p : p + 13])
        want[k] = min(want.get(k, 10**9), owner[p])
    assert dict(zip(place.tolist(), least.tolist())) == {p: want[tuple(text[p : p + 13])] for p in spots}


def test_op2_drops_only_boilerplate_of_the_host(spark):
    rows = [(i, "h" if i < 10 else None, f"boiler\nown {i}\n\nboiler" if i % 2 else f"own {i}") for i in range(20)]
    rows += [(20, "h", None), (21, "h", ""), (22, "solo", "boiler\nx")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(df, "source", "text", ratio=0.3, min_pages=4).collect()}
    assert got[1].text == "own 1\n" and got[1].n_dropped == 2 and got[1].n_lines == 3
    assert got[11].text == "own 11\n" and got[20].text is None and got[21].text == "" and got[22].text == "boiler\nx"


def test_url_host(spark):
    df = spark.createDataFrame([("https://Blog.a.example.com/en/1#top",), ("no url",), (None,)], "u string")
    assert [r[0] for r in df.select(line_dedup.url_host("u")).collect()] == ["blog.a.example.com", None, None]


def test_op3(spark, edge_dir, docs):
    got = result(spark, "op3_minhash_near_dedup", edge_dir)
    assert dict(zip(got.doc_id, got.class_id)) == brute.op3(docs)


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 8])
def test_op3_group_of_edited_copies(spark, block, monkeypatch):
    """Variants of one text whose pairs lie on both sides of the threshold; no link may be lost."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(250):
        w = list(base)
        for p in rng.integers(0, 150, rng.integers(0, 6)):
            w[p] = f"e{rng.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    pdf = pd.DataFrame(rows, columns=["doc_id", "text"])
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert dict(zip(got.doc_id, got.class_id)) == brute.op3(pdf)


def test_signatures_agree_as_often_as_weighted_jaccard_says():
    near_dedup.Words([b"a"])
    a, b = " ".join(f"x{i}" for i in range(400)).encode(), " ".join(f"x{i}" if i % 25 else f"y{i}" for i in range(400)).encode()
    h, o = near_dedup.shingles(near_dedup.Words([a, b]))
    s = near_dedup.signatures(h, o, 2)
    bags = [Counter(h[o == k].tolist()) for k in (0, 1)]
    exact = (bags[0] & bags[1]).total() / (bags[0] | bags[1]).total()
    assert abs((s[0] == s[1]).mean() - exact) < 0.15 and (s != np.iinfo(np.uint64).max).all()


def test_op4(spark, edge_dir):
    pages = spark.read.parquet(f"{edge_dir}/pages.parquet").toPandas()
    got = result(spark, "op4_warc", edge_dir).set_index("page_id")
    body = {r.page_id: (r.html or "").encode() for r in pages.itertuples()}
    first = {}
    for i in sorted(body):
        first.setdefault(body[i], i)
    assert len(got) == len(body)
    for i, b in body.items():
        r = got.loc[i]
        assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert r.record_type == ("response" if first[b] == i else "revisit")
        assert (None if pd.isna(r.refers_to) else r.refers_to) == (None if first[b] == i else first[b])


def test_packages_are_valid_zip_files_and_keep_payloads(spark):
    rows = [(1, "http://a", "x" * 5000), (2, None, "y\r\n\r\nz"), (3, "c", "é")]
    path = scratch_path(spark, "packages")
    warc_zip.write_packages(spark.createDataFrame(rows, "page_id long, url string, html string"), path, package_bytes=1)
    files = [f for f in glob.glob(f"{path.removeprefix('file:')}/part*")]
    assert len(files) == 3 and all(zipfile.ZipFile(f).testzip() is None for f in files)
    got = {r.page_id: (r.url, bytes(r.payload).decode()) for r in warc_zip.read_packages(spark, path).collect()}
    assert got == {i: (u, h) for i, u, h in rows}


@pytest.mark.parametrize("zip64", [False, True])
def test_directory_of_zip_and_zip64(zip64):
    data = warc_zip.package([("one", b"PK\x05\x06 not the end"), ("é/two", b"")], zip64)
    assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None
    at, n = warc_zip.directory(io.BytesIO(data), len(data))["one"]
    assert data[at : at + n] == b"PK\x05\x06 not the end"


def test_op5_finds_held_out_toxic_documents(spark):
    rng = np.random.default_rng(2)
    clean = [f"wort{i}en" for i in range(400)]
    texts, y = [], []
    for i in range(900):
        w = list(rng.choice(clean, rng.integers(10, 120)))
        if toxic := i % 3 == 0:
            w[rng.integers(0, len(w))] = "zorgl" + rng.choice(["o", "er", "ing", "ab", "ix", "um"]) + str(rng.integers(0, 40))
        texts.append(" ".join(w))
        y.append(float(toxic))
    model = toxicity.fit(texts[:600], np.array(y[:600]), np.ones(600))
    got = model.score(texts[600:]) >= 0.3
    assert (got == (np.array(y[600:]) == 1)).mean() > 0.97
    assert model.score(["", "  "]).shape == (2,) and model.score(["", " "])[0] < 0.3


def test_op5_scores_every_row(spark, edge_dir, docs):
    got = result(spark, "op5_toxicity", edge_dir)
    assert sorted(got.doc_id) == sorted(docs.doc_id) and got.score.between(0, 1).all()
    assert all(r.held_out == brute.held_out(r.doc_id, 4, 2) and r.predicted == (r.score >= 0.3) for r in got.itertuples())


def test_op6_base_counts(spark, edge_dir, docs):
    got = result(spark, "op6_quality_rules", edge_dir).set_index("doc_id")
    assert len(got) == len(docs)
    for r in docs.itertuples():
        n, chars, symbols, lines, repeats = brute.op6_base(r.text)
        g = got.loc[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (n, chars, symbols, lines, repeats), r
        assert g.base_failed == (n < 20 or 100 * repeats > 30 * n) and (not g.kept or not g.base_failed)


def test_op6_follows_the_labels(spark, small):
    got = result(spark, "op6_quality_rules", "/root/testdata/sf0.01").merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"))
    got = got[~got.base_failed]
    assert (got.kept == (got.quality == 1)).mean() > 0.97


def test_op6_rules_for_different_faults_do_not_vote_each_other_down():
    good, a, b = (0, 0, 0, 0, 1), (-1, -1, 0, 0, 0), (0, 0, -1, -1, 0)  # two rules for each of two faults; they abstain on the other
    post = quality_rules.fit([(good, 8000), (a, 700), (b, 300), ((0, 0, 0, 0, 0), 5)]).posterior
    assert post[good] > 0.8 and post[a] < 0.5 and post[b] < 0.5
    assert quality_rules.fit([]).posterior == {}


def test_op6_one_rule_alone_does_not_reject_where_good_texts_are_common():
    """Nothing bears the first rule out, so its votes weigh no more than the share of good texts."""
    post = quality_rules.fit([((0, 1), 8000), ((-1, 0), 300)]).posterior
    assert post[(0, 1)] > 0.8 and post[(-1, 0)] > 0.5


def test_op6_accuracies_decide_not_the_presence_of_a_bad_vote():
    """A rule that the others contradict is overruled, and its good votes do not save a text either."""
    rng = np.random.default_rng(7)
    seen = Counter()
    for _ in range(30_000):
        y = 1 if rng.random() < 0.6 else -1
        vote = lambda right, cast: (y if rng.random() < right else -y) if rng.random() < cast else 0
        seen[(vote(0.95, 0.9), vote(0.9, 0.8), vote(0.85, 0.9), vote(0.3, 0.7))] += 1
    got = quality_rules.fit(list(seen.items()))
    assert np.allclose(got.accuracy, (0.95, 0.9, 0.85, 0.3), atol=0.03) and abs(got.prior - 0.6) < 0.03
    assert got.posterior[(1, 1, 1, -1)] > 0.9 and got.posterior[(0, 0, 1, -1)] > 0.5  # a bad vote, kept
    assert got.posterior[(0, 0, 0, 1)] < got.prior and got.posterior[(-1, 0, 0, 1)] < 0.5


def test_op6_fit_is_plain_expectation_maximisation():
    """The same numbers as EM over single texts, written out with arrays."""
    rng = np.random.default_rng(3)
    patterns = [tuple(int(x) for x in v) for v in {tuple(rng.integers(-1, 2, 4)) for _ in range(30)}]
    counts = rng.integers(1, 60, len(patterns))
    votes = np.repeat(np.array(patterns), counts, axis=0)
    good = np.select([votes.sum(1) > 0, votes.sum(1) < 0], [0.9, 0.1], 0.5)
    for _ in range(400):
        prior = (good.sum() + 1) / (len(votes) + 2)
        right = np.where(votes > 0, good[:, None], 1 - good[:, None]) * (votes != 0)
        acc = (right.sum(0) + 2) / ((votes != 0).sum(0) + 3)
        on_good = prior * np.where(votes > 0, acc, np.where(votes < 0, 1 - acc, 1)).prod(1)
        on_bad = (1 - prior) * np.where(votes < 0, acc, np.where(votes > 0, 1 - acc, 1)).prod(1)
        good = on_good / (on_good + on_bad)
    got = quality_rules.fit([(v, int(n)) for v, n in zip(patterns, counts)])
    assert np.allclose(np.repeat([got.posterior[v] for v in patterns], counts), good, atol=1e-6)


def test_op6_keeps_what_the_posterior_keeps(spark, edge_dir):
    """``kept`` is the verdict of the fitted pattern of a row's votes, and no count of bad votes."""
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet").select("doc_id", "text")
    got = quality_rules.quality_verdicts(docs).toPandas()
    votes = [tuple(int(v) for v in r) for r in got[[f"vote_{r}" for r in quality_rules.RULES]].to_numpy()]
    post = quality_rules.fit(list(Counter(votes).items())).posterior
    assert np.allclose(got.quality_prob, [post[v] for v in votes])
    assert (got.kept == (~got.base_failed & (got.quality_prob >= 0.5))).all()


def test_op7(spark, edge_dir, ids):
    got = result(spark, "op7_packing", edge_dir)
    whole = {i: [*t, 0] for i, t in ids.items()}
    pieces = got.sort_values(["doc_id", "piece"]).groupby("doc_id")
    assert set(pieces.groups) == set(whole)
    for i, p in pieces:
        assert p.start.tolist() == [0, *np.cumsum(p.length)[:-1]] and p.length.sum() == len(whole[i]) and (p.length[1:] == 2048).all()
        assert p.ids_crc32.tolist() == [zlib.crc32(np.array(whole[i][s : s + n], "<u4").tobytes()) for s, n in zip(p.start, p.length)]
    for _, s in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
    assert got.sequence_id.nunique() <= 1.02 * got.length.sum() / 2048 + 1


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = {int(x): int(n) for x, n in zip(rng.choice(np.arange(1, 65), 20, replace=False), rng.integers(1, 200, 20))}
    runs = packing.plan(counts, 64)
    placed, filled = Counter(), Counter()
    for x, rank, n, first, offset in sorted(runs, key=lambda r: r[4]):
        placed[x] += n
        for s in range(first, first + n):
            assert filled[s] == offset
            filled[s] += x
    assert placed == counts and max(filled.values()) <= 64
    ranks = {x: sorted((a, a + n) for y, a, n, _, _ in runs if x == y) for x in counts}
    assert all(r[0][0] == 0 and all(p[1] == q[0] for p, q in zip(r, r[1:])) and r[-1][1] == counts[x] for x, r in ranks.items())


def test_op8(spark, edge_dir, docs, ids):
    got = result(spark, "op8_token_counts", edge_dir).set_index("doc_id")
    for r in docs.itertuples():
        g = got.loc[r.doc_id]
        assert (g.n_bytes, g.n_tokens) == (len((r.text or "").encode()), len(ids[r.doc_id])) and g.over_limit == (g.n_tokens > 512)


def test_byte_pairs_like_the_library_on_odd_texts():
    rng = np.random.default_rng(4)
    alphabet = list(" '\t\n\r sStTdmlrevé  x1٣中!?.́’\x1c\x85 😀") + ["<|endoftext|>", "'ll", "'S"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(3000)]
    v, tok = bpe.vocabulary(bpe.default_vocabulary()), Tokenizer.from_file(bpe.default_vocabulary())
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    parts, number, between = v.fragments(texts)
    sums = bpe._sums(v.count(parts), number)
    assert [int(s) + len(b) for s, b in zip(sums, between)] == [len(w) for w in want]


def test_op9(spark, edge_dir, docs):
    items = spark.read.parquet(f"{edge_dir}/benchmark.parquet").toPandas()
    got = result(spark, "op9_decontaminate", edge_dir)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got.itertuples()} == brute.op9(docs, items)
    assert (got.contaminated == (got.n_hit > 0)).all()


def test_op9_keeps_the_columns_of_the_input(spark):
    df = spark.createDataFrame([(1, SHARED, "z", 5)], "doc_id long, text string, other string, n_words int")
    bench = spark.createDataFrame([("i", SHARED, "w")], "item_id string, text string, n_hit string")
    row = decontaminate.contamination(df, bench).first()
    assert row.other == "z" and row.n_words == 40 and row.n_hit == 40 and row["items"] == ["i"]


def test_op10(spark, edge_dir, docs):
    got = result(spark, "op10_hmm_scores", edge_dir).set_index("doc_id")
    tokens = {r.doc_id: [*brute.words((r.text or "").encode().translate(brute.LOWER).decode()), None] for r in docs.itertuples()}
    c = Counter(t for i, w in tokens.items() if not brute.held_out(i, 5, 1) for t in w)
    n, v = c.total(), len(c)
    for i, w in tokens.items():
        g = got.loc[i]
        base = sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in w)
        assert (g.n_tokens, g.n_known, g.train_tokens, g.held_out) == (len(w), sum(c[t] > 0 for t in w), n, brute.held_out(i, 5, 1))
        assert g.base_score == pytest.approx(base) and g.score < 0
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()


def test_likelihood_is_the_sum_over_all_state_paths():
    rng = np.random.default_rng(3)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    m = hmm.Model(norm(rng.random(hmm.STATES), 0), norm(rng.random(hmm.STATES), 0), norm(rng.random((hmm.STATES, hmm.STATES)), 1), norm(rng.random((5, hmm.STATES)), 0))
    texts = [np.array([0]), np.array([1, 2, 0]), np.array([3, 3, 4, 0])]
    for t, got in zip(texts, m.likelihood(texts)):
        state = m.start * m.emit[t[0]]
        for s in t[1:]:
            state = (state @ m.move) * m.emit[s]
        assert got == pytest.approx(math.log10(state.sum()))


def test_baum_welch_raises_the_likelihood():
    rng = np.random.default_rng(5)
    texts = [np.append(rng.integers(1 + 20 * (k % 3), 20 + 20 * (k % 3), rng.integers(1, 200)), 0).astype(np.uint16) for k in range(90)]
    share = (np.bincount(np.concatenate(texts), minlength=hmm.SYMBOLS) + 0.5) / (sum(map(len, texts)) + 0.5 * hmm.SYMBOLS)
    m, seen = hmm.Model.guess(share), []
    for _ in range(6):
        seen.append(m.likelihood(texts).sum())
        m = hmm.Model.refit(m.expect(texts), share)
    assert seen[-1] > seen[0]


def test_training_reads_every_document_until_the_posterior_stops_rising(spark):
    """Copies of one text, of any number, do not stand for the corpus: the states are those of EM over all rows."""
    rng = np.random.default_rng(8)
    others = [np.append(rng.integers(1 + 20 * (k % 3), 20 + 20 * (k % 3), rng.integers(1, 200)), 0).astype("<u2") for k in range(60)]
    texts = [np.array([7, 0], "<u2")] * 900 + others
    share = (np.bincount(np.concatenate(texts), minlength=hmm.SYMBOLS) + 0.5) / (sum(map(len, texts)) + 0.5 * hmm.SYMBOLS)
    want, risen = hmm.Model.guess(share), []
    while len(risen) < 2 or risen[-1] - risen[-2] > 1e-5 * abs(risen[-1]):
        total = want.expect(texts)
        risen.append(want.posterior(total, share))
        want = hmm.Model.refit(total, share)
    assert len(risen) > 4 and risen == sorted(risen)
    rows = spark.createDataFrame([(True, t.tobytes()) for t in texts] + [(False, np.array([9, 9, 0], "<u2").tobytes())] * 50, "_learn boolean, symbols binary")
    got = hmm.train(rows.repartition(5), share)
    for part in ("start", "later", "move", "emit"):
        assert np.allclose(getattr(got, part), getattr(want, part), atol=1e-4)
