"""Near-duplicate classes of documents from weighted minwise signatures made with darts.

An element is a 5-word shingle, its weight the number of times it occurs (a text of fewer
words is one shingle). Every unit of weight of every element owns a strip of the plane of
weights and ranks, cut into unit cells; each cell holds a Poisson(1) number of darts, all
given by hashes, and each dart falls on one coordinate. A document looks at the darts inside
its elements' weights, up to a rank that gives ``k ln k + 2 k`` of them whatever its length
(and up to double that rank, again and again, while a coordinate has none). The earliest dart of a
coordinate is its signature value; two documents share it with the probability of their
weighted Jaccard similarity. Bands of the signature are buckets.

Links are exact: a pair counts if the weighted Jaccard similarity of its shingles is at least
``THRESHOLD``. Copies are one row (equal word sequences). First every text is compared with
the least text it shares a bucket with; the links are parent pointers, and following them
gives classes. Then the buckets that hold more than one class are searched: members outside a
bucket's largest class are compared with those of other classes inside the tasks, which return
only links that join classes. A text is left out of a search if the shingles that no other
member has already rule out the threshold. Buckets of more than ``BLOCK`` members are searched
in pairs of blocks, so every pair of a bucket is in one class, compared or ruled out, and no
task holds more than two blocks.

Edge cases: null and wordless texts are classes of their own; ids are whole numbers of up to 64
bits (others fail) and should be unique (rows with an equal id get equal classes; rows without
id have a null class and join nobody's); texts of any length count whole; an empty table gives an empty
result; other columns of the input do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.llm.storage import settle
from alphaloom.llm.wordhash import Words, blocks, mix

SHINGLE = 5
THRESHOLD = 0.8
BLOCK = 1024
BYTES = 250_000  # of texts handled at once: signing and comparing take many times as much memory
BANDS, ROWS = 24, 5
COORDINATES = BANDS * ROWS
DARTS = COORDINATES * math.log(COORDINATES) + 2 * COORDINATES
FRACTION = 50  # bits of a rank below the unit
_U = np.uint64
#: chance of at most 0, 1, 2, ... darts in a cell, as 64-bit numbers
_POISSON = np.array([min(2**64 - 1, int(sum(math.exp(-1) / math.factorial(i) for i in range(n + 1)) * 2**64)) for n in range(18)], _U)


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle occurrence and the text it is in, text by text."""
    counts = np.diff(w.first)
    text = np.repeat(np.arange(len(counts)), counts)
    n = max(0, len(w.hash) - SHINGLE + 1)
    whole = np.arange(n) + SHINGLE <= np.repeat(w.first[1:], counts)[:n]
    hashes, owner = w.grams(SHINGLE)[whole], text[:n][whole]
    few = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(few):
        one = np.zeros(len(few), _U)
        for j in range(SHINGLE - 1):
            has = counts[few] > j
            one[has] = mix(one[has] * _U(31) + w.hash[w.first[few[has]] + j] + _U(j))
        hashes, owner = np.append(hashes, one), np.append(owner, few)
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, owner


def _units(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hash of every unit of weight: the n-th occurrence of a shingle in its text is its n-th unit."""
    both = hashes + mix(owner.astype(_U) + _U(1))
    order = np.argsort(both, kind="stable")
    x = both[order]
    new = np.append(True, x[1:] != x[:-1])[: len(x)]
    begin = np.flatnonzero(new)
    nth = np.empty(len(x), np.int64)
    nth[order] = np.arange(len(x)) - np.repeat(begin, np.diff(np.append(begin, len(x))))
    return mix(hashes + nth.astype(_U) * _U(0xD1B54A32D192ED03))


def signatures(hashes: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Signature of each text as one row of ``COORDINATES`` ranks; rows of texts without shingles stay at the maximum."""
    none = np.iinfo(np.uint64).max
    out = np.full(texts * COORDINATES, none, _U)
    units = _units(hashes, owner)
    weight = np.bincount(owner, minlength=texts)
    low, high = np.zeros(texts), DARTS / np.maximum(weight, 1)
    active = weight > 0
    while active.any():
        mine = active[owner]
        u, o = units[mine], owner[mine]
        cells = np.ceil(high[o]).astype(np.int64) - np.floor(low[o]).astype(np.int64)
        cell = np.arange(int(cells.sum())) - np.repeat(np.cumsum(cells) - cells, cells) + np.repeat(np.floor(low[o]).astype(np.int64), cells)
        u, o = np.repeat(u, cells), np.repeat(o, cells)
        seed = mix(u ^ (cell.astype(_U) * _U(0x9E3779B97F4A7C15)))
        darts = np.searchsorted(_POISSON, seed)
        nth = np.arange(int(darts.sum())) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix(np.repeat(seed, darts) + (nth.astype(_U) + _U(1)) * _U(0xA24BAED4963EE407))
        o = np.repeat(o, darts)
        rank = (np.repeat(cell, darts).astype(_U) << _U(FRACTION)) | (dart >> _U(64 - FRACTION))
        inside = rank < (high * 2.0**FRACTION).astype(_U)[o]
        inside &= rank >= (low * 2.0**FRACTION).astype(_U)[o]
        rank, o, dart = rank[inside], o[inside], dart[inside]
        coordinate = (mix(dart + _U(1)) % _U(COORDINATES)).astype(np.int64)
        np.minimum.at(out, o * COORDINATES + coordinate, rank)
        active &= (out.reshape(texts, COORDINATES) == none).any(axis=1)
        low, high = np.where(active, high, low), np.where(active, 2 * high, high)
    return out.reshape(texts, COORDINATES)


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Copy key and band buckets of every text that has words."""
    for b in batches:
        raw = [t.encode() for t in b["_t"]]
        ids = b["_id"].to_numpy()
        for x, y in blocks([len(r) for r in raw], BYTES):
            w = Words(raw[x:y])
            some = np.flatnonzero(np.diff(w.first) > 0)
            s = signatures(*shingles(w), y - x)[some]
            bucket = np.zeros((len(some), BANDS), _U) + np.arange(BANDS, dtype=_U)
            for j in range(ROWS):
                bucket = mix(bucket * _U(0x9E3779B97F4A7C15) + s[:, j::ROWS])
            keys = [hashlib.blake2b(b" ".join(raw[x + k].split()), digest_size=16).digest() for k in some.tolist()]
            yield pd.DataFrame({"_id": ids[x:y][some], "copy": keys, "buckets": list(bucket.view(np.int64))})


def _similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs whose texts reach ``THRESHOLD``."""
    for b in batches:
        left, right = [t.encode() for t in b["ta"]], [t.encode() for t in b["tb"]]
        keep = np.zeros(len(b), bool)
        for x, y in blocks([len(p) + len(q) for p, q in zip(left, right, strict=True)], BYTES):
            h, o = shingles(Words([*left[x:y], *right[x:y]]))
            u = _units(h, o)
            n = y - x
            size = np.bincount(o, minlength=2 * n)
            pair = np.sort(u + mix((o % n).astype(_U) + _U(1)))  # units are distinct inside a text
            # a unit that both texts have is there twice; count such per pair
            key = u + mix((o % n).astype(_U) + _U(1))
            twice = pair[1:][pair[1:] == pair[:-1]]
            first = np.isin(key[o < n], twice)
            both = np.bincount((o[o < n])[first], minlength=n)
            keep[x:y] = both >= THRESHOLD * (size[:n] + size[n:] - both) - 1e-9
        yield b.loc[keep, ["a", "b"]]


def texts_of(own: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``own`` whose ``_id`` is in ``ids``, by a hash table of the ids: the texts stream past it and none is sorted or kept."""
    return own.join(ids.distinct().hint("shuffle_hash"), "_id", "left_semi")


def similar_pairs(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose texts are similar enough; ``own`` has ``_id`` and ``_t``."""

    def side(c: str) -> DataFrame:
        return texts_of(own, pairs.select(F.col(c).alias("_id"))).select(F.col("_id").alias(c), F.col("_t").alias(f"t{c}"))

    out = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb").mapInPandas(_similar, "a BIGINT, b BIGINT")
    return out.repartition("b")  # a task finds few links; by themselves they would be as many files as tasks


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (least node of its component) of every node with a link, by large and small stars.

    Each round is written to the checkpoint folder; it ends when a round changes no edge.
    """

    def stars(edges: DataFrame, small: bool) -> DataFrame:
        if small:
            near = edges  # v < u: a node and its smaller neighbours
        else:
            near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        moved = near.join(least, "u")
        if small:
            moved = moved.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        else:
            moved = moved.filter("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.filter("u != v").distinct()

    def sign(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    before = sign(edges)
    while before[0]:
        edges = settle(stars(stars(edges, small=False), small=True))
        now = sign(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _roots(parents: DataFrame) -> DataFrame:
    """``node`` and ``root`` by pointer jumping; every ``node`` has one ``parent``, a lesser node."""
    found = settle(parents.select(F.col("b").alias("node"), F.col("a").alias("root"), F.lit(True).alias("moved")))
    while not found.filter("moved").isEmpty():
        up = found.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = settle(found.drop("moved").join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
    roots = found.select("node", "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links that join classes inside each group (``bucket``, ``i``, ``j``) of rows sorted by these."""

    def links(g: pd.DataFrame) -> list[tuple[int, int]]:
        g = g.drop_duplicates("_id")
        root = pd.factorize(g["root"])[0]
        ids, main = g["_id"].to_numpy(), (g["root"] == g["main"]).to_numpy()
        if root.max() == 0 or main.all():
            return []
        u, owner = shingles(Words([t.encode() for t in g["_t"]]))
        code, _ = pd.factorize(_units(u, owner))
        n = len(g)
        size = np.bincount(owner, minlength=n)
        shared = np.bincount(code) > 1
        most = np.bincount(owner, shared[code], minlength=n).astype(np.int64)  # overlap that is possible at all
        begin = np.cumsum(size) - size
        out = []
        for x in np.flatnonzero(~main).tolist():
            both = np.minimum(most[x], most)
            able = (root != root[x]) & (both >= THRESHOLD * (size[x] + size - both) - 1e-9)
            if not able.any():
                continue
            mark = np.zeros(len(shared), bool)
            mark[code[begin[x] : begin[x] + size[x]]] = True
            both = np.bincount(owner, mark[code], minlength=n)
            for y in np.flatnonzero(able & (both >= THRESHOLD * (size[x] + size - both) - 1e-9)).tolist():
                if root[y] != root[x]:
                    out.append((int(ids[x]), int(ids[y])))
                    root[root == root[y]] = root[x]
        return out

    rest: list[pd.DataFrame] = []
    for b in batches:
        for _, g in b.groupby(["bucket", "i", "j"], sort=False):
            if rest and (rest[0].iloc[0][["bucket", "i", "j"]] != g.iloc[0][["bucket", "i", "j"]]).any():
                yield pd.DataFrame(links(pd.concat(rest)), columns=["a", "b"])
                rest = []
            rest.append(g)
    if rest:
        yield pd.DataFrame(links(pd.concat(rest)), columns=["a", "b"])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``class_id``, the least id of its class, of every row."""
    own = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t")).filter("_id IS NOT NULL")
    signed = settle(own.mapInPandas(_sign, "_id BIGINT, copy BINARY, buckets ARRAY<BIGINT>"))
    texts = settle(signed.groupBy("copy").agg(F.min("_id").alias("_id"), F.first("buckets").alias("buckets")))
    bucket = Window.partitionBy("bucket")
    placed = texts.select(F.explode("buckets").alias("bucket"), "_id").withColumns({"a": F.min("_id").over(bucket), "n": F.count(F.lit(1)).over(bucket)})
    shared = settle(placed.filter("n > 1"))  # buckets of two texts or more
    first = settle(shared.groupBy(F.col("_id").alias("b")).agg(F.min("a").alias("a")).filter("a != b").select("a", "b"))
    roots = settle(_roots(settle(similar_pairs(first, own))))

    classed = shared.join(roots, F.col("_id") == F.col("node"), "left").select("bucket", "_id", "n", F.coalesce("root", "_id").alias("root"))
    parts = classed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("k"))
    mixed = parts.groupBy("bucket").agg(F.max(F.struct("k", "root")).alias("top"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    mixed = settle(classed.join(mixed.select("bucket", F.col("top.root").alias("main")), "bucket"))
    rest = mixed.withColumn("blocks", F.expr(f"CAST(ceil(n / {BLOCK}) AS INT)")).withColumn("block", F.expr("CAST(pmod(xxhash64(_id), blocks) AS INT)"))
    rest = rest.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "_id", "root", "main"
    )
    rest = rest.join(texts_of(own, mixed.select("_id")), "_id").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    more = settle(rest.mapInPandas(_search, "a BIGINT, b BIGINT").repartition("b"))
    # classes joined by these links: components over class roots
    over = more
    for side in ("a", "b"):
        over = over.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}")), side, "left").withColumn(side, F.coalesce(f"r{side}", side)).drop(f"r{side}")
    top = components(over)
    top = top.select(F.col("node").alias("root"), F.col("root").alias("top"))

    by_copy = texts.select("copy", F.col("_id").alias("node")).join(roots, "node", "left").select("copy", F.coalesce("root", "node").alias("root"))
    by_copy = by_copy.join(top, "root", "left").select("copy", F.coalesce("top", "root").alias("root"))
    known = signed.select("_id", "copy").join(by_copy, "copy").select("_id", "root").groupBy("_id").agg(F.min("root").alias("root"))
    out = docs.select(F.col(doc_id)).join(known, F.col(doc_id).cast("long") == F.col("_id"), "left")
    return out.select(doc_id, F.coalesce("root", F.col(doc_id).cast("long")).alias("class_id"))
