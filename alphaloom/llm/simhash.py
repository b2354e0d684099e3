"""SimHash near-duplicates over a Gray-order hierarchical index.

A fingerprint has a bit set if the bit is set in more than half of the XXH64 hashes of a
text's 3-word shingles. Distinct fingerprints are sorted by their rank in the Gray code (codes
next to each other differ in few bits) and cut into pieces. Runs of ``FAN`` neighbours are
factored into a node that holds the bits they share (a mask and a pattern), runs of nodes into upper nodes, and so on.
A search goes down from the roots, adds up the differing bits of each node that its ancestors have not
yet compared, and drops a whole group as soon as the sum passes the bound. The roots of the
pieces (at most ``MOST_PIECES``) are the leaves of an upper index that routes every fingerprint
to the later pieces that may hold a neighbour; inside a piece the search ends at fingerprints.

Only distinct fingerprints are searched, and a search passes over groups that already belong to
the searching fingerprint's component, so a task returns no more links than join components:
every pair within the bound ends up in one component, and no group's pairs are listed. Pieces
that many fingerprints are routed to are split by the searching side (``SEARCHES``).

Edge cases: null, empty and wordless texts have fingerprint zero, which is linked like any
other; a text of one or two words is one shingle; copies share a fingerprint; texts of any
length count whole; ids may be of any ordered type, repeat or be null (a component without an id
has a null ``component_id``); an empty table gives an empty result; other columns of the input
do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.near_dedup import components
from alphaloom.llm.storage import settle
from alphaloom.operators.staging import discard

SHINGLE = 3
SEED = 42
BOUND = 2
FAN = 8
LEAST_PIECES, MOST_PIECES, PIECE = 64, 4096, 65536
SEARCHES = 1_000_000  # searches in one split of a piece
BLOCK, FRONTIER = 1024, 500_000  # searches that go down together, and entries of a level expanded at once
HASHES = 100_000  # shingles whose bits are counted at once
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_U = np.uint64


# ---- fingerprints


def _fingerprint(text: bytes) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.append(0, end[:-1] + 1).tolist()
    n = max(1, len(words) - SHINGLE + 1)
    end = end[min(SHINGLE, len(words)) - 1 :].tolist()
    bits = np.zeros(64, np.int64)
    for a in range(0, n, HASHES):
        h = [xxhash.xxh64_intdigest(joined[p:q], SEED) for p, q in zip(start[a : a + HASHES], end[a : a + HASHES])]
        bits += np.unpackbits(np.array(h, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [_fingerprint(t) for t in b.column("_t").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(made, pa.int64())], names=["_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id`` and ``fp`` (64 bits as a signed number) of every row."""
    own = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_t"))
    return own.mapInArrow(_fingerprints, f"_id {docs.schema[doc_id].dataType.simpleString()}, fp BIGINT")


# ---- index


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Position of unsigned codes in the reflected Gray code."""
    for s in (1, 2, 4, 8, 16, 32):
        code = code ^ (code >> _U(s))
    return code


def gray_order(code: F.Column) -> F.Column:
    """A signed number that sorts like the Gray rank of 64-bit codes."""
    for s in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, s))
    return code.bitwiseXOR(F.lit(-(2**63)))


class GrayIndex:
    """Levels of (pattern, mask) over leaves in Gray order; ``levels[0]`` are the leaves, the last has at most ``FAN`` nodes."""

    def __init__(self, pattern: np.ndarray, mask: np.ndarray):
        self.levels = [(pattern, mask)]
        while len(pattern) > FAN:
            at = np.arange(0, len(pattern), FAN)
            all_set, any_set = np.bitwise_and.reduceat(pattern, at), np.bitwise_or.reduceat(pattern, at)
            mask = np.bitwise_and.reduceat(mask, at) & ~(all_set ^ any_set)
            pattern = all_set & mask
            self.levels.append((pattern, mask))
        self.label: list[np.ndarray] = [np.full(len(p), -1) for p, _ in self.levels]

    def relabel(self, component: np.ndarray) -> None:
        """Labels each node with the component that all its leaves are in, or -1."""
        self.label = [component]
        for p, _ in self.levels[1:]:
            below, at = self.label[-1], np.arange(len(p)) * FAN
            low = np.minimum.reduceat(below, at)
            self.label.append(np.where(low == np.maximum.reduceat(below, at), low, -1))

    def search(self, code: np.ndarray, own: np.ndarray, bound: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (search, leaf) whose compared bits differ in at most ``bound``, part by part; groups labelled ``own`` are passed over."""
        top = len(self.levels) - 1
        n = len(self.levels[top][0])
        many = len(code)
        work = [(top, np.repeat(np.arange(many), n), np.tile(np.arange(n), many), np.zeros(many * n, np.int64))]
        while work:
            level, q, node, diff = work.pop()
            pattern, mask = self.levels[level]
            fresh = mask[node]
            if level < top:
                fresh = fresh & ~self.levels[level + 1][1][node // FAN]
            diff = diff + np.bitwise_count((code[q] ^ pattern[node]) & fresh)
            on = np.flatnonzero((diff <= bound) & (self.label[level][node] != own[q]))
            q, node, diff = q[on], node[on], diff[on]
            if not level:
                if len(q):
                    yield q, node
                continue
            size = len(self.levels[level - 1][0])
            for a in range(0, len(q), FRONTIER // FAN):
                s = slice(a, a + FRONTIER // FAN)
                child = (node[s, None] * FAN + np.arange(FAN)).ravel()
                inside = child < size
                work.append((level - 1, np.repeat(q[s], FAN)[inside], child[inside], np.repeat(diff[s], FAN)[inside]))


class _Components:
    """Union-find over leaves and searches of one piece."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def flat(self) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                return up
            self.root = up

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Joins pairs; returns which of them joined two components."""
        used = []
        left = np.arange(len(a))
        while True:
            root = self.flat()
            ra, rb = root[a[left]], root[b[left]]
            left, ra, rb = left[ra != rb], ra[ra != rb], rb[ra != rb]
            if not len(left):
                return np.array(used, np.int64)
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            _, one = np.unique(high, return_index=True)  # each higher root hangs below one lower root
            self.root[high[one]] = low[one]
            used.extend(left[one].tolist())


def piece_links(leaves: np.ndarray, own: np.ndarray, routed: np.ndarray, bound: int = BOUND) -> np.ndarray:
    """Pairs of codes that join the components of ``leaves`` and ``routed`` codes; leaves marked ``own`` search too."""
    order = np.argsort(gray_rank(leaves), kind="stable")
    leaves, own = leaves[order], own[order]
    index = GrayIndex(leaves, np.full(len(leaves), _U(2**64 - 1)))
    searches = np.concatenate([leaves[own], routed])
    node = np.concatenate([np.flatnonzero(own), len(leaves) + np.arange(len(routed))])
    found = _Components(len(leaves) + len(routed))
    out = []
    for a in range(0, len(searches), BLOCK):
        root = found.flat()
        index.relabel(root[: len(leaves)])
        mine = node[a : a + BLOCK]
        for q, leaf in index.search(searches[a : a + BLOCK], root[mine], bound):
            new = found.join(mine[q], leaf)
            out.append(np.stack([searches[a : a + BLOCK][q[new]], leaves[leaf[new]]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), _U)


# ---- Spark


def _codes(column: pd.Series) -> np.ndarray:
    return column.to_numpy(np.int64).view(_U)


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of every (``piece``, ``split``) in rows sorted by these; kind 0: leaf, 1: leaf that searches, 2: routed."""

    def links(g: pd.DataFrame) -> pd.DataFrame:
        code, kind = _codes(g["fp"]), g["kind"].to_numpy()
        pairs = piece_links(code[kind < 2], kind[kind < 2] == 1, code[kind == 2])
        return pd.DataFrame(pairs.view(np.int64), columns=["a", "b"])

    rest: list[pd.DataFrame] = []
    for b in batches:
        for key, g in b.groupby(["piece", "split"], sort=False):
            if rest and tuple(rest[0].iloc[0][["piece", "split"]]) != key:
                yield links(pd.concat(rest))
                rest = []
            rest.append(g)
    if rest:
        yield links(pd.concat(rest))


def neighbour_links(codes: DataFrame, bound: int = BOUND) -> DataFrame:
    """Links (``a``, ``b``) that join all codes of the distinct ``fp`` of ``codes`` with at most ``bound`` differing bits into components."""
    spark = codes.sparkSession
    many = codes.count()
    pieces = max(LEAST_PIECES, min(MOST_PIECES, many // PIECE))
    cut = settle(codes.select("fp").repartitionByRange(pieces, gray_order(F.col("fp"))).withColumn("piece", F.spark_partition_id()))
    roots = cut.groupBy("piece").agg(F.bit_and("fp").alias("all_set"), F.bit_or("fp").alias("any_set")).orderBy("piece").collect()  # a row per piece
    number, all_set, any_set = (np.array([r[c] for r in roots], np.int64) for c in ("piece", "all_set", "any_set"))
    sent = spark.sparkContext.broadcast((number, all_set.view(_U), ~(all_set ^ any_set).view(_U)))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, pattern, mask = sent.value
        index = GrayIndex(pattern & mask, mask)
        for b in batches:
            code, piece = _codes(b["fp"]), b["piece"].to_numpy()
            for a in range(0, len(code), BLOCK):
                for q, leaf in index.search(code[a : a + BLOCK], np.full(len(code[a : a + BLOCK]), -2), bound):
                    later = number[leaf] > piece[a + q]
                    yield pd.DataFrame({"piece": number[leaf[later]], "fp": code[a + q[later]].view(np.int64)})

    routed = settle(cut.mapInPandas(route, "piece INT, fp BIGINT"))
    loads = spark.createDataFrame(
        [(r["piece"], 1 + r["count"] // SEARCHES) for r in routed.groupBy("piece").count().collect()], "piece INT, splits INT"
    )  # a row per piece
    salt = F.expr("CAST(pmod(xxhash64(fp), splits) AS INT)")
    members = cut.join(F.broadcast(loads), "piece", "left").withColumn("splits", F.coalesce("splits", F.lit(1)))
    members = members.withColumn("salt", salt).withColumn("split", F.explode(F.expr("sequence(0, splits - 1)")))
    members = members.select("piece", "split", (F.col("split") == F.col("salt")).cast("int").alias("kind"), "fp")
    searches = routed.join(F.broadcast(loads), "piece").select("piece", salt.alias("split"), F.lit(2).alias("kind"), "fp")
    rows = members.unionByName(searches).repartition("piece", "split").sortWithinPartitions("piece", "split")
    out = settle(rows.mapInPandas(_links, "a BIGINT, b BIGINT"))
    discard(cut)
    discard(routed)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bound: int = BOUND) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` (least id that links reach) of every row."""
    marked = settle(fingerprints(docs, doc_id, text))
    codes = settle(marked.groupBy("fp").agg(F.min("_id").alias("least")))
    found = components(neighbour_links(codes, bound))
    rooted = settle(codes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    out = marked.join(named, "fp")
    return out.select(F.col("_id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
