"""Packing of token sequences: exact complements by length counts, then best fit.

Documents become pieces of at most ``CAPACITY`` tokens. All that packing needs to know is how
many pieces there are of each length, at most ``CAPACITY`` numbers. On these counts the plan
fills gaps exactly with one, two or three lengths (found by their sums) as often as all of
them are available, then places what is left best-fit, longest first. The plan's rows are
runs: piece ``first_rank + k`` of a length goes to sequence ``first_sequence + k`` at a fixed
offset; their number depends on the lengths that occur, not on how many pieces have them.
Ranks within a length are counted bucket by bucket, so a common length is never in one task.

Edge cases: null and empty texts are the end mark alone; texts of any length are cut, none is
dropped; repeated rows are packed as often as they occur; an empty table gives no sequences.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.llm import bpe
from alphaloom.llm.storage import settle, small_table

CAPACITY = 2048
BUCKET_ROWS = 100_000
END = 0


def token_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length`` and ``ids_crc32``; only a document's first piece may be short."""
    path = vocabulary or bpe.default_vocabulary()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = bpe.vocabulary(path)
        end = np.array([END], np.uint32)
        for b in batches:
            texts, names, rows = b["_t"].tolist(), b["_id"].tolist(), []
            for x, y in bpe.blocks(texts):
                parts, number, between = v.fragments(texts[x:y])
                ids, sizes = v.encode(parts)
                past = np.cumsum(sizes).tolist()
                at = f = 0
                for k in range(x, y):
                    own = []
                    for mark in [*between[k - x], None]:
                        own.append(ids[at : past[f]])
                        at, f = past[f], f + 1
                        if mark is not None:
                            own.append(np.array([mark], np.uint32))
                    whole = np.concatenate([*own, end]).astype("<u4", copy=False)
                    n = len(whole)
                    first = n - (-(-n // capacity) - 1) * capacity
                    edges = [0, *range(first, n + 1, capacity)]
                    rows += [(names[k], j, s, e - s, zlib.crc32(whole[s:e].tobytes())) for j, (s, e) in enumerate(zip(edges, edges[1:], strict=False))]
            yield pd.DataFrame(rows, columns=["_id", "piece", "start", "length", "ids_crc32"])

    # ids pass through as text: a null would turn the longs of a batch into doubles
    flat = docs.select(F.col(doc_id).cast("string").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    out = flat.mapInPandas(cut, "_id STRING, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT")
    return out.select(F.col("_id").cast(docs.schema[doc_id].dataType).alias(doc_id), "piece", "start", "length", "ids_crc32")


class _Counts:
    """Available pieces by length, with bit sets of the available lengths for sums of two."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n, self.capacity = defaultdict(int, counts), capacity
        self.used: dict[int, int] = defaultdict(int)
        self.has = sum(1 << x for x, n in counts.items() if n)
        self.mirror = sum(1 << (capacity - x) for x, n in counts.items() if n)

    def times(self, lengths: tuple[int, ...]) -> int:
        return min(self.n[x] // lengths.count(x) for x in set(lengths))

    def take(self, length: int, n: int) -> int:
        """Reserves ``n`` pieces; returns the rank of the first."""
        rank = self.used[length]
        self.used[length] += n
        self.n[length] -= n
        if not self.n[length]:
            self.has &= ~(1 << length)
            self.mirror &= ~(1 << (self.capacity - length))
        return rank

    def pair(self, total: int, most: int, also: tuple[int, ...]) -> tuple[int, ...] | None:
        """Two lengths of at most ``most`` with this sum, available beside ``also``; the longest first."""
        if total < 2:
            return None
        both = self.has & (self.mirror >> (self.capacity - total)) & ((1 << (most + 1)) - 1)
        while both:
            x = both.bit_length() - 1
            if 2 * x < total:
                return None
            if self.times((*also, x, total - x)):
                return x, total - x
            both &= ~(1 << x)
        return None

    def complement(self, length: int) -> tuple[int, ...] | None:
        """The lengths that fill a sequence exactly beside ``length``: none, one, two or three."""
        gap = self.capacity - length
        if not gap:
            return ()
        if self.has >> gap & 1 and self.times((length, gap)):
            return (gap,)
        if found := self.pair(gap, gap, (length,)):
            return found
        first = self.has & ((1 << gap) - 1)
        while first:
            x = first.bit_length() - 1
            if 3 * x < gap:
                return None
            if self.times((length, x)) and (found := self.pair(gap - x, x, (length, x))):
                return x, *found
            first &= ~(1 << x)
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first_rank, pieces, first_sequence, offset) that place every counted piece."""
    c, runs, sequences = _Counts(counts, capacity), [], 0
    lengths = sorted((x for x, n in counts.items() if n), reverse=True)
    for x in lengths:
        while c.n[x] and (rest := c.complement(x)) is not None:
            whole = (x, *rest)
            n, offset = c.times(whole), 0
            for y in whole:
                runs.append((y, c.take(y, n), n, sequences, offset))
                offset += y
            sequences += n
    open_runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first sequence, sequences)
    gaps = 0
    for x in lengths:
        while n := c.n[x]:
            fits = gaps >> x
            if fits:
                gap = x + (fits & -fits).bit_length() - 1
                first, many = open_runs[gap].pop()
                if many > n:
                    open_runs[gap].append((first + n, many - n))
                if not open_runs[gap]:
                    gaps &= ~(1 << gap)
                k = min(n, many)
            else:
                k, gap = -(-n // (capacity // x)), capacity
                first, sequences = sequences, sequences + k
            runs.append((x, c.take(x, k), k, first, capacity - gap))
            if gap > x:
                open_runs[gap - x].append((first, k))
                gaps |= 1 << (gap - x)
    return runs


def pack(pieces: DataFrame, keys: list[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; lengths are 1 to ``capacity``, ``keys`` tell pieces of equal length apart.

    ``pieces`` has to give the same rows whenever it is read (a stored table).
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # at most ``capacity`` rows
    runs = sorted(plan(counts, capacity))
    parts = small_table(spark, {length: (pa.int64(), list(counts)), "_parts": (pa.int64(), [-(-n // BUCKET_ROWS) for n in counts.values()])})
    dealt = pieces.join(F.broadcast(parts), length).withColumn("_part", F.expr(f"pmod(xxhash64({', '.join(f'`{k}`' for k in keys)}), _parts)")).drop("_parts")
    before = dealt.groupBy(length, "_part").count().withColumn(
        "_before", F.coalesce(F.sum("count").over(Window.partitionBy(length).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    ranked = dealt.withColumn("_row", F.row_number().over(Window.partitionBy(length, "_part").orderBy(*keys)))
    ranked = ranked.join(before.drop("count"), [length, "_part"]).withColumn("_rank", F.col("_before") + F.col("_row") - 1).drop("_part", "_before", "_row")
    table = spark.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 5))
    high = 2**44

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = table.value
        begin = t[:, 0] * high + t[:, 1]
        for b in batches:
            rank = b["_rank"].to_numpy()
            k = np.searchsorted(begin, b[length].to_numpy() * high + rank, "right") - 1
            out = b.drop(columns="_rank")
            out["sequence_id"] = t[k, 3] + rank - t[k, 1]
            out["offset"] = t[k, 4]
            yield out

    kinds = {f.name: f.dataType for f in ranked.schema if f.name != "_rank"}
    text = [k for k in keys if k != length]  # keys pass through as text, as they may be null
    ranked = ranked.withColumns({k: F.col(k).cast("string") for k in text})
    schema = ", ".join(f"`{c}` {'STRING' if c in text else kind.simpleString()}" for c, kind in kinds.items())
    out = ranked.mapInPandas(place, f"{schema}, sequence_id BIGINT, offset BIGINT")
    return out.withColumns({k: F.col(k).cast(kinds[k]) for k in text})


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    pieces = settle(token_pieces(docs, doc_id, text, vocabulary, capacity))
    return pack(pieces, [doc_id, "piece", "start", "ids_crc32"], capacity=capacity)
