"""Substrings that an earlier document holds too, found with compressed FM-indexes.

Equal windows of ``SPAN`` words have the same smallest ``GRAM``-gram hash, their anchor. Every
document is cut into segments, runs of windows with one anchor, and segments are sharded by
anchor, so a shard holds every copy of the windows it gets. Anchors of one document alone are
dropped before any text moves; copies of a segment become one row before they reach a shard
(first and last document); anchors of very many documents are sharded window by window.

A shard is indexed block by block: word numbers, suffixes ordered by their first 16 words, the
Burrows-Wheeler transform in a wavelet matrix of packed bits. Segments are streamed through it
from right to left: backward search extends the current interval by one word, and matches
longer than the threshold give up their last word. For every window at the threshold the
index reports the least document of its interval.

Edge cases: null, empty and short texts have no windows; texts of any length are cut whole;
columns of the input other than id and text do not matter; ids should be unique, equal rows
(id included) get equal results and do not count as copies of each other; empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.storage import settle
from alphaloom.llm.wordhash import Words, blocks, mix, sliding_min

SPAN = 13
GRAM = 4
ORDER = 16  # words by which suffixes are sorted: at least SPAN
MOST_WINDOWS = 64  # windows of one segment; a longer run is cut
BUSY_ANCHOR = 20_000  # documents of an anchor from which its windows are sharded one by one
BLOCK_WORDS = 300_000
_U = np.uint64


class FMIndex:
    """Index of one symbol sequence (symbols 1 and up, 0 between segments) for patterns of at most ``ORDER`` symbols."""

    def __init__(self, text: np.ndarray, owner: np.ndarray, span: int):
        n, self.span = len(text), span
        rank = text.astype(np.int64)
        at, ranks = 1, {1: rank}
        while at < ORDER:
            after = np.zeros(n, np.int64)
            after[: max(0, n - at)] = rank[at:]
            key = rank * (int(rank.max(initial=0)) + 1) + after
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.append(1, key[order][1:] != key[order][:-1])) if n else 0
            rank, at = new, at * 2
            ranks[at] = rank
        self.suffixes = order if n else np.zeros(0, np.int64)
        bwt = text[self.suffixes - 1]  # the text ends with 0, so the first suffix wraps to a separator
        self.least = np.searchsorted(text[self.suffixes], np.arange(int(text.max(initial=0)) + 2)).astype(np.int64)
        self._wavelet(bwt.astype(np.int64))
        # groups of suffixes with equal first ``span`` symbols, and the least owner of each
        half = ORDER // 2
        late = np.zeros(n, np.int64)
        late[: max(0, n - (span - half))] = ranks[half][span - half :]
        a, b = ranks[half][self.suffixes], late[self.suffixes]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[:n]
        self.group = np.cumsum(new) - 1
        self.begin = np.flatnonzero(new)
        self.finish = np.append(self.begin[1:], n)
        self.owner = np.minimum.reduceat(owner[self.suffixes], self.begin) if n else owner[:0]

    def _wavelet(self, bwt: np.ndarray) -> None:
        """Levels of packed bits, most significant first; zeros of a level move to the front of the next."""
        self.levels = []
        width = max(1, int(bwt.max(initial=0)).bit_length())
        for level in range(width - 1, -1, -1):
            bit = (bwt >> level) & 1
            packed = np.packbits(np.append(bit, np.zeros(-len(bit) % 64 + 64, np.int64)).astype(np.uint8), bitorder="little").view(_U)
            ones = np.append(0, np.cumsum(np.bitwise_count(packed).astype(np.int64)))
            zeros = int(len(bit) - bit.sum())
            self.levels.append((level, packed, ones, zeros))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])

    def occurrences(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each position, plus the start of its last level's range."""
        low, high = np.zeros(len(symbol), np.int64), before
        for level, packed, ones, zeros in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            out = []
            for x in (low, high):
                word = x >> 6
                r = ones[word] + np.bitwise_count(packed[word] & ((_U(1) << (x & 63).astype(_U)) - _U(1))).astype(np.int64)
                out.append(np.where(one, zeros + r, x - r))
            low, high = out
        return high - low

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: intervals of the patterns with one more symbol in front."""
        both = self.occurrences(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.least[symbol]
        return base + both[: len(low)], base + both[len(low) :]

    def window_owners(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of streamed segments, cut at ``span``: window starts in ``text`` and the least owner of each.

        Segments are kept in order of length, so those that end early fall off the back.
        """
        order = np.argsort(start - end, kind="stable")
        begin, at = start[order], end[order].copy()
        low, high, matched = np.zeros(len(at), np.int64), np.full(len(at), len(self.suffixes)), 0
        places, owners = [], []
        while len(at):
            at = at - 1
            low, high = self.extend(text[at], low, high)
            matched += 1
            if matched > self.span:  # one word too long: back to the interval of the first ``span``
                g = self.group[low]
                low, high = self.begin[g], self.finish[g]
            if matched >= self.span:
                g = self.group[low]
                hit = high > low
                places.append(at[hit])
                owners.append(self.owner[g[hit]])
            live = int(np.count_nonzero(at > begin))
            at, begin, low, high = at[:live], begin[:live], low[:live], high[:live]
        if not places:
            return start[:0], self.owner[:0]
        return np.concatenate(places), np.concatenate(owners)


def _runs(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and anchor of every segment of the texts."""
    least = sliding_min(w.grams(GRAM), SPAN - GRAM + 1)
    n = len(least)
    counts = np.diff(w.first)
    past = np.repeat(w.first[1:], counts)[:n]
    text = np.repeat(np.arange(len(counts)), counts)[:n]
    whole = np.arange(n) + SPAN <= past
    begins = whole.copy()
    begins[1:] &= (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(begins)
    if not len(first):
        return first, first, least[:0]
    size = np.add.reduceat(whole.astype(np.int64), first)
    parts = -(-size // MOST_WINDOWS)
    at = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(first, parts) + at * MOST_WINDOWS
    return start, np.minimum(MOST_WINDOWS, np.repeat(first + size, parts) - start), np.repeat(least[first], parts)


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The distinct anchors of every document."""
    for b in batches:
        raw = [t.encode() for t in b["_t"]]
        ids = b["_id"].to_numpy()
        for x, y in blocks([len(r) for r in raw]):
            w = Words(raw[x:y])
            start, _, anchor = _runs(w)
            doc = np.searchsorted(w.first, start, "right") - 1
            out = pd.DataFrame({"anchor": anchor.view(np.int64) >> 12, "_id": ids[x:y][doc]})
            yield out.drop_duplicates()


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments with an anchor that other documents have too, with their words."""
    for b in batches:
        raw = [t.encode() for t in b["_t"]]
        ids = b["_id"].to_numpy()
        shared, busy = b["shared"].tolist(), b["busy"].tolist()
        for x, y in blocks([len(r) for r in raw]):
            w = Words(raw[x:y])
            start, size, anchor = _runs(w)
            anchor = anchor.view(np.int64) >> 12
            doc = np.searchsorted(w.first, start, "right") - 1
            edge = np.searchsorted(doc, np.arange(y - x + 1))
            keep, single = np.zeros(len(start), bool), np.zeros(len(start), bool)
            for k in range(y - x):
                s = slice(edge[k], edge[k + 1])
                keep[s] = np.isin(anchor[s], shared[x + k])
                if len(busy[x + k]):
                    single[s] = np.isin(anchor[s], busy[x + k])
            start, size, anchor, doc, single = (v[keep] for v in (start, size, anchor, doc, single))
            # windows of busy anchors one by one, each with a route of its own
            times = np.where(single, size, 1)
            step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            start, doc = np.repeat(start, times) + step, np.repeat(doc, times)
            size = np.where(np.repeat(single, times), 1, np.repeat(size, times))
            own = np.repeat(single, times)
            route = np.repeat(anchor, times)
            past = start + size + SPAN - 1
            key = np.zeros(len(start), _U)
            for n in np.unique(past - start):
                g = np.flatnonzero(past - start == n)
                h = np.zeros(len(g), _U)
                for j in range(n):
                    h = h * _U(0x9E3779B97F4A7C15) + w.hash[start[g] + j]
                key[g] = mix(h + _U(n))
            key = key.view(np.int64)
            route = np.where(own, key, route)
            data = w.data.tobytes()
            text = [b" ".join(data[p:q].split()) for p, q in zip(w.start[start].tolist(), w.end[past - 1].tolist(), strict=True)]
            yield pd.DataFrame({"route": route, "key": key, "_id": ids[x:y][doc], "start": (start - w.first[doc]).astype(np.int32), "words": text})


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Least document of every window of the distinct segments of a shard, block by block of whole routes."""

    def index(rows: pd.DataFrame) -> pd.DataFrame:
        split = [s.split() for s in rows["words"]]
        size = np.fromiter(map(len, split), np.int64, len(split))
        end = np.cumsum(size + 1) - 1
        start = end - size
        codes, _ = pd.factorize(np.array([x for s in split for x in s], object))
        text = np.zeros(int(end[-1]) + 1, np.int64)
        inside = np.ones(len(text), bool)
        inside[end] = False
        text[inside] = codes + 1
        place, owner = FMIndex(text, np.repeat(rows["least"].to_numpy(), size + 1), SPAN).window_owners(text, start, end)
        owners = np.full(len(text), np.iinfo(np.int64).max)
        owners[place] = owner
        last = rows["last"].to_numpy()
        useful = np.minimum.reduceat(owners, start) < last
        out = rows.loc[useful, ["route", "key"]].copy()
        found = [owners[a : b - SPAN + 1] for a, b in zip(start[useful].tolist(), end[useful].tolist(), strict=True)]
        out["least"] = pd.Series(found, out.index, object)  # also where no segment repeats a window
        return out

    rest, words = [], 0
    for b in batches:  # sorted by route
        edges = np.flatnonzero(b["route"].to_numpy()[1:] != b["route"].to_numpy()[:-1]) + 1
        size = np.append(0, np.cumsum([x.count(b" ") + 2 for x in b["words"]]))
        a = 0
        if rest and len(b) and rest[-1]["route"].iloc[-1] != b["route"].iloc[0]:
            edges = np.append(0, edges)
        for e in edges.tolist():
            if words + size[e] - size[a] >= BLOCK_WORDS:
                yield index(pd.concat([*rest, b.iloc[a:e]], ignore_index=True))
                rest, words, a = [], 0, e
        if a < len(b):
            rest.append(b.iloc[a:])
            words += size[-1] - size[a]
    if rest:
        yield index(pd.concat(rest, ignore_index=True))


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id`` and ``starts``: word positions of the windows that a document with a smaller id has too.

    Shared anchors and indexed windows are staged, so that the shuffles of one step are gone
    before the next one begins.
    """
    own = _bare(docs, doc_id, text).filter("_id IS NOT NULL")
    anchors = own.mapInPandas(_anchors, "anchor BIGINT, _id BIGINT")
    seen = anchors.groupBy("anchor").agg(F.min("_id").alias("a"), F.max("_id").alias("b"), F.count(F.lit(1)).alias("n"))
    seen = seen.filter("a < b").select("anchor", (F.col("n") > BUSY_ANCHOR).alias("busy"))
    flags = anchors.join(seen, "anchor").groupBy("_id").agg(F.collect_list("anchor").alias("shared"), F.expr("collect_list(anchor) FILTER (WHERE busy)").alias("busy"))
    flags = settle(flags)
    cut = own.join(flags, "_id").mapInPandas(_segments, "route BIGINT, key BIGINT, _id BIGINT, start INT, words BINARY")
    distinct = cut.groupBy("route", "key").agg(F.min("_id").alias("least"), F.max("_id").alias("last"), F.min("words").alias("words"))
    owners = settle(distinct.repartition("route").sortWithinPartitions("route").mapInPandas(_search, "route BIGINT, key BIGINT, least ARRAY<BIGINT>"))
    hits = cut.select("route", "key", "_id", "start").join(owners, ["route", "key"])
    hits = hits.selectExpr("_id", "filter(transform(least, (x, i) -> CASE WHEN x < _id THEN start + i END), x -> x IS NOT NULL) AS starts")
    return hits.filter("size(starts) > 0").groupBy("_id").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def _bare(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))


def _removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for t, starts in zip(b["_t"], b["starts"], strict=True):
            words = t.encode().split()
            if starts is not None and len(starts):
                cover = np.zeros(len(words) + 1, np.int64)
                s = np.unique(starts)
                s = s[s + SPAN <= len(words)]  # rows of one id with different texts
                cover[s] += 1
                cover[s + SPAN] -= 1
                keep = np.cumsum(cover)[:-1] == 0
                kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            else:
                kept = words
            rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
        out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])
        out.insert(0, "_id", b["_id"].to_numpy())
        yield out


def remove_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and the ``kept`` words of every document, joined by one space."""
    own = _bare(docs, doc_id, text)
    out = own.join(repeated_windows(docs, doc_id, text), "_id", "left").withColumn("_id", F.col("_id").cast("string"))  # a null would turn the longs of a batch into doubles
    out = out.mapInPandas(_removed, "_id STRING, n_words BIGINT, n_removed BIGINT, kept STRING")
    return out.select(F.col("_id").cast("long").alias(doc_id), "n_words", "n_removed", "kept")

