"""Byte-level BPE over many texts at once: vectorised pre-tokens, cached merges.

The vocabulary file, its split pattern and its special strings are those of the installed
tokenizer library; character classes are asked of the library's own pre-tokenizer. Only
distinct pre-tokens of a block of texts reach Python code; counts need no identifiers.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd

BLOCK_CHARS = 300_000  # characters handled at once; a longer text is a block of its own
CACHE_ENTRIES = 50_000  # pre-tokens whose ids a worker keeps, some 250 bytes each
CACHE_COUNTS = 1_000_000  # pre-tokens whose number of tokens it keeps, some 100 bytes each, as merging takes long
LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)
_U = np.uint64
_POWER = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Vocabulary:
    """Pre-token splitter, merge table and encoder of one vocabulary file, kept per worker."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        self.pre = own.pre_tokenizer
        self.special = {t.content: i for i, t in own.get_added_tokens_decoder().items()}
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.powers = self.inverse = np.ones(1, _U)
        model = json.load(open(path, encoding="utf-8"))["model"]
        # the byte alphabet of byte-level BPE: printable characters stand for themselves
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        back = {c: b for b, c in shown.items()}
        vocab = model["vocab"]
        self.first = [vocab[shown[b]] for b in range(256)]
        self.merge: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merge[vocab[a] << 20 | vocab[b]] = rank, vocab[a + b]
        ranks = {bytes(back[c] for c in s): i for s, i in vocab.items() if s not in self.special}
        self.piece = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.counts: dict[int, int] = {}
        self.ids: dict[int, list[int]] = {}

    def _learn(self, points: np.ndarray) -> None:
        for p in np.unique(points):
            c = chr(p)
            joins = [len(self.pre.pre_tokenize_str(x + c)) == 1 for x in "a1!"]
            self.classes[p] = joins.index(True) if any(joins) else SPACE

    def _weights(self, n: int) -> None:
        if len(self.powers) < n or len(self.powers) > BLOCK_CHARS + 1 >= n:  # those of a long text go with the next block
            n = max(n, BLOCK_CHARS + 1)
            for name, factor in (("powers", _POWER), ("inverse", pow(_POWER, -1, 2**64))):
                steps = np.full(n, factor, _U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points, pre-token starts, number of pre-tokens of each text, 64-bit pre-token hashes."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        n = len(points)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.cumsum(lengths) - lengths
        if not n:
            return points, np.zeros(0, np.int64), np.zeros(len(texts), np.int64), np.zeros(0, _U)
        kind = self.classes[points]
        if (kind == UNKNOWN).any():
            self._learn(points[kind == UNKNOWN])
            kind = self.classes[points]
        opens = np.zeros(n + 1, bool)  # a text begins here
        opens[at] = True
        opens[n] = True
        change = opens.copy()
        change[1:n] |= kind[1:] != kind[:-1]
        runs = np.flatnonzero(change[:n])
        ends = np.append(runs[1:], n)
        start = change.copy()
        led = (kind[runs] == SPACE) & ~opens[ends]  # white space before a word: its last character stands apart or joins the word
        start[ends[led] - 1] = True
        start[ends[led][points[ends[led] - 1] == 0x20]] = False
        self._contractions(points, kind, change, opens, start, runs, ends)
        starts = np.flatnonzero(start[:n])
        self._weights(n + 1)
        mixed = (points.astype(_U) + _U(1)) * _U(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> _U(29)
        total = np.zeros(n + 1, _U)
        np.cumsum(mixed * self.powers[:n], out=total[1:])
        hashes = (total[np.append(starts[1:], n)] - total[starts]) * self.inverse[starts]
        hashes ^= hashes >> _U(32)
        number = np.diff(np.append(np.searchsorted(starts, at), len(starts)))
        return points, starts, number, hashes

    @staticmethod
    def _contractions(points, kind, change, opens, start, runs, ends) -> None:
        """'s 't 'm 'd and 're 've 'll after no space are pre-tokens, even inside a longer word."""
        n = len(points)
        alone = runs[(points[runs] == 0x27) & (ends - runs == 1)]
        alone = alone[start[alone]]
        alone = alone[(alone + 1 < n)]
        alone = alone[~opens[alone + 1] & (kind[alone + 1] == LETTER)]
        if not len(alone):
            return
        a = points[alone + 1]
        b = np.where((alone + 2 < n) & ~change[np.minimum(alone + 2, n)], points[np.minimum(alone + 2, n - 1)], 0)
        long = np.zeros(len(alone), bool)
        for x, y in ("re", "ve", "ll"):
            long |= (a == ord(x)) & (b == ord(y))
        short = np.isin(a, [ord(c) for c in "stmd"])
        for mask, size in ((short, 2), (long & ~short, 3)):
            start[alone[mask] + 1] = False
            start[alone[mask] + size] = True

    def _distinct(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], list[str]]:
        points, starts, number, hashes = self.split(texts)
        codes, found = pd.factorize(hashes)
        first = np.empty(len(found), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        ends = np.append(starts[1:], len(points))
        text = "".join(texts)
        return number, codes, first, found.tolist(), [text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]

    def merged_size(self, piece: bytes) -> int:
        """Initial symbols minus merges: the lowest-rank adjacent pair is merged until none is left."""
        n = len(piece)
        if n < 2:
            return n
        merge = self.merge
        symbol = [self.first[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if m := merge.get(symbol[i] << 20 | symbol[i + 1]):
                heap.append((m[0], i, m[1]))
        heapq.heapify(heap)
        left = n
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i] if symbol[i] >= 0 else n
            if j >= n or merge.get(symbol[i] << 20 | symbol[j], (-1, -1)) != (rank, new):
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = new, -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merge.get(new << 20 | symbol[k]):
                    heapq.heappush(heap, (m[0], i, m[1]))
            if (h := before[i]) >= 0 and (m := merge.get(symbol[h] << 20 | new)):
                heapq.heappush(heap, (m[0], h, m[1]))
        return left

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text without special strings in it."""
        number, codes, _, found, pieces = self._distinct(texts)
        cache = self.counts
        if len(cache) > CACHE_COUNTS:
            cache.clear()
        sizes = np.empty(len(found), np.int64)
        for k, h in enumerate(found):
            c = cache.get(h)
            if c is None:
                c = cache[h] = self.merged_size(pieces[k].encode())
            sizes[k] = c
        return _sums(sizes[codes], number)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and the number of ids of each text."""
        number, codes, _, found, pieces = self._distinct(texts)
        cache = self.ids
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        own = []
        single = self.piece.encode_ordinary
        for k, h in enumerate(found):
            c = cache.get(h)
            if c is None:
                c = cache[h] = single(pieces[k])
            own.append(c)
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        pool = np.fromiter(chain.from_iterable(own), np.uint32, int(sizes.sum()))
        offset = np.cumsum(sizes) - sizes
        each = sizes[codes]
        begin = np.cumsum(each) - each
        ids = pool[np.repeat(offset[codes] - begin, each) + np.arange(int(each.sum()))]
        return ids, _sums(each, number)

    def fragments(self, texts: list[str]) -> tuple[list[str], np.ndarray, list[list[int]]]:
        """Texts cut at special strings: all fragments, their number in each text, the special ids between them."""
        parts, number, between = [], np.ones(len(texts), np.int64), []
        for k, t in enumerate(texts):
            cut, ids = [t], []
            for s, i in self.special.items():
                if s in t:
                    out, marks = [], []
                    for f, old in zip(cut, [*ids, None], strict=True):
                        p = f.split(s)
                        out += p
                        marks += [i] * (len(p) - 1) + ([] if old is None else [old])
                    cut, ids = out, marks
            parts += cut
            number[k] = len(cut)
            between.append(ids)
        return parts, number, between


def _sums(values: np.ndarray, number: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values))
    last = np.cumsum(number)
    return total[last] - total[last - number]


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``BLOCK_CHARS`` characters, or one longer text."""
    a = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > BLOCK_CHARS:
            yield a, k
            a, size = k, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)
