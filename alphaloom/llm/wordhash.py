"""Words and word n-grams of many texts at once, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK_BYTES = 2_000_000  # texts handled at once; a longer text is a block of its own
_U = np.uint64
_POWER = _U(0x9E3779B97F4A7C15)
_UNPOWER = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, np.uint64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit hashes spread over the whole word."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = 1 << n.bit_length()
        made = []
        for p in (_POWER, _UNPOWER):
            steps = np.full(size if n <= BLOCK_BYTES + 2 else n, p, _U)
            steps[0] = 1
            made.append(np.cumprod(steps))
        if n > BLOCK_BYTES + 2:  # a text longer than a block: not kept
            return made[0], made[1]
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def blocks(sizes: list[int], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes add up to at most ``limit``, or of one larger item."""
    a = total = 0
    for k, s in enumerate(sizes):
        if total and total + s > limit:
            yield a, k
            a, total = k, 0
        total += s
    if a < len(sizes):
        yield a, len(sizes)


class Words:
    """Words between ASCII white space of UTF-8 texts: ``start`` and ``end`` bytes in ``data``, 64-bit ``hash``.

    ``first[k]`` is the first word of text ``k``; ``first`` has one more entry than there are texts.
    """

    def __init__(self, texts: list[bytes]):
        joined = b" ".join([b"", *texts, b""])
        self.data = np.frombuffer(joined, np.uint8)
        space = _SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.first = np.searchsorted(self.start, np.append(1, 1 + np.cumsum(sizes)))
        power, back = powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, _U)
        np.cumsum(_BYTE[self.data] * power[:-1], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * back[self.start] + (self.end - self.start).astype(_U))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the ``k`` words from each word on; those that pass the end of a text mean nothing."""
        h = self.hash
        n = max(0, len(h) - k + 1)
        out = np.zeros(n, _U)
        for j in range(k):
            out = out * _POWER + h[j : j + n]
        return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` neighbours from each position on."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    out, done = x, 1
    while done * 2 <= width:
        out = np.minimum(out[: len(out) - done], out[done:])
        done *= 2
    return np.minimum(out[:n], out[width - done : width - done + n])
