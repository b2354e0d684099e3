"""Collocations by multikey three-way quicksort of suffix pointers.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?]`` and line ends, and these into words
at spaces and tabs. Every word position is a suffix of up to ``LONGEST`` words of its piece.
Suffixes are routed by their leading word to as many routes as the corpus needs; the suffixes
of a word with more than an even route's share of all positions (so there are never more such
words than routes) are routed by their first two words for the counts of pairs and by all
three for the counts of triples. All suffixes that begin with a phrase thus meet in one route,
as blocks of distinct suffixes with their counts, made before the shuffle. A block is cut into at most
``FAN`` routes at once; where there are more, blocks of one coarse route are joined into large ones and cut again, so that
the number of cut blocks follows the corpus and not the corpus times the routes.

In a route, suffix pointers are partitioned three ways around the pivot word of their partition at its
depth. Pointers equal to the pivot go one word deeper, and the weight of that partition is
the count of the phrase; lesser and greater ones are partitioned again. Partitions lighter than
the least count are abandoned at once. All partitions of a depth of recursion are handled together, as numpy arrays.

Phrases of two and three words are scored by ``floor(10**6 a a / (l r))`` at their worst cut, in
exact decimals; the counts of the parts are joined by shuffle. A phrase that a longer one accounts
for to at least half goes.

Edge cases: a null or wordless text has no phrase; a null language is ``und``; texts of any
length count whole; repeated rows count as often as they occur; equal scores go by count, then by
the phrase's bytes; an empty table gives an empty result; other columns of the input do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.llm.storage import settle
from alphaloom.llm.wordhash import blocks, mix
from alphaloom.operators.staging import discard

LONGEST = 3
LEAST = 10
TOP = 2000
BLOCK = 4_000_000  # bytes of text whose suffixes are counted before the shuffle; of all languages a task holds four times that
JOINED = 500_000  # suffixes of blocks of one coarse route that are joined and cut again
FAN = 512  # routes that a block is cut into at once
ROUTE_WORDS, MOST_ROUTES = 400_000, 2**17
_BLOCKS = ["route", "lang", "kind", "words", "codes", "counts"]
WHOLE, PAIR, TRIPLE = 0, 1, 2  # what a routed block counts: phrases of two and three words, of two, of three
_BREAKS, _SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
_PLAIN = bytes(32 if i in _BREAKS + _SPACES else i + 32 if 65 <= i <= 90 else i for i in range(256))
_KIND = np.array([2 if i in _BREAKS else 1 if i in _SPACES else 0 for i in range(256)], np.uint8)
_U = np.uint64


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of each word, the piece it is in, and the distinct words."""
    data = b"\n".join([b"", *texts])
    kind = _KIND[np.frombuffer(data or b"\n", np.uint8)]
    starts = np.flatnonzero((kind[1:] == 0) & (kind[:-1] > 0)) + 1
    piece = np.cumsum(kind == 2)[starts]
    codes, found = pd.factorize(np.array(data.translate(_PLAIN).split(), object))
    return codes, piece, found


def _by_language(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list[bytes]]]:
    """Blocks of texts of one language; texts of several batches share a block."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for b in batches:
        for lang, g in b.groupby("lang", sort=False):
            raw = g["_t"].tolist()
            for x, y in blocks([len(t) for t in raw], BLOCK):
                more = sum(map(len, raw[x:y]))
                if size.get(lang, 0) + more > BLOCK and lang in held:
                    yield lang, held.pop(lang)
                    size.pop(lang)
                held.setdefault(lang, []).extend(raw[x:y])
                size[lang] = size.get(lang, 0) + more
                while sum(size.values()) > 4 * BLOCK:
                    most = max(size, key=size.get)
                    size.pop(most)
                    yield most, held.pop(most)
    yield from held.items()


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for lang, texts in _by_language(batches):
        codes, _, found = _words(texts)
        yield pd.DataFrame({"lang": lang, "phrase": pd.Series([w.decode() for w in found], dtype=object), "n": np.bincount(codes, minlength=len(found))})


def suffixes(codes: np.ndarray, piece: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes of at least two words as rows of ``LONGEST`` codes from 1 on (0: the piece has ended), and their counts."""
    rows = np.zeros((len(codes), LONGEST), np.int64)
    for d in range(LONGEST):
        n = max(0, len(codes) - d)
        rows[:n, d] = np.where(piece[d:] == piece[:n], codes[d:] + 1, 0)
    rows = rows[rows[:, 1] > 0]
    if words < 2**21 - 1:
        key, at, n = np.unique((rows[:, 0] << 42) | (rows[:, 1] << 21) | rows[:, 2], return_index=True, return_counts=True)
    else:
        _, pair = np.unique((rows[:, 0] << 32) | rows[:, 1], return_inverse=True)
        _, at, n = np.unique((pair << 32) | rows[:, 2], return_index=True, return_counts=True)
    return rows[at], n


def _hashes(found: np.ndarray, lang: str) -> np.ndarray:
    """Hash of each code's word; code 0 is none."""
    seed = zlib.crc32(lang.encode())
    return np.array([0, *(xxhash.xxh64_intdigest(w, seed) for w in found)], _U)


def _routes(rows: np.ndarray, kind: int, hashes: np.ndarray, routes: int) -> np.ndarray:
    """Route of each suffix, by its first word, its first two words or all three."""
    h = hashes[rows[:, 0]]
    for d in range(1, kind + 1):
        h = mix(h * _U(31) + hashes[rows[:, d]])
    return (h % _U(routes)).astype(np.int64)


def _cut(rows: np.ndarray, n: np.ndarray, found: np.ndarray, route: np.ndarray) -> Iterator[tuple]:
    """A block (route, distinct words, codes, counts) for each route."""
    order = np.argsort(route, kind="stable")
    rows, n, route = rows[order], n[order], route[order]
    edges = np.append(np.flatnonzero(np.append(True, route[1:] != route[:-1])[: len(route)]), len(route))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        used, at = np.unique(np.append(0, rows[a:b]), return_inverse=True)
        yield int(route[a]), b" ".join(found[used[1:] - 1]), at[1:].astype("<u4").tobytes(), n[a:b].astype("<u4").tobytes()


def _route(rows: np.ndarray, n: np.ndarray, found: np.ndarray, lang: str, hot: set[bytes], routes: int, fan: int) -> Iterator[tuple]:
    """Blocks (route modulo ``fan``, language, kind, distinct words, codes, counts) of sorted distinct suffixes."""
    hashes = _hashes(found, lang)
    is_hot = np.array([False, *(w in hot for w in found)])
    busy = is_hot[rows[:, 0]]
    whole, whole_n, rows, n = rows[~busy], n[~busy], rows[busy], n[busy]
    first = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))[: len(rows)])  # of each pair
    three = rows[:, 2] > 0
    parts = (
        (WHOLE, whole, whole_n),
        (PAIR, rows[first] * [1, 1, 0], np.add.reduceat(n, first) if len(first) else n),
        (TRIPLE, rows[three], n[three]),
    )
    for kind, r, count in parts:
        for route, *block in _cut(r, count, found, _routes(r, kind, hashes, routes) % fan):
            yield route, lang, kind, *block


def _joined(g: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of codes from 1 on, counts and distinct words of blocks (words, codes, counts) of one language and kind."""
    lists = [w.split() for w, _, _ in g]
    codes, found = pd.factorize(np.array([w for x in lists for w in x], object))
    base = np.cumsum([0, *map(len, lists)])
    local = [np.frombuffer(x, "<u4").astype(np.int64) for _, x, _ in g]
    keys = np.concatenate([np.where(x > 0, np.append(-1, codes[o : o + len(w)])[x] + 1, 0) for x, o, w in zip(local, base.tolist(), lists)]).reshape(-1, LONGEST)
    return keys, np.concatenate([np.frombuffer(x, "<u4") for _, _, x in g]).astype(np.int64), found


def _recut(batches: Iterator[pd.DataFrame], routes: int, fan: int) -> Iterator[pd.DataFrame]:
    """Blocks of routes from blocks of routes modulo ``fan``, which come sorted by route, language and kind and are joined before they are cut."""

    def cut(key: tuple[int, str, int], held: list[tuple[bytes, bytes, bytes]]) -> pd.DataFrame:
        _, lang, kind = key
        rows, n, found = _joined(held)
        order = np.lexsort(rows.T[::-1])
        rows = rows[order]
        first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1)))
        rows, n = rows[first], np.add.reduceat(n[order], first)
        route = _routes(rows, kind, _hashes(found, lang), routes)
        return pd.DataFrame([(r, lang, kind, *block) for r, *block in _cut(rows, n, found, route)], columns=_BLOCKS)

    last, held, size, total = None, [], 0, 0
    for b in batches:
        for route, lang, kind, *block in b[_BLOCKS].itertuples(index=False, name=None):
            more, weight = len(block[2]) // 4, int(np.frombuffer(block[2], "<u4").sum(dtype=np.int64))
            if held and ((route, lang, kind) != last or size + more > JOINED or total + weight >= 2**32):
                yield cut(last, held)
                held, size, total = [], 0, 0
            last, size, total = (route, lang, kind), size + more, total + weight
            held.append(tuple(block))
    if held:
        yield cut(last, held)


def frequent(keys: np.ndarray, weight: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefixes of the rows of ``keys`` that weigh at least ``least``: a row that has it, its length and its weight; 0 ends a row.

    Three-way partitioning of row pointers around the middle pointer's key at each partition's depth.
    """
    deepest = keys.shape[1]
    pointer, size, depth = np.arange(len(keys)), np.array([len(keys)]), np.array([0])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(pointer):
        many = len(size)
        start = np.cumsum(size) - size
        part = np.repeat(np.arange(many), size)
        key = keys[pointer, depth[part]]
        pivot = key[start + size // 2]
        side = 1 + np.sign(key - pivot[part])
        group = part * 3 + side
        count = np.bincount(group, minlength=3 * many).reshape(many, 3)
        total = np.bincount(group, weight[pointer], minlength=3 * many).reshape(many, 3)
        begin = (np.cumsum(count) - count.ravel()).reshape(many, 3)
        moved = np.empty_like(pointer)
        for s in range(3):
            of = np.flatnonzero(side == s)
            moved[np.arange(len(of)) + np.repeat(begin[:, s] - (np.cumsum(count[:, s]) - count[:, s]), count[:, s])] = pointer[of]
        enough = total >= least
        enough[:, 1] &= pivot > 0
        hit = np.flatnonzero(enough[:, 1])
        out.append((moved[begin[hit, 1]], depth[hit] + 1, total[hit, 1]))
        deeper = np.stack([depth, depth + 1, depth], axis=1)
        keep = (enough & (deeper < deepest) & (count > 0)).ravel()
        pointer = moved[np.repeat(keep, count.ravel())]
        size, depth = count.ravel()[keep], deeper.ravel()[keep]
    if not out:
        return pointer, pointer, pointer
    a, d, n = (np.concatenate(x) for x in zip(*out))
    return a, d, n.astype(np.int64)


def _count_route(route: pd.DataFrame, least: int) -> pd.DataFrame:
    """Frequent phrases of the blocks of one route."""
    out = []
    for (lang, kind), g in route.groupby(["lang", "kind"], sort=False):
        keys, weight, found = _joined(list(g[["words", "codes", "counts"]].itertuples(index=False, name=None)))
        row, size, n = frequent(keys, weight, least)
        on = (size > 1) & ((kind == WHOLE) | (size == kind + 1))
        phrase = [b" ".join(found[k[:d] - 1]).decode() for k, d in zip(keys[row[on]], size[on].tolist())]
        out.append(pd.DataFrame({"lang": lang, "phrase": pd.Series(phrase, dtype=object), "size": size[on], "n": n[on]}))
    return pd.concat(out)


def phrase_counts(texts: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Counts of all words (``lang``, ``phrase``, ``n``), and those of the phrases of two and three words (also ``size``) that reach ``least``; both staged.

    ``texts`` has ``lang`` and ``_t``.
    """
    spark = texts.sparkSession
    found = texts.mapInPandas(_count_words, "lang STRING, phrase STRING, n BIGINT")
    words = settle(found.groupBy("lang", "phrase").agg(F.sum("n").alias("n")))
    total = words.agg(F.sum("n")).first()[0] or 0
    routes = max(1, min(MOST_ROUTES, total // ROUTE_WORDS))
    hot: dict[str, set[bytes]] = {}
    for r in words.filter(F.col("n") > total // routes).collect():  # fewer than ``routes`` words
        hot.setdefault(r["lang"], set()).add(r["phrase"].encode())
    sent = spark.sparkContext.broadcast(hot)

    fan = min(FAN, routes)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, raw in _by_language(batches):
            codes, piece, found = _words(raw)
            rows, n = suffixes(codes, piece, len(found))
            yield pd.DataFrame(list(_route(rows, n, found, lang, sent.value.get(lang, set()), routes, fan)), columns=_BLOCKS)

    schema = "route BIGINT, lang STRING, kind INT, words BINARY, codes BINARY, counts BINARY"
    cut = texts.mapInPandas(route, schema)
    if routes > fan:
        coarse = cut.hint("rebalance", "route").sortWithinPartitions("route", "lang", "kind")
        cut = coarse.mapInPandas(lambda batches: _recut(batches, routes, fan), schema)
    phrases = cut.groupBy("route").applyInPandas(lambda g: _count_route(g, least), "lang STRING, phrase STRING, size INT, n BIGINT")
    return words, settle(phrases)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, counts ``a``, ``l``, ``r`` and ``n``, and ``score`` of the first ``top`` phrases of every language."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_t"))
    words, phrases = phrase_counts(texts, least)
    parts = words.filter(F.col("n") >= least).select("lang", "phrase", "n").unionByName(phrases.filter("size = 2").select("lang", "phrase", "n"))
    cuts = phrases.selectExpr("lang", "phrase", "n AS a", "split(phrase, ' ') AS w").selectExpr(
        "lang", "phrase", "a", "explode(transform(sequence(1, size(w) - 1), k -> named_struct('k', k,"
        " 'left', array_join(slice(w, 1, k), ' '), 'right', array_join(slice(w, k + 1, size(w) - k), ' ')))) AS c"
    ).select("lang", "phrase", "a", "c.*")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    square = "CAST(1000000BD * CAST(a AS DECIMAL(19,0)) AS DECIMAL(38,0)) * CAST(a AS DECIMAL(38,0))"
    scored = cuts.withColumn("score", F.expr(f"{square} div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"))
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("worst"))
    inside = phrases.filter("size = 3").selectExpr("lang", "n", "split(phrase, ' ') AS w")
    inside = inside.selectExpr("lang", "n", "explode(array(array_join(slice(w, 1, 2), ' '), array_join(slice(w, 2, 2), ' '))) AS phrase")
    inside = inside.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    free = worst.join(inside, ["lang", "phrase"], "left").filter("longer IS NULL OR 100 * longer < 50 * a")
    free = free.select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = free.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return first.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
