"""Benchmark decontamination by winnowed fingerprints, on DataFrame functions alone.

A window is 10 consecutive words of a benchmark item (an item of fewer words is one window).
From texts of at least 10 words the smallest 5-gram hash of every 6 neighbouring 5-grams is
kept, on both sides, so any shared span of 10 words shares a kept fingerprint. Fingerprints
are joined, each hit is extended to the windows around it and compared word by word.

Edge cases: null, empty and wordless texts match nothing; items without words are ignored;
repeated items count once each per id, repeated rows get equal results; an empty table on either
side gives zero hits; columns pass through, except those named like a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.operators.staging import stage

SPAN = 10
GRAM = 5
NEAR = SPAN - GRAM + 1
LOW = 30  # bits of a packed fingerprint that hold the word position
OTHER = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WORD = r"[\\x30-\\x39\\x41-\\x5A\\x61-\\x7A\\x{80}-\\x{10FFFF}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: str) -> str:
    """SQL for the array of words of a text column; only A-Z are lower-cased."""
    low = f"CASE WHEN char_length({text}) = octet_length({text}) THEN lower({text}) ELSE translate({text}, '{UPPER}', '{UPPER.lower()}') END"
    return f"filter(split({low}, '{OTHER}'), w -> w != '')"


def winnowed(w: str) -> str:
    """SQL for the kept fingerprints of a word array of at least ``SPAN`` words: hash above, position below.

    The leftmost of equal hashes is kept, as the position breaks the tie.
    """
    grams = (
        f"transform(sequence(0, size({w}) - {GRAM}), i ->"
        f" shiftleft(shiftright(xxhash64(slice({w}, i + 1, {GRAM})), {LOW}), {LOW}) + i)"
    )
    return (
        f"array_distinct(transform(array({grams}), g -> transform(sequence(1, size(g) - {NEAR - 1}), i -> array_min(slice(g, i, {NEAR}))))[0])"
    )


def _fingerprints(df: DataFrame, keep: list[str], column: str) -> DataFrame:
    """One row per kept fingerprint: ``keep``, ``print`` and ``pos``."""
    out = df.filter(f"size({column}) >= {SPAN}").selectExpr(*keep, f"explode({winnowed(column)}) AS _f")
    return out.selectExpr(*keep, f"shiftright(_f, {LOW}) AS print", f"CAST(_f & {2**LOW - 1} AS INT) AS pos")


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` (sorted ids as strings) and ``hits`` (covered [first, past) word ranges).

    ``doc_id`` has to be unique; rows without one are told apart by their texts. Item words travel only with fingerprints that were hit.
    """
    items = stage(
        benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("_t"))
        .selectExpr("item", f"coalesce({words('_t')}, array()) AS iw")
        .filter("item IS NOT NULL AND size(iw) > 0"),
        "snappy",
    )
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("\n"), F.sha2(F.col(text), 256)))
    bare = docs.select(key.alias("_id"), F.col(text).alias("_t")).filter("_t IS NOT NULL")
    tokens = bare.selectExpr("_id", f"{words('_t')} AS w")

    marks = _fingerprints(items, ["item", "iw"], "iw").selectExpr("print", "struct(item, iw, pos AS q) AS it")
    found = _fingerprints(tokens, ["_id"], "w").join(marks, "print").select("_id", "pos", "it")

    # items of fewer than SPAN words: one window each, looked up at every position, length by length
    lengths = [r[0] for r in items.filter(f"size(iw) < {SPAN}").selectExpr("size(iw) AS n").distinct().orderBy("n").collect()]
    for n in lengths:
        short = items.filter(f"size(iw) = {n}").selectExpr("xxhash64(iw) AS print", "struct(item, iw, 0 AS q) AS it")
        at = tokens.filter(f"size(w) >= {n}").selectExpr("_id", f"posexplode(transform(sequence(1, size(w) - {n - 1}), i -> xxhash64(slice(w, i, {n}))))  AS (pos, print)")
        found = found.unionByName(at.join(short, "print").select("_id", "pos", "it"))

    # starts that a hit proposes: item window s at document word pos - q + s
    near = found.selectExpr(
        "_id", "pos - it.q AS shift", "it.item AS item", "it.iw AS iw",
        f"greatest(0, it.q - {NEAR - 1}) AS lo", f"least(it.q, greatest(0, size(it.iw) - {SPAN})) AS hi",
    )
    hits = near.groupBy("_id").agg(F.collect_set(F.struct("item", "iw", "shift", "lo", "hi")).alias("near"))

    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c in (doc_id, text) or c.lower() not in ("n_words", "n_hit", "items", "hits", "near", "_w", "_m", "_hit_id")])
    own = [f"`{c}`" for c in docs.columns]
    out = docs.join(hits.withColumnRenamed("_id", "_hit_id"), key == F.col("_hit_id"), "left").drop("_hit_id")
    out = out.selectExpr(
        *own, f"CAST(coalesce(regexp_count(`{text}`, '{WORD}'), 0) AS BIGINT) AS n_words", "near",
        f"CASE WHEN near IS NULL THEN array() ELSE {words(f'`{text}`')} END AS _w",
    )
    out = out.selectExpr(
        *own, "n_words",
        f"""flatten(transform(coalesce(near, array()), x -> transform(filter(sequence(x.lo, greatest(x.lo, x.hi)), s ->
            s + x.shift >= 0 AND s + x.shift + least({SPAN}, size(x.iw)) <= size(_w)
            AND slice(_w, s + x.shift + 1, least({SPAN}, size(x.iw))) = slice(x.iw, s + 1, least({SPAN}, size(x.iw)))),
            s -> named_struct('first', s + x.shift, 'past', s + x.shift + least({SPAN}, size(x.iw)), 'item', x.item)))) AS _m""",
    )
    out = out.selectExpr(
        *own, "n_words", "array_sort(array_distinct(transform(_m, x -> x.item))) AS items",
        "array_sort(array_distinct(transform(_m, x -> named_struct('first', x.first, 'past', x.past)))) AS hits",
    )
    return out.withColumn(
        "n_hit",
        F.expr("CAST(aggregate(hits, named_struct('past', 0, 'n', 0), (a, x) -> named_struct('past', greatest(a.past, x.past), 'n', a.n + greatest(0, x.past - greatest(x.first, a.past))), a -> a.n) AS BIGINT)"),
    )
