"""Weak supervision of document quality: rules vote or abstain, EM weighs the votes.

Every rule votes 1 (good), -1 (bad) or 0 (abstains) on a whole text. The number of vote
patterns is at most ``2 ** rules`` (each rule knows one side), so after one aggregation of the
corpus to pattern counts expectation-maximisation runs on those counts alone: it estimates
the accuracy of each rule's votes and gives each pattern its posterior probability of being
good. One bad vote does not reject a text, nor does the lack of one keep it: what counts is how
often the rules that voted are borne out by the others. Texts that break a hard limit are rejected whatever the posterior says.

Edge cases: a null or blank text has no words and fails the hard limit; equal rows get equal
results; an empty table gives an empty result; other columns pass through, except those named like a
result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.storage import small_table
from alphaloom.operators.staging import stage

SPACE = r"[\\x20\\x09-\\x0D]"
WINDOW = 8

#: name -> (bad when, good when); conditions over ``text_features``. A rule abstains where it has no say: those that
#: look for one kind of damage say nothing about texts without it, and the two that know good text need all its marks.
RULES = {
    "symbols": ("n_symbols * 10 > n_words", "false"),
    "odd_words": ("n_plain * 10 < n_words * 7", "false"),
    "repetition": ("n_repeat_words * 100 > n_words * 15 OR n_dup_lines * 2 > n_lines", "false"),
    "monotony": ("n_distinct * 10 < n_words", "false"),
    "shouting": ("n_upper * 2 > word_chars", "false"),
    "exclaiming": ("n_exclaim * 4 > n_words", "false"),
    "no_sentences": ("n_words >= 20 AND (n_ends * 2 > n_words OR n_ends * 100 < n_words)", "false"),
    "garbled": ("n_garbled * 100 > word_chars", "false"),
    "word_length": ("word_chars < 2 * n_words OR word_chars > 20 * n_words", "false"),
    "prose": ("false", "n_plain * 20 >= n_words * 17 AND n_ends BETWEEN n_words / 50 AND n_words / 4 AND n_capital > 0 AND n_upper * 5 <= word_chars"),
    "vocabulary": (
        "false",
        "n_plain * 20 >= n_words * 17 AND n_distinct * 4 > n_words AND n_repeat_words * 20 <= n_words AND n_dup_lines * 10 <= n_lines AND word_chars BETWEEN 3 * n_words AND 12 * n_words",
    ),
}
PSEUDO = 3.0

#: names of results and helpers; input columns of such a name are left out
_NAMES = {
    "n_words", "word_chars", "n_symbols", "n_upper", "n_garbled", "n_exclaim", "n_lines", "n_dup_lines", "n_repeat_words", "n_plain", "n_distinct", "n_ends", "n_capital", "base_failed", "kept",
    "quality_prob", "_t", "_w", "_l", "_h", "_s", "_p", *(f"vote_{r}" for r in RULES),
}


def text_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the counts that the rules and the hard limit use.

    ``n_repeat_words`` counts the words inside 8-word windows that occur at least twice in the
    same text. Windows are compared by their 64-bit hashes; positions are only sorted for the
    texts that have a repeated hash.
    """
    keep = [c for c in docs.columns if c != text and c.lower() not in _NAMES]
    t = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t")).selectExpr(
        *[f"`{c}`" for c in keep],
        "_t",
        f"filter(split(_t, '{SPACE}+'), w -> w != '') AS _w",
        f"filter(split(_t, '\\n'), l -> l RLIKE '[^\\\\x20\\\\x09-\\\\x0D]') AS _l",
    )
    t = t.selectExpr(
        *[f"`{c}`" for c in keep],
        "CAST(size(_w) AS BIGINT) AS n_words",
        "CAST(char_length(array_join(_w, '')) AS BIGINT) AS word_chars",
        "CAST(regexp_count(_t, '[#*$%&|<>]') AS BIGINT) AS n_symbols",
        "CAST(regexp_count(_t, '\\\\p{Lu}') AS BIGINT) AS n_upper",
        "CAST(regexp_count(_t, '[\\\\x00-\\\\x08\\\\x0E-\\\\x1F\\\\x{FFFD}]') AS BIGINT) AS n_garbled",
        "CAST(char_length(_t) - char_length(replace(_t, '!', '')) AS BIGINT) AS n_exclaim",
        "CAST(size(filter(_w, w -> w RLIKE '^\\\\p{L}+[.,;:!?]?$')) AS BIGINT) AS n_plain",
        "CAST(size(array_distinct(_w)) AS BIGINT) AS n_distinct",
        "CAST(regexp_count(_t, '[.!?](?=[\\\\x20\\\\x09-\\\\x0D]|$)') AS BIGINT) AS n_ends",
        "CAST(regexp_count(_t, '(?<![^\\\\x20\\\\x09-\\\\x0D])\\\\p{Lu}') AS BIGINT) AS n_capital",
        "CAST(size(_l) AS BIGINT) AS n_lines",
        "CAST(size(_l) - size(array_distinct(_l)) AS BIGINT) AS n_dup_lines",
        f"CASE WHEN size(_w) > {WINDOW} THEN transform(sequence(1, size(_w) - {WINDOW - 1}), i -> xxhash64(slice(_w, i, {WINDOW})))"
        " ELSE array() END AS _h",
    )
    counts = [f"`{c}`" for c in keep] + ["n_words", "word_chars", "n_symbols", "n_upper", "n_garbled", "n_exclaim", "n_plain", "n_distinct", "n_ends", "n_capital", "n_lines", "n_dup_lines"]
    t = t.selectExpr(
        *counts,
        "CASE WHEN size(array_distinct(_h)) < size(_h)"
        " THEN array_sort(transform(_h, (h, i) -> named_struct('h', h, 'i', i))) ELSE array() END AS _s",
    )
    t = t.selectExpr(
        *counts,
        "array_sort(transform(filter(transform(_s, (x, j) -> named_struct('i', x.i, 'twice',"
        " (j > 0 AND x.h = get(_s, j - 1).h) OR (j + 1 < size(_s) AND x.h = get(_s, j + 1).h))), x -> x.twice), x -> x.i)) AS _p",
    )
    return t.selectExpr(
        *counts,
        f"CAST(aggregate(_p, named_struct('past', 0, 'n', 0), (a, p) -> named_struct('past', p + {WINDOW},"
        f" 'n', a.n + p + {WINDOW} - greatest(p, a.past)), a -> a.n) AS BIGINT) AS n_repeat_words",
    )


def votes(features: DataFrame) -> DataFrame:
    """A column ``vote_<rule>`` of 1, -1 or 0 for every rule."""
    return features.withColumns({f"vote_{r}": F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END") for r, (bad, good) in RULES.items()})


@dataclass(frozen=True)
class Fitted:
    """Share of good texts, accuracy of each rule's votes, and the posterior of "good" of each vote pattern."""

    prior: float
    accuracy: tuple[float, ...]
    posterior: dict[tuple[int, ...], float]


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 500) -> Fitted:
    """Expectation-maximisation over pattern counts.

    A rule's vote is right with a probability of its own, its accuracy, whichever class the text is in; abstentions say
    nothing, and votes are taken as independent given the class. Accuracies and the share of
    good texts are estimated (with a pseudo-count of ``PSEUDO`` votes, two thirds of them right,
    and of one text of either class); nothing bounds them, so a rule that the others contradict gets
    little or negative weight. Starts from the majority of the votes.
    """
    posterior = {v: 0.9 if sum(v) > 0 else 0.1 if sum(v) < 0 else 0.5 for v, _ in patterns}
    rules = range(len(patterns[0][0])) if patterns else range(0)
    total = sum(n for _, n in patterns)
    prior, accuracy = 0.5, tuple(2 / 3 for _ in rules)
    for _ in range(rounds):
        prior = (sum(n * posterior[v] for v, n in patterns) + 1) / (total + 2)
        accuracy = tuple(
            (sum(n * (posterior[v] if v[j] > 0 else 1 - posterior[v]) for v, n in patterns if v[j]) + PSEUDO * 2 / 3)
            / (sum(n for v, n in patterns if v[j]) + PSEUDO)
            for j in rules
        )
        weight = [math.log(a / (1 - a)) for a in accuracy]
        new = {}
        for v, _ in patterns:
            x = math.log(prior / (1 - prior)) + sum(w * c for w, c in zip(weight, v, strict=True))
            new[v] = 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))
        moved = max((abs(new[v] - posterior[v]) for v in new), default=0.0)
        posterior = new
        if moved < 1e-9:
            break
    return Fitted(prior, accuracy, posterior)


def quality_verdicts(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Features, votes, ``quality_prob``, ``base_failed`` and ``kept`` of every row of ``docs``.

    Rows are matched to nothing but their own votes, so ids may repeat. The features are
    written once; only pattern counts (at most ``2 ** rules`` rows) reach the driver.
    """
    names = [f"vote_{r}" for r in RULES]
    rated = stage(votes(text_features(docs, text)), "snappy")
    counted = rated.groupBy(*names).count().collect()
    fitted = fit([(tuple(r[c] for c in names), r["count"]) for r in counted])
    rows = sorted(fitted.posterior.items())
    columns = {c: (pa.int32(), [v[j] for v, _ in rows]) for j, c in enumerate(names)}
    table = small_table(docs.sparkSession, columns | {"quality_prob": (pa.float64(), [p for _, p in rows])})
    out = rated.join(F.broadcast(table), names, "left")
    out = out.withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))
    return out.withColumn("kept", F.expr(f"NOT base_failed AND quality_prob >= {threshold}"))
