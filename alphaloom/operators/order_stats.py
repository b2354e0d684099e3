"""Exact grouped order statistics that never gather an unbounded group in one task.

``percentile`` and ``median`` hold every distinct value of a group in one reducer, which a
date or a training window with billions of rows does not survive. For groups of every size
each statistic is found the same way, in passes with map-side combining:

1. per statistic, ``BINS`` ranges of equal width between two outer quantiles of all rows, and
   one range on either side; per group and range, a row count. The running counts show which
   ranges hold the wanted ranks: the group's *bracket*;
2. rows outside the bracket are dropped (those below it have been counted), and rows
   inside it collapse to (value, count) pairs in ``PARTS`` parts of the bracket;
3. the parts' counts show which part holds the rank, and the running count inside that
   part alone gives the value.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alphaloom.operators.staging import stage

# the ranges only have to spread the rows, so a rough quantile is enough for their ends
OUTER = 0.005
ACCURACY = 1_000
BINS = 64
PARTS = 256
# fewer rows than this are one range
BRACKET_FROM = 10_000


@dataclass(frozen=True)
class OrderStat:
    """One statistic: value expression, rough quantile ``at`` and exact rank.

    ``rank`` maps the count of non-null values to a 1-based rank; ``rank_column`` names a
    column holding one rank per group instead. With neither, the statistic is the linearly
    interpolated quantile at ``at``.
    """

    value: Column
    at: float | None = None
    rank: Callable[[Column], Column] | None = None
    rank_column: str | None = None


def quantile(value: Column, at: float) -> OrderStat:
    return OrderStat(value, at)


def median(value: Column) -> OrderStat:
    return OrderStat(value, 0.5)


def _ranks(stat: OrderStat, n: Column, given: Column) -> tuple[Column, Column]:
    """The two 1-based ranks a statistic needs (equal unless it interpolates)."""
    if stat.rank_column is not None:
        return given, given
    if stat.rank is not None:
        return stat.rank(n), stat.rank(n)
    pos = (n - 1) * F.lit(stat.at)
    return F.floor(pos) + 1, F.ceil(pos) + 1


def _interpolates(stat: OrderStat) -> bool:
    return stat.rank is None and stat.rank_column is None


def _ends(rows: DataFrame, count: int) -> list[tuple[float, float] | None]:
    """Lower and upper end of the ranges of each statistic, None where all its rows are one range."""
    total, *found = rows.agg(F.count(F.lit(1)), *[F.percentile_approx(f"__v{i}", [OUTER, 1.0 - OUTER], ACCURACY) for i in range(count)]).first()
    return [tuple(e) if total > BRACKET_FROM and e and math.isfinite(e[1] - e[0]) and e[1] > e[0] else None for e in found]


def _bin(value: Column, ends: tuple[float, float] | None) -> Column:
    """Number of the value's range: -1 below the ranges, ``BINS`` above them; NULL for NULL."""
    if ends is None:
        return F.when(value.isNotNull(), F.lit(0))
    return _bin_between(value, F.lit(ends[0]), F.lit(ends[1]), F.lit(ends[1] - ends[0]))


def _bin_between(value: Column, low: Column, high: Column, width: Column) -> Column:
    at = F.greatest(F.least(F.floor((value - low) / width * BINS), F.lit(BINS - 1)), F.lit(0)).cast("int")
    return F.when(value < low, -1).when(value >= high, BINS).when(value.isNotNull(), at)


def _bin_of(value: Column, number: Column, ends: list[tuple[float, float] | None]) -> Column:
    """:func:`_bin` of the statistic ``number``. One expression for all statistics: with one each, the code that Spark
    generates for many of them is too long for the JVM to compile."""
    if not any(ends):
        return _bin(value, None)
    low, high, width = (F.array(*[F.lit(x).cast("double") for x in xs])[number] for xs in zip(*[(e[0], e[1], e[1] - e[0]) if e else (None, None, None) for e in ends]))
    found = _bin_between(value, low, high, width)
    return found if all(ends) else F.when(low.isNull(), _bin(value, None)).otherwise(found)


def _edge(number: Column, ends: tuple[float, float] | None, outside: float) -> Column:
    """Where range ``number`` begins; ``outside`` beyond the ranges."""
    if ends is None:
        return F.lit(outside)
    return F.when(number.between(0, BINS), F.lit(ends[0]) + number * F.lit((ends[1] - ends[0]) / BINS)).otherwise(F.lit(outside))


def _brackets(rows: DataFrame, keys: list[str], stats: list[OrderStat], ends: list[tuple[float, float] | None]) -> DataFrame:
    """One row per group: count, the two ranks, the first and last range of the bracket, its ends and the rows below it, of every statistic ``i``."""
    span = range(len(stats))
    ranked = any(s.rank_column for s in stats)
    given = [(F.col(f"__k{i}") if stats[i].rank_column else F.lit(None)).cast("long") for i in span]
    entries = rows.select(*keys, *([F.array(*given).alias("__ks")] if ranked else []), F.posexplode(F.array(*[f"__v{i}" for i in span])).alias("__s", "__v"))
    entries = entries.select(*keys, "__s", _bin_of(F.col("__v"), F.col("__s"), ends).alias("__bin"), *([F.col("__ks")[F.col("__s")].alias("__k")] if ranked else []))
    counts = entries.groupBy(*keys, "__s", "__bin")
    counts = counts.agg(F.count(F.lit(1)).alias("__c"), (F.max("__k") if ranked else F.lit(None).cast("long")).alias("__k"))
    counts = counts.withColumn("__c", F.when(F.col("__bin").isNull(), 0).otherwise(F.col("__c")))
    group = W.partitionBy(*keys, "__s")
    counts = counts.withColumns({"__n": F.sum("__c").over(group), "__k": F.max("__k").over(group), "__upto": F.sum("__c").over(group.orderBy("__bin").rowsBetween(W.unboundedPreceding, W.currentRow))})
    ranks = [_ranks(s, F.col("__n"), F.col("__k")) for s in stats]
    for j, name in enumerate(("__r1", "__r2")):
        counts = counts.withColumn(name, F.greatest(F.coalesce(*[F.when(F.col("__s") == i, ranks[i][j].cast("long")) for i in span]), F.lit(1)))
    holds = [(F.col("__c") > 0) & (F.col("__upto") >= F.col(x)) & (F.col("__upto") - F.col("__c") < F.col(x)) for x in ("__r1", "__r2")]
    out = []
    for i in span:
        own = F.col("__s") == i
        out += [F.max(F.when(own, F.col(c))).alias(f"__{a}{i}") for c, a in (("__n", "n"), ("__r1", "r"), ("__r2", "s"))]
        out += [F.max(F.when(own & h, F.col("__bin"))).alias(f"__{a}{i}") for h, a in zip(holds, ("first", "last"))]
        out.append(F.coalesce(F.max(F.when(own & holds[0], F.col("__upto") - F.col("__c"))), F.lit(0)).alias(f"__below{i}"))
    found = counts.groupBy(*keys).agg(*out)
    # a rank beyond the group leaves the bracket open above
    found = found.withColumns({f"__last{i}": F.coalesce(f"__last{i}", F.lit(BINS)) for i in span})
    found = found.withColumns({f"__first{i}": F.coalesce(f"__first{i}", F.lit(BINS)) for i in span})
    return found.withColumns(
        {f"__lo{i}": _edge(F.col(f"__first{i}"), ends[i], float("-inf")) for i in span} | {f"__hi{i}": _edge(F.col(f"__last{i}") + 1, ends[i], float("inf")) for i in span}
    )


def grouped_order_stats(df: DataFrame, keys: Sequence[str], stats: Mapping[str, OrderStat]) -> DataFrame:
    """One row per group: ``keys`` and, per statistic, its value and ``<name>_n`` (non-null
    count), ``<name>_less`` (rows strictly below it) and ``<name>_ties`` (rows equal to it).

    Groups with a NULL key are left out; a group without values has NULL statistics. Ranks
    beyond the group give NULL. The input is read three times: stage it if it is costly.
    """
    keys, names = list(keys), list(stats)
    whole = not keys
    if whole:
        df, keys = df.withColumn("__all", F.lit(1)), ["__all"]
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    span = range(len(names))
    extra = [F.col(stats[n].rank_column).alias(f"__k{i}") for i, n in enumerate(names) if stats[n].rank_column]
    rows = df.select(*keys, *[stats[n].value.cast("double").alias(f"__v{i}") for i, n in enumerate(names)], *extra)

    ends = _ends(rows, len(names))
    bracket = stage(_brackets(rows, keys, [stats[n] for n in names], ends))

    # ranks are counted from the bracket's first row
    ranks = [[(F.col(f"__{x}{i}") - F.col(f"__below{i}")).alias(name) for x, name in (("r", "r1"), ("s", "r2"))] for i in span]
    places = [[F.col(f"__{x}{i}").alias(x) for x in ("first", "last", "lo", "hi")] for i in span]
    packed = bracket.select(*keys, F.array(*[F.struct(*ranks[i], *places[i]) for i in span]).alias("__b"))
    entries = rows.select(*keys, F.array(*[f"__v{i}" for i in span]).alias("__vs")).join(packed, keys)
    entries = entries.select(*keys, "__b", F.posexplode("__vs").alias("s", "v"))
    entries = entries.select(*keys, "s", "v", _bin_of(F.col("v"), F.col("s"), ends).alias("at"), F.col("__b")[F.col("s")].alias("b"))
    counted = (
        entries.filter(F.col("at").between(F.col("b.first"), F.col("b.last")))
        .select(*keys, "s", "v", F.col("b.r1").alias("r1"), F.col("b.r2").alias("r2"), _part(F.col("v"), F.col("b.lo"), F.col("b.hi")).alias("bin"))
        .groupBy(*keys, "s", "bin", "v")
        .agg(F.count(F.lit(1)).alias("c"), F.max("r1").alias("r1"), F.max("r2").alias("r2"))
    )
    ranges = counted.groupBy(*keys, "s", "bin").agg(F.sum("c").alias("c"), F.max("r1").alias("r1"), F.max("r2").alias("r2"))
    order = W.partitionBy(*keys, "s").orderBy("bin")
    ranges = ranges.withColumn("before", F.sum("c").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("c"))
    holds = [(F.col("before") < F.col(x)) & (F.col("before") + F.col("c") >= F.col(x)) for x in ("r1", "r2")]
    ranges = ranges.filter(holds[0] | holds[1]).select(*keys, "s", "bin", "before")
    order = W.partitionBy(*keys, "s", "bin").orderBy("v")
    ranked = counted.join(ranges, [*keys, "s", "bin"])
    ranked = ranked.withColumn("upto", F.col("before") + F.sum("c").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    holds1 = (F.col("upto") >= F.col("r1")) & (F.col("upto") - F.col("c") < F.col("r1"))
    holds2 = (F.col("upto") >= F.col("r2")) & (F.col("upto") - F.col("c") < F.col("r2"))
    picked = (
        ranked.filter(holds1 | holds2)
        .groupBy(*keys)
        .agg(
            *[
                c
                for i in span
                for c in (
                    F.max(F.when((F.col("s") == i) & holds1, F.struct("v", (F.col("upto") - F.col("c")).alias("less"), "c"))).alias(f"__p{i}"),
                    F.max(F.when((F.col("s") == i) & holds2, F.col("v"))).alias(f"__q{i}"),
                )
            ]
        )
    )
    picked = bracket.select(*keys, *[f"__{x}{i}" for i in span for x in ("n", "r", "below")]).join(picked, keys, "left")
    out = []
    for i, name in enumerate(names):
        found, n = F.col(f"__p{i}.v"), F.col(f"__n{i}")
        missed = found.isNull() & (n >= F.col(f"__r{i}"))
        value = F.when(missed, F.raise_error(F.lit(f"no value of {name} inside its bracket")).cast("double")).otherwise(found)
        if _interpolates(stats[name]):
            pos = (n - 1) * F.lit(stats[name].at)
            value = value + (F.col(f"__q{i}") - value) * (pos - F.floor(pos))
        out += [value.alias(name), n.alias(f"{name}_n"), (F.col(f"__below{i}") + F.col(f"__p{i}.less")).alias(f"{name}_less"), F.col(f"__p{i}.c").alias(f"{name}_ties")]
    return picked.select(*([] if whole else keys), *out)


def _part(value: Column, low: Column, high: Column) -> Column:
    """Number of the value's part of the bracket from ``low`` to ``high``; 0 in a bracket without ends."""
    at = F.greatest(F.least(F.floor((value - low) / (high - low) * PARTS), F.lit(PARTS - 1)), F.lit(0)).cast("int")
    return F.when((low > float("-inf")) & (high < float("inf")), at).otherwise(0)


def tie_key(df: DataFrame, column: str) -> Column:
    """Numeric tie-break: the column itself, or a fixed 53-bit hash order for text codes."""
    if isinstance(df.schema[column].dataType, T.NumericType):
        return F.col(column)
    return F.pmod(F.xxhash64(column), F.lit(1 << 53))


def keep_top(
    df: DataFrame,
    keys: Sequence[str],
    order: Column,
    tie: Column,
    size: Callable[[Column], Column],
    at: float | None = None,
    calendar_keyed: bool = False,
) -> DataFrame:
    """Rows whose rank in the group by (``order`` descending, ``tie`` ascending) is ``<= size(n)``.

    For group-sized cuts such as a top fraction, where ``row_number`` would sort a whole group
    in one task. ``at`` is the rough share kept; ``tie`` must be numeric (see :func:`tie_key`).
    Rows with NULL ``order`` are neither counted nor kept.
    """
    keys = list(keys)
    hint = F.broadcast if calendar_keyed else (lambda d: d)
    base = df.withColumn("_x", (-order).cast("double")).withColumn("_t", tie.cast("double"))
    cut = grouped_order_stats(base, keys, {"_cut": OrderStat(F.col("_x"), at, size)})
    cut = stage(cut.select(*keys, "_cut", (size(F.col("_cut_n")).cast("long") - F.col("_cut_less")).alias("_want"), "_cut_ties"))
    split = cut.filter("_want < _cut_ties")
    tied = base.join(hint(split), keys).filter("_x = _cut")
    limit = grouped_order_stats(tied, keys, {"_limit": OrderStat(F.col("_t"), rank_column="_want")}).select(*keys, "_limit")
    cut = cut.join(hint(limit), keys, "left").select(*keys, "_cut", "_limit")
    inside = (F.col("_x") < F.col("_cut")) | (
        (F.col("_x") == F.col("_cut")) & (F.col("_limit").isNull() | (F.col("_t") <= F.col("_limit")))
    )
    return base.join(hint(cut), keys).filter(inside).select(*df.columns)
