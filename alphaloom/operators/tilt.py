"""Constraint-respecting tilts of the benchmark and the turnover-limited path.

This replaces a quadratic solver. The base book is the benchmark cut at the weight cap, the
excess spread inside the industry and, where an industry is full, over the others. Candidates
tilt the base by alpha, scaled by one factor each: the cap bounds it exactly, tracking error
and industry deviation by the base's own share plus the factor times the tilt's (which is exact
where the benchmark is within the cap). The best candidate by the same objective is kept for
each date. It meets the same constraints as the quadratic optimum but is not that optimum.
Only dates whose base itself breaks a limit fall back to the last book or the benchmark.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.operators.staging import remove, stage
from alphaloom.operators.risk import YEAR, Limits, day_moments, shrunk_variance
from alphaloom.session import scratch_path

STRENGTHS = (0.25, 0.5, 1.0, 2.0)


def _settings(df: DataFrame, limits: Limits, gamma: float) -> DataFrame:
    """Scenario columns win; missing settings come from ``limits``."""
    defaults = {
        "max_tracking_error": limits.max_tracking_error,
        "max_industry_deviation": limits.max_industry_deviation,
        "max_weight": limits.max_weight,
        "gamma": gamma,
    }
    return df.withColumns({k: F.lit(float(v)) for k, v in defaults.items() if k not in df.columns})


def _level(rows: DataFrame, group: list[str], weight: str, total: str, out: str) -> DataFrame:
    """``out`` = ``least(max_weight, level * weight)``, with the level that keeps the group's sum of ``total``.

    At most ``1 / max_weight`` names can be at the cap, so the largest ones alone fix the level;
    where all names are full, they are at the cap.
    """
    order = W.partitionBy(*group).orderBy(F.col(weight).desc(), F.col("ts_code"))
    sums = rows.groupBy(*group).agg(F.sum(weight).alias("_sum"), F.sum(total).alias("_total"))
    top = rows.where(F.col(weight) > 0).select(
        *group, weight, "max_weight", F.row_number().over(order).alias("_r"),
        F.coalesce(F.sum(weight).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("_above"),
    ).where(F.col("_r") <= F.ceil(1.0 / F.col("max_weight")) + 1)
    level = F.try_divide(F.col("_total") - (F.col("_r") - 1) * F.col("max_weight"), F.col("_sum") - F.col("_above"))
    top = top.join(sums, group).withColumn("_level", level).where(F.col("_level") * F.col(weight) <= F.col("max_weight") + 1e-12)
    levels = top.groupBy(*group).agg(F.min_by("_level", "_r").alias("_level"))
    full = F.when(F.col(weight) > 0, F.col("max_weight")).otherwise(0.0)
    value = F.when(F.col("_level").isNull(), full).otherwise(F.least("max_weight", F.col("_level") * F.col(weight)))
    return rows.join(levels, group, "left").withColumn(out, value).drop("_level")


def capped_base(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with ``_base``: the benchmark within ``max_weight``, its excess spread by industry first."""
    inside = _level(df, [*keys, "industry_name"], "benchmark_weight", "benchmark_weight", "_inside")
    return _level(inside, keys, "_inside", "benchmark_weight", "_base").drop("_inside")


def tilt(
    prepared: DataFrame,
    windows: DataFrame,
    shrink: DataFrame,
    limits: Limits = Limits(),
    by: Sequence[str] = (),
    strengths: Sequence[float] = STRENGTHS,
    gamma: float = 0.0,
) -> DataFrame:
    """Target weights per (scenario, rebalance, code).

    ``prepared`` holds one row per code with benchmark_weight, industry_name and alpha_score,
    optionally ``confidence`` (for ``gamma``) and ``extra_variance``. All dates, scenarios and
    candidates run in one plan. Output adds weight, candidate and optimization_status.
    """
    by, keys = list(by), [*by, "rebalance_date"]
    df = _settings(prepared, limits, gamma)
    for c, v in (("confidence", 0.5), ("extra_variance", 0.0)):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(v))
    df = stage(capped_base(df, keys).withColumn("_g", F.coalesce("industry_name", F.lit(""))))
    grid = [(0.0, True)] + [(float(k), neutral) for k in strengths for neutral in (True, False)]
    span = range(len(grid))
    # the basis: the benchmark, the base, and the base tilted by each strength; a candidate is one of these times a factor
    shapes = {"_b": F.col("benchmark_weight"), "_w0": F.col("_base")}
    shapes |= {f"_w{j}": F.col("_base") * F.greatest(1.0 + float(k) * F.col("alpha_score"), F.lit(0.0)) for j, k in enumerate(strengths, 1)}
    shape_of = [f"_w{0 if not k else 1 + list(strengths).index(k)}" for k, _ in grid]
    rows = df.withColumns(shapes)
    sums = stage(rows.groupBy(*keys, "_g").agg(*[F.sum(c).alias(c) for c in shapes]))
    totals = sums.groupBy(*keys).agg(*[F.sum(c).alias(f"{c}_all") for c in shapes])
    # neutral candidates keep each industry's base weight, free ones only the total; without anything to scale the base stays
    scale = [F.when(F.col(c) > 0, F.col("_w0") / F.col(c)) if neutral else F.when(F.col(f"{c}_all") > 0, F.col("_w0_all") / F.col(f"{c}_all")) for c, (_, neutral) in zip(shape_of, grid)]
    by_industry = stage(sums.join(totals, keys).select(*keys, "_g", *shapes, F.array(*scale).alias("_f")))
    factors = by_industry.select(*keys, "_g", "_f")

    def active(c: int) -> Column:
        """Candidate ``c`` less the base, of a row or of sums over rows of one industry."""
        return F.coalesce(F.col("_f")[c] * F.col(shape_of[c]), F.col("_w0")) - F.col("_w0")

    wb, doubt = F.col("_base"), 1.0 - F.col("confidence")
    own = rows.join(factors, [*keys, "_g"]).withColumns({f"_a{c}": active(c) for c in span} | {"_drift": F.col("_w0") - F.col("_b")})
    each = []
    for c in span:
        a = F.col(f"_a{c}")
        each += [
            F.min(F.when(a > 1e-15, F.greatest(F.col("max_weight") - wb, F.lit(0.0)) / a)).alias(f"_room{c}"),
            F.sum(F.col("alpha_score") * a).alias(f"_gain{c}"), F.sum(2.0 * doubt * wb * a).alias(f"_one{c}"), F.sum(doubt * a * a).alias(f"_two{c}"),
            F.sum(a * a).alias(f"_aa{c}"), F.sum(F.col("extra_variance") * a * a).alias(f"_xa{c}"),
        ]
    drift = F.col("_drift")
    per = own.groupBy(*keys).agg(
        *each, F.sum(F.col("alpha_score") * wb).alias("_gain_base"), F.sum(doubt * wb * wb).alias("_doubt_base"),
        F.sum(drift * drift).alias("_aa_base"), F.sum(F.col("extra_variance") * drift * drift).alias("_xa_base"),
        *[F.max(c).alias(c) for c in ("max_tracking_error", "max_industry_deviation", "gamma")],
    )
    gap = by_industry.groupBy(*keys).agg(
        *[F.max(F.abs(active(c))).alias(f"_gap{c}") for c in span], F.max(F.abs(F.col("_w0") - F.col("_b"))).alias("_gap_base"), F.abs(F.sum(F.col("_w0") - F.col("_b"))).alias("_lost")
    )
    # one join with the return windows: daily sums of the basis by industry, from which those of every candidate follow
    basis = [c for c in shapes]
    daily = rows.select(*keys, "_g", "ts_code", *basis).join(windows.select("rebalance_date", "ts_code", "t", "x"), ["rebalance_date", "ts_code"])
    daily = daily.groupBy(*keys, "_g", "t").agg(*[F.sum(F.col(c) * F.col("x")).alias(c) for c in basis]).join(factors, [*keys, "_g"])
    daily = daily.groupBy(*keys, "t").agg(*[F.sum(active(c)).alias(f"_s{c}") for c in span], F.sum(F.col("_w0") - F.col("_b")).alias("_s_base"))
    named = [*map(str, span), "_base"]
    spread = daily.groupBy(*keys).agg(*[x for n in named for x in day_moments(F.col(f"_s{n}"), n)])
    per = per.join(gap, keys).join(spread, keys, "left").join(shrink, "rebalance_date", "left")
    ridge = limits.covariance_ridge
    variance = {n: shrunk_variance(n, F.col(f"_aa{n}"), F.col(f"_xa{n}"), ridge) for n in named}
    candidates = [F.struct(F.lit(c).alias("candidate"), *[F.col(f"{x}{c}").alias(x) for x in ("_room", "_gain", "_one", "_two", "_gap")], variance[str(c)].alias("_var")) for c in span]
    per = per.select(
        *keys, "max_tracking_error", "max_industry_deviation", "gamma", "_gain_base", "_doubt_base", "_gap_base", "_lost", variance["_base"].alias("_var_base"), F.inline(F.array(*candidates))
    )
    risk0, risk1 = F.sqrt("_var_base"), F.sqrt("_var")
    te_left = F.col("max_tracking_error") / F.sqrt(F.lit(float(YEAR))) - risk0
    gap_left = F.col("max_industry_deviation") - F.col("_gap_base")
    te_room = F.when(F.col("_var") > 1e-18, te_left / risk1)
    gap_room = F.when(F.col("_gap") > 1e-12, gap_left / F.col("_gap"))
    theta = F.least(F.lit(1.0), F.coalesce("_room", F.lit(1.0)), F.coalesce(te_room, F.lit(1.0)), F.coalesce(gap_room, F.lit(1.0)))
    per = per.withColumn("_theta", theta).where((F.col("_lost") <= 1e-9) & (te_left >= 0) & (gap_left >= 0))
    th = F.col("_theta")
    value = (
        F.col("_gain_base")
        + th * F.col("_gain")
        - limits.risk_aversion * (risk0 + th * risk1) * (risk0 + th * risk1)
        - F.col("gamma") * (F.col("_doubt_base") + th * F.col("_one") + th * th * F.col("_two"))
    )
    # rounding keeps float noise from deciding between equal candidates
    best = per.groupBy(*keys).agg(F.max_by(F.struct("candidate", "_theta"), F.struct(F.round(value, 9).alias("v"), (-F.col("candidate")).alias("c"))).alias("_best"))
    chosen = stage(best.select(*keys, "_best.candidate", "_best._theta"))
    tilted = own.join(chosen, keys).withColumn("weight", wb + F.col("_theta") * F.array(*[F.col(f"_a{c}") for c in span])[F.col("candidate")])
    df = df.drop("_base", "_g")
    targets = stage(tilted.select(*df.columns, "candidate", "weight").withColumn("optimization_status", F.lit("tilted")))
    return _fill_infeasible(df, targets, keys, by)


def _fill_infeasible(df: DataFrame, targets: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Dates without a feasible candidate: last feasible weights, else benchmark, else equal weights."""
    done = targets.select(*keys).distinct()
    every = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("benchmark_weight").alias("_wb"))
    state = every.join(done.withColumn("_ok", F.lit(True)), keys, "left")
    order = W.partitionBy(*by).orderBy("rebalance_date").rowsBetween(W.unboundedPreceding, -1)
    prior = F.last(F.when(F.col("_ok"), F.col("rebalance_date")), ignorenulls=True).over(order)
    missing = state.withColumn("_prior", prior).where("_ok IS NULL")
    rows = df.join(stage(missing), keys)
    old = targets.select(*by, F.col("rebalance_date").alias("_prior"), "ts_code", F.col("weight").alias("_old"))
    rows = rows.join(old, [*by, "_prior", "ts_code"], "left")
    kept = rows.groupBy(*keys).agg(F.sum("_old").alias("_kept"))
    rows = rows.join(kept, keys)
    weight = (
        F.when(F.col("_kept") > 0, F.coalesce("_old", F.lit(0.0)) / F.col("_kept"))
        .when(F.col("_wb") > 0, F.col("benchmark_weight") / F.col("_wb"))
        .otherwise(F.lit(1.0) / F.col("_n"))
    )
    status = F.when(F.col("_kept") > 0, "fallback_previous").when(F.col("_wb") > 0, "fallback_benchmark").otherwise("fallback_equal")
    filled = rows.select(*df.columns, F.lit(None).cast("int").alias("candidate"), weight.alias("weight"), status.alias("optimization_status"))
    return targets.unionByName(filled)


def turnover_path(targets: DataFrame, limits: Limits = Limits(), by: Sequence[str] = (), max_turnover: dict | None = None, rows_per_task: int = 5000) -> DataFrame:
    """Walk from book to target, moving at most the one-way turnover limit per rebalance.

    ``targets`` holds every snapshot code of a date, zero weights included; a book lives on its
    snapshot. The old book is cut to the codes still present and scaled back to sum 1, then
    ``w = old + min(1, limit/move)·(target - old)`` with ``move = ½Σ|target - old|``. With
    nothing left of the old book the target is taken as it is.

    The step of a date depends on all earlier ones, so dates are taken in order, but in one Spark
    job: targets are laid out as one short array per (scenario, code) and dealt over the tasks of
    a barrier stage, where each task carries the books of its codes forward and the tasks add up
    four sums per scenario at every date, through small files beside the staged tables. A lost
    executor makes the stage start again from the stored arrays. ``max_turnover`` gives limits per scenario: by its value, or by the tuple of the values of ``by``.
    """
    by = list(by) or ["_all"]
    plain = by == ["_all"]
    if plain:
        targets = targets.withColumn("_all", F.lit(0))
    # one text per scenario that no two scenarios share, NULLs and separators in names included
    targets = targets.withColumn("_s", F.to_json(F.struct(*by), {"ignoreNullFields": "false"}))
    live = targets.select(*by, "_s", "rebalance_date").distinct().collect()  # a row per scenario and date
    if not live:
        return targets.select(*([] if plain else by), "rebalance_date", "ts_code", "weight").where("false")
    names = sorted({x["_s"] for x in live})
    number = {s: i for i, s in enumerate(names)}
    dates = sorted({x["rebalance_date"] for x in live})
    caps = [limits.max_turnover] * len(names)
    trades = [[False] * len(dates) for _ in names]
    for x in live:
        cap = (max_turnover or {}).get(x[by[0]] if len(by) == 1 else tuple(x[c] for c in by))
        caps[number[x["_s"]]] = limits.max_turnover if cap is None else cap
        trades[number[x["_s"]]][dates.index(x["rebalance_date"])] = True
    at = F.array_position(F.array(*[F.lit(d) for d in dates]), F.col("rebalance_date"))
    laid = targets.groupBy(*by, "_s", "ts_code").agg(F.map_from_entries(F.collect_list(F.struct(at.alias("i"), "weight"))).alias("_m"))
    slots = F.sequence(F.lit(1), F.lit(len(dates)))
    code = F.array_position(F.array(*[F.lit(s) for s in names]), F.col("_s")) - 1
    laid = stage(laid.select(*by, "ts_code", code.cast("int").alias("_s"), F.transform(slots, lambda i: F.try_element_at("_m", i.cast("long"))).alias("_w")))
    slots_there = laid.sparkSession.sparkContext.defaultParallelism  # a barrier stage needs all its tasks at the same time
    tasks = max(1, min(slots_there, -(-laid.count() // rows_per_task)))
    kept = [*by, "ts_code"]
    schema = ", ".join(f"`{c}` {laid.schema[c].dataType.simpleString()}" for c in kept) + ", _i INT, weight DOUBLE"
    folder = scratch_path(laid.sparkSession, "sums")
    walked = laid.repartition(tasks, "_s", "ts_code").mapInArrow(_walk(kept, caps, trades, folder), schema, barrier=True)
    day = F.element_at(F.array(*[F.lit(d) for d in dates]), F.col("_i") + 1)
    path = stage(walked.select(*([] if plain else by), day.alias("rebalance_date"), "ts_code", "weight"))
    remove(laid.sparkSession, folder)
    return path


def _exchange(context, folder: str) -> Callable[[int, str], list[str]]:
    """A function of (round, text) that gives the texts of all tasks of a barrier stage, in the order of its tasks.

    Spark's ``allGather`` looks for its answer once a second, whatever it carries, so the tasks leave files for
    each other in ``folder``. Files are named by the attempt that wrote them, so that those of a stage that has to
    start again are not read. Where some task cannot see the files of all others, ``allGather`` carries the texts.
    """
    from pyarrow import fs

    if len(context.getTaskInfos()) == 1:
        return lambda i, text: [text]
    own = context.taskAttemptId()
    try:
        system, inner = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    except Exception:
        system, inner = None, folder

    def leave(name: str, text: str) -> None:
        with system.open_output_stream(f"{inner}/_{name}") as f:
            f.write(text.encode())
        system.move(f"{inner}/_{name}", f"{inner}/{name}")  # a file has its name only when it is whole

    def there(name: str) -> bool:
        return system.get_file_info(f"{inner}/{name}").type == fs.FileType.File

    def read(name: str) -> str:
        began = time.monotonic()
        while not there(name):
            time.sleep(min(0.1, 0.001 + (time.monotonic() - began) / 10))
        with system.open_input_stream(f"{inner}/{name}") as f:
            return f.read().decode()

    def seen(names: list[str]) -> bool:
        try:
            return all(there(n) for n in names)
        except Exception:
            return False

    try:
        system.create_dir(inner, recursive=True)
        leave(f"task-{own}", "")
    except Exception:
        pass  # the others miss the file
    tasks = context.allGather(str(own))
    shared = system is not None and seen([f"task-{x}" for x in tasks])
    if not all(json.loads(x) for x in context.allGather(json.dumps(shared))):
        return lambda i, text: context.allGather(text)

    def swap(i: int, text: str) -> list[str]:
        leave(f"{i}-{own}", text)
        return [read(f"{i}-{x}") for x in tasks]

    return swap


def _walk(kept: list[str], caps: list[float], trades: list[list[bool]], folder: str):
    """Books of a task's codes, date after date; the tasks of the stage add up their sums at each date."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        context, scenarios, days = BarrierTaskContext.get(), len(caps), len(trades[0])
        parts = [b for b in batches if b.num_rows]
        table = pa.Table.from_batches(parts).combine_chunks() if parts else None
        scenario = table["_s"].to_numpy() if parts else np.zeros(0, np.int32)
        target = np.concatenate([b.column("_w").flatten().to_numpy(zero_copy_only=False).reshape(-1, days) for b in parts]) if parts else np.zeros((0, days))
        add = lambda x: np.bincount(scenario, x, minlength=scenarios)
        book, held = np.zeros(len(scenario)), np.zeros(scenarios)
        found: list[tuple[np.ndarray, int, np.ndarray]] = []
        swap = _exchange(context, folder)
        for i in range(days):
            goal, here = np.nan_to_num(target[:, i]), ~np.isnan(target[:, i])
            stays = ~np.isnan(target[:, i + 1]) if i + 1 < days else np.zeros(len(scenario), bool)
            old = book / np.where(held > 0, held, 1.0)[scenario]
            own = [add(np.abs(goal - old) * here) / 2, add(book * (stays & here)), add(goal * stays), add(book * stays)]
            every = swap(i, json.dumps([x.tolist() for x in own]))
            move, old_stays, goal_stays, all_stays = np.sum([json.loads(x) for x in every], axis=0)
            trading = np.array([t[i] for t in trades])
            free = (held <= 0) | (move <= caps)
            step = np.where(free, 1.0, caps / np.where(free, 1.0, move))
            after = np.where(held > 0, (1 - step) * old_stays / np.where(held > 0, held, 1.0), 0.0) + step * goal_stays
            stay = np.where(held > 0, 1 - step, 0.0)[scenario]
            book = np.where(trading[scenario], (old * stay + step[scenario] * goal) * here, book)
            held = np.where(trading, after, all_stays)
            rows = np.flatnonzero(trading[scenario] & (book > 0))
            found.append((rows, i, book[rows]))
        if table is not None:
            for rows, i, weight in found:
                out = table.select(kept).take(pa.array(rows)).append_column("_i", pa.array(np.full(len(rows), i, np.int32))).append_column("weight", pa.array(weight))
                yield from out.combine_chunks().to_batches()

    return walk
