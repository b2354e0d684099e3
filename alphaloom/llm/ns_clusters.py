"""Centroid clustering with ns-bounds: exact rounds that skip most distance evaluations.

Every vector keeps, for each centroid, the distance it last evaluated and the round it did so
in. The history of all centroids is kept, so in a later round the stored distance is loosened
by the norm of the centroid's total displacement since that round (not by the sum of what it
moved in each round, which is never smaller). A centroid whose loosened lower bound lies above
the loosened upper bound of the vector's own centroid cannot be nearer; all others are
evaluated anew, exactly. Components are integers, so squared distances are exact; bounds are
doubles and widened by ``SLACK``, and ties are always evaluated.

Each round writes vectors and bounds once to the checkpoint folder. Cluster sums are kept
from round to round: only vectors that changed their cluster are added and taken away, as at most
one row per cluster and task. The driver holds ``rounds * k`` centroids.

Edge cases: vectors that are null, have another number of components, or a null, non-finite or
huge component (``scale * x`` beyond 2**27, where squared distances pass 64 bits) are left out;
equal distances go to the smaller number; repeated rows count as often as they occur, rows
without id are clustered but are no seeds; fewer than ``k`` vectors with an id give as many clusters (none: an empty result);
an empty table gives an empty result; other columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.storage import settle
from alphaloom.operators.staging import discard

SLACK = 1e-9
LIMIT = 2**27


def quantised(vectors: DataFrame, vec_id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """``_id`` and ``_v``: the vectors with ``dims`` finite components as integers ``floor(scale * x)``."""
    own = vectors.select(F.col(vec_id).alias("_id"), F.col(vector).alias("_v"))
    fit = own.filter(f"size(_v) = {dims} AND forall(_v, x -> x IS NOT NULL AND abs(CAST(x AS DOUBLE)) < {LIMIT / scale!r}D)")
    return fit.selectExpr("_id", f"transform(_v, x -> CAST(floor({scale} * CAST(x AS DOUBLE)) AS INT)) AS _v")


def seeds(own: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``<seed>:<id>``, in that order; equal ids by their components."""
    rows = own.filter("_id IS NOT NULL").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256), "_v").limit(k).collect()
    return np.array([r["_v"] for r in rows], np.int64)


def _matrix(column: pa.ListArray, kind: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1)


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], values.ravel())


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def evaluate(x: np.ndarray, far: np.ndarray, seen: np.ndarray, history: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, int]:
    """Nearest centroid of the last round for each row of ``x``, and how many distances were evaluated.

    ``far`` and ``seen`` (distance and round of its evaluation, by row and centroid) are updated in place;
    ``own`` is the cluster of the round before, None in the first round, when all distances are evaluated.
    """
    now, k = len(history) - 1, history.shape[1]
    centre = history[now]
    if own is None:
        for j in range(k):
            far[:, j] = squared(x, centre[j])
        seen[:] = now
        return far.argmin(axis=1), far.size  # exact integers up to here
    moved = np.sqrt(((history - centre).astype(float) ** 2).sum(axis=2))  # (round, centroid): total displacement since
    loose = moved[seen, np.arange(k)]
    low = np.sqrt(far) * (1 - SLACK) - loose * (1 + SLACK)
    rows = np.arange(len(x))
    high = np.sqrt(far[rows, own]) * (1 + SLACK) + loose[rows, own] * (1 + SLACK)
    doubt = low <= high[:, None]
    doubt[rows, own] = False
    at = np.flatnonzero(doubt.any(axis=1))  # some bound fails: the own distance first
    far[at, own[at]] = squared(x[at], centre[own[at]])
    seen[at, own[at]] = now
    high[at] = np.sqrt(far[at, own[at]]) * (1 + SLACK)
    doubt &= low <= high[:, None]
    i, j = np.nonzero(doubt)
    far[i, j] = squared(x[i], centre[j])
    seen[i, j] = now
    best, out = np.full(len(x), np.iinfo(np.int64).max), own.copy()
    best[at] = far[at, own[at]]
    for c in range(k):  # ascending numbers; ties stay with the smaller one
        r = i[j == c]
        d = far[r, c]
        take = (d < best[r]) | ((d == best[r]) & (c < out[r]))
        best[r[take]], out[r[take]] = d[take], c
    return out, len(at) + len(i)


def _assign(state: DataFrame, history: np.ndarray, first: bool) -> DataFrame:
    """``state`` after one more round: ``was`` and ``cluster`` are the clusters before and now."""
    sent = state.sparkSession.sparkContext.broadcast(history)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        past = sent.value
        k = past.shape[1]
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("_v"), np.int64)
            if first:
                far, seen, own = np.zeros((len(x), k), np.int64), np.zeros((len(x), k), np.int16), None
            else:
                far, seen = _matrix(b.column("far"), np.int64).copy(), _matrix(b.column("seen"), np.int16).copy()
                own = b.column("cluster").to_numpy().astype(np.int64)
            cluster, looked = evaluate(x, far, seen, past, own)
            was = np.full(len(x), -1) if first else own
            looks = np.zeros(len(x), np.int64)
            looks[0] = looked
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("_id"), b.column("_v"), pa.array(was.astype(np.int32)), pa.array(cluster.astype(np.int32)),
                    pa.array(squared(x, past[-1][cluster])), _lists(far), _lists(seen), pa.array(looks),
                ],
                names=["_id", "_v", "was", "cluster", "distance", "far", "seen", "looked"],
            )

    kind = state.schema["_id"].dataType.simpleString()
    return state.mapInArrow(run, f"_id {kind}, _v ARRAY<INT>, was INT, cluster INT, distance BIGINT, far ARRAY<BIGINT>, seen ARRAY<SMALLINT>, looked BIGINT")


def _changes(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """What the round adds to each cluster's component sums and count, as Python integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for b in batches:
            x = np.column_stack([_matrix(b.column("_v"), np.int64).reshape(-1, dims), np.ones(b.num_rows, np.int64)])
            was = b.column("was").to_numpy()
            np.add.at(total, b.column("cluster").to_numpy(), x)
            np.subtract.at(total, was[was >= 0], x[was >= 0])
        j, i = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(total[j, i])], names=["j", "i", "n"])

    moved = state.filter("was != cluster").select("_v", "was", "cluster").mapInArrow(run, "j INT, i INT, n BIGINT")
    out = np.zeros((k, dims + 1), object)
    for r in moved.groupBy("j", "i").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():  # k * (dims + 1) rows at most
        out[r["j"], r["i"]] = int(r["n"])
    return out[:, :dims], out[:, dims]


def clusters(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1
) -> DataFrame:
    """``vec_id``, ``cluster``, squared ``distance``, ``cluster_inertia``, ``inertia`` and the final ``centroid`` of every kept vector.

    ``rounds`` times, vectors go to the nearest centroid and every centroid that has some becomes
    the floor of their mean; then they are assigned once more.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vec_id].dataType.simpleString()
    state = quantised(vectors, vec_id, vector, dims, scale)
    history = seeds(state, k, seed)[None]
    if not history.size:
        return spark.createDataFrame([], f"`{vec_id}` {kind}, cluster INT, distance BIGINT, cluster_inertia BIGINT, inertia BIGINT, centroid ARRAY<BIGINT>")
    sums, counts = np.zeros(history.shape[1:], object), np.zeros(history.shape[1], object)
    for step in range(rounds + 1):
        last, state = state, settle(_assign(state, history, first=step == 0))
        if step:
            discard(last)
        if step < rounds:
            more, members = _changes(state, *history.shape[1:])
            sums, counts = sums + more, counts + members
            new = history[-1].copy()
            for j in np.flatnonzero(counts > 0):
                new[j] = (sums[j] // counts[j]).astype(np.int64)
            history = np.concatenate([history, new[None]])
    inertia = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(j, s, sum(inertia.values()), history[-1][j].tolist()) for j, s in inertia.items()]
    table = spark.createDataFrame(rows, "cluster INT, cluster_inertia BIGINT, inertia BIGINT, centroid ARRAY<BIGINT>")  # k rows
    return state.select(F.col("_id").alias(vec_id), "cluster", "distance").join(F.broadcast(table), "cluster").select(
        vec_id, "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )
