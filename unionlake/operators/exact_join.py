"""Exact cosine join of dense vectors (D3).

Every pair of vectors with cosine >= threshold, found without looking at all
pairs in full:

* The unit vectors are rotated onto the principal axes of the lake, so that
  the first components carry most of their length.
* An inverted index of clusters: a lake vector is listed under its nearest
  centroid, with the widest angle of that list.  A block of queries reads only
  the lists that its own cone, widened by acos(threshold), touches (triangle
  inequality on angles).
* In a list, products are built up from a prefix of the components.  What the
  rest can still add is at most the product of the remaining norms; pairs that
  cannot reach the threshold any more go before the next components are read.

All bounds are exact up to a margin for rounding, so no pair is missed.  How
much they spare depends on the data: vectors without any structure have wide
cones, and only the remaining-norm bound works.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unionlake.session import materialize

#: Centroids are shipped to every task; their number is bounded whatever the lake's size.
MAX_LISTS = 4096
BLOCK = 512
MARGIN = 1e-6
#: Shares of the components after which pairs are tested.
STAGES = (0.125, 0.25, 0.5, 0.75)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def principal_axes(vecs: DataFrame, dim: int) -> np.ndarray:
    """Eigenvectors of the unit vectors' second moments, largest first: dim * dim sums are all that reaches the driver."""
    def moments(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            u = _unit(_matrix(b.column("vec")))
            total += u.T @ u if len(u) else 0.0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = vecs.select("vec").mapInArrow(moments, "i long, row array<double>")
    rows = parts.groupBy("i").agg(F.array(*[F.sum(F.col("row")[d]) for d in range(dim)]).alias("row")).orderBy("i").collect()
    _, axes = np.linalg.eigh(np.array([r["row"] for r in rows]))
    return axes[:, ::-1].copy()


@dataclass
class Rotation:
    axes: np.ndarray
    centroids: np.ndarray  #: unit vectors on the rotated axes

    def rotated(self, column: pa.Array) -> np.ndarray:
        return _unit(_matrix(column)) @ self.axes

    def lists(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid of each row, and the cosine to it."""
        near = rows @ self.centroids.T
        home = near.argmax(axis=1)
        return home, near[np.arange(len(rows)), home]


def spread_out(rows: np.ndarray, k: int) -> np.ndarray:
    """k of the unit vectors, each next one with the widest angle to those before: narrow cones for what they cover."""
    chosen, near = [0], rows @ rows[0]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int(near.argmin()))
        np.maximum(near, rows @ rows[chosen[-1]], out=near)
    return rows[chosen]


def fit(lake: DataFrame, n: int, dim: int) -> Rotation:
    """Axes of the lake, and at most MAX_LISTS centroids spread over a hash sample of four times as many vectors."""
    axes = principal_axes(lake, dim)
    k = min(MAX_LISTS, max(1, math.ceil(math.sqrt(n))))
    rows = lake.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(4 * k).collect()
    return Rotation(axes, spread_out(_unit(np.array([r["vec"] for r in rows], np.float64)) @ axes, k))


def _blocks(vecs: DataFrame, rotation: Rotation, n: int) -> DataFrame:
    """(list, ids, rows, least): blocks of at most BLOCK vectors of one list; ``least`` is the smallest cosine to its
    centroid.  A list that many vectors share is dealt to as many tasks as it is expected to fill."""
    k = len(rotation.centroids)
    shards = max(1, min(64, n // (k * BLOCK * 4)))

    def place(batches):
        for b in batches:
            if b.num_rows:
                rows = rotation.rotated(b.column("vec"))
                home, _ = rotation.lists(rows)
                yield pa.RecordBatch.from_arrays([pa.array(home), b.column("id"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["list", "id", "row"])

    def pack(batches):
        held, at = [], None

        def out():
            rows = np.frombuffer(b"".join(h[1] for h in held), np.float64).reshape(len(held), -1)
            least = float((rows @ rotation.centroids[at]).min())
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([np.array([h[0] for h in held], np.int64).tobytes()], pa.binary()), pa.array([rows.tobytes()], pa.binary()), pa.array([least])], names=["list", "ids", "rows", "least"])

        for b in batches:
            for home, i, row in zip(*(b.column(c).to_pylist() for c in ("list", "id", "row"))):
                if held and (home != at or len(held) == BLOCK):
                    yield out()
                    held = []
                at = home
                held.append((i, row))
        if held:
            yield out()

    placed = vecs.select("id", "vec").mapInArrow(place, "list bigint, id bigint, row binary")
    dealt = placed.repartition("list", F.pmod("id", F.lit(shards))).sortWithinPartitions("list", "id")
    return dealt.mapInArrow(pack, "list bigint, ids binary, rows binary, least double")


def _reached(queries: DataFrame, lists: dict[int, float], rotation: Rotation, threshold: float) -> DataFrame:
    """(list, ids, rows) of every query block and each list that its cone can reach."""
    k = len(rotation.centroids)
    width = np.full(k, -1.0)
    for i, least in lists.items():
        width[i] = math.acos(max(-1.0, min(1.0, least)))
    some = np.flatnonzero(width >= 0)
    reach = math.acos(max(-1.0, threshold - MARGIN)) + MARGIN
    between = np.arccos(np.clip(rotation.centroids @ rotation.centroids[some].T, -1.0, 1.0))

    def reached(batches):
        for b in batches:
            home, own = b.column("list").to_numpy(), np.arccos(np.clip(b.column("least").to_numpy(), -1.0, 1.0))
            row, at = np.nonzero(between[home] <= own[:, None] + width[some][None, :] + reach)
            yield pa.RecordBatch.from_arrays([pa.array(some[at]), *(b.column(c).take(pa.array(row)) for c in ("ids", "rows"))], names=["list", "ids", "rows"])

    return queries.select("list", "ids", "rows", "least").mapInArrow(reached, "list bigint, ids binary, rows binary")


def survivors(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(row of a, row of b, pairs left after each stage) of the pairs whose product reaches the threshold, up to the margin."""
    dim, least = a.shape[1], threshold - MARGIN
    cuts = sorted({max(1, math.ceil(dim * s)) for s in STAGES} | {dim})
    squares_a, squares_b = (np.concatenate((np.zeros((len(x), 1)), np.cumsum(x * x, axis=1)), axis=1) for x in (a, b))
    rest = lambda squares, at: np.sqrt(np.maximum(squares[:, -1] - squares[:, at], 0.0))
    left, done, whole = [], 0, np.zeros((len(a), len(b)))
    i = j = part = None
    for at in cuts:
        if i is None:
            whole += a[:, done:at] @ b[:, done:at].T
            bound = whole + np.outer(rest(squares_a, at), rest(squares_b, at))
            alive = int((bound >= least).sum())
            if alive < whole.size / 8 or at == dim:  # few are left: from here on pair by pair
                i, j = np.nonzero(bound >= least)
                part = whole[i, j]
        else:
            step = np.empty(len(i))
            for s in range(0, len(i), 1 << 16):
                some = slice(s, s + (1 << 16))
                step[some] = np.einsum("ij,ij->i", a[i[some], done:at], b[j[some], done:at])
            part = part + step
            keep = part + rest(squares_a, at)[i] * rest(squares_b, at)[j] >= least
            i, j, part = i[keep], j[keep], part[keep]
            alive = len(i)
        left.append(alive)
        done = at
    return i, j, left


def _compared(queries: DataFrame, lake: DataFrame, threshold: float, count_only: bool) -> DataFrame:
    """(q_id, c_id) of all pairs that reach the threshold; or the work done: (stage, pairs)."""
    n_q, n_c, dim = queries.count(), lake.count(), lake.agg(F.max(F.size("vec"))).first()[0]
    schema = "stage int, pairs bigint" if count_only else "q_id bigint, c_id bigint"
    if not n_q or not n_c:
        return queries.sparkSession.createDataFrame([], schema)
    rotation = fit(lake, n_c, dim)
    lake_blocks = materialize(_blocks(lake, rotation, n_c), "cosine-lists")
    query_blocks = lake_blocks if queries is lake else _blocks(queries, rotation, n_q)
    # a row per list
    lists = {r["list"]: r["least"] for r in lake_blocks.groupBy("list").agg(F.min("least").alias("least")).collect()}
    asked = materialize(_reached(query_blocks, lists, rotation, threshold), "cosine-asked")
    met = asked.withColumnsRenamed({"ids": "q_ids", "rows": "q_rows"}).join(lake_blocks.select("list", "ids", "rows"), "list")

    def compare(batches):
        work = np.zeros(len(STAGES) + 2, np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                q, c = (np.frombuffer(batch.column(x)[r].as_buffer(), np.int64) for x in ("q_ids", "ids"))
                a, b = (np.frombuffer(batch.column(x)[r].as_buffer(), np.float64).reshape(-1, dim) for x in ("q_rows", "rows"))
                i, j, left = survivors(a, b, threshold)
                work[0] += len(q) * len(c)
                work[1 : 1 + len(left)] += left
                if not count_only:
                    yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(c[j])], names=["q_id", "c_id"])
        if count_only:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(work), dtype=np.int32)), pa.array(work)], names=["stage", "pairs"])

    return met.mapInArrow(compare, schema)


def candidate_pairs(queries: DataFrame, lake: DataFrame, threshold: float) -> DataFrame:
    """(q_id, c_id) of every pair of the (id, vec) frames with cosine >= threshold, up to a margin of 1e-6: callers verify."""
    return _compared(queries, lake, threshold, count_only=False)


def pruning(queries: DataFrame, lake: DataFrame, threshold: float) -> list[float]:
    """Shares of all pairs that are left after the list test and after each stage of the remaining-norm test."""
    every = max(1, queries.count() * lake.count())
    work = _compared(queries, lake, threshold, count_only=True).groupBy("stage").agg(F.sum("pairs").alias("n")).orderBy("stage").collect()
    return [r["n"] / every for r in work][: len(STAGES) + 2]
