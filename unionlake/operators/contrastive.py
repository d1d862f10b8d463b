"""Contrastive pairs, NT-Xent loss and data-parallel training of the
projection (D8, D9, E12, E13, H3, L5, U9, U10).

The loss compares every vector of a batch with every other.  A batch is cut
into tiles of bounded size; a pair of tiles is one matrix product, whose rows
are reduced to a running log-sum-exp before they leave the task, so no task
holds the matrix of a batch and no pairs are emitted.  Training takes a step
for every batch (or for as many as there are ranks) inside a barrier stage.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unionlake.functions import vectors as V
from unionlake.operators import embed, sampling
from unionlake.session import materialize

TABLE, COLUMN = "table_name", "column_name"


def pair_views(view_i: DataFrame, view_j: DataFrame, keys=("batch_id", TABLE, COLUMN)) -> DataFrame:
    """Match the two views of the same column -> keys + view_i, view_j."""
    a = view_i.select(*keys, F.col("vec").alias("view_i"))
    b = view_j.select(*keys, F.col("vec").alias("view_j"))
    return a.join(b, list(keys))


def stack_views(pairs: DataFrame, keys=("batch_id", TABLE, COLUMN)) -> DataFrame:
    """H3: view i rows then view j rows (2N vectors per batch) with a side flag."""
    a = pairs.select(*keys, F.lit(0).alias("side"), F.col("view_i").alias("vec"))
    b = pairs.select(*keys, F.lit(1).alias("side"), F.col("view_j").alias("vec"))
    return a.unionByName(b)


def flatten_batch_columns(vecs: DataFrame, batch_size: int, seed: int = 12345) -> DataFrame:
    """Every column vector of the lake with the batch of its table."""
    return vecs.join(sampling.assign_batches(vecs, batch_size, seed), TABLE)


# --- NT-Xent per batch ----------------------------------------------------------
def _unit(m: np.ndarray) -> np.ndarray:
    n = np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    return m / n


def _ntxent_batch(zi: np.ndarray, zj: np.ndarray, tau: float):
    """Loss and dL/dz for one batch (z rows in view order i then j)."""
    n = zi.shape[0]
    z = np.concatenate([zi, zj])
    norms = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    u = z / norms
    s = u @ u.T / tau
    idx = np.arange(2 * n)
    pos = np.concatenate([idx[n:], idx[:n]])
    masked = s.copy()
    masked[idx, idx] = -np.inf
    mx = masked.max(axis=1, keepdims=True)
    e = np.exp(masked - mx)
    denom = e.sum(axis=1, keepdims=True)
    lse = (np.log(denom) + mx)[:, 0]
    losses = lse - s[idx, pos]
    loss = losses.mean()
    g = e / denom / (2 * n)
    g[idx, pos] -= 1.0 / (2 * n)
    du = (g + g.T) @ u / tau
    dz = (du - u * np.sum(u * du, axis=1, keepdims=True)) / norms
    return loss, losses, dz


def _tiles(stacked: DataFrame, group: str, tile: int) -> DataFrame:
    """(group, tile, pairs, sides, rows): blocks of at most ``tile`` unit vectors of one batch, written.

    A batch is dealt to as many tasks as it fills tiles."""
    rows = stacked.select(F.col(group).cast("long").alias("batch"), F.col("pair").cast("long").alias("pair"), F.col("side").cast("int").alias("side"), V.to_double_array("vec").alias("vec"))
    sizes = materialize(rows.groupBy(F.col("batch").alias("of")).agg(F.count(F.lit(1)).alias("n")), "batch-sizes")
    dealt = rows.join(sizes, F.col("batch").eqNullSafe(F.col("of"))).select("batch", "pair", "side", "vec", F.pmod(F.xxhash64("pair", "side"), F.ceil(F.col("n") / tile)).alias("shard"))

    def pack(batches):
        held, at = [], None

        def out():
            vecs = np.array([h[2] for h in held], np.float64).reshape(len(held), -1)
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]], pa.int64()), pa.array([np.array([h[0] for h in held], np.int64).tobytes()], pa.binary()),
                 pa.array([np.array([h[1] for h in held], np.int32).tobytes()], pa.binary()), pa.array([_unit(vecs).tobytes()], pa.binary())], names=["batch", "pairs", "sides", "rows"])

        for b in batches:
            for key in zip(*(b.column(c).to_pylist() for c in ("batch", "shard", "pair", "side", "vec"))):
                if held and (key[:2] != at or len(held) == tile):
                    yield out()
                    held = []
                at = key[:2]
                held.append(key[2:])
        if held:
            yield out()

    packed = dealt.repartition("batch", "shard").sortWithinPartitions("batch", "shard", "pair", "side").mapInArrow(pack, "batch long, pairs binary, sides binary, rows binary")
    return materialize(packed.withColumn("tile", F.monotonically_increasing_id()), "loss-tiles")


def per_vector_loss(stacked: DataFrame, tau: float = 0.1, group: str = "batch_id", tile: int = 2048) -> DataFrame:
    """D9 + E12: for every vector its NT-Xent term
    -log(exp(s+/tau) / sum_{k != i} exp(s_ik/tau)) within its batch.
    ``stacked``: group, pair, side (0/1), vec.  -> group, pair, side, loss, neg_sum."""
    tiles = _tiles(stacked, group, tile)
    other = tiles.select(F.col("batch").alias("o_batch"), *[F.col(c).alias(f"o_{c}") for c in ("tile", "pairs", "sides", "rows")])
    met = tiles.join(other, F.col("batch").eqNullSafe(F.col("o_batch"))).drop("o_batch")

    def compare(batches):
        for b in batches:
            for r in range(b.num_rows):
                pairs, o_pairs = (np.frombuffer(b.column(c)[r].as_buffer(), np.int64) for c in ("pairs", "o_pairs"))
                sides, o_sides = (np.frombuffer(b.column(c)[r].as_buffer(), np.int32) for c in ("sides", "o_sides"))
                rows, o_rows = (np.frombuffer(b.column(c)[r].as_buffer(), np.float64).reshape(len(n), -1) for c, n in (("rows", pairs), ("o_rows", o_pairs)))
                s = rows @ o_rows.T / tau
                same = pairs[:, None] == o_pairs[None, :]
                partner = same & (sides[:, None] != o_sides[None, :])
                s_pos = np.where(partner.any(axis=1), np.where(partner, s, 0.0).sum(axis=1), np.nan)
                if b.column("tile")[r].as_py() == b.column("o_tile")[r].as_py():
                    np.fill_diagonal(s, -np.inf)
                top = s.max(axis=1)
                total = np.exp(s - np.where(np.isfinite(top), top, 0.0)[:, None]).sum(axis=1)
                batch = pa.array([b.column("batch")[r].as_py()] * len(pairs), pa.int64())
                yield pa.RecordBatch.from_arrays([batch, pa.array(pairs), pa.array(sides), pa.array(top), pa.array(total), pa.array(s_pos, from_pandas=True)], names=["batch", "pair", "side", "top", "total", "s_pos"])

    parts = met.mapInArrow(compare, "batch long, pair long, side int, top double, total double, s_pos double")
    # a part for each tile of the batch
    merged = parts.groupBy("batch", "pair", "side").agg(F.max("top").alias("top"), F.collect_list(F.struct("top", "total")).alias("parts"), F.max("s_pos").alias("s_pos"))
    total = F.aggregate("parts", F.lit(0.0), lambda a, x: a + F.when(x["total"] > 0, x["total"] * F.exp(x["top"] - F.col("top"))).otherwise(0.0))
    merged = merged.withColumn("total", total)
    return merged.select(F.col("batch").alias(group), "pair", "side", (F.ln("total") + F.col("top") - F.col("s_pos")).alias("loss"), (F.col("total") * F.exp("top")).alias("neg_sum"))


def ntxent_loss(stacked: DataFrame, tau: float = 0.1, group: str = "batch_id") -> DataFrame:
    """Mean NT-Xent loss per batch."""
    return per_vector_loss(stacked, tau, group).groupBy(group).agg(
        F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("n_vectors"))


# --- E13: data-parallel training --------------------------------------------------
def _forward(x, p):
    h_pre = x @ p["w1"] + p["b1"]
    h = np.maximum(h_pre, 0.0)
    return h_pre, h, h @ p["w2"] + p["b2"]


def _grads(xi, xj, p, tau):
    x = np.concatenate([xi, xj])
    h_pre, h, z = _forward(x, p)
    n = xi.shape[0]
    loss, _, dz = _ntxent_batch(z[:n], z[n:], tau)
    g = {"w2": h.T @ dz, "b2": dz.sum(axis=0)}
    dh = dz @ p["w2"].T * (h_pre > 0)
    g["w1"] = x.T @ dh
    g["b1"] = dh.sum(axis=0)
    return loss, g


KEYS = ["w1", "b1", "w2", "b2"]


def _flat(p: dict) -> np.ndarray:
    return np.concatenate([np.asarray(p[k], np.float64).ravel() for k in KEYS])


def _shaped(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in KEYS:
        shape = np.asarray(like[k]).shape
        out[k] = flat[at : at + int(np.prod(shape))].reshape(shape)
        at += int(np.prod(shape))
    return out


@dataclass(frozen=True)
class AdamW:
    lr: float = 5e-4
    weight_decay: float = 1e-2
    betas: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8

    def rate(self, epoch: int, epochs: int) -> float:
        """Cosine from lr to lr / 50, a value for each epoch."""
        low = self.lr / 50.0
        return low + (self.lr - low) * (1 + np.cos(np.pi * epoch / epochs)) / 2

    def step(self, p, m, v, g, t, lr):
        """Weights and moments after step ``t`` (from 1)."""
        m = self.betas[0] * m + (1 - self.betas[0]) * g
        v = self.betas[1] * v + (1 - self.betas[1]) * g * g
        p = p * (1 - lr * self.weight_decay)
        return p - lr * (m / (1 - self.betas[0] ** t)) / (np.sqrt(v / (1 - self.betas[1] ** t)) + self.eps), m, v


def epoch_order(pairs: DataFrame, epoch: int, ranks: int, seed: int) -> DataFrame:
    """The batches of an epoch in an order of its own: (batch_id, step, rank), a row a batch."""
    ids = pairs.select("batch_id").distinct()
    w = Window.orderBy(sampling.hash_order(seed, F.lit(epoch), "batch_id"), "batch_id")
    n = F.row_number().over(w) - 1
    return ids.select("batch_id", F.floor(n / ranks).cast("int").alias("step"), F.pmod(n, F.lit(ranks)).cast("int").alias("rank"))


def _train_epoch(src: DataFrame, state: tuple, like: dict, optimiser: AdamW, lr: float, steps: int, ranks: int, tau: float):
    """One epoch in a barrier stage: each rank reads its batches in order, all ranks exchange the gradients of a step and
    take the same step.  Returns (state, mean loss): one row of parameter size reaches the driver."""
    def run(batches):
        context = BarrierTaskContext.get()
        p, m, v, t = state

        def mine():
            held, at = [], None
            for b in batches:
                for step, vi, vj in zip(*(b.column(c).to_pylist() for c in ("step", "view_i", "view_j"))):
                    if held and step != at:
                        yield at, held
                        held = []
                    at = step
                    held.append((vi, vj))
            if held:
                yield at, held

        own, total, n = mine(), 0.0, 0
        ready = next(own, None)
        for step in range(steps):
            message = ""
            if ready is not None and ready[0] == step:  # the last step may have fewer batches than ranks
                xi, xj = (np.array(x, np.float64) for x in zip(*ready[1]))
                loss, g = _grads(xi, xj, _shaped(p, like), tau)
                message = base64.b64encode(np.append(_flat(g), loss).tobytes()).decode()
                ready = next(own, None)
            got = [np.frombuffer(base64.b64decode(x), np.float64) for x in context.allGather(message) if x]
            mean = np.mean(got, axis=0)
            total, n, t = total + mean[-1], n + 1, t + 1
            p, m, v = optimiser.step(p, m, v, mean[:-1], t, lr)
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([list(x)], pa.list_(pa.float64())) for x in (p, m, v)] + [pa.array([total / max(n, 1)])], names=["p", "m", "v", "loss"])

    dealt = src.repartitionById(ranks, F.col("rank")).sortWithinPartitions("step")
    row = dealt.mapInArrow(run, "p array<double>, m array<double>, v array<double>, loss double", barrier=True).collect()[0]
    return (*(np.array(row[c]) for c in ("p", "m", "v")), state[3] + steps), float(row["loss"])


def validation_loss(pairs: DataFrame, params: dict, tau: float) -> float:
    """E12 of projected pairs: the mean over all vectors."""
    numbered = pairs.select("batch_id", F.monotonically_increasing_id().alias("pair"), *[V.project_vectors(c, params).alias(c) for c in ("view_i", "view_j")])
    stacked = stack_views(materialize(numbered, "valid-views"), keys=("batch_id", "pair"))
    return float(per_vector_loss(stacked, tau).agg(F.avg("loss")).first()[0])


@dataclass
class Epoch:
    epoch: int
    steps: int
    loss: float
    valid_loss: float | None


def fit_projection(pairs: DataFrame, params: dict, epochs: int = 20, lr: float = 5e-4, weight_decay: float = 1e-2,
                   tau: float = 0.1, betas=(0.9, 0.999), eps: float = 1e-8, valid: DataFrame | None = None,
                   ranks: int = 1, seed: int = 12345) -> tuple[dict, list[Epoch]]:
    """AdamW with a cosine schedule (eta_min = lr / 50), a step for each
    batch of each epoch.  With ``ranks`` > 1 that many batches are worked out
    at the same time and their gradients averaged to one step.

    ``pairs``: batch_id, view_i, view_j.  An epoch is one barrier stage; the
    weights come back after it, so a lost executor costs an epoch.  Returns
    the weights of the epoch with the smallest loss on ``valid`` (on the
    training pairs if there is none), and a record of every epoch."""
    src = materialize(pairs.select(F.col("batch_id").cast("long").alias("batch_id"), V.to_double_array("view_i").alias("view_i"), V.to_double_array("view_j").alias("view_j")), "train-pairs")
    optimiser, like = AdamW(lr, weight_decay, tuple(betas), eps), {k: np.asarray(params[k], np.float64) for k in KEYS}
    start = _flat(like)
    state, history, best = (start, np.zeros_like(start), np.zeros_like(start), 0), [], (np.inf, like)
    steps = -(-src.select("batch_id").distinct().count() // ranks)
    for epoch in range(epochs if steps else 0):
        order = materialize(epoch_order(src, epoch, ranks, seed), "epoch-order")
        state, loss = _train_epoch(src.join(order, "batch_id"), state, like, optimiser, optimiser.rate(epoch, epochs), steps, ranks, tau)
        now = _shaped(state[0], like)
        held_out = validation_loss(valid, now, tau) if valid is not None else None
        history.append(Epoch(epoch, steps, loss, held_out))
        best = min(best, (loss if held_out is None else held_out, now), key=lambda x: x[0])
    return best[1], history


# --- U9 / U10 ---------------------------------------------------------------------
def pretraining_pairs(cells: DataFrame, num_rows: int = 5, batch_size: int = 32, dim: int = 64,
                      seeds: tuple[int, int] = (1, 2), batch_seed: int = 12345) -> DataFrame:
    """Two row samples per table -> column vectors of each -> paired by
    (batch, table, column)."""
    vi, vj = sampling.two_view_sample(cells, num_rows, seeds)
    ei, ej = embed.embed_columns(vi, dim), embed.embed_columns(vj, dim)
    batches = sampling.assign_batches(cells, batch_size, batch_seed)
    return pair_views(ei.join(batches, TABLE), ej.join(batches, TABLE))


def infer_projected_vectors(vecs: DataFrame, params: dict) -> DataFrame:
    """Apply a (trained) projection to column vectors."""
    return vecs.withColumn("vec", V.project_vectors("vec", params))
