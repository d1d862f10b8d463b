"""Approximate nearest neighbours with balanced posting lists.

Distinct vectors go into posting lists around centroids.  Centroids are fitted on a bounded sample, and lists that get too
many vectors are split between rounds.  A vector near a boundary is stored in several lists.  Lists are written as blocks
of at most ``block`` vectors, so a large list is many blocks and no task holds it whole.  A query finds the centroids
around it in a graph that every task holds in memory, and reads the lists whose centroids lie within a ratio of the nearest
one's distance.  That ratio is fitted: a bounded sample of the queries is compared with all vectors, and the ratio is the
smallest that reaches ``target`` of their true neighbours.

Equal vectors are one entry with its k + 1 smallest ids, which is all that a list of k can need; queries with equal vectors
are searched once.  Distances that are returned are exact, in double precision.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unionlake.llm.centroid_graph import CentroidGraph
from unionlake.llm.vecs import lists, matrix, packed, unpacked, usable
from unionlake.session import materialize

LAST = (1 << 63) - 1  #: stands for a null id: it comes last
SLICE = 512  #: vectors searched in the graph at a time


@dataclass(frozen=True)
class SearchParams:
    k: int = 10
    #: Bound of the centroids in memory: it caps the number of lists, whatever the table's size.
    centroid_bytes: int = 8 << 20
    #: Vectors a list is fitted on, on average; the sample is this times the number of lists.
    fit_per_list: int = 64
    rounds: int = 4
    #: Lists with more than this times the mean are split.
    heavy: float = 2.0
    closure: float = 1.3
    replicas: int = 4
    #: Lists that every query reads, whatever the ratio.
    at_least: int = 4
    block: int = 1024
    #: Queries that fit the ratio, at most.
    sample: int = 256
    target: float = 0.97


def in_search(vector: str) -> Column:
    """True for vectors that take part: there, finite, and not zero."""
    return usable(vector) & F.coalesce(F.exists(F.col(vector), lambda x: x != 0), F.lit(False))


def vector_keys(vector: str) -> list[Column]:
    """Two 64-bit hashes that stand for a vector."""
    return [F.xxhash64(F.col(vector)).alias("h1"), F.xxhash64(F.lit(0x5EED), F.col(vector)).alias("h2")]


def distinct_vectors(vectors: DataFrame, vec_id: str, vector: str, keep: int) -> DataFrame:
    """(rep, h1, h2, v, first, ids) of every distinct vector, written: a number, its hashes, its smallest id (null last), and
    its ``keep`` smallest ids.  Repeats are cut to ``keep`` before the shuffle, so a vector that holds a third of the rows
    is a few rows of every task."""
    rows = vectors.where(in_search(vector)).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), *vector_keys(vector))
    w = Window.partitionBy("h1", "h2").orderBy(F.col("id").asc_nulls_last())
    few = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep).withColumn("id", F.coalesce("id", F.lit(LAST)))
    reps = few.groupBy("h1", "h2").agg(F.min_by("v", "n").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))
    return materialize(reps.select(F.monotonically_increasing_id().alias("rep"), "h1", "h2", "v", F.col("ids")[0].alias("first"), "ids"), "distinct-vectors")


def _rows(batch: pa.RecordBatch, dims: int, unit: float) -> np.ndarray:
    return (matrix(batch.column("v"), dims) / unit).astype(np.float32)


@dataclass
class _Lists:
    """The lists that queries read; it travels to the tasks."""

    graph: CentroidGraph
    sizes: np.ndarray
    params: SearchParams

    def lists(self, rows: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) that queries read: by the ratio, and where those hold too few vectors for k distinct ones, further
        lists by distance until they suffice."""
        need = (self.params.k + 1) * self.params.replicas
        row, home = self.graph.within(rows, ratio, self.params.at_least)
        short = np.flatnonzero(np.bincount(row, weights=self.sizes[home], minlength=len(rows)) < min(need, self.sizes.sum()))
        if not len(short):
            return row, home
        every, k = np.arange(len(self.graph)), len(self.graph)
        far = self.graph.distance(rows, np.repeat(short, k), np.tile(every, len(short))).reshape(-1, k)
        order = np.argsort(far, axis=1, kind="stable")
        held = np.cumsum(self.sizes[order], axis=1)
        which, place = np.nonzero(held - self.sizes[order] < need)
        keep = ~np.isin(row, short)
        return np.concatenate((row[keep], short[which])), np.concatenate((home[keep], order[which, place]))


@dataclass
class Index:
    reps: DataFrame  #: the distinct vectors
    blocks: DataFrame  #: (list, n, reps, firsts, vectors): posting blocks, written
    graph: CentroidGraph
    dims: int
    unit: float  #: components are divided by this for the graph
    params: SearchParams
    sizes: np.ndarray  #: vectors in each list


def _split(points: np.ndarray, count: np.ndarray, spread: np.ndarray, heavy: float, most: int) -> np.ndarray:
    """Centroids without the empty lists; a list with more than ``heavy`` times the mean becomes several, moved off its
    centre along its spread in directions of random signs."""
    some = count > 0
    points, count, spread = points[some], count[some], spread[some]
    room, mean, out, made = most - len(points), count.mean(), [points], 0
    signs = np.random.Generator(np.random.PCG64(len(points)))
    for i in np.argsort(-count, kind="stable"):
        more = min(room - made, int(count[i] / mean) - 1)
        if count[i] <= heavy * mean or more <= 0 or not spread[i].any():
            continue
        out.append(points[i] + spread[i] * signs.choice((-1.0, 1.0), (more, points.shape[1])))
        made += more
    return np.concatenate(out)


def _fit(reps: DataFrame, n: int, dims: int, unit: float, p: SearchParams) -> tuple[CentroidGraph, np.ndarray]:
    """(graph, expected vectors of each list).  The sample are the vectors whose hash is below a bound; at most
    centroid_bytes of centroids and their sums reach the driver."""
    k = max(1, min(p.centroid_bytes // (8 * dims), math.ceil(2 * math.sqrt(n))))
    share = min(1.0, p.fit_per_list * k / n)
    mark = F.pmod(F.col("h1"), F.lit(1 << 30))
    sample = reps.where(mark < int(share * (1 << 30)) + 1).select("v", "h2")
    sample = materialize(sample.repartition(max(1, math.ceil(n * share / (1 << 15))), "h2"), "fit-sample")
    points = _rows(sample.orderBy("h2").limit(k).select("v").toArrow().combine_chunks().to_batches()[0], dims, unit).astype(np.float64)
    count = np.zeros(len(points))
    for step in range(p.rounds):
        graph = CentroidGraph(points)

        def sums(batches):
            total, squares, n_of = np.zeros((len(graph), dims)), np.zeros((len(graph), dims)), np.zeros(len(graph), np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    rows = _rows(batch.slice(at, SLICE), dims, unit)
                    home = graph.beam(rows, 4)[0][:, 0]
                    np.add.at(total, home, rows)
                    np.add.at(squares, home, rows.astype(np.float64) ** 2)
                    n_of += np.bincount(home, minlength=len(graph))
            some = np.flatnonzero(n_of)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n_of[some]), lists(np.hstack((total[some], squares[some])), pa.float64())], names=["list", "n", "sums"])

        parts = sample.mapInArrow(sums, "list bigint, n bigint, sums array<double>")
        by_list = parts.groupBy("list").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[d]) for d in range(2 * dims)]).alias("sums")).toArrow()
        at, size = by_list["list"].to_numpy(), by_list["n"].to_numpy()
        both = matrix(by_list["sums"].combine_chunks(), 2 * dims) / size[:, None]
        points, count, spread = points.copy(), np.zeros(len(points)), np.zeros(points.shape)
        points[at], count[at] = both[:, :dims], size
        spread[at] = np.sqrt(np.maximum(both[:, dims:] - both[:, :dims] ** 2, 0.0))
        if step < p.rounds - 1:
            points = _split(points, count, spread, p.heavy, p.centroid_bytes // (8 * dims))
    return CentroidGraph(points), count / share


def build_index(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", params: SearchParams = SearchParams()) -> Index | None:
    """The posting lists of all vectors that take part; None if there are none."""
    p = params
    reps = distinct_vectors(vectors, vec_id, vector, p.k + 1)
    n, dims, unit = reps.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()
    if not n:
        return None
    graph, expected = _fit(reps, n, dims, unit, p)
    shards = np.maximum(1, np.ceil(expected / (8 * p.block))).astype(np.int64)
    kind = reps.schema["v"].dataType.simpleString()
    exact = np.float32 if kind == "array<float>" else np.float64

    def post(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                row, home = graph.closure(_rows(part, dims, unit), p.closure, p.replicas)
                reps_of = part.column("rep").to_numpy()[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(home), pa.array(reps_of % shards[home]), pa.array(reps_of), part.column("first").take(pa.array(row)), packed(matrix(part.column("v"), dims).astype(exact)).take(pa.array(row))],
                    names=["list", "shard", "rep", "first", "v"])

    def pack(batches):
        held, at = [], None

        def out():
            fields = [pa.array([at]), pa.array([len(held)], pa.int32()), *[pa.array([np.array([h[i] for h in held], np.int64).tobytes()], pa.binary()) for i in (0, 1)], pa.array([b"".join(h[2] for h in held)], pa.binary())]
            return pa.RecordBatch.from_arrays(fields, names=["list", "n", "reps", "firsts", "vectors"])

        for batch in batches:
            for home, rep, first, v in zip(*(batch.column(c).to_pylist() for c in ("list", "rep", "first", "v"))):
                if held and (home != at or len(held) == p.block):
                    yield out()
                    held = []
                at = home
                held.append((rep, first, v))
        if held:
            yield out()

    postings = reps.select("rep", "first", "v").mapInArrow(post, "list bigint, shard bigint, rep bigint, first bigint, v binary")
    blocks = postings.repartition("list", "shard").sortWithinPartitions("list", "rep").mapInArrow(pack, "list bigint, n int, reps binary, firsts binary, vectors binary")
    blocks = materialize(blocks, "posting-blocks")
    sizes = np.zeros(len(graph), np.int64)
    for r in blocks.groupBy("list").agg(F.sum("n").alias("n")).collect():  # a row per centroid
        sizes[r["list"]] = r["n"]
    return Index(reps, blocks, graph, dims, unit, p, sizes)


class _Nearest:
    """The nearest entries of each query among those added so far, ``keep`` of them, ties to the smaller id."""

    def __init__(self, keep: int, room: int = 1 << 20):
        self.keep, self.room, self.parts, self.held = keep, room, [], 0

    def add(self, query, score, first, rep):
        self.parts.append((query, score, first, rep))
        self.held += len(query)
        if self.held > self.room:
            self.cut()

    def cut(self):
        if not self.parts:
            return
        q, s, f, r = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((r, f, s, q))
        q, s, f, r = q[order], s[order], f[order], r[order]
        once = np.ones(len(q), bool)
        once[1:] = (q[1:] != q[:-1]) | (r[1:] != r[:-1])  # a vector from several lists
        q, s, f, r = q[once], s[once], f[once], r[once]
        new = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        place = np.arange(len(q)) - np.repeat(new, np.diff(np.append(new, len(q))))
        few = place < self.keep
        self.parts = [(q[few], s[few], f[few], r[few])]
        self.held = int(few.sum())

    def batches(self):
        self.cut()
        for q, s, f, r in self.parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q, r, f, s)], names=["q", "rep", "first", "score"])
        self.parts, self.held = [], 0


def _nearest_in(queries: np.ndarray, vectors: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, distance) of the ``keep`` nearest vectors of each query and those that tie: products find them, with
    a margin for their rounding, and differences give the exact distances."""
    norm_q, norm_v = (queries**2).sum(axis=1), (vectors**2).sum(axis=1)
    near = norm_q[:, None] + norm_v[None, :] - 2 * (queries @ vectors.T)
    if keep < len(vectors):
        margin = (norm_q + norm_v.max()) * (queries.shape[1] + 8) * 2.0**-50
        q, v = np.nonzero(near <= (np.partition(near, keep - 1, axis=1)[:, keep - 1] + 2 * margin)[:, None])
    else:
        q, v = (x.reshape(-1) for x in np.indices(near.shape))
    score = np.empty(len(q))
    for at in range(0, len(q), 1 << 14):
        score[at : at + (1 << 14)] = np.sqrt(((queries[q[at : at + (1 << 14)]] - vectors[v[at : at + (1 << 14)]]) ** 2).sum(axis=1))
    return q, v, score


def fit_ratio(index: Index, queries: DataFrame) -> float:
    """The smallest distance ratio that reaches ``target`` of the true neighbours of a sample of the queries (rep, v).

    At most ``sample`` query vectors, those with the smallest hashes, are compared with all vectors; their neighbours
    (sample * k vectors) reach the driver, which looks up the lists that hold them."""
    p, dims = index.params, index.dims
    some = queries.orderBy("h2", "h1").limit(p.sample).select("rep", "v").toArrow()
    ids, points = some["rep"].to_numpy(), matrix(some["v"].combine_chunks(), dims)

    def compare(batches):
        best = _Nearest(p.k)
        for batch in batches:
            for at in range(0, batch.num_rows, 4 * SLICE):
                part = batch.slice(at, 4 * SLICE)
                rep = part.column("rep").to_numpy()
                q, v, score = _nearest_in(points, matrix(part.column("v"), dims), p.k + 1)
                other = rep[v] != ids[q]
                best.add(q[other], score[other], part.column("first").to_numpy()[v[other]], rep[v[other]])
        yield from best.batches()

    found = index.reps.select("rep", "first", "v").mapInArrow(compare, "q bigint, rep bigint, first bigint, score double")
    w = Window.partitionBy("q").orderBy("score", "first", "rep")
    true = found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= p.k).select("q", "rep")
    true = true.join(index.reps.select("rep", "v"), "rep").toArrow()
    if not true.num_rows:
        return 1.0
    q = true["q"].to_numpy()
    near = (points / index.unit).astype(np.float32)
    reach = index.graph.beam(near, max(8, p.at_least))[1]
    row, home = index.graph.closure((matrix(true["v"].combine_chunks(), dims) / index.unit).astype(np.float32), p.closure, p.replicas)
    best = np.full(len(q), np.inf, np.float32)
    np.minimum.at(best, row, index.graph.distance(near, q[row], home))
    needed = np.sort(np.where(best <= reach[q, p.at_least - 1], 1.0, best / np.maximum(reach[q, 0], 1e-30)))
    return float(needed[min(len(needed) - 1, math.ceil(p.target * len(needed)) - 1)]) * (1 + 1e-5)


def search(index: Index, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", ratio: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query row, nearest first, ties to the smaller id.

    ``queries`` are rows of the indexed table: a row is no candidate of its own, but rows with equal vectors or ids are.
    Rows that take no part (see in_search) and null ids give nothing as queries; with k or fewer candidates, and all lists
    in reach, all are returned.  Repeated query rows are answered as often as they come."""
    p, dims = index.params, index.dims
    asked = queries.where(in_search(vector) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("query_id"), *vector_keys(vector))
    asked = materialize(asked.join(index.reps.select("h1", "h2", "rep"), ["h1", "h2"]).select("query_id", F.col("rep").alias("q")), "asked")
    distinct = index.reps.join(asked.select(F.col("q").alias("rep")).distinct(), "rep", "left_semi")
    ratio = fit_ratio(index, distinct) if ratio is None else ratio
    unit, keep = index.unit, p.k + 1
    exact = np.float32 if index.reps.schema["v"].dataType.simpleString() == "array<float>" else np.float64
    near = _Lists(index.graph, index.sizes, p)

    def probe(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE // 4):
                part = batch.slice(at, SLICE // 4)
                row, home = near.lists(_rows(part, dims, unit), ratio)
                yield pa.RecordBatch.from_arrays([pa.array(home), part.column("rep").take(pa.array(row)), packed(matrix(part.column("v"), dims).astype(exact)).take(pa.array(row))], names=["list", "q", "v"])

    def pack(batches):
        held, at = [], None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([np.array([h[0] for h in held], np.int64).tobytes()], pa.binary()), pa.array([b"".join(h[1] for h in held)], pa.binary())], names=["list", "qs", "points"])

        for batch in batches:
            for home, q, v in zip(*(batch.column(c).to_pylist() for c in ("list", "q", "v"))):
                if held and (home != at or len(held) == 512):
                    yield out()
                    held = []
                at = home
                held.append((q, v))
        if held:
            yield out()

    def compare(batches):
        best = _Nearest(keep)
        for batch in batches:
            qs, points, reps, firsts, vectors = (batch.column(c) for c in ("qs", "points", "reps", "firsts", "vectors"))
            for i in range(batch.num_rows):
                ids, rep, first = (np.frombuffer(c[i].as_buffer(), np.int64) for c in (qs, reps, firsts))
                a, b = (np.frombuffer(c[i].as_buffer(), exact).reshape(-1, dims).astype(np.float64) for c in (points, vectors))
                q, v, score = _nearest_in(a, b, keep)
                best.add(ids[q], score, first[v], rep[v])
                if best.held > best.room // 2:  # many queries: what is settled here goes out
                    yield from best.batches()
        yield from best.batches()

    probes = distinct.select("rep", "v").mapInArrow(probe, "list bigint, q bigint, v binary")
    packs = probes.repartition("list").sortWithinPartitions("list", "q").mapInArrow(pack, "list bigint, qs binary, points binary")
    met = materialize(packs, "probes").join(index.blocks, "list").select("qs", "points", "reps", "firsts", "vectors")
    found = met.mapInArrow(compare, "q bigint, rep bigint, first bigint, score double").groupBy("q", "rep").agg(F.min("score").alias("score"), F.min("first").alias("first"))
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("score", "first", "rep"))).where(F.col("n") <= keep)
    each = found.join(index.reps.select("rep", "ids"), "rep").select("q", "score", "rep", F.explode("ids").alias("id"))
    each = each.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("score", "id", "rep"))).where(F.col("n") <= keep)
    answer = each.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("n", "score", "id", F.col("rep")))).alias("near"))
    own = F.array_position(F.transform("near", lambda x: (x["rep"] == F.col("q")) & (x["id"] == F.col("query_id"))), True)
    others = F.slice(F.filter("near", lambda x, i: i + 1 != F.col("own")), 1, p.k)
    rows = asked.join(answer, "q").withColumn("own", own).select("query_id", F.posexplode(others).alias("place", "x"))
    return rows.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.nullif(F.col("x.id"), F.lit(LAST)).alias("vec_id"), F.col("x.score").alias("score"))
