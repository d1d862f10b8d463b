"""Centroid clustering on subvector dictionaries.

Vectors become integers and are stored in chunks.  A chunk cuts the dimensions into blocks and keeps, for each block, the
distinct subvectors that its rows have there (the dictionary) and one code per row: nothing is lost.  A round computes
the exact squared distance of every dictionary entry to every centroid once, and the distance of a row is the sum of the
entries it points at.  New centroids come from code counts: how often each entry occurs in a cluster, times the entry.

Neighbouring blocks are joined where a wider dictionary saves work: copies and clustered vectors get wide blocks, vectors
without a pattern get blocks of one dimension.  All numbers are integers, so results don't depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unionlake.llm.vecs import lists, matrix, scaled, usable
from unionlake.session import materialize

CHUNK = "ids array<bigint>, widths array<int>, sizes array<int>, entries binary, codes binary"


@dataclass
class Block:
    first: int
    entries: np.ndarray  #: (distinct subvectors, width)
    codes: np.ndarray  #: one per row

    @property
    def width(self) -> int:
        return self.entries.shape[1]


def _joined(a: Block, b: Block, rows: int) -> Block | None:
    """Both blocks as one, if its dictionary costs a round less than the two of them."""
    pairs, codes = np.unique(a.codes * np.int64(len(b.entries)) + b.codes, return_inverse=True)
    if len(pairs) * (a.width + b.width) + rows >= len(a.entries) * a.width + len(b.entries) * b.width + 2 * rows:
        return None
    left, right = np.divmod(pairs, len(b.entries))
    return Block(a.first, np.hstack((a.entries[left], b.entries[right])), codes.astype(np.int64))


def encode(rows: np.ndarray) -> list[Block]:
    """Dictionary blocks of a matrix of integers, from left to right."""
    done = []
    for d in range(rows.shape[1]):
        entries, codes = np.unique(rows[:, d], return_inverse=True)
        done.append(Block(d, entries[:, None], codes.astype(np.int64)))
    joined = True
    while joined:  # neighbours pair by pair, as long as any pair gains
        joined, at, out = False, 0, []
        while at < len(done):
            both = _joined(done[at], done[at + 1], len(rows)) if at + 1 < len(done) else None
            out.append(both or done[at])
            joined, at = joined or both is not None, at + (2 if both else 1)
        done = out
    return done


def distances(blocks: list[Block], rows: int, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows, centroids): entry distances once, then sums by code."""
    total = np.zeros((rows, len(centroids)), np.int64)
    for b in blocks:
        part = np.zeros((len(b.entries), len(centroids)), np.int64)
        for d in range(b.width):
            gap = b.entries[:, d, None] - centroids[None, :, b.first + d]
            part += gap * gap
        total += part[b.codes]
    return total


def cluster_sums(blocks: list[Block], cluster: np.ndarray, k: int, dims: int) -> np.ndarray:
    """Componentwise sums of the rows of each cluster, by counting codes."""
    out = np.zeros((k, dims), np.int64)
    for b in blocks:
        m = len(b.entries)
        counts = np.bincount(cluster * m + b.codes, minlength=k * m).reshape(k, m)
        out[:, b.first : b.first + b.width] = counts @ b.entries
    return out


def _stored(ids: pa.Array, blocks: list[Block]) -> pa.RecordBatch:
    kinds = [np.uint8 if len(b.entries) <= 1 << 8 else np.uint16 if len(b.entries) <= 1 << 16 else np.uint32 for b in blocks]
    fields = [
        pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(pa.int64())),
        pa.array([[b.width for b in blocks]], pa.list_(pa.int32())),
        pa.array([[len(b.entries) for b in blocks]], pa.list_(pa.int32())),
        pa.array([b"".join(b.entries.astype("<i4").tobytes() for b in blocks)], pa.binary()),
        pa.array([b"".join(b.codes.astype(t).tobytes() for b, t in zip(blocks, kinds))], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(fields, names=["ids", "widths", "sizes", "entries", "codes"])


def _chunks(batches):
    """(ids, blocks) of every stored chunk."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch.column("ids")[i].values
            widths, sizes = (batch.column(c)[i].as_py() for c in ("widths", "sizes"))
            entries = np.frombuffer(batch.column("entries")[i].as_buffer(), "<i4").astype(np.int64)
            codes, rows, blocks, first, at, code_at = batch.column("codes")[i].as_buffer(), len(ids), [], 0, 0, 0
            for w, m in zip(widths, sizes):
                kind = np.dtype(np.uint8 if m <= 1 << 8 else np.uint16 if m <= 1 << 16 else np.uint32)
                blocks.append(Block(first, entries[at : at + w * m].reshape(m, w), np.frombuffer(codes, kind, rows, code_at).astype(np.int64)))
                first, at, code_at = first + w, at + w * m, code_at + rows * kind.itemsize
            yield ids, blocks


def dictionary_chunks(vectors: DataFrame, vec_id: str, vector: str, dims: int, scale: int, chunk: int = 1 << 14) -> DataFrame:
    """The usable vectors of ``dims`` components as dictionary-encoded chunks of at most ``chunk`` rows, written."""
    kept = vectors.where(usable(vector) & (F.size(vector) == dims)).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"))

    def store(batches):
        ids, parts, held = [], [], 0

        def out():
            return _stored(pa.concat_arrays(ids), encode(np.vstack(parts)))

        for batch in batches:
            rows, at = scaled(matrix(batch.column("v"), dims), scale), 0
            while at < len(rows):
                to = min(len(rows), at + chunk - held)
                ids.append(batch.column("id").slice(at, to - at))
                parts.append(rows[at:to])
                held, at = held + to - at, to
                if held == chunk:
                    yield out()
                    ids, parts, held = [], [], 0
        if held:
            yield out()

    return materialize(kept.mapInArrow(store, CHUNK), "dictionary-chunks")


def first_centroids(vectors: DataFrame, vec_id: str, vector: str, dims: int, scale: int, k: int, salt: str) -> np.ndarray:
    """The k kept vectors with the smallest sha256 of ``salt`` and the id, in that order; null ids come last."""
    kept = vectors.where(usable(vector) & (F.size(vector) == dims))
    order = F.sha2(F.concat(F.lit(salt), F.col(vec_id).cast("long").cast("string")), 256)
    rows = kept.select(order.alias("o"), F.col(vector).alias("v")).orderBy(F.col("o").asc_nulls_last(), "v").limit(k).collect()
    return scaled(np.array([r["v"] for r in rows], np.float64).reshape(len(rows), dims), scale)


def _round(chunks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round; k rows of sums come from every task and meet in a sum by cluster and component."""
    k, dims = centroids.shape

    def sums(batches):
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for ids, blocks in _chunks(batches):
            cluster = distances(blocks, len(ids), centroids).argmin(axis=1)
            total += cluster_sums(blocks, cluster, k, dims)
            count += np.bincount(cluster, minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(count), lists(total, pa.int64())], names=["cluster", "n", "sums"])

    parts = chunks.mapInArrow(sums, "cluster int, n bigint, sums array<bigint>").where("n > 0")
    new = centroids.copy()
    for r in parts.select("cluster", "n", F.posexplode("sums").alias("d", "s")).groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        new[r["cluster"], r["d"]] = r["s"] // r["n"]
    return new


def _assigned(chunks: DataFrame, centroids: np.ndarray) -> DataFrame:
    def assign(batches):
        for ids, blocks in _chunks(batches):
            far = distances(blocks, len(ids), centroids)
            cluster = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(far[np.arange(len(far)), cluster])], names=["id", "cluster", "distance"])

    return chunks.mapInArrow(assign, "id bigint, cluster int, distance bigint")


def centroid_digest(centroid) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, salt: str = "2:", chunk: int = 1 << 14) -> tuple[DataFrame, np.ndarray]:
    """(rows, centroids): (id, cluster, distance) of every kept vector, written, and the final integer centroids.

    Kept are vectors with exactly ``dims`` components, none null or not finite.  Ties go to the smaller centroid number; a
    cluster without rows keeps its centroid.  With fewer than k kept vectors there are fewer centroids; with none, no rows.
    Repeated rows count as often as they come; a null id is a row like any other but starts no cluster before those with
    an id.  A component beyond ±2^27 after scaling ends the job with an error instead of an inexact distance.  Only
    k * dims sums and the k first vectors reach the driver."""
    centroids = first_centroids(vectors, vec_id, vector, dims, scale, k, salt)
    if not len(centroids):
        empty = vectors.where(F.lit(False)).select(F.col(vec_id).cast("long").alias("id"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return empty, centroids
    chunks = dictionary_chunks(vectors, vec_id, vector, dims, scale, chunk)
    for _ in range(rounds):
        centroids = _round(chunks, centroids)
    return materialize(_assigned(chunks, centroids), "clusters"), centroids


def with_inertia(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows with the summed distance of their cluster and of all, and a digest of their centroid.

    The k cluster sums (k is a parameter) are read by the driver and go back as a literal map."""
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}

    def by_cluster(values: dict, kind: str) -> Column:
        pairs = [x for c, v in values.items() for x in (F.lit(c).cast("int"), F.lit(v).cast(kind))]
        return F.create_map(*pairs)[F.col("cluster")] if pairs else F.lit(None).cast(kind)

    return rows.withColumns({
        "cluster_inertia": by_cluster(sums, "bigint"), "inertia": F.lit(sum(sums.values())).cast("bigint"),
        "centroid_sha256": by_cluster({c: centroid_digest(centroids[c]) for c in sums}, "string")})
