"""Vector code compression with LAESA pivots.

A vector is cut into equal parts; each part position has a codebook of integer entries that rounds of assignment and
averaging improve, and the code of a vector names the nearest entry of every part.  The distances of each part to a few
fixed pivots are computed once and stored beside it.  In a round only the pivots' distances to the entries are new: the
largest difference |d(part, pivot) - d(entry, pivot)| is a lower bound of d(part, entry), entries are tried in the order
of their bounds, and a part is done when the next bound exceeds its best exact distance.  Distances that decide are exact
integers; bounds are doubles with a margin for their rounding, so that no entry is skipped that could win or tie.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unionlake.llm.columns import fresh
from unionlake.llm.vecs import lists, matrix, packed, scaled, unpacked, usable
from unionlake.session import materialize

#: Relative error of a stored distance (a float of 24 bits), with room.
SLACK = 2.0**-22


@dataclass(frozen=True)
class Shape:
    parts: int
    width: int  #: components of a part
    pivots: int


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between the integer rows of two matrices."""
    gap = a[:, None, :] - b[None, :, :]
    return np.sqrt((gap * gap).sum(axis=2, dtype=np.int64).astype(np.float64))


def choose_pivots(entries: np.ndarray, n: int) -> np.ndarray:
    """Entries that lie far from each other: each next one has the largest sum of distances to those before."""
    far = _distance(entries, entries)
    chosen = [int(far.sum(axis=1).argmax())]
    while len(chosen) < min(n, len(entries)):
        gain = far[chosen].sum(axis=0)
        gain[chosen] = -1
        chosen.append(int(gain.argmax()))
    return entries[chosen]


def nearest(rows: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance, exact evaluations) of the nearest entry of every row; ties go to the smaller index."""
    n, k = len(rows), len(entries)
    of_entries = _distance(pivots, entries)
    stored = to_pivots.astype(np.float64)
    bound = np.zeros((n, k))
    for p in range(len(pivots)):
        near = stored[:, p, None]
        np.maximum(bound, np.abs(near - of_entries[p]) - SLACK * (near + of_entries[p]), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1)
    bound *= bound
    bound *= 1 - 2.0**-40
    best, index, done = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), 0
    at = np.arange(n)
    for step in range(k):
        at = at[bound[at, step] <= best[at]]
        if not len(at):
            break
        tried = order[at, step]
        gap = rows[at] - entries[tried]
        exact = (gap * gap).sum(axis=1)
        done += len(at)
        wins = (exact < best[at]) | ((exact == best[at]) & (tried < index[at]))
        best[at[wins]], index[at[wins]] = exact[wins], tried[wins]
    return index, best, done


def _codes(batch: pa.RecordBatch, books: np.ndarray, pivots: np.ndarray, s: Shape):
    """(parts, index per part, squared distance per part, exact evaluations) of a stored batch."""
    rows = unpacked(batch.column("parts"), "<i4", s.parts * s.width).astype(np.int64).reshape(-1, s.parts, s.width)
    stored = unpacked(batch.column("far"), "<f4", s.parts * s.pivots).reshape(-1, s.parts, s.pivots)
    index, error, done = np.zeros(rows.shape[:2], np.int64), np.zeros(rows.shape[:2], np.int64), 0
    for j in range(s.parts):
        index[:, j], error[:, j], n = nearest(rows[:, j], stored[:, j], books[j], pivots[j])
        done += n
    return rows, index, error, done


def _round(table: DataFrame, books: np.ndarray, pivots: np.ndarray, s: Shape) -> tuple[np.ndarray, int]:
    """(codebooks after one round, exact evaluations)."""
    entries = books.shape[1]

    def sums(batches):
        total, count, done = np.zeros((s.parts, entries, s.width), np.int64), np.zeros((s.parts, entries), np.int64), 0
        for batch in batches:
            rows, index, _, n = _codes(batch, books, pivots, s)
            done += n
            for j in range(s.parts):
                count[j] += np.bincount(index[:, j], minlength=entries)
                np.add.at(total[j], index[:, j], rows[:, j])
        slot = np.arange(s.parts * entries, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(count.reshape(-1)), pa.array(np.where(slot == 0, done, 0)), lists(total.reshape(-1, s.width), pa.int64())], names=["slot", "n", "done", "sums"])

    parts = table.mapInArrow(sums, "slot int, n bigint, done bigint, sums array<bigint>")
    new, done = books.copy(), 0
    by_slot = parts.groupBy("slot").agg(F.sum("n").alias("n"), F.sum("done").alias("done"), F.array(*[F.sum(F.col("sums")[d]) for d in range(s.width)]).alias("sums"))
    for r in by_slot.collect():
        done += r["done"]
        if r["n"]:
            new[divmod(r["slot"], entries)] = [x // r["n"] for x in r["sums"]]
    return new, done


@dataclass
class Codes:
    rows: DataFrame  #: the kept rows with id, label, code and error, written
    books: np.ndarray  #: (parts, entries, width)
    evaluations: list[int]  #: exact evaluations of each round


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, pivots: int = 4) -> Codes:
    """Codes of all vectors that are there with finite components, and the codebooks.

    Codebooks start as the parts of the vectors with the smallest ids (ties: the smaller vector; null ids last); with fewer
    than ``entries`` kept vectors they are shorter.  Vectors shorter than the longest one, or than a multiple of ``parts``,
    count as filled up with zeros; that changes no distance between vectors of one length.  Repeated rows count as often as
    they come; an empty table gives no rows.  A component beyond ±2^27 after scaling ends the job with an error.  Only the
    codebooks' sums (parts * entries rows) and first vectors reach the driver."""
    kept = vectors.where(usable(vector)).select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    width = max(1, -(-(longest or 0) // parts))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    full = np.zeros((len(first), parts * width))
    for i, r in enumerate(first):
        full[i, : len(r["v"])] = r["v"]
    books = scaled(full, scale).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    schema = f"id bigint, label {kept.schema['label'].dataType.simpleString()}"
    if not len(first):
        return Codes(kept.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books, [])
    fixed = np.stack([choose_pivots(b, pivots) for b in books])
    s = Shape(parts, width, fixed.shape[1])

    def store(batches):
        for batch in batches:
            rows = scaled(matrix(batch.column("v"), parts * width), scale)
            far = np.concatenate([_distance(rows[:, j * width : (j + 1) * width], fixed[j]) for j in range(parts)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), packed(rows.astype("<i4")), packed(far.astype("<f4"))], names=["id", "label", "parts", "far"])

    table = materialize(kept.mapInArrow(store, f"{schema}, parts binary, far binary"), "pivot-distances")
    evaluations = []
    for _ in range(rounds):
        books, done = _round(table, books, fixed, s)
        evaluations.append(done)

    def code(batches):
        for batch in batches:
            _, index, error, _ = _codes(batch, books, fixed, s)
            codes = [bytes(r).hex() for r in index.astype(np.uint8)] if entries <= 256 else ["".join(f"{x:04x}" for x in r) for r in index]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(error.sum(axis=1))], names=["id", "label", "code", "error"])

    return Codes(materialize(table.mapInArrow(code, f"{schema}, code string, error bigint"), "codes"), books, evaluations)


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in books.reshape(-1)).encode()).hexdigest()


def label_errors(rows: DataFrame, label: str = "label", error: str = "error", out: str = "label_error") -> DataFrame:
    """The rows with the error summed over equal labels (nulls are equal); sums are taken before the shuffle, and the
    planner splits a label that holds many of the rows."""
    key, = fresh(rows, "label")
    sums = rows.groupBy(F.col(label).alias(key)).agg(F.sum(error).alias(out))
    return rows.join(sums, F.col(label).eqNullSafe(F.col(key)), "left").drop(key)
