"""Best-fit packing: bound-certified repacking.

Documents are cut into pieces of at most ``capacity`` tokens.  Pieces are dealt to partitions of bounded size, each packed by
best-fit decreasing.  Dual feasible functions give a lower bound of a partition's sequences: a partition that meets it is
certified and closes all sequences but its emptiest; a partition with a gap gives up its emptiest sequences, up to half of its
pieces.  What is given up is exchanged: dealt anew to fewer partitions, and packed again.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unionlake.llm.arrowtext import slices
from unionlake.llm.tokens import encoder
from unionlake.session import materialize

PIECE = "doc long, piece int, start long, length long, crc long"


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 4096, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc, piece, start, length, crc) of every document's ids with the end id; only longer documents are cut.  Null
    text counts as empty: the document is the end id alone."""
    def cut(batches):
        coder = encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                ids, ends = coder.encode(part.column("text"))
                rows = []
                for i, d in enumerate(part.column("doc").to_pylist()):
                    mine = np.append(ids[ends[i] : ends[i + 1]], np.uint32(end_id)).astype("<u4")
                    rows += [(d, k, at, len(p := mine[at : at + capacity]), zlib.crc32(p.tobytes())) for k, at in enumerate(range(0, len(mine), capacity))]
                columns = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc", "piece", "start", "length", "crc"])

    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(cut, PIECE)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing of these lengths has fewer sequences: the best of two families of dual feasible functions.

    f(x) keeps the sum over any full sequence at most its capacity, so the sum of f over all pieces needs that many.
    One family rounds pieces above capacity - k up to the whole and drops those below k; the other rounds
    to multiples of capacity / k."""
    sizes, counts = np.unique(np.asarray(lengths, np.int64), return_counts=True)
    if not len(sizes):
        return 0
    best = -(-int((sizes * counts).sum()) // capacity)
    for k in np.unique(np.append(sizes[sizes <= capacity // 2], 1)):
        f = np.where(sizes > capacity - k, capacity, np.where(sizes < k, 0, sizes))
        best = max(best, -(-int((f * counts).sum()) // capacity))
    for k in range(1, 101):
        exact = (k + 1) * sizes % capacity == 0
        f = np.where(exact, sizes * k, (k + 1) * sizes // capacity * capacity)
        best = max(best, -(-int((f * counts).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each piece's sequence and offset, and the fill of each sequence.

    Open sequences stand in a stack for each free space; the bits of one number tell which stacks have any."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    have, count = 0, 0
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fits = have >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                have ^= 1 << space
        else:
            space, b, count = capacity, count, count + 1
        bins[i], offsets[i] = b, capacity - space
        if left := space - size:
            if not free[left]:
                have |= 1 << left
            free[left].append(b)
    fill = np.bincount(bins, weights=lengths, minlength=count).astype(np.int64)
    return bins, offsets, fill


def given_up(fill: np.ndarray, counts: np.ndarray, certified: bool, capacity: int) -> np.ndarray:
    """Which sequences a partition exchanges: the emptiest, if certified; else from the emptiest on while they hold at most half
    of the pieces.  Full sequences stay."""
    order = np.argsort(fill, kind="stable")
    half = np.cumsum(counts[order]) <= counts.sum() // 2
    give = np.zeros(len(fill), bool)
    give[order[0]] = True
    if not certified:
        give[order[half]] = True
    return give & (fill < capacity)


def _pack(capacity: int, round_no: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc", "piece", "crc"], ascending=[False, True, True, True], ignore_index=True)
        bins, offsets, fill = best_fit(group["length"].to_numpy(np.int64), capacity)
        certified = len(fill) == lower_bound(group["length"].to_numpy(), capacity)
        closed = np.ones(len(fill), bool) if last else ~given_up(fill, np.bincount(bins), certified, capacity)
        return group.assign(sequence_id=(round_no << 56) + (int(group["part"].iloc[0]) << 24) + bins, offset=offsets, closed=closed[bins], certified=certified).drop(columns="part")

    return pack


def pack(cut: DataFrame, capacity: int = 4096, group: int = 50_000) -> DataFrame:
    """The pieces with sequence_id and offset: every piece once, sequences gapless from 0.

    group: pieces packed by one task.  Every round gives up at most half of the pieces (or one sequence of a partition) and at
    least halves the partitions, so a task stays within the group or some sequences; the rounds end when one task can take what is
    left.  Repeated rows are packed one by one.  An empty table gives an empty result."""
    schema = f"{PIECE}, sequence_id long, offset long, closed boolean, certified boolean"
    pool, done, round_no = materialize(cut, "pieces"), [], 0
    parts = max(1, -(-pool.count() // group))
    while True:
        last = parts == 1
        dealt = pool.withColumn("part", F.pmod(F.monotonically_increasing_id() + F.shiftright(F.monotonically_increasing_id(), 33), F.lit(parts)).cast("long"))
        packed = materialize(dealt.groupBy("part").applyInPandas(_pack(capacity, round_no, last), schema), "packed")
        left = 0 if last else packed.where("not closed").count()
        done.append(packed.where("closed"))
        if not left:
            break
        pool = packed.where("not closed").select("doc", "piece", "start", "length", "crc")
        parts, round_no = max(1, min(-(-left // group), parts // 2)), round_no + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc", "piece", "start", "length", "crc", "sequence_id", "offset")


def certificate(packed: DataFrame, capacity: int = 4096) -> tuple[int, int]:
    """(sequences used, lower bound over all pieces): equal numbers prove the packing optimal.  Only the counts of the
    at most ``capacity`` different lengths reach the driver."""
    used = packed.agg(F.countDistinct("sequence_id")).first()[0]
    hist = np.array([tuple(r) for r in packed.groupBy("length").count().collect()], np.int64).reshape(-1, 2)
    return used, lower_bound(np.repeat(hist[:, 0], hist[:, 1]), capacity)
