"""Token-ID files: patched frame-of-reference blocks.

A file holds the ids of a range of documents in a row, in blocks of BLOCK ids.  A block stores its minimum, a width chosen so
that a percentile of its values less the minimum fit, all low bits packed at that width, and the exceptions: their places
and high bits.  Behind the blocks stand the index of block starts and the documents' ids and lengths.

    file   = magic, block*, u64 start of each block, (i64 id, u8 null, u64 n) of each document, u64 blocks, u64 documents
    block  = u32 minimum, u16 ids, u16 exceptions, u8 width, packed bits (eight ids to ``width`` bytes), u16 place of each
             exception, u32 high bits of each
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unionlake.llm.arrowtext import slices
from unionlake.llm.shared import Atomic, shared_dir
from unionlake.llm.tokens import encoder
from unionlake.session import materialize

MAGIC, BLOCK = b"PFORIDS2", 512
_HEAD = struct.Struct("<IHHB")
_DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u8")])


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value, row by row, eight values to ``width`` bytes; rows hold a multiple of eight."""
    eight = values.astype(np.uint64).reshape(-1, 8) & np.uint64((1 << width) - 1)
    out = np.zeros((len(eight), width + 8), np.uint8)
    for j in range(8):
        first, shift = divmod(j * width, 8)
        shifted = eight[:, j] << np.uint64(shift)
        for k in range((shift + width + 7) // 8):
            out[:, first + k] |= (shifted >> np.uint64(8 * k)).astype(np.uint8)
    return out[:, :width].reshape(len(values), -1)


def unpack_bits(packed: np.ndarray, width: int) -> np.ndarray:
    """The values of rows that ``pack_bits`` made."""
    groups = packed.reshape(-1, width)
    out = np.empty((len(groups), 8), np.uint32)
    for j in range(8):
        first, shift = divmod(j * width, 8)
        value = np.zeros(len(groups), np.uint64)
        for k in range((shift + width + 7) // 8):
            value |= groups[:, first + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, j] = (value >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    return out.reshape(len(packed), -1)


def pack_blocks(ids: np.ndarray, percentile: float = 90) -> list[bytes]:
    """The blocks of some ids; only the last may be short."""
    out: list[bytes] = []
    full = len(ids) // BLOCK * BLOCK
    for part in ([ids[:full].reshape(-1, BLOCK)] if full else []) + ([ids[full:].reshape(1, -1)] if full < len(ids) else []):
        rows, n = part.shape
        least = part.min(axis=1)
        rel = (part - least[:, None]).astype(np.uint32)
        bits = np.frexp(rel.astype(np.float64))[1]
        place = min(n - 1, int(np.ceil(n * percentile / 100)) - 1)
        width = np.partition(bits, place, axis=1)[:, place]
        padded = np.pad(rel, ((0, 0), (0, -n % 8)))
        packed: list = [b""] * rows
        for w in np.unique(width[width > 0]):
            chosen = np.flatnonzero(width == w)
            for i, line in zip(chosen, pack_bits(padded[chosen], int(w))):
                packed[i] = line.tobytes()
        row, at = np.nonzero(bits > width[:, None])
        places, high = at.astype("<u2"), (rel[row, at].astype(np.uint64) >> width[row].astype(np.uint64)).astype("<u4")
        cut = np.searchsorted(row, np.arange(rows + 1)).tolist()
        for i, (low, w) in enumerate(zip(least.tolist(), width.tolist())):
            odd = slice(cut[i], cut[i + 1])
            out.append(_HEAD.pack(low, n, cut[i + 1] - cut[i], w) + packed[i] + places[odd].tobytes() + high[odd].tobytes())
    return out


def unpack_blocks(raw: bytes) -> np.ndarray:
    """The ids of blocks that follow one another; blocks of the same shape are unpacked together."""
    at, end, same = 0, 0, {}
    data = np.frombuffer(raw, np.uint8)
    while at < len(raw):
        least, n, odd, width = _HEAD.unpack_from(raw, at)
        bits = at + _HEAD.size
        at = bits + (n + 7) // 8 * width
        same.setdefault((n, width), []).append((end, least, bits, odd, at))
        at += 6 * odd
        end += n
    out = np.empty(end, np.uint32)
    for (n, width), blocks in same.items():
        size = (n + 7) // 8 * width
        ids = np.zeros((len(blocks), n), np.uint32)
        if width:
            ids = unpack_bits(np.stack([data[bits : bits + size] for _, _, bits, _, _ in blocks]), width)[:, :n]
        for mine, (to, least, _, odd, tail) in zip(ids, blocks):
            if odd:
                places = np.frombuffer(raw, "<u2", odd, tail)
                high = np.frombuffer(raw, "<u4", odd, tail + 2 * odd)
                mine[places] |= (high.astype(np.uint64) << np.uint64(width)).astype(np.uint32)
            np.add(mine, np.uint32(least), out=out[to : to + n])
    return out


class Writer:
    """Writes blocks as ids come; holds one stretch of ids, the block starts and the document table."""

    def __init__(self, file, stretch: int = 1 << 18):
        self.file, self.stretch, self.held, self.n_held, self.starts, self.docs = file, stretch, [], 0, [], []
        self.at = file.write(MAGIC)
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.tokens += len(ids)
        if self.n_held >= self.stretch:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        cut = len(ids) if last else len(ids) // BLOCK * BLOCK
        for block in pack_blocks(ids[:cut]) if cut else []:
            self.starts.append(self.at)
            self.at += self.file.write(block)
        self.held, self.n_held = [ids[cut:]], len(ids) - cut

    def close(self) -> None:
        self._flush(True)
        self.file.write(np.array(self.starts, "<u8").tobytes())
        self.file.write(np.array(self.docs, _DOC).tobytes())
        self.file.write(struct.pack("<QQ", len(self.starts), len(self.docs)))


class Reader:
    """Random access to blocks through the index; ``documents`` goes through a file with one stretch of blocks in memory."""

    def __init__(self, path: str):
        self.file = open(path, "rb")
        if self.file.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no token-ID file")
        self.file.seek(-16, os.SEEK_END)
        end = self.file.tell()
        n, docs = struct.unpack("<QQ", self.file.read(16))
        index = end - docs * _DOC.itemsize - 8 * n
        self.file.seek(index)
        self.starts = np.append(np.frombuffer(self.file.read(8 * n), "<u8").astype(np.int64), index)
        self.docs = np.frombuffer(self.file.read(docs * _DOC.itemsize), _DOC)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks first .. last - 1."""
        if first >= last:
            return np.zeros(0, np.uint32)
        self.file.seek(int(self.starts[first]))
        return unpack_blocks(self.file.read(int(self.starts[last] - self.starts[first])))

    def documents(self, stretch: int = 512) -> Iterator[tuple[int | None, list[np.ndarray]]]:
        """(id, parts of its ids) of each document in the file's order."""
        ids, at, block, blocks = np.zeros(0, np.uint32), 0, 0, len(self.starts) - 1
        for doc in self.docs:
            need, parts = int(doc["n"]), []
            while need:
                if at == len(ids):
                    ids, at, block = self.blocks(block, min(block + stretch, blocks)), 0, min(block + stretch, blocks)
                take = ids[at : at + need]
                parts.append(take)
                at += len(take)
                need -= len(take)
            yield (None if doc["null"] else int(doc["id"])), parts

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encodes every text, appends ``end_id``, writes the ids in ascending document order, one file for each range of ids, and
    returns the written files as a stored table (part, path, n_docs, n_tokens), ordered by part.

    Null text counts as empty (its document is the end id alone); a null id comes first; rows that repeat an id follow
    one another, by text.  An empty table has no files."""
    folder = shared_dir(docs.sparkSession, "token-files")

    def write(batches):
        coder, part = encoder(vocabulary), TaskContext.get().partitionId()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        path = f"{folder}/part-{part:06d}.pfor"
        with Atomic(path) as file:
            writer = Writer(file)
            for batch in (b for group in ([first], batches) for b in group):
                for piece in slices(batch, "text", 8 << 20):
                    ids, ends = coder.encode(piece.column("text"))
                    for i, d in enumerate(piece.column("id").to_pylist()):
                        writer.add(d, np.append(ids[ends[i] : ends[i + 1]], np.uint32(end_id)).astype(np.uint32))
            writer.close()
        yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "n_docs": len(writer.docs), "n_tokens": writer.tokens}])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    return materialize(ordered.mapInArrow(write, "part long, path string, n_docs long, n_tokens long"), "token-manifest").orderBy("part")


def read_token_files(files: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files: start counts all ids before it."""
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = files.select("path", F.coalesce(before, F.lit(0)).alias("start"))

    def read(batches):
        for batch in batches:
            for file in batch.to_pylist():
                reader, at, rows = Reader(file["path"]), file["start"], []
                for d, parts in reader.documents():
                    crc, n = 0, sum(map(len, parts))
                    for p in parts:
                        crc = zlib.crc32(p.astype("<u4").tobytes(), crc)
                    rows.append((d, at, n, crc))
                    at += n
                    if len(rows) == 10_000:
                        yield _rows(rows, doc_id)
                        rows = []
                reader.close()
                yield _rows(rows, doc_id)

    return placed.repartition(max(1, files.count())).mapInArrow(read, f"`{doc_id}` long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list, doc_id: str) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[doc_id, "start", "n_tokens", "ids_crc32"])
