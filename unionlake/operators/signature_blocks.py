"""Band join of signatures whose bands are no selection (D2 at low thresholds).

With few bits in a band, a large share of all pairs meets in some band (a
tenth of them at threshold 0.3), and most of those pairs meet in vain.  Joined
by band, each is a row that is shuffled, made distinct and given both vectors.
Here every block of vectors meets every block with its signatures: the pairs
that reach the threshold are looked for first, by one product of matrices, and
those without a band in common go.  The result is that of the band join; only
pairs of the result leave a task (``compared``).  Their number still grows
with the square of the vectors, so a search, which needs no pair by itself,
keeps them in the task (``class_sums``): a first pass over the lake finds the
best score of each query vector and class of tables, a second one counts the
hits up to each of these scores, which are their weights, and sums by class
leave.  Blocks are read as they were written, by every task that needs them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unionlake.functions import vectors as V
from unionlake.session import materialize

BLOCK = 2048
MARGIN = 1e-6
#: Entries (vector and class) up to which a lake's classes are broadcast to the blocks; beyond, the blocks are shuffled to them.
ENTRIES = 2_000_000
#: Hits that a task holds before it reduces them; tasks for each core if there are fewer blocks of queries.
HITS, TASKS = 1 << 20, 3


def blocks(sigs: DataFrame, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(block, ids, keys, rows, bits) of (key, vec, bits), at most ``size`` of them a row and written, and (key, id) read
    from them.  The number of a block is its first id; components that are 32-bit numbers are written as such."""
    def pack(batches):
        held, n = [], 0

        def out():
            whole = [np.concatenate([h[i] for h in held]) for i in range(4)]
            short = whole[2].astype(np.float32)
            whole[2] = short if np.array_equal(short, whole[2]) else whole[2]
            return pa.RecordBatch.from_arrays([pa.array([int(whole[0][0])]), *[pa.array([x.tobytes()], pa.binary()) for x in whole]], names=["block", "ids", "keys", "rows", "bits"])

        for b in batches:
            for s in range(0, b.num_rows, size):
                part = b.slice(s, size)
                m = part.num_rows
                if n + m > size:
                    yield out()
                    held, n = [], 0
                matrix = lambda c, kind: part.column(c).flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(m, -1)  # noqa: B023, E731
                key = np.stack([part.column(c).to_numpy() for c in ("h1", "h2")], axis=1)
                held.append((part.column("id").to_numpy(), key, matrix("vec", np.float64), matrix("bits", np.int64)))
                n += m
        if held:
            yield out()

    numbered = sigs.select(F.monotonically_increasing_id().alias("id"), "key.h1", "key.h2", "vec", "bits")
    out = materialize(numbered.mapInArrow(pack, "block bigint, ids binary, keys binary, rows binary, bits binary"), "signature-blocks")

    def unpack(batches):
        for b in batches:
            for ids, keys in zip(b.column("ids").to_pylist(), b.column("keys").to_pylist()):
                key = np.frombuffer(keys, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)), pa.array(key[:, 0]), pa.array(key[:, 1])], names=["id", "h1", "h2"])

    ids = out.select("ids", "keys").mapInArrow(unpack, "id bigint, h1 bigint, h2 bigint")
    return out, ids.select(F.struct("h1", "h2").alias("key"), "id")


def signs(bits: bytes, n: int) -> np.ndarray:
    """0 or 1 for every bit of n signatures, in order."""
    return np.unpackbits(np.frombuffer(bits, np.uint8).reshape(n, -1), axis=1, bitorder="little")


def keys(on: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """The key of every band of every signature."""
    cut = on[:, : n_bands * rows].reshape(len(on), n_bands, rows)
    if rows < 24:  # exact as 32-bit floats
        return (cut.astype(np.float32) @ np.exp2(np.arange(rows, dtype=np.float32))).astype(np.int16 if rows < 16 else np.int32)
    return cut @ (np.int64(1) << np.arange(rows, dtype=np.int64))


def vectors(rows: bytes, n: int, dim: int) -> np.ndarray:
    """The vectors of a block."""
    return np.frombuffer(rows, np.float32 if len(rows) == 4 * n * dim else np.float64).astype(np.float64).reshape(n, dim)


@dataclass
class Meeting:
    """How two blocks are compared."""

    threshold: float
    bits: int
    dim: int
    score: str

    def __post_init__(self):
        self.bands, self.band = V.lsh_params(self.threshold, self.bits)
        self.digits = 10.0 ** V.SCORE_DIGITS

    def side(self, rows: bytes, bits: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
        """What is multiplied, and the keys of the bands."""
        on = signs(bits, n)
        found = keys(on, self.bands, self.band)
        if self.score != "exact":
            return on[:, : self.bits] * 2.0 - 1.0, found
        unit = vectors(rows, n, self.dim)
        return unit / np.linalg.norm(unit, axis=1, keepdims=True), found

    def hits(self, q: tuple[np.ndarray, np.ndarray], c: tuple[np.ndarray, np.ndarray]):
        """(place in q, place in c, score times 10^6) of the pairs with a band in common whose score reaches the threshold, in parts."""
        if self.score == "signature":
            found = np.cos(math.pi * ((self.bits - q[0] @ c[0].T) / 2) / self.bits)
            places, score = np.flatnonzero(found >= self.threshold - MARGIN), lambda x, y: found[x, y]
        else:  # 32-bit products find the pairs, within the error they can have; scores are products of 64 bits
            near = q[0].astype(np.float32) @ c[0].T.astype(np.float32)
            places = np.flatnonzero(near >= np.float32(self.threshold - MARGIN - 1e-7 * (self.dim + 4)))
            score = lambda x, y: np.einsum("ij,ij->i", q[0][x], c[0][y])
        i, j = np.divmod(places, max(len(c[0]), 1))
        for s in range(0, len(i), 1 << 16):
            x, y = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            met = (q[1][x] == c[1][y]).any(axis=1)
            x, y = x[met], y[met]
            near = np.round(score(x, y) * self.digits)
            yes = near / self.digits >= self.threshold
            yield x[yes], y[yes], near[yes]


def compared(queries: DataFrame, lake: DataFrame, threshold: float, bits: int, dim: int, score: str = "exact") -> DataFrame:
    """(q_id, c_id, score) of the pairs of vectors in ``blocks`` that have a band in common and whose rounded score reaches the threshold."""
    meet = Meeting(threshold, bits, dim, score)

    def compare(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids, rows, bits_ = (batch.column(c)[r].as_py() for c in ("q_ids", "q_rows", "q_bits"))
                q = np.frombuffer(ids, np.int64)
                a = meet.side(rows, bits_, len(q))
                ids, rows, bits_ = (batch.column(c)[r].as_py() for c in ("ids", "rows", "bits"))
                c = np.frombuffer(ids, np.int64)
                for x, y, near in meet.hits(a, meet.side(rows, bits_, len(c))):
                    yield pa.RecordBatch.from_arrays([pa.array(q[x]), pa.array(c[y]), pa.array(near / meet.digits)], names=["q_id", "c_id", "score"])

    asked = queries.select(F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("bits").alias("q_bits"))
    met = asked.crossJoin(lake.select("ids", "rows", "bits"))
    return met.mapInArrow(compare, "q_id bigint, c_id bigint, score double")


@dataclass
class Blocks:
    """A lookup by blocks: those of the queries and of the lake, and how they are compared."""

    queries: DataFrame
    lake: DataFrame
    meeting: Meeting


def with_entries(blocks: DataFrame, parts: DataFrame, tables: DataFrame) -> DataFrame:
    """``blocks`` with their entries (pos, h1, h2, columns, held): the classes that have the vector at a place of the block,
    the columns that hold it in a table of the class, and in all of its tables."""
    def places(batches):
        for b in batches:
            for block, ids in zip(b.column("block").to_pylist(), b.column("ids").to_pylist()):
                ids = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(ids), pa.array(np.arange(len(ids), dtype=np.int32))], names=["block", "id", "pos"])

    at = blocks.select("block", "ids").mapInArrow(places, "block bigint, id bigint, pos int")
    sized = parts.join(tables.groupBy("class").agg(F.count(F.lit(1)).alias("tables")), "class").join(at, "id")
    entry = F.struct("pos", "class.h1", "class.h2", "columns", (F.col("columns") * F.col("tables")).alias("held"))
    entries = materialize(sized.groupBy("block").agg(F.collect_list(entry).alias("entries")), "block-entries")
    few = (entries.agg(F.sum(F.size("entries"))).first()[0] or 0) <= ENTRIES
    return blocks.select("block", F.expr("octet_length(ids) div 8").cast("int").alias("n"), "rows", "bits").join(F.broadcast(entries) if few else entries, "block")


def fields(batch: pa.RecordBatch, column: str, r: int) -> list[np.ndarray]:
    """The fields of a list of structs as arrays."""
    values = batch.column(column)[r].values
    return [values.field(i).to_numpy(zero_copy_only=False) for i in range(values.type.num_fields)]


def numbered(codes: dict, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The numbers of classes in ``codes``, where new ones get the next."""
    pairs, where = np.unique(np.stack([h1, h2], axis=1), axis=0, return_inverse=True)
    return np.array([codes.setdefault(tuple(p), len(codes)) for p in pairs.tolist()], np.int64)[where.reshape(-1)]


def most(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with its largest value."""
    order = np.lexsort((values, keys))
    keys, values = keys[order], values[order]
    last = np.append(keys[1:] != keys[:-1], True) if len(keys) else np.zeros(0, bool)
    return keys[last], values[last]


#: Column of the scores in a key of a place and a score (times 10^6, from -10^6).
LOW = 1 << 21


def level(x: np.ndarray, score: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) * (2 * LOW) + score.astype(np.int64) + LOW


def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray]:
    """Classes, and place, class number and best score, of what tasks have found for a block: (h1, h2, pos, code, score) of each."""
    codes: dict = {}
    x, code, score = map(np.concatenate, zip(*[(pos, numbered(codes, h1, h2)[code], score) for h1, h2, pos, code, score in parts]))
    n = len(codes)
    key, score = most(x * n + code, score)
    return list(codes), key // n, key % n, score


def read_bests(batch: pa.RecordBatch, r: int) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray]:
    return merged([tuple(np.frombuffer(x[c], np.int64) for c in ("h1", "h2", "pos", "code", "score")) for x in batch.column("bests")[r].as_py()])


def class_sums(join: Blocks, q_parts: DataFrame, q_tables: DataFrame, c_parts: DataFrame, c_tables: DataFrame) -> DataFrame:
    """F1, E2 and E3 on classes without a row for a pair of vectors: (q_class, c_class, sw, sum_w, n_matched), to be summed
    by q_class and c_class.  Per query vector and class of the lake the best score counts, with the share of the vector's
    hits (columns of the lake) up to that score as its weight.  A task holds a block of queries, the scores that its
    vectors have with classes, and at most ``HITS`` hits."""
    meeting = join.meeting
    lake = with_entries(join.lake, c_parts, c_tables)
    queries = lake if (join.queries is join.lake and q_parts is c_parts) else with_entries(join.queries, q_parts, q_tables)
    n = join.queries.count()
    cores = lake.sparkSession.sparkContext.defaultParallelism
    c_side = lake.coalesce(max(1, TASKS * cores // max(n, 1)))

    def met(q: DataFrame) -> DataFrame:
        q = q.withColumnsRenamed({c: f"q_{c}" for c in ("block", "n", "rows", "bits", "entries")})
        return c_side.crossJoin(q.repartition(max(n, 1), "q_block").hint("shuffle_replicate_nl"))

    def meetings(batches, state):
        """(state of the block of queries, its hits with the block of the lake, entries of that) of every row."""
        asked, at, c = {}, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                if (block := batch.column("block")[r].as_py()) != at:
                    at, c, entries = block, meeting.side(*[batch.column(k)[r].as_py() for k in ("rows", "bits", "n")]), fields(batch, "entries", r)
                if (q_block := batch.column("q_block")[r].as_py()) not in asked:
                    asked[q_block] = meeting.side(*[batch.column(f"q_{k}")[r].as_py() for k in ("rows", "bits", "n")]), state(q_block, batch, r)
                q, own = asked[q_block]
                for x, y, near in meeting.hits(q, c):
                    yield own, x, y, near, entries, block

    def find(batches):
        """The best score of each vector of a block and class of the lake that the task has met."""
        states, codes, of, at = {}, {}, None, None
        for own, x, y, near, (pos, h1, h2, _, _), block in meetings(batches, lambda b, *_: states.setdefault(b, [[], 0, 0])):
            if block != at:  # classes by place of the lake's block
                at, order = block, np.argsort(pos, kind="stable")
                of, first = numbered(codes, h1, h2)[order], np.searchsorted(pos[order], np.arange(pos.max() + 2))
            many = first[y + 1] - first[y]
            which = np.repeat(first[y] - np.cumsum(many) + many, many) + np.arange(many.sum())
            own[0].append((np.repeat(x, many) << 32 | of[which], np.repeat(near, many).astype(np.int64)))
            own[1] += len(which)
            if own[1] > max(HITS, 2 * own[2]):
                own[0] = [most(*(np.concatenate([p[i] for p in own[0]]) for i in range(2)))]
                own[1] = own[2] = len(own[0][0][0])
        table = np.array(list(codes), np.int64).reshape(-1, 2)
        for block, (held, _, _) in states.items():
            if held:
                key, score = most(*(np.concatenate([p[i] for p in held]) for i in range(2)))
                used, code = np.unique(key & 0xFFFFFFFF, return_inverse=True)
                out = [table[used, 0], table[used, 1], key >> 32, code.astype(np.int64), score]
                yield pa.RecordBatch.from_arrays([pa.array([block]), *[pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in out]], names=["q_block", "h1", "h2", "pos", "code", "score"])

    def count(batches):
        """The hits (columns of the lake) between one and the next of a vector's best scores that the task has met."""
        states, weight, at = {}, None, None

        def start(block, batch, r):
            _, x, _, score = read_bests(batch, r)
            levels = np.unique(level(x, score))
            return states.setdefault(block, (levels, np.zeros(len(levels), np.int64)))

        for (levels, counts), x, y, near, (pos, _, _, _, held), block in meetings(batches, start):
            if block != at:
                at, weight = block, np.bincount(pos, weights=held).astype(np.int64)
            counts += np.bincount(np.searchsorted(levels, level(x, near)), weights=weight[y], minlength=len(counts)).astype(np.int64)
        for block, (_, counts) in states.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([counts.tobytes()], pa.binary())], names=["q_block", "counts"])

    def finish(batches):
        """Sums of a block's queries by their classes and the lake's."""
        for batch in batches:
            for r in range(batch.num_rows):
                classes, x, code, score = read_bests(batch, r)
                counts = sum(np.frombuffer(c, np.int64) for c in batch.column("counts")[r].as_py())
                levels, mine = np.unique(level(x, score), return_inverse=True)
                place = levels // (2 * LOW)
                up = np.cumsum(counts)
                before = np.concatenate(([0], up))[np.searchsorted(place, place)]
                total = up[np.searchsorted(place, place, side="right") - 1] - before
                w = ((up - before) / total)[mine.reshape(-1)]
                s = score / meeting.digits
                pos, h1, h2, columns, _ = fields(batch, "entries", r)
                codes: dict = {}
                of = numbered(codes, h1, h2)
                first, last = np.searchsorted(x, pos), np.searchsorted(x, pos, side="right")
                many = last - first
                which = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
                times = np.repeat(columns, many)
                key, group = np.unique(np.repeat(of, many) * len(classes) + code[which], return_inverse=True)
                total_of = lambda v: np.bincount(group.reshape(-1), weights=v, minlength=len(key))  # noqa: B023, E731
                own, other = np.array(list(codes), np.int64)[key // len(classes)], np.array(classes, np.int64)[key % len(classes)]
                out = [own[:, 0], own[:, 1], other[:, 0], other[:, 1], total_of(s[which] * w[which] * times), total_of(w[which] * times), total_of(times).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in out], names=["q1", "q2", "c1", "c2", "sw", "sum_w", "n_matched"])

    best = met(queries.drop("entries").withColumn("entries", F.lit(None).cast("int"))).mapInArrow(find, "q_block bigint, h1 binary, h2 binary, pos binary, code binary, score binary")
    best = materialize(best, "block-bests")
    bests = best.groupBy("q_block").agg(F.collect_list(F.struct("h1", "h2", "pos", "code", "score")).alias("bests")).withColumnRenamed("q_block", "block")
    known = queries.drop("entries").join(bests, "block").withColumn("entries", F.lit(None).cast("int"))
    counts = materialize(met(known).mapInArrow(count, "q_block bigint, counts binary"), "block-counts")
    counts = counts.groupBy(F.col("q_block").alias("block")).agg(F.collect_list("counts").alias("counts"))
    sums = bests.join(counts, "block").join(queries.select("block", "entries"), "block").select("bests", "counts", "entries")
    sums = sums.mapInArrow(finish, "q1 bigint, q2 bigint, c1 bigint, c2 bigint, sw double, sum_w double, n_matched bigint")
    pair = lambda a, b: F.struct(F.col(a).alias("h1"), F.col(b).alias("h2"))
    return sums.select(pair("q1", "q2").alias("q_class"), pair("c1", "c2").alias("c_class"), "sw", "sum_w", "n_matched")
