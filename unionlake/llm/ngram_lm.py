"""LM scoring: an interpolated modified Kneser-Ney bigram model.

Spark counts words and word pairs over all training texts.  The counts are stored as sorted hash arrays in files of the shared
folder, sharded by hash; workers map the files into memory, so a worker's own memory holds only pages it has touched.  Word pairs
are summed in the tasks before they are shuffled, in shards of bounded size by the hash of the pair, so a frequent word has no
task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unionlake.llm.arrowtext import LOWER, mix, slices, text_bytes, word_bounds, word_hashes
from unionlake.llm.shared import Atomic, shared_dir
from unionlake.session import materialize

#: The end of a text as a word: a hash of its own.
END = np.int64(-0x7E57E57E57E57E57)
#: Word numbers in a range of the dense statistics, and partial sums of a range that one task adds up.
DENSE, FAN_IN = 1 << 17, 32


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, each text followed by END; the text of each; the place where each text starts."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, doc = word_bounds(data, offsets)
    size = np.bincount(doc, minlength=len(column)) + 1
    first = np.cumsum(size) - size
    out = np.full(int(size.sum()), END, np.int64)
    out[np.arange(len(doc)) + doc] = word_hashes(data, starts, ends).view(np.int64)
    return out, np.repeat(np.arange(len(column)), size), first


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their summed counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    keys, back = np.unique(keys, return_inverse=True)
    return keys, np.bincount(back, weights=counts, minlength=len(keys)).astype(np.int64)


def _collect(arrays: Iterator[np.ndarray], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sums keys over many arrays; gives them out whenever more than ``most`` different ones are held."""
    parts, held = [], 0
    for keys in arrays:
        found = np.unique(keys, return_counts=True)
        parts.append(found)
        held += len(found[0])
        if held > most:
            parts = [_summed(parts)]
            held = len(parts[0][0])
            if held > most // 2:
                yield parts[0]
                parts, held = [], 0
    if parts:
        yield _summed(parts)


@dataclass
class Words:
    """Sorted word hashes and counts in shard files; a word's number is its place in the whole order."""

    shards: list[tuple[int, int, str]]  # (first hash, words, path), in order
    total: int = 0
    maps: list = field(default=None, repr=False)

    @property
    def size(self) -> int:
        return sum(n for _, n, _ in self.shards)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unknown) and counts of sorted word hashes."""
        if self.maps is None:
            self.maps = [np.memmap(p, np.int64, "r", shape=(2, n)) for _, n, p in self.shards]
        ids, counts = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
        cuts = np.append(np.searchsorted(words, [lo for lo, _, _ in self.shards]), len(words)) if self.shards else []
        base = 0
        for k, table in enumerate(self.maps):
            mine = slice(cuts[k], cuts[k + 1])
            at = np.minimum(np.searchsorted(table[0], words[mine]), table.shape[1] - 1)
            hit = table[0][at] == words[mine]
            ids[mine] = np.where(hit, base + at, -1)
            counts[mine] = np.where(hit, table[1][at], 0)
            base += table.shape[1]
        return ids, counts

    def __getstate__(self):
        return {"shards": self.shards, "total": self.total, "maps": None}


def _write_words(train: DataFrame, folder: str, most: int) -> Words:
    def count(batches):
        arrays = (_tokens(p.column("text"))[0] for b in batches for p in slices(b, "text", 1 << 20))
        for keys, n in _collect(arrays, most):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["h", "n"])

    def write(batches):
        path = f"{folder}/words-{TaskContext.get().partitionId():06d}"
        parts = [(b.column("h").to_numpy(), b.column("n").to_numpy()) for b in batches if b.num_rows]
        if parts:
            keys, n = (np.concatenate(x) for x in zip(*parts))
            with Atomic(path) as file:
                file.write(keys.astype("<i8").tobytes() + n.astype("<i8").tobytes())
            yield pa.RecordBatch.from_pylist([{"lo": int(keys[0]), "n": len(keys), "path": path, "total": int(n.sum())}])

    counts = train.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    files = materialize(counts.repartitionByRange("h").sortWithinPartitions("h").mapInArrow(write, "lo long, n long, path string, total long"), "lm-words")
    rows = files.orderBy("lo").collect()  # one row a file
    return Words([(r.lo, r.n, r.path) for r in rows], sum(r.total for r in rows))


def _pairs(column: pa.Array, words: Words) -> tuple[np.ndarray, ...]:
    """(context number, word number, word count, text) of every token; a text's first context is the number ``words.size``."""
    h, doc, first = _tokens(column)
    distinct, back = np.unique(h, return_inverse=True)
    ids, counts = words.find(distinct)
    ids, counts = ids[back], counts[back]
    context = np.concatenate(([0], ids[:-1]))
    context[first] = words.size
    return context, ids, counts, doc


def _key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One hash for a pair of numbers (bijective, so pairs never collide while there are fewer than 2**32 words)."""
    return mix((context.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64))


def _unkey(x: np.ndarray) -> np.ndarray:
    """The pair behind a hash."""
    def unshift(x, s):
        y = x.copy()
        for _ in range(64 // s):
            y = x ^ (y >> np.uint64(s))
        return y

    x = unshift(x, 31) * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = unshift(x, 27) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return unshift(x, 30)


_BLOB = "kind string, shard long, source long, path string, keys binary, a binary, b binary, c binary, d binary"
_BLOB_SCHEMA = pa.schema([("kind", pa.string()), ("shard", pa.int64()), ("source", pa.int64()), ("path", pa.string()), *((c, pa.binary()) for c in ("keys", "a", "b", "c", "d"))])


def _pack(x: np.ndarray) -> bytes:
    """Numbers as differences, byte planes apart: zero bytes stand together for the shuffle's compression."""
    step = np.diff(x.astype(np.uint64), prepend=np.uint64(0))
    return np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T)
    return np.cumsum(planes.view(np.uint64).reshape(-1), dtype=np.uint64)


def _planes(x: np.ndarray) -> bytes:
    """Small counts, byte planes apart, without differences."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


def _row(kind, shard, path=None, keys=None, a=None, b=None, c=None, d=None, source=0) -> dict:
    return {"kind": kind, "shard": int(shard), "source": int(source), "path": path, "keys": keys, "a": a, "b": b, "c": c, "d": d}


def _by_word(kind: str, source: int, ids: np.ndarray, *values: np.ndarray) -> Iterator[dict]:
    """Statistics of words (sorted by number) as one row for each dense range of numbers; ``source`` numbers who found them."""
    block = ids // DENSE
    for k in np.unique(block):
        m = slice(*np.searchsorted(block, [k, k + 1]))
        yield _row(kind, k, None, _pack(ids[m]), *(_planes(v[m]) for v in values), source=source)


def _write_pairs(train: DataFrame, words: Words, folder: str, shards: int, most: int) -> DataFrame:
    """One row a pair file, and rows of word statistics: contexts (tokens, words seen once, twice, more often) and continuations
    (contexts before the word)."""
    def count(batches):
        def keys():
            for b in batches:
                for p in slices(b, "text", 1 << 20):
                    context, ids, _, _ = _pairs(p.column("text"), words)
                    yield _key(context, ids)

        for found, n in _collect(keys(), most):
            shard = (found >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
            cuts = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
            rows = [_row("part", k, None, _pack(found[s:e]), _planes(n[s:e])) for k, (s, e) in enumerate(zip(cuts, cuts[1:])) if e > s]
            yield pa.RecordBatch.from_pylist(rows, schema=_BLOB_SCHEMA)

    def merge(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, n = _summed([(_unpack(k.as_py()), _unplanes(a.as_py())) for k, a in zip(table.column("keys"), table.column("a"))])
        path = f"{folder}/pairs-{shard:08d}"
        with Atomic(path) as file:
            file.write(keys.astype("<u8").tobytes() + n.astype("<u8").tobytes())
        pair = _unkey(keys)
        context, word = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        rows = [_row("file", shard, path, np.array([len(keys), *(int((n == k).sum()) for k in (1, 2, 3, 4))], "<i8").tobytes())]
        order = np.argsort(context, kind="stable")
        ids, at = np.unique(context[order], return_index=True)
        m = n[order]
        sums = [np.add.reduceat(v, at) for v in (m, m == 1, m == 2, m > 2)] if len(ids) else [m] * 4
        rows += _by_word("context", shard, ids, *(s.astype(np.int64) for s in sums))
        ids, seen = np.unique(word, return_counts=True)
        rows += _by_word("word", shard, ids, seen)
        return pa.Table.from_pylist(rows, schema=_BLOB_SCHEMA)

    return materialize(train.mapInArrow(count, _BLOB).groupBy("shard").applyInArrow(merge, _BLOB), "lm-pairs")


def _range_sums(table: pa.Table) -> np.ndarray:
    """The statistics of one range of numbers, summed over the rows of a table: contexts in rows 0 to 3, continuations in 4."""
    sums = np.zeros((5, DENSE), np.int64)
    start = table.column("shard")[0].as_py() * DENSE
    for i, kind in enumerate(table.column("kind").to_pylist()):
        at = _unpack(table.column("keys")[i].as_py()).astype(np.int64) - start
        for k, c in enumerate("abcd" if kind == "context" else "a"):
            sums[4 if kind == "word" else k][at] += _unplanes(table.column(c)[i].as_py())
    return sums


def _write_stats(found: DataFrame, folder: str, shards: int) -> DataFrame:
    """Dense statistics by word number, one file for each range of numbers: five u8 rows.

    Every pair shard has a row for each range, so the rows of a range grow with the corpus: FAN_IN of them are added up at a
    time, in levels, until that many are left."""
    def add(table: pa.Table) -> pa.Table:
        block, source, sums = table.column("shard")[0].as_py(), table.column("source")[0].as_py() // FAN_IN, _range_sums(table)
        rows, ids = [], np.flatnonzero(sums[0])
        rows += _by_word("context", source, ids + block * DENSE, *(v[ids] for v in sums[:4]))
        ids = np.flatnonzero(sums[4])
        rows += _by_word("word", source, ids + block * DENSE, sums[4][ids])
        return pa.Table.from_pylist(rows, schema=_BLOB_SCHEMA)

    def write(table: pa.Table) -> pa.Table:
        block, sums = table.column("shard")[0].as_py(), _range_sums(table)
        path = f"{folder}/stats-{block:08d}"
        with Atomic(path) as file:
            file.write(sums.astype("<u8").tobytes())
        cont = sums[4]
        return pa.Table.from_pylist([_row("stats", block, path, np.array([int(cont.sum()), *(int((cont == k).sum()) for k in (1, 2, 3, 4)), int((cont > 2).sum())], "<i8").tobytes())], schema=_BLOB_SCHEMA)

    rows = found.where("kind in ('context', 'word')")
    while shards > FAN_IN:
        rows = materialize(rows.groupBy("shard", F.floor(F.col("source") / FAN_IN).alias("part")).applyInArrow(add, _BLOB), "lm-range-sums")
        shards = -(-shards // FAN_IN)
    return materialize(rows.groupBy("shard").applyInArrow(write, _BLOB), "lm-stats")


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """The three discounts of modified Kneser-Ney, from how many are counted once to four times; at index 0 none.  A discount that
    the counts don't allow is 0.5, 1 and 1.5."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else None
    out = [0.0]
    for k, (low, high) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * high / low if y is not None and low else 0.5 * k
        out.append(d if 0 < d < k else 0.5 * k)
    return np.array(out)


@dataclass
class Model:
    """What a worker needs to score: file names and a few numbers; the files are mapped on first use."""

    words: Words
    pairs: list[tuple[str, int]]  # (path, pairs) of each shard
    stats: list[str]
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    continuations: int
    once_twice_more: tuple[int, int, int]
    maps: list = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"maps": None}

    def _stat(self, row: int, ids: np.ndarray) -> np.ndarray:
        if self.maps is None:
            self.maps = [[(np.memmap(p, np.uint64, "r", shape=(n,)), np.memmap(p, np.int64, "r", 8 * n, (n,))) if n else None for p, n in self.pairs], [np.memmap(p, np.int64, "r", shape=(5, DENSE)) for p in self.stats]]
        out, block = np.zeros(len(ids), np.int64), ids // DENSE
        for k in np.unique(block):
            mine = np.flatnonzero(block == k)
            if k < len(self.maps[1]):  # the start of a text comes after the last word, and may begin a range of its own
                out[mine] = self.maps[1][k][row][ids[mine] - k * DENSE]
        return out

    def _pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted pair hashes."""
        out = np.zeros(len(keys), np.int64)
        shard = (keys >> np.uint64(32)) * np.uint64(len(self.pairs)) >> np.uint64(32)
        cuts = np.searchsorted(shard, np.arange(len(self.pairs) + 1, dtype=np.uint64))
        for k, table in enumerate(self.maps[0]):
            if table is not None and cuts[k + 1] > cuts[k]:
                mine = keys[cuts[k] : cuts[k + 1]]
                at = np.minimum(np.searchsorted(table[0], mine), len(table[0]) - 1)
                out[cuts[k] : cuts[k + 1]] = np.where(table[0][at] == mine, table[1][at], 0)
        return out

    def log10(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 P(word | context) of word numbers; word -1 is unknown, context -1 unknown."""
        size, known = self.words.size, word >= 0
        some = np.maximum(word, 0)
        cont = np.where(known, self._stat(4, some), 0)
        d, total = self.word_discounts, max(self.continuations, 1)
        uniform = 1.0 / (size + 1)
        mass = (np.array(self.once_twice_more) * d[1:]).sum() / total if self.continuations else 1.0
        p = np.maximum(cont - d[np.minimum(cont, 3)], 0) / total + mass * uniform
        seen = context >= 0
        some_context = np.maximum(context, 0)
        ctx = np.where(seen, self._stat(0, some_context), 0)
        d = self.pair_discounts
        back = sum(self._stat(k, some_context) * d[k] for k in (1, 2, 3))
        n = np.zeros(len(word), np.int64)
        both = np.flatnonzero(known & seen)
        keys, at = np.unique(_key(context[both], word[both]), return_inverse=True)
        n[both] = self._pair_counts(keys)[at]
        full = np.where(ctx > 0, (np.maximum(n - d[np.minimum(n, 3)], 0) + back * p) / np.maximum(ctx, 1), p)
        return np.log10(full)


def train(texts: DataFrame, text: str = "text", pairs_per_shard: int = 1_000_000, most: int = 500_000) -> Model:
    """Counts the texts and writes the model.  pairs_per_shard bounds the tokens behind a shard (and what a task sums); most: different
    keys a task holds before it passes them on.  Null text counts as empty: its end is still a token."""
    folder = shared_dir(texts.sparkSession, "ngram-model")
    rows = texts.select(F.col(text).cast("string").alias("text"))
    words = _write_words(rows, folder, most)
    shards = max(1, -(-words.total // pairs_per_shard))
    found = _write_pairs(rows, words, folder, shards, most)
    stats = sorted(_write_stats(found, folder, shards).collect(), key=lambda r: r.shard)  # one row for each range of numbers
    files = {r.shard: r for r in found.where("kind = 'file'").collect()}  # one row a shard
    sizes = {k: np.frombuffer(r["keys"], "<i8") for k, r in files.items()}
    totals = sum(sizes.values(), np.zeros(5, np.int64))
    conts = sum((np.frombuffer(r["keys"], "<i8") for r in stats), np.zeros(6, np.int64))
    return Model(
        words, [(files[k].path, int(sizes[k][0])) if k in files else ("", 0) for k in range(shards)], [r.path for r in stats],
        discounts(*map(int, totals[1:])), discounts(*map(int, conts[1:5])), int(conts[0]), (int(conts[1]), int(conts[2]), int(conts[5])),
    )


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep + (n_tokens, n_known, base_score, score) of every row: its tokens with the end, those seen in training, the log10
    probability under add-0.1 word counts, and under the model.  Null text counts as empty; repeated rows are scored one by one."""
    total, size = model.words.total, model.words.size

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__text", 1 << 20):
                column = part.column("__text")
                context, word, counts, doc = _pairs(column, model.words)
                base = np.log10((counts + 0.1) / (total + 0.1 * (size + 1)))
                lm = model.log10(context, word)
                sums = [np.bincount(doc, minlength=len(column)), np.bincount(doc, weights=counts > 0, minlength=len(column)), np.bincount(doc, weights=base, minlength=len(column)), np.bincount(doc, weights=lm, minlength=len(column))]
                arrays = [pa.array(s.astype(np.int64)) if i < 2 else pa.array(s) for i, s in enumerate(sums)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + arrays, names=[*keep, "n_tokens", "n_known", "base_score", "score"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"{fields}, n_tokens long, n_known long, base_score double, score double")


def held_out(doc_id: str, parts: int = 10) -> Column:
    """Whether a document is left out of training: crc32 of its id as text is a multiple of ``parts``; a null id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts)) == 0, F.lit(False))


def perplexity(scored: DataFrame) -> Column:
    """Per token, from a scored table's columns."""
    return F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
