"""MinHash near-dedup: DartMinHash signatures, banded joining, exact verification.

Every element of a weighted set throws darts: points of a random process, the same in every set, each with a rank, a place in
the element's weight and a coordinate of the signature.  A dart counts if its place lies within the weight.  For each
coordinate the dart of the lowest rank is kept, so two sets agree in a coordinate with the probability of their weighted
Jaccard similarity.  A set only throws the darts of low rank it needs, some k ln k, whatever its size.

Texts with the same words are one node.  Nodes that share a band meet: first only one of them with all others, then, of
what that leaves in different components, all with all, but only similar pairs leave that join.  So copies that resemble one
text cost as many pairs as there are, and no pair is left out.  The exact similarity of word shingles decides.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unionlake.llm.arrowtext import mix, slices, text_bytes, word_bounds, word_hashes
from unionlake.llm.columns import fresh, ratio
from unionlake.llm.components import components
from unionlake.session import materialize


@dataclass(frozen=True)
class NearParams:
    """words: words of a shingle.  threshold: smallest Jaccard similarity of two texts' shingle sets.  bands, rows: the
    signature has bands * rows coordinates; at similarity 0.8, 28 bands of 6 miss 2 pairs in 10,000.
    weights: ``set`` gives each shingle the weight 1, ``count`` its number in the text (for candidates; verification is
    on sets)."""

    words: int = 5
    threshold: float = 0.8
    bands: int = 28
    rows: int = 6
    weights: str = "set"


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all word shingles, repeats included, and the text each is in.  A text of fewer words has one
    shingle of them all; a text without words has none."""
    data, offsets = text_bytes(column)
    starts, ends, doc = word_bounds(data, offsets)
    h = word_hashes(data, starts, ends)
    n = len(column)
    size = np.bincount(doc, minlength=n)
    first = np.cumsum(size) - size
    factor = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    at = np.flatnonzero(np.arange(len(h)) - first[doc] + width <= size[doc]) if len(h) else np.zeros(0, np.int64)
    s = np.zeros(len(at), np.uint64)
    for j in range(width):
        s += h[at + j] * factor[j]
    short = np.flatnonzero((size > 0) & (size < width))
    extra = np.array([np.bitwise_xor.reduce(mix(h[first[d] : first[d] + size[d]] * factor[: size[d]] + np.uint64(size[d]))) for d in short], np.uint64)
    return np.concatenate((mix(s), mix(extra))), np.concatenate((doc[at], short))


def dart_signatures(element: np.ndarray, owner: np.ndarray, weight: np.ndarray, sets: int, k: int) -> np.ndarray:
    """(sets, k) signatures; entries (element, owner, weight) have an element at most once per set, or repeat it with the
    same weight.  Sets without elements get zeros.

    Weight is cut into cells [0, 1), [1, 2), [2, 4), ...  In each cell of an element darts arrive along the rank as a Poisson
    process of the cell's width: gaps, place, coordinate and identity are hashes of (element, cell, number)."""
    cells = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))), 0).astype(np.int64) + 1
    entry = np.repeat(np.arange(len(element)), cells)
    cell = np.arange(len(entry)) - np.repeat(np.cumsum(cells) - cells, cells)
    low, width = np.where(cell == 0, 0.0, 2.0 ** (cell - 1)), np.where(cell == 0, 1.0, 2.0 ** (cell - 1))
    seed = mix(element[entry] + mix(cell.astype(np.uint64) + np.uint64(0x51ED)))
    total = np.bincount(owner, weights=weight, minlength=sets)
    out = np.zeros((sets, k), np.uint64)
    todo = total > 0
    reach = k * (np.log(k) + 2) / np.maximum(total, 1e-300)
    while todo.any():
        active = np.flatnonzero(todo[owner[entry]])
        best, name = np.full(sets * k, np.inf), np.zeros(sets * k, np.uint64)
        rank, kept = np.zeros(len(active)), []
        number = 0
        while len(active):
            number += 1
            u = mix(seed[active] + np.uint64(number * 0x9E3779B97F4A7C15 % (1 << 64)))
            rank = rank - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[active]
            inside = rank < reach[owner[entry[active]]]
            active, rank, u = active[inside], rank[inside], u[inside]
            dart = mix(u ^ np.uint64(0xD1B54A32D192ED03))
            place = low[active] + width[active] * ((dart >> np.uint64(40)).astype(np.float64) * 2.0**-24)
            hit = place < weight[entry[active]]
            slot = owner[entry[active]] * k + ((dart & np.uint64(0xFFFFFFFF)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            kept.append((slot[hit], rank[hit], dart[hit]))
        slot, ranks, darts = (np.concatenate(x) for x in zip(*kept))
        np.minimum.at(best, slot, ranks)
        first = ranks == best[slot]
        name[slot[first]] = darts[first]
        best, name = best.reshape(sets, k), name.reshape(sets, k)
        full = todo & np.isfinite(best).all(axis=1)
        out[full] = name[full]
        todo &= ~full
        reach = np.where(todo, reach * 2, reach)
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_TO_SPACE = str.maketrans("\t\n\x0b\x0c\r", "     ")


def _nodes(column: pa.Array) -> np.ndarray:
    """A 64-bit number for the words of each text in order."""
    spaced = [(t or "").translate(_TO_SPACE) for t in column.to_pylist()]
    words = (" ".join(w for w in t.split(" ") if w) for t in spaced)
    return np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little", signed=True) for w in words], np.int64)


def signatures(docs: DataFrame, text: str, doc_id: str, p: NearParams) -> DataFrame:
    """(doc, node, bands): node numbers equal word sequences; bands: a hash of each band, none for texts without words."""
    k = p.bands * p.rows

    def sign(batches):
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                column = part.column("text")
                element, owner = shingles(column, p.words)
                if p.weights == "count":
                    both = np.unique(np.stack((owner.astype(np.uint64), element)), axis=1, return_counts=True)
                    owner, element, weight = both[0][0].astype(np.int64), both[0][1], both[1].astype(np.float64)
                else:
                    weight = np.ones(len(element))
                found = dart_signatures(element, owner, weight, len(column), k)
                factor = mix(np.arange(1, p.rows + 1, dtype=np.uint64)) | np.uint64(1)
                band = mix((mix(found).reshape(-1, p.bands, p.rows) * factor).sum(axis=2, dtype=np.uint64) + np.arange(p.bands, dtype=np.uint64))
                some = np.bincount(owner, minlength=len(column)) > 0
                ends = np.concatenate(([0], np.cumsum(some * p.bands))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(np.ascontiguousarray(band[some]).reshape(-1))))
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(_nodes(column)), lists], names=["doc", "node", "bands"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(sign, "doc long, node long, bands array<long>")


def _shingle_sets(docs: DataFrame, wanted: DataFrame, text: str, doc_id: str, p: NearParams) -> DataFrame:
    """(node, shingles) for the wanted (doc, node)."""
    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                column = part.column("text")
                element, owner = shingles(column, p.words)
                order = np.lexsort((element, owner))
                element, owner = element[order], owner[order]
                new = np.ones(len(element), bool)
                new[1:] = (element[1:] != element[:-1]) | (owner[1:] != owner[:-1])
                ends = np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=len(column))))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(_nodes(column)), pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(element[new])))], names=["node", "shingles"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    some = rows.join(wanted.select("doc").distinct(), "doc", "left_semi")
    sets = some.mapInArrow(cut, "node long, shingles array<long>")
    return materialize(sets.join(wanted.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "near-shingles")


def _similar(left: str, right: str, p: NearParams) -> Column:
    """Whether two columns of shingle sets have the similarity."""
    num, den = ratio(p.threshold)
    return F.size(F.array_intersect(left, right)) * (num + den) >= num * (F.size(left) + F.size(right))


def near_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", params: NearParams = NearParams()) -> DataFrame:
    """One row per row of ``docs``: its id, class_id (the smallest id of the class) and class_size (rows).

    A class is a connected component of the texts that are similar or have the same words.  Null text counts as empty;
    texts without words form one class.  A null id takes part, but is never the class's smallest unless all are
    null.  Texts are told apart by 64-bit hashes of their words."""
    signed = materialize(signatures(docs, text, doc_id, params), "near-signatures")
    nodes = signed.groupBy("node").agg(F.min("doc").alias("doc"))
    bands = signed.where(F.size("bands") > 0).select("node", "bands").dropDuplicates(["node"]).select("node", F.explode("bands").alias("band"))
    bands = materialize(bands, "near-bands")
    crowds = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(bands.join(crowds, "band"), "near-buckets")
    sets = _shingle_sets(docs, nodes.join(shared.select("node").distinct(), "node"), text, doc_id, params)
    # first the node with the most company leads each bucket: of a group of copies that is likely what they were copied from
    company = shared.groupBy("node").agg(F.sum("n").alias("company"))
    lead = shared.join(company, "node").groupBy("band").agg(F.max(F.struct("company", "node"))["node"].alias("a"))
    star = shared.join(lead, "band").where("a != node").select("a", F.col("node").alias("b")).distinct()
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    links = materialize(star.join(left, "a").join(right, "b").where(_similar("sa", "sb", params)).select("a", "b"), "near-links")
    # then the nodes of a bucket that are still in different components meet; only similar pairs leave the join
    label = components(links)
    part = shared.join(label, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    mixed = part.groupBy("band").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l != h").select("band")
    part = materialize(part.join(mixed, "band"), "near-open").join(sets, "node")
    a, b = part.alias("a"), part.alias("b")
    cross = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.label") != F.col("b.label")) & _similar("a.shingles", "b.shingles", params))
    more = materialize(cross.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), "near-links")
    label = components(links.unionByName(more)) if not more.isEmpty() else label
    of_node = nodes.join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    rows = signed.select("doc", "node").join(of_node, "node")
    classes = rows.groupBy("label").agg(F.min("doc").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return rows.join(classes, "label").select(F.col("doc").alias(doc_id), "class_id", "class_size")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", params: NearParams = NearParams()) -> DataFrame:
    """``docs`` with one document of each class: the one whose id is the smallest.  Of rows that repeat a kept id the one with
    the smallest text stays.  Rows without an id can't be told apart and stay."""
    kept, n, r = fresh(docs, "near_kept", "near_rows", "near_rank")
    keep = near_classes(docs, text, doc_id, params).where(F.col(doc_id) == F.col("class_id")).groupBy(F.col(doc_id).alias(kept)).agg(F.count(F.lit(1)).alias(n))
    keep = materialize(keep, "near-kept")
    found = docs.join(keep, F.col(doc_id).cast("long") == F.col(kept))
    repeated = found.where(F.col(n) > 1).withColumn(r, F.row_number().over(Window.partitionBy(kept).orderBy(text))).where(F.col(r) == 1)
    return found.where(F.col(n) == 1).select(*docs.columns).unionByName(repeated.select(*docs.columns)).unionByName(docs.where(F.col(doc_id).isNull()))
