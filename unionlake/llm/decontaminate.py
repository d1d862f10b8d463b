"""Benchmark decontamination: spaced-seed hashing [native].

Fixed masks over token positions leave some positions out, so a seed survives substituted tokens there.  Seeds of the
benchmark and of every position of every document are joined on their hash.  Around a hit the document is aligned with
the item token by token; it is a leak if some stretch of the item agrees in enough places.  The masks of a stretch are hit
wherever its substituted tokens stand, so every leak is a candidate.  Texts are read twice: for their seeds, and those with
a hit for the tokens beside it.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unionlake.llm.columns import fresh, let, text_of
from unionlake.session import materialize

#: Masks (fixed values) by tokens of a stretch and substituted tokens in it: 1 takes the token, 0 leaves it out.  Each set
#: was enumerated: it has a hit for every placement of the substituted tokens.
MASKS = {
    (13, 2): ["11110111", "11001001111", "11111101"],
    (12, 2): ["11101011", "1100100111", "101111001"],
    (11, 2): ["1110111", "111001011", "110100111", "101101101"],
    (10, 2): ["111011", "11010011", "111001001"],
    (9, 1): ["1111011", "110011011"],
    (8, 1): ["1111101", "1101111", "10110111"],
    (7, 1): ["111101", "1001111", "111011"],
    (6, 1): ["11101", "10111"],
    (5, 1): ["1111", "10111", "11101", "11011"],
}

#: Words of 64 bits in a row of the seed filter, and in all of it at most (48 MB); it has 16 bits a seed below that.
ROW_WORDS, FILTER_WORDS = 64, 6_000_000


@dataclass(frozen=True)
class LeakParams:
    """stretch: aligned tokens that are compared (all, if the item is shorter); share: smallest part of them that agrees.
    broadcast_seeds: up to so many benchmark seeds (40 bytes each) or keys of documents with a hit are broadcast; beyond,
    both sides are shuffled, and a filter of the benchmark's seeds is broadcast instead."""

    stretch: int = 13
    share: float = 0.8
    broadcast_seeds: int = 2_000_000


def token_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased runs of letters and digits."""
    hashes = F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: F.xxhash64(x))
    return F.array_remove(hashes, F.xxhash64(F.lit("")))  # a split leaves empty strings at the ends


def stretch_masks(width: int, share: float) -> list[str]:
    """Masks that have a hit in every stretch of ``width`` tokens with enough equal ones.  Without a set of its own a stretch
    has the run of equal tokens that is left however the others are placed."""
    lost = width - max(math.ceil(share * width), 1)
    return MASKS.get((width, lost), ["1" * -(-(width - lost) // (lost + 1))])


def _windows(df: DataFrame, keep: list[str], masks: dict[str, Column]) -> DataFrame:
    """keep + (hashes, at, seed): one row for each position of ``hashes`` and mask whose condition holds; the seed is null
    where the mask passes the end."""
    shortest = min(map(len, masks))
    spots = df.where(F.size("hashes") >= shortest).select(*keep, "hashes", F.explode(F.sequence(F.lit(0), F.size("hashes") - shortest)).alias("at"))
    taken = lambda m: F.xxhash64(F.lit(m), *[F.get("hashes", F.col("at") + o) for o, c in enumerate(m) if c == "1"])
    seeds = [F.when((F.col("at") + len(m) <= F.size("hashes")) & cond, taken(m)) for m, cond in masks.items()]
    return spots.select(*keep, "hashes", "at", F.explode(F.array(*seeds)).alias("seed"))


def benchmark_texts(items: DataFrame) -> DataFrame:
    """(text, hashes, n, width): the different token runs of (item, hashes), numbered once and written.  Items with equal
    tokens are one text.  width: tokens of the stretch that is compared."""
    texts = items.select("hashes", F.size("hashes").alias("n"), "width").distinct()
    return materialize(texts.withColumn("text", F.monotonically_increasing_id()), "benchmark-texts")


def benchmark_seeds(texts: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """(text, n, width, item_at, item_seed).  A text of fewer tokens than a stretch has masks of its own length."""
    widths: dict[str, list[int]] = {}
    for width in range(1, params.stretch + 1):
        for m in stretch_masks(width, params.share):
            widths.setdefault(m, []).append(width)
    seeds = _windows(texts, ["text", "n", "width"], {m: F.col("width").isin(w) for m, w in widths.items()}).where("seed is not null")
    return seeds.select("text", "n", "width", F.col("at").alias("item_at"), F.col("seed").alias("item_seed"))


def _place(seed: Column, words: int) -> tuple[Column, Column, Column]:
    """Row, word of the row and bits of the word that a seed has in a filter of so many words."""
    word = F.pmod(F.shiftrightunsigned(seed, 24), F.lit(words).cast("long"))
    bits = [F.shiftrightunsigned(seed, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(4)]
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    return F.floor(word / ROW_WORDS).cast("long"), F.pmod(word, F.lit(ROW_WORDS).cast("long")).cast("int"), functools.reduce(lambda x, y: x.bitwiseOR(y), map(bit, bits))


def seed_filter(seeds: DataFrame, words: int) -> DataFrame:
    """(row, words): a bit filter of the seeds, four bits in one word for each; rows without a seed are left out."""
    row, word, bits = _place(F.col("item_seed"), words)
    held = seeds.select(row.alias("row"), word.alias("word"), bits.alias("bits")).groupBy("row", "word").agg(F.bit_or("bits").alias("bits"))
    rows = held.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    return rows.select("row", F.transform(F.sequence(F.lit(0), F.lit(ROW_WORDS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("words"))


def leaks(docs: DataFrame, bench: DataFrame, text: str = "text", doc_id: str = "doc_id", bench_text: str = "text", item_id: str = "item_id", params: LeakParams = LeakParams()) -> DataFrame:
    """(doc_id, item_id, token_at, n_same, n_item, n_places): one row per document and item that leaked into it; the best
    place (most equal tokens, then the first), its first token in the document (negative if the item's start is cut
    off) and the number of places.

    Null text counts as empty.  Rows that repeat a document id, or an item id, count as one.  Empty tables have no leaks;
    an item without tokens proves nothing."""
    items = bench.select(F.col(item_id).alias("item"), token_hashes(text_of(bench_text)).alias("hashes")).where(F.size("hashes") > 0)
    texts = benchmark_texts(items.withColumn("width", F.least(F.size("hashes"), F.lit(params.stretch))))
    seeds = materialize(benchmark_seeds(texts, params), "benchmark-seeds")
    n_seeds = {r["width"]: r["count"] for r in seeds.groupBy("width").count().collect()}
    small = sum(n_seeds.values()) <= params.broadcast_seeds
    masks = {m: F.lit(True) for w in n_seeds or [params.stretch] for m in stretch_masks(w, params.share)}
    rows = docs.select(F.col(doc_id).alias("doc"), text_of(text).alias("doc_text"))
    rows = rows.withColumns({"h1": F.xxhash64("doc", "doc_text"), "h2": F.xxhash64(F.lit(0x5EED), "doc", "doc_text")})  # the key of a row
    windows = _windows(rows.select("doc", "h1", "h2", token_hashes(F.col("doc_text")).alias("hashes")), ["doc", "h1", "h2"], masks)
    if small:
        seeds = F.broadcast(seeds)
    else:  # only seeds that pass the filter of the benchmark's are shuffled
        n_words = min(sum(n_seeds.values()) // 4 + 1, FILTER_WORDS)
        row, word, bits = _place(F.col("seed"), n_words)
        among = materialize(seed_filter(seeds, n_words), "seed-filter")
        windows = windows.join(F.broadcast(among), F.col("row") == row).where(F.get("words", word).bitwiseAND(bits) == bits)
    # a document's hits meet in a hash table before they leave its task, without its tokens: a row that left with them would
    # be held once for each hit of the document
    hits = windows.select("doc", "h1", "h2", "at", "seed").join(seeds, F.col("seed") == F.col("item_seed"))
    found = materialize(hits.select("doc", "h1", "h2", "text", "n", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "leak-hits")
    hit_rows = found.select("h1", "h2").distinct()
    if hit_rows.count() <= params.broadcast_seeds:
        hit_rows = F.broadcast(hit_rows)
    hit = rows.join(hit_rows, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]).select("h1", "h2", token_hashes(F.col("doc_text")).alias("hashes"))
    part = F.slice("hashes", F.greatest(F.col("shift"), F.lit(0)) + 1, F.col("n"))
    # the document's part beside the item is cut out here, so the join's other side stays small
    beside = found.join(hit, ["h1", "h2"]).select("doc", "text", "shift", part.alias("part"))
    compared = texts.select("text", F.col("hashes").alias("item_hashes"))
    beside = beside.join(F.broadcast(compared) if small else compared, "text")

    def agreed(same: Column) -> Column:
        width = F.least(F.size("item_hashes"), F.lit(params.stretch))
        sums = F.transform(F.sequence(F.lit(0), F.size(same) - width), lambda i: F.aggregate(F.slice(same, i + 1, width), F.lit(0), lambda a, x: a + x))
        return F.struct(F.aggregate(same, F.lit(0), lambda a, x: a + x).alias("n"), (F.array_max(sums) >= params.share * width).alias("leak"))

    back = F.least(F.col("shift"), F.lit(0))
    same = F.transform("item_hashes", lambda x, i: F.when(x == F.get(F.col("part"), F.when(i + back >= 0, i + back).otherwise(F.lit(-1))), 1).otherwise(0))
    checked = beside.withColumn("check", let(same, agreed)).where("check.leak")
    held = items.join(texts, "hashes").select("item", "text").distinct()
    places = checked.select("doc", "text", "shift", F.col("check.n").alias("n"), F.size("item_hashes").alias("n_item")).distinct().join(held, "text")
    best = F.min(F.struct(-F.col("n"), F.col("shift"), F.col("n_item")))
    return places.groupBy("doc", "item").agg(best.alias("b"), F.countDistinct("shift").alias("n_places")).select(
        F.col("doc").alias(doc_id), F.col("item").alias(item_id), F.col("b.shift").cast("long").alias("token_at"), (-F.col("b.col1")).cast("long").alias("n_same"), F.col("b.n_item").cast("long").alias("n_item"), F.col("n_places").cast("long").alias("n_places"))


def drop_leaked(docs: DataFrame, bench: DataFrame, text: str = "text", doc_id: str = "doc_id", bench_text: str = "text", item_id: str = "item_id", params: LeakParams = LeakParams()) -> DataFrame:
    """``docs`` without the documents that hold a leak; a document with a null id can't be told apart and stays."""
    leaked, = fresh(docs, "leaked")
    bad = leaks(docs, bench, text, doc_id, bench_text, item_id, params).select(F.col(doc_id).alias(leaked)).distinct()
    return docs.join(bad, F.col(doc_id) == F.col(leaked), "left_anti")
