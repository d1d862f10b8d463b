"""Quality rules: distribution divergence of documents from language references [native].

A document's histogram of character classes and of its language's common words is compared with the
language's reference by the Jensen-Shannon distance.  References are counted over all documents (one pass: class
sums and word counts per language).  The verdict per document is a row expression: nothing but the word counts is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unionlake.llm.columns import SPACE_CHARS, fresh, let, text_of, words
from unionlake.session import materialize

#: Character classes (fixed values): pattern of the characters of each; what no pattern takes is one more class.
CHAR_CLASSES = [
    r"\p{Ll}",
    r"\p{Lu}",
    r"[0-9]",
    r"[\x20\x09-\x0D]",
    r"[.,;:!?'\x22()-]",
    r"[#*$%&|<>]",
]
SYMBOLS = CHAR_CLASSES[5]
POOLED = "*"
#: Slots (a power of two) of the table of hashes that tells most words apart from the common ones without a search.
SLOTS = 1024


@dataclass(frozen=True)
class QualityParams:
    """min_words / max_repeat_pct: the base rules.  common_words: words in a reference histogram.
    min_reference_words: a language with fewer words in the corpus is compared with all languages together.
    min_chars, min_words_js: shorter documents are not judged by that histogram (their histograms are noise).
    max_char_js, max_word_js: largest accepted Jensen-Shannon distances (base 2, 0..1).  From the divergence of
    the words, (bins - 1) / (8 n ln 2) is taken off first: what a sample of n words from the reference itself has."""

    min_words: int = 50
    max_repeat_pct: int = 50
    common_words: int = 40
    min_reference_words: int = 2_000
    min_chars: int = 200
    min_words_js: int = 50
    max_char_js: float = 0.3
    max_word_js: float = 0.245


def class_counts(text: Column) -> Column:
    """Characters of each class, as an array.  A class is taken out of what the ones before it left, so only the first, the
    small letters, goes through the whole text."""
    def count(left: Column, rest: list[str]) -> Column:
        if not rest:
            return F.array().cast("array<int>")
        return let(F.regexp_replace(left, rest[0] + "+", ""), lambda new: F.concat(F.array(F.length(left) - F.length(new)), count(new, rest[1:])))

    return count(text, CHAR_CLASSES)


def _shares(counts: Column) -> Column:
    """An array of counts as shares of their sum (all zero if the sum is)."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return let(F.struct(counts.alias("c"), total.alias("t")), lambda s: F.transform(s["c"], lambda x: F.when(s["t"] > 0, x / s["t"]).otherwise(0.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms of shares."""
    def term(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(x * 2 / (x + y))).otherwise(0.0)

    parts = F.zip_with(p, q, lambda x, y: term(x, y) + term(y, x))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def word_divergence(found: Column, n: Column, shares: Column) -> Column:
    """Jensen-Shannon distance of a document's common words from the reference shares.

    found: the places in the reference (from 1) of the document's common words, sorted; n: all its words.  Equal places are
    counted as runs; a bin without words adds its whole reference share, so only the document's own bins are visited."""
    def term(p: Column, q: Column) -> Column:
        return p * F.log2(p * 2 / (p + q)) + F.when(q > 0, q * F.log2(q * 2 / (p + q))).otherwise(0.0) - q

    def runs(p: Column) -> Column:
        m = F.size(p)
        starts = F.filter(F.transform(p, lambda x, i: F.when((i == 0) | (F.get(p, i - 1) != x), i)), lambda i: i.isNotNull())
        share = lambda i: F.coalesce(F.get(shares, (F.get(p, i) - 1).cast("int")), F.lit(0.0))
        terms = lambda s: F.transform(s, lambda i, k: term((F.coalesce(F.get(s, k + 1), m) - i) / n, share(i)))
        other = F.when(m < n, term((n - m) / n, F.coalesce(F.element_at(shares, -1), F.lit(0.0)))).otherwise(0.0)
        return F.sqrt(F.greatest((F.aggregate(let(starts, terms), F.lit(0.0), lambda a, x: a + x) + other + 1) / 2, F.lit(0.0)))

    return runs(found)


def slot(word: Column) -> Column:
    return F.hash(word).bitwiseAND(F.lit(SLOTS - 1))


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang", params: QualityParams = QualityParams()) -> DataFrame:
    """(lang, chars, words, slots, word_shares): class shares, the common words, the hash slots they take and their shares (the last share is all
    other words) of each language with enough words, and of all languages together as lang ``*``.  Ties of
    word counts go to the word that sorts first.  A null language counts only for ``*``."""
    base = docs.select(F.col(lang).cast("string").alias("lang"), text_of(text).alias("text"))
    counts = [F.get("classes", F.lit(i)).cast("double").alias(f"c{i}") for i in range(len(CHAR_CLASSES))]
    chars = base.select("lang", F.length("text").cast("double").alias("n"), class_counts(F.col("text")).alias("classes")).select("lang", "n", *counts)
    sums = chars.groupBy("lang").agg(F.sum("n").alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(counts))])
    tokens = base.select("lang", F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("word")).where("word != ''")
    # one pass over the words; the small per-language tables below are built from these counts
    counted = materialize(tokens.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "quality-words")
    sums = materialize(sums, "quality-chars")
    both = counted.where("lang is not null").unionByName(counted.groupBy("word").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(POOLED)))
    # how many words have each count: from it the sizes, and the least count a common word can have, so few words are ranked
    counts_of = materialize(both.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("m")), "quality-count-sizes")
    above = Window.partitionBy("lang").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    least = F.min(F.when(F.coalesce("before", F.lit(0)) < params.common_words, F.col("n"))).alias("least")
    sizes = materialize(counts_of.withColumn("before", F.sum("m").over(above)).groupBy("lang").agg(F.sum(F.col("n") * F.col("m")).alias("size"), least), "quality-sizes")
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    ranked = both.join(sizes.select("lang", "least"), "lang").where(F.col("n") >= F.col("least")).drop("least")
    common = ranked.withColumn("r", F.row_number().over(top)).where(F.col("r") <= params.common_words)
    hist = (
        common.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("r", "word", "n"))).alias("top"))
        .join(sizes, "lang")
        .where((F.col("size") >= params.min_reference_words) | (F.col("lang") == POOLED))
        .select(
            "lang",
            F.transform("top", lambda x: x["word"]).alias("words"),
            F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: F.exists("top", lambda x: slot(x["word"]) == k)).alias("slots"),
            _shares(F.concat(
                F.transform("top", lambda x: x["n"].cast("double")),
                F.array((F.col("size") - F.aggregate("top", F.lit(0).cast("long"), lambda a, x: a + x["n"])).cast("double")),
            )).alias("word_shares"),
        )
    )
    cols = [f"c{i}" for i in range(len(counts))]
    pooled = sums.agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in cols]).withColumn("lang", F.lit(POOLED))
    all_sums = sums.where("lang is not null").unionByName(pooled)
    rest = F.col("n") - sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    chars = all_sums.select("lang", _shares(F.array(*cols, rest)).alias("chars"))
    return materialize(hist.join(chars, "lang"), "quality-references")


def with_repeat_words(df: DataFrame, h: str, out: str) -> DataFrame:
    """``df`` with the words covered by 3-word windows that occur twice or more; h: the words' 64-bit hashes in order.

    O(n log n) per document: window hash and start are packed in one long (the start takes as many low bits as
    n needs) and sorted, so equal neighbours give the repeated starts.  Documents whose windows are all
    different, as 64-bit hashes, skip that.  Every step is a column of its own: only the functions over single elements
    are interpreted, sorting and distinct run on plain longs."""
    win, rep, bits, packed, starts = fresh(df, "win", "rep", "bits", "packed", "starts")
    n = F.size(h)
    none = F.array().cast("array<long>")
    windows = F.transform(F.slice(h, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    window = lambda x: F.call_function("shiftright", x, F.col(bits))
    start = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(bits)) - 1
    same = lambda e, k: F.coalesce(window(e) == window(F.get(packed, k - 1)), F.lit(False)) | F.coalesce(window(e) == window(F.get(packed, k + 1)), F.lit(False))
    at = F.transform(packed, lambda e, k: F.when(same(e, k), e.bitwiseAND(start)).otherwise(F.lit(-1).cast("long")))
    m = F.size(starts)
    gaps = F.zip_with(F.slice(starts, F.lit(1), F.greatest(m - 1, F.lit(0))), F.slice(starts, F.lit(2), F.greatest(m - 1, F.lit(0))), lambda a, b: F.least(b - a, F.lit(3).cast("long")))
    steps = (
        df.withColumn(win, windows)
        .withColumn(rep, F.when(F.size(win) == F.size(F.array_distinct(win)), none).otherwise(F.col(win)))
        .withColumn(bits, F.length(F.bin(F.size(rep).cast("long"))))
        .withColumn(packed, F.sort_array(F.transform(rep, lambda x, i: F.call_function("shiftleft", x, F.col(bits)).bitwiseOR(i.cast("long")))))
        .withColumn(starts, F.sort_array(F.array_remove(at, F.lit(-1).cast("long"))))
    )
    total = F.when(m > 0, F.aggregate(gaps, F.lit(3).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))
    return steps.withColumn(out, total).drop(win, rep, bits, packed, starts)


def rate(docs: DataFrame, references: DataFrame, text: str = "text", lang: str = "lang", params: QualityParams = QualityParams(), out: str | None = None) -> tuple[DataFrame, str]:
    """``docs`` with one more struct column (its name is returned too): n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, char_js, word_js, base_failed, kept.

    Null text counts as empty (no words, base rules fail); an unknown or null language is compared with the
    pooled reference; if there is no reference at all (empty corpus) only the base rules judge.  Repeated rows
    are each judged; columns of ``docs`` with any names stay as they are."""
    t, w, h, classes, ref, key, found, lines, repeated, q = fresh(docs, "text", "w", "h", "classes", "ref", "reflang", "found", "lines", "repeated", out or "quality")
    known = references.where(F.col("lang") != POOLED).select(F.col("lang").alias(key), F.struct("chars", "words", "word_shares", "slots").alias(ref))
    pooled = references.where(F.col("lang") == POOLED).select(F.struct("chars", "words", "word_shares", "slots").alias("r")).scalar()
    worded = F.filter(F.split(F.col(t), "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    counts = class_counts(F.col(t)).cast("array<double>")
    # only words in a slot of a common word are looked up
    nowhere = F.lit(0).cast("long")
    place = lambda x: F.when(F.get(F.col(ref)["slots"], slot(x)), F.coalesce(F.array_position(F.col(ref)["words"], x), nowhere)).otherwise(nowhere)
    seen = (
        docs.withColumn(t, text_of(text))
        .join(known, F.col(lang).cast("string") == F.col(key), "left")
        .withColumn(ref, F.coalesce(F.col(ref), pooled))
        .withColumns({w: words(F.col(t)), classes: counts, lines: worded})
        .withColumns({h: F.transform(w, lambda x: F.xxhash64(x)), found: F.sort_array(F.array_remove(F.transform(F.transform(w, F.lower), place), nowhere))})
    )
    seen = with_repeat_words(seen, h, repeated)
    p = params
    size = F.size(w).cast("long")
    length = F.length(t)
    all_classes = F.concat(F.col(classes), F.array(length - F.aggregate(classes, F.lit(0.0), lambda a, x: a + x)))
    facts = F.struct(
        size.alias("n_words"),
        (length - F.get(F.col(classes), F.lit(3))).cast("long").alias("word_chars"),
        F.get(F.col(classes), F.lit(5)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.col(repeated).alias("n_repeat_words"),
        F.when(length >= p.min_chars, js_distance(_shares(all_classes), F.col(ref)["chars"])).alias("char_js"),
        F.when(size >= p.min_words_js, word_divergence(F.col(found), size, F.col(ref)["word_shares"])).alias("word_js"),
    )

    def judged(f: Column) -> Column:
        failed = (f["n_words"] < p.min_words) | (100 * f["n_repeat_words"] > p.max_repeat_pct * f["n_words"])
        noise = F.size(F.col(ref)["words"]) / (8 * math.log(2) * f["n_words"])
        near = F.coalesce(f["char_js"] <= p.max_char_js, F.lit(True)) & F.coalesce(F.pow(f["word_js"], F.lit(2)) - noise <= p.max_word_js**2, F.lit(True))
        return F.struct(*[f[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_js", "word_js")], failed.alias("base_failed"), (~failed & near).alias("kept"))

    # a condition that is not deterministic keeps a filter on the verdict above this projection: pushed below,
    # it would compute the words and their hashes anew wherever the verdict uses them
    once = F.monotonically_increasing_id() >= 0
    return seen.withColumn(q, F.when(once, let(facts, judged))).select(*docs.columns, q), q
