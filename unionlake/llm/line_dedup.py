"""Line dedup: exact set-similarity join of lines [native].

A line is its set of words.  Words are ordered by rarity; prefix, positional and length filters (and a parity
sketch that bounds the symmetric difference) leave few candidate pairs, Jaccard decides, and a line is removed if an
earlier line, by (document id, line number), has the same words or a similarity of at least the threshold.

Equal word sets collapse to one class before any join.  Most of a large family of similar lines is settled against
the earliest line that shares a rare word of many places, in linear work; only lines that are still unsettled meet all
earlier candidates.
No bucket or partner is capped.  Sets are told apart by 64-bit hashes of 64-bit word hashes.  Filters and overlaps use the low
32 bits of the word hashes; different sets that are equal in those differ in at least one word, and count so.  In other pairs
two of the few words that differ coincide with a chance of about 4e-9 (4 words of each), which adds one to their overlap.
"""

from __future__ import annotations

import functools
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unionlake.llm.columns import SPACE_CHARS, SPACE_RUN, ceil_div, fresh, let, ratio, split_words, text_of
from unionlake.session import materialize, scratch_path


@dataclass(frozen=True)
class LineParams:
    """threshold: smallest Jaccard similarity of word sets that makes a later line a match.
    rarity_buckets: size (a power of two) of the table of word counts by hash; it bounds what each task holds.
    lead_words: rarest words of a line that look for an earliest line.
    rounds: parts of the words whose candidates are joined one after the other, which divides the disk they need.
    few: words of a lower rank than one of so many places make fewer pairs a line than that, and look for no earliest line."""

    threshold: float = 0.8
    rarity_buckets: int = 1 << 20
    lead_words: int = 6
    rounds: int = 2
    few: int = 32


#: Ranks of words whose counts differ by a factor of two.
RANKS_A_DOUBLING = 6


def low_half(h: Column) -> Column:
    """The low 32 bits of a 64-bit hash."""
    return h.bitwiseAND(F.lit((1 << 32) - 1).cast("long"))


def word_rarity(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """One row: the rank of each hash bucket, from the corpus count of its words on a log scale, as an array (its
    size is the parameter, not the data).  Any order keeps the join exact; a good one keeps it small."""
    lines = docs.select(F.explode(F.split(text_of(text), "\n")).alias("line"))
    tokens = lines.select(F.explode(split_words(F.col("line"))).alias("w")).where("w != ''")
    counts = tokens.groupBy(F.xxhash64("w").bitwiseAND(F.lit(buckets - 1).cast("long")).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left")
    scale = F.least(F.floor(F.log2(F.coalesce("n", F.lit(0).cast("long")) + 1) * RANKS_A_DOUBLING), F.lit(127)).cast("tinyint")
    table = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("b", scale.alias("n")))), lambda x: x["n"]).alias("ranks"))
    return materialize(table, "line-rarity")


def _rank_of(count: int) -> int:
    """The rank of a word that stands in ``count`` places; words of a lower rank stand in fewer."""
    return math.floor(math.log2(count + 1) * RANKS_A_DOUBLING)


def _prefix(n: Column, p: LineParams) -> Column:
    """How many of the n words of a set, rarest first, any set of the similarity shares one of."""
    num, den = ratio(p.threshold)
    return (n - ceil_div(n.cast("long") * num, den) + 1).cast("int")


def _parity(words: Column, n: Column) -> list[Column]:
    """128 parity bits of a set: each word flips one bit, so bits that differ bound the difference of two sets from
    below.  Sets of up to 64 words keep all in the first half (what the halves of a larger set give when combined)."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    flip = lambda a, v: a.bitwiseXOR(F.call_function("shiftleft", one, v))  # noqa: E731  the shift takes the low six bits
    half = lambda h: F.aggregate(words, zero, lambda a, v: F.when(v.bitwiseAND(F.lit(64)) == h, flip(a, v)).otherwise(a))
    return [F.when(n <= 64, F.aggregate(words, zero, flip)).otherwise(half(0)).alias("b0"), F.when(n <= 64, zero).otherwise(half(64)).alias("b1")]


def line_sets(docs: DataFrame, rarity: DataFrame, text: str, doc_id: str, p: LineParams) -> DataFrame:
    """(doc, line_no, key, n, few, words, b0, b1) of every line with a word; words: 32-bit hashes, rarest first; few: how
    many words of the prefix stand in few places, so that they need no earliest line."""
    mask = F.lit(p.rarity_buckets - 1).cast("long")
    lines = docs.select(F.col(doc_id).alias("doc"), F.posexplode(F.split(text_of(text), "\n")).alias("line_no", "line"))
    worded = lines.withColumn("line", F.btrim("line", F.lit(SPACE_CHARS))).where("line != ''")
    # one long per word: its rank above, half of its hash below; the ranks are read once per word, never copied to the rows.
    # Arrays without nulls are sorted as they are, without a box for each number.
    rank = lambda h: F.coalesce(F.get("ranks", h.bitwiseAND(mask).cast("int")), F.lit(0).cast("tinyint"))
    ranked = lambda h: F.shiftleft(rank(h).cast("long"), 32).bitwiseOR(low_half(h))
    hashed = worded.select("doc", "line_no", F.array_distinct(F.transform(split_words(F.col("line")), lambda w: F.xxhash64(w))).alias("hashes"))
    # the same for any order of the words; it is made below the ranks: the step that adds them must use the hashes once, or
    # Spark keeps the ranks as a column and copies them to every row
    keyed = hashed.select("doc", "line_no", F.xxhash64(F.sort_array("hashes")).alias("key"), "hashes")
    ordered = keyed.withColumn("ranks", rarity.scalar()).select("doc", "line_no", "key", F.sort_array(F.transform("hashes", ranked)).alias("ordered"))
    n = F.size("ordered")
    few = F.size(F.filter(F.slice("ordered", F.lit(1), _prefix(n, p)), lambda k: k < F.lit(_rank_of(p.few) << 32).cast("long")))
    # numbers in the range of an int, so that the array is cast as a whole
    words = F.transform("ordered", lambda k: low_half(k) - F.lit(1 << 31).cast("long")).cast("array<int>")
    sets = ordered.select("doc", "line_no", "key", few.alias("few"), words.alias("words"))
    return sets.select("doc", "line_no", "key", F.size("words").alias("n"), "few", "words", *_parity(F.col("words"), F.size("words")))


def _close(x: str, y: str, num: int, den: int, n=lambda x: F.col(f"{x}.n")) -> Column:
    """Length filter and parity bound: false only for pairs below the threshold."""
    a, b = n(x), n(y)
    d0, d1 = (F.col(f"{x}.{h}").bitwiseXOR(F.col(f"{y}.{h}")) for h in ("b0", "b1"))
    differ = F.when((a <= 64) == (b <= 64), F.bit_count(d0) + F.bit_count(d1)).otherwise(F.bit_count(d0.bitwiseXOR(d1)))
    return (a * den >= b * num) & (b * den >= a * num) & (differ * (num + den) <= (a + b) * (den - num))


def _verified(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """(key) of every class that has an earlier class among its pairs (x, y) with the similarity."""
    ord_ = F.struct("doc", "line_no")
    left = classes.select(F.col("key").alias("x"), ord_.alias("xo"), F.col("words").alias("xw"))
    right = classes.select(F.col("key").alias("y"), ord_.alias("yo"), F.col("words").alias("yw"))
    both = pairs.join(left, "x").join(right, "y")
    common = F.size(F.array_intersect("xw", "yw"))
    # two classes are two sets: if their halves of the hashes are all equal, one word at least is not
    common = common - (common == F.greatest(F.size("xw"), F.size("yw"))).cast("int")
    similar = common * (num + den) >= num * (F.size("xw") + F.size("yw"))
    return both.where(similar).select(F.when(F.col("xo") < F.col("yo"), F.col("y")).otherwise(F.col("x")).alias("key")).distinct()


def _classes(docs: DataFrame, text: str, doc_id: str, p: LineParams) -> DataFrame:
    """The first line of each word set, written once in buckets of its key, so that pairs meet their words without
    another shuffle of all words."""
    spark = docs.sparkSession
    sets = line_sets(docs, word_rarity(docs, text, p.rarity_buckets), text, doc_id, p)
    first = Window.partitionBy("key").orderBy("doc", "line_no")
    classes = sets.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    name = f"line_classes_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    classes.write.bucketBy(buckets, "key").option("compression", "zstd").option("path", scratch_path(spark, name)).saveAsTable(name)
    written = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the frame has its files; the catalog keeps nothing
    return written


def _candidates(prefixes: DataFrame, part: int, p: LineParams) -> DataFrame:
    """(x, y): pairs that share a prefix word (of this part of all words), pass the positional and length filters and have an
    open line as the later one.

    The join key holds the word and a size band, one band to the length filter's ratio: the smaller set goes to its own
    band and the one above, with as many prefix words as the positional filter leaves against sizes of that band."""
    num, den = ratio(p.threshold)
    step = den / num if num < den else 2.0
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(step) + 1e-9).cast("int")
    me = ["key", "n", "b0", "b1", "doc", "place"]
    both = prefixes.withColumn("place", F.shiftleft(F.col("line_no").cast("long"), 1) + (~F.col("open")).cast("long"))
    # word and band in one number
    at = F.shiftleft(F.col("word").cast("long"), 16) + F.col("band")
    mine = F.pmod("word", F.lit(p.rounds)) == part
    floor = F.greatest(F.floor(F.pow(F.lit(step), F.col("band")) + 1e-6).cast("long"), F.col("n").cast("long"))
    last = F.col("n") - ceil_div((F.col("n") + floor) * num, num + den)
    lower = both.select(*me, "words", F.explode(F.sequence(band, band + 1)).alias("band")).withColumn("last", last.cast("int")).where("last >= 0")
    slim = ["key", "b0", "b1", "doc", "place", at.alias("at"), (F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")).alias("n_pos")]
    a = lower.select(*me, "band", F.posexplode(F.slice("words", F.lit(1), F.col("last") + 1)).alias("pos", "word")).where(mine).select(*slim).alias("a")
    b = both.select(*me, band.alias("band"), F.posexplode("words").alias("pos", "word")).where(mine).select(*slim).alias("b")
    n = lambda x: F.shiftright(f"{x}.n_pos", 32)
    line = lambda x: F.struct(f"{x}.doc", F.shiftright(f"{x}.place", 1))
    open_ = lambda x: F.col(f"{x}.place").bitwiseAND(F.lit(1).cast("long")) == 0
    order = (n("a") < n("b")) | ((n("a") == n("b")) & (F.col("a.key") < F.col("b.key")))
    left = F.least(*[n(x) - low_half(F.col(f"{x}.n_pos")) for x in "ab"])
    enough = left * (num + den) >= (n("a") + n("b")) * num
    # only a later line that is still open needs the pair
    wanted = F.when(line("a") < line("b"), open_("b")).otherwise(open_("a"))
    near = (F.col("a.at") == F.col("b.at")) & order & enough & wanted & _close("a", "b", num, den, n)
    return a.join(b.hint("shuffle_hash"), near).select(F.col("a.key").alias("x"), F.col("b.key").alias("y")).distinct()


def matched_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", params: LineParams = LineParams()) -> DataFrame:
    """(doc, line_no, n, similar) of the first line of each class of equal word sets; similar: an earlier line of
    another class matches it.  All other lines with words repeat an earlier one.

    Ties: rows that repeat a document id stand at the same place, one of them counts as the first."""
    num, den = ratio(params.threshold)
    classes = _classes(docs, text, doc_id, params)
    prefix = _prefix(F.col("n"), params)
    me = ["key", "n", "b0", "b1"]

    # an earliest line for each of the rarest words that stand in many places
    leads = classes.select("doc", "line_no", *me, F.explode(F.slice("words", F.col("few") + 1, F.least(prefix - F.col("few"), F.lit(params.lead_words)))).alias("word"))
    first = leads.groupBy("word").agg(F.min(F.struct("doc", "line_no", *me)).alias("x"))
    led = leads.select("word", F.struct(*me).alias("y")).join(first, "word")
    near = led.where("x.key != y.key").where(_close("x", "y", num, den)).select(F.col("x.key").alias("x"), F.col("y.key").alias("y")).distinct()
    settled = materialize(_verified(near, classes, num, den), "line-settled")

    # all candidates of the lines that are still open, a part of the words at a time
    open_ = materialize(classes.join(settled.select("key", F.lit(True).alias("settled")), "key", "left").select(*me, "doc", "line_no", F.col("settled").isNull().alias("open"), F.slice("words", F.lit(1), prefix).alias("words")), "line-prefixes")
    parts = [materialize(_candidates(open_, k, params), "line-pairs") for k in range(params.rounds)]
    pairs = functools.reduce(DataFrame.unionByName, parts).distinct()
    found = settled.unionByName(_verified(pairs, classes, num, den)).distinct()
    return classes.select("key", "doc", "line_no", "n").join(found.select("key", F.lit(True).alias("similar")), "key", "left").select("doc", "line_no", "n", F.coalesce("similar", F.lit(False)).alias("similar"))


def removals(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", params: LineParams = LineParams()) -> DataFrame:
    """(doc, firsts, kept, n_similar): per document id the numbers of its class-first lines that stay (sorted), and how
    many class-first lines go because an earlier line is similar.  Ids without such lines are absent."""
    lines = matched_lines(docs, text, doc_id, params)
    return lines.groupBy("doc").agg(
        F.sort_array(F.collect_list(F.when(~F.col("similar"), F.col("line_no")))).alias("kept"),
        F.count_if("similar").alias("n_similar"),
    )


def worded_lines(text: Column) -> Column:
    """Numbers (from 0) of the lines that have a word."""
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.when(F.btrim(x, F.lit(SPACE_CHARS)) != "", i))
    return F.filter(numbered, lambda i: i.isNotNull())


def line_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", params: LineParams = LineParams()) -> DataFrame:
    """One row per row of ``docs``: its id, n_lines (lines with a word), n_removed, n_similar (removed for a similar but
    different line) and removed (line numbers, comma-joined).  Null text counts as empty; empty documents and an empty
    table have nothing to remove.  A null id sorts before all others."""
    kept = removals(docs, text, doc_id, params).withColumnRenamed("doc", "kept_doc")
    mine = docs.select(F.col(doc_id).alias("doc"), worded_lines(text_of(text)).alias("worded"))
    gone = F.array_except("worded", F.coalesce("kept", F.array().cast("array<int>")))
    return (
        mine.join(kept, F.col("doc").eqNullSafe(F.col("kept_doc")), "left")
        .withColumn("gone", gone)
        .select(
            F.col("doc").alias(doc_id),
            F.size("worded").cast("long").alias("n_lines"),
            F.size("gone").cast("long").alias("n_removed"),
            F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"),
            F.array_join(F.transform("gone", lambda x: x.cast("string")), ",").alias("removed"),
        )
    )


def drop_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", params: LineParams = LineParams()) -> DataFrame:
    """``docs`` with the matched lines taken out of the text; lines without words stay, every row stays (its text may
    become empty), a null text stays null, all columns stay as they are."""
    doc, kept, cuts, n = fresh(docs, "line_doc", "line_kept", "line_cuts", "line_n")
    keep = removals(docs, text, doc_id, params).select(F.col("doc").alias(doc), F.col("kept").alias(kept))
    worded = worded_lines(F.col(text))
    gone = F.array_except(worded, F.coalesce(F.col(kept), F.array().cast("array<int>")))

    def rebuilt(lines: Column) -> Column:
        def cut(g: Column) -> Column:
            # the stretches between removed lines, so that rebuilding is linear in the lines
            m = F.size(g)
            stretches = F.transform(F.sequence(F.lit(0), m), lambda k: let(
                F.struct(F.coalesce(F.get(g, k - 1) + 1, F.lit(0)).alias("from"), F.coalesce(F.get(g, k), F.size(lines)).alias("to")),
                lambda s: F.slice(lines, s["from"] + 1, F.greatest(s["to"] - s["from"], F.lit(0))),
            ))
            return F.when(m == 0, F.col(text)).otherwise(F.array_join(F.flatten(stretches), "\n"))

        return let(gone, cut)

    joined = docs.join(keep, F.col(doc_id).eqNullSafe(F.col(doc)), "left")
    return joined.withColumn(text, let(F.split(F.col(text), "\n"), rebuilt)).select(*docs.columns)
