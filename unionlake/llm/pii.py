"""PII: information-theoretic sanitisation [native].

Personal data is found by pattern and checksum.  Each value found is a protected entity.  Its disclosure by a term is their
pointwise mutual information over the distinct texts, as a part of the entity's own information:
log(n(e,t) N / (n(e) n(t))) / log(N / n(e)), which is 1 if the term occurs only with the entity.  n(e,t) counts the texts that
have the term within some words of the entity, whatever else stands between.  Terms near an entity that disclose it
beyond a threshold are removed, above a lower one generalised, wherever they stand in documents with the entity.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unionlake.llm.columns import SPACE_CHARS, SPACE_RUN, fresh, let, text_of, words
from unionlake.session import materialize

KINDS = ["email", "ip", "card", "phone", "remove", "generalise"]
_LOCAL = "[A-Za-z0-9._%+-]"
#: Patterns of the kinds.  Possessive where nothing that follows could need a character back, so time is linear; an
#: e-mail starts where its local part does, or right where the last one ended.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


@dataclass(frozen=True)
class DisclosureParams:
    """near: words on each side of an entity whose co-occurrence is counted.  min_support: distinct texts with an entity,
    and with an entity beside a term, from which a disclosure is estimated; fewer can't be told from chance.
    remove, generalise: disclosures from which a term is removed, or replaced by its shape."""

    near: int = 10
    min_support: int = 3
    remove: float = 0.9
    generalise: float = 0.7


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    """The check digit rule: from the right every second digit counts double, less 9 if that exceeds 9."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda c: c.try_cast("int"))
    weighed = F.transform(F.filter(numbers, lambda x: x.isNotNull()), lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, m: Column) -> Column:
    n = F.length(_digits(m))
    # leading zeros don't count; a part of more than three digits exceeds 255
    part = lambda p: let(F.ltrim(p, F.lit("0")), lambda v: F.when(v == "", True).when(F.length(v) <= 3, v.try_cast("int") <= 255).otherwise(False))
    ip = F.forall(F.split(m, r"\."), part)
    card = F.when(n.between(12, 19), _luhn(_digits(m))).otherwise(False)
    return F.when(kind == "email", True).when(kind == "ip", ip).when(kind == "card", card).otherwise(n.between(9, 15))


def _pieces(text: Column, kind: str, may: Column) -> Column:
    """Matches of a kind with the length of the text between them and the last, and the words that begin in that text or
    with the match: (kind, i, gap, match, begun)."""
    pattern = F.lit(PATTERNS[kind])
    space = lambda c: F.contains(F.lit(SPACE_CHARS), c)

    def begun(part: Column, i: Column) -> Column:
        # a match has no white space at its ends, so text beside it goes on with its word
        goes_on = (i > 0) & (part != "") & ~space(F.left(part, F.lit(1)))
        fresh_word = F.when(part == "", i == 0).otherwise(space(F.right(part, F.lit(1))))
        return F.size(words(part)) - goes_on.cast("int") + fresh_word.cast("int")

    rows = lambda found: let(F.split(text, PATTERNS[kind], -1), lambda parts: F.transform(found, lambda m, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(parts, i)).alias("gap"), m.alias("match"), begun(F.get(parts, i), i).alias("begun"))))
    empty = F.array().cast("array<struct<kind:string,i:int,gap:int,match:string,begun:int>>")
    return F.when(may, let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.when(F.size(m) > 0, rows(m)).otherwise(empty))).otherwise(empty)


def text_key(text: str) -> Column:
    """128 bits that stand for a text.  Spans depend on the text alone, so they are found once for equal texts and come back
    to rows by this key: it is the same in every plan, which a row number is not."""
    return F.struct(F.xxhash64(text_of(text)).alias("h1"), F.xxhash64(F.lit(0x5EED), text_of(text)).alias("h2"))


def mentions(docs: DataFrame, text: str) -> DataFrame:
    """(copy, kind, from, to, match, first, last): the valid matches of every distinct text in code points, with the numbers (from 0)
    of the first and last word of the text that they touch; copy is the text's key."""
    t = F.col("text")
    base = docs.select(text_key(text).alias("copy"), text_of(text).alias("text"))
    digit = t.rlike("[0-9]")
    found = F.concat(
        _pieces(t, "email", F.contains(t, F.lit("@"))),
        _pieces(t, "ip", t.rlike(r"[0-9]\.[0-9]")),
        _pieces(t, "card", digit),
        _pieces(t, "phone", F.contains(t, F.lit("+"))),
    )
    # rows with equal texts give equal pieces
    once = base.select("copy", F.inline(found)).groupBy("copy", "kind").agg(F.sort_array(F.collect_set(F.struct("i", "gap", "match", "begun"))).alias("pieces"))
    rows = once.select("copy", "kind", F.inline("pieces"))
    run = Window.partitionBy("copy", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    to = F.sum(F.col("gap") + F.length("match")).over(run)
    inner = F.size(words(F.col("match"))) - 1
    last = F.sum(F.col("begun") + inner).over(run) - 1
    placed = rows.withColumn("to", to).withColumn("last", last).withColumn("from", F.col("to") - F.length("match")).withColumn("first", F.col("last") - inner)
    return placed.where(F.coalesce(_valid(F.col("kind"), F.col("match")), F.lit(False))).select("copy", "kind", "from", "to", "match", "first", "last")


def may_mention(t: Column) -> Column:
    """True for every text with a valid match of some kind, and few others."""
    return F.contains(t, F.lit("@")) | t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]|\+[0-9]|[0-9](?:[\x20-]?[0-9]){11}")


def near_terms(docs: DataFrame, found: DataFrame, text: str, near: int) -> DataFrame:
    """(kind, match, copy, term): the words of each text within ``near`` words of a mention, on each side."""
    spots = found.groupBy("copy").agg(F.collect_set(F.struct("kind", "match", "first", "last")).alias("spots"))
    base = docs.where(may_mention(text_of(text))).select(text_key(text).alias("copy"), text_of(text).alias("text"))

    def beside(all_words: Column) -> Column:
        def around(s: Column) -> Column:
            start = F.greatest(s["first"] - near, F.lit(0)).cast("int")
            before = F.slice(all_words, start + 1, s["first"].cast("int") - start)
            return F.struct(s["kind"].alias("kind"), s["match"].alias("match"), F.array_distinct(F.concat(before, F.slice(all_words, s["last"].cast("int") + 2, near))).alias("terms"))

        return F.transform("spots", around)

    each = base.join(spots, "copy").select("copy", F.inline(let(words(F.col("text")), beside)))
    return each.select("kind", "match", "copy", F.explode("terms").alias("term")).distinct()


def disclosing_terms(docs: DataFrame, found: DataFrame, text: str, p: DisclosureParams) -> DataFrame:
    """(kind, match, term, action): terms that disclose an entity beyond a threshold.  All counts are of distinct texts, so
    a copied document proves nothing and an entity that stands often in a text counts once there."""
    entities = materialize(found.select("kind", "match", "copy").distinct().groupBy("kind", "match").agg(F.count(F.lit(1)).alias("ne")).where(F.col("ne") >= p.min_support), "pii-entities")
    beside = near_terms(docs, found.join(entities, ["kind", "match"], "left_semi"), text, p.near).where(F.col("term") != F.col("match"))
    counted = beside.groupBy("kind", "match", "term").agg(F.count(F.lit(1)).alias("net")).where(F.col("net") >= p.min_support)
    pairs = materialize(counted.join(entities, ["kind", "match"]), "pii-pairs")
    if pairs.isEmpty():
        return pairs.select("kind", "match", "term", F.lit("remove").alias("action"))
    # a text that c rows repeat has its words in c rows, so the rows with a term, grouped by c and divided by it, are the
    # texts with the term: one pass over the words and no text is told from another word by word
    texts = docs.select(text_of(text).alias("text")).withColumn("h", F.xxhash64("text"))
    copies = texts.groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    total = copies.count()
    repeated = materialize(copies.where("c > 1"), "pii-repeated")
    n = F.lit(float(max(total, 2)))
    gain = lambda nt: F.log2(F.col("net") * n / (F.col("ne") * nt)) / F.greatest(F.log2(n / F.col("ne")), F.lit(1e-9))
    words_of = F.explode(F.array_distinct(F.split("text", SPACE_RUN))).alias("term")
    rows = texts.join(repeated, "h", "left").select(F.coalesce("c", F.lit(1)).alias("c"), words_of).groupBy("term", "c").agg(F.count(F.lit(1)).alias("rows"))
    holding = rows.groupBy("term").agg(F.sum(F.expr("rows div c")).alias("nt"))
    scored = pairs.join(holding, "term").withColumn("gain", gain(F.col("nt"))).where(F.col("gain") >= p.generalise)
    return materialize(scored.select("kind", "match", "term", F.when(F.col("gain") >= p.remove, "remove").otherwise("generalise").alias("action")), "pii-terms")


def term_spans(docs: DataFrame, found: DataFrame, terms: DataFrame, text: str) -> DataFrame:
    """(copy, kind, from, to) of the words to remove or generalise: wherever a term stands in a text with its entity."""
    marked = found.join(terms, ["kind", "match"]).groupBy("copy", "term").agg(F.min(F.struct(F.when(F.col("action") == "remove", 0).otherwise(1).alias("o"), "action"))["action"].alias("action"))
    marked = materialize(marked, "pii-marked")
    base = docs.select(text_key(text).alias("copy"), text_of(text).alias("text")).join(marked.select("copy").distinct(), "copy", "left_semi").dropDuplicates(["copy"])
    # each piece is a word with the white space after it, so lengths add up to places
    pieces = base.select("copy", F.posexplode(F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")).alias("i", "piece"))
    run = Window.partitionBy("copy").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = pieces.withColumn("from", F.sum(F.length("piece")).over(run) - F.length("piece")).withColumn("term", F.btrim("piece", F.lit(SPACE_CHARS)))
    return placed.join(marked, ["copy", "term"]).select("copy", F.col("action").alias("kind"), "from", (F.col("from") + F.length("term")).alias("to"))


def text_spans(docs: DataFrame, text: str = "text", params: DisclosureParams = DisclosureParams()) -> DataFrame:
    """(copy, spans) of every distinct text with spans, written: arrays of (from, kind_no, to, kind) in code points, end
    exclusive, sorted."""
    found = materialize(mentions(docs, text), "pii-mentions")
    terms = disclosing_terms(docs, found, text, params)
    spans = found.select("copy", "kind", "from", "to")
    if not terms.isEmpty():
        spans = spans.unionByName(term_spans(docs, found, terms, text))
    order = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(KINDS)])
    span = F.struct(F.col("from").cast("long").alias("from"), order.alias("kind_no"), F.col("to").cast("long").alias("to"), "kind")
    return materialize(spans.groupBy("copy").agg(F.sort_array(F.collect_list(span)).alias("spans")), "pii-spans")


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", params: DisclosureParams = DisclosureParams()) -> DataFrame:
    """One row per row of ``docs``: its id and spans, an array of (from, kind_no, to, kind) in code points, end exclusive, sorted.

    Null text counts as empty; empty documents have no spans; rows that repeat an id each have those of their text."""
    spans = text_spans(docs, text, params)
    rows = docs.select(F.col(doc_id).alias("doc"), text_key(text).alias("copy")).join(spans, "copy", "left")
    return rows.select(F.col("doc").alias(doc_id), F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["from"].cast("string"), s["to"].cast("string"))), ",")


def sanitise(docs: DataFrame, text: str = "text", params: DisclosureParams = DisclosureParams()) -> DataFrame:
    """``docs`` with personal data and disclosing terms replaced in the text: the kind in brackets, nothing for a removed
    term, and a generalised term's shape (letters as x, digits as 0).  Overlapping spans are replaced from the first on; a null text stays null."""
    key, spans = fresh(docs, "pii_key", "pii_spans")
    found = text_spans(docs, text, params).select(F.col("copy").alias(key), F.col("spans").alias(spans))
    t = F.col(text)

    def put(s: Column) -> Column:
        value = F.substr(t, s["from"].cast("int") + 1, (s["to"] - s["from"]).cast("int"))
        shape = F.regexp_replace(F.regexp_replace(value, r"[0-9]", "0"), r"\p{L}", "x")
        return F.when(s["kind"] == "remove", F.lit("")).when(s["kind"] == "generalise", shape).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substr(t, a["at"].cast("int") + 1, F.greatest(s["from"] - a["at"], F.lit(0)).cast("int"))
        new = F.when(s["from"] >= a["at"], F.concat(a["out"], F.array(gap, put(s)))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["to"]).alias("at"), new.alias("out"))

    replaced = F.aggregate(F.col(spans), start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(t, a["at"].cast("int") + 1, F.length(t))))
    joined = docs.withColumn(key, text_key(text)).join(found, key, "left")
    return joined.withColumn(text, F.when(F.size(spans) > 0, replaced).otherwise(t)).select(*docs.columns)
