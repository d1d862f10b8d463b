"""Token corpora for word vectors: web-table row walks and weighted graph
walks (B11, B12, D6, D7, E9, F2, F4, H1, H2, I3, I5-I8, E14).

Graph walks draw from running weights.  The neighbours of a node, in id order,
are cut by rank into ranges of at most ``fan``; the ranges of a hub are cut
again, level by level, until one range is its root (``neighbour_index``,
written once).  A step joins each live walk with the root of its node, finds
the drawn weight among the running weights of that row, and follows at most
one row per further level: the rows of a step are the live walks, whatever
the degrees.  A draw of a node that the walk has been to is drawn anew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unionlake.functions import text as tx
from unionlake.operators import sampling
from unionlake.session import materialize

WALK_TYPES = ("base", "row", "tax", "tax-from-ids", "combo")


# --- graph -----------------------------------------------------------------------
def edge_weight_filter(edges: DataFrame, weight_limit: float) -> DataFrame:
    """Drop edges with w < weight_limit."""
    return edges.where(F.col("w") >= F.lit(weight_limit))


def symmetrize(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Both directions; on a duplicate (u, v) the weight written last
    wins (line order, then direction).  ``edges``: u, v, w[, line_no].

    Edges meet as pairs of nodes, whichever way they run, and both directions
    are read off a pair.  ``parts``: tasks to deal them to, so that what a task
    holds does not grow with the graph; else Spark's settings decide."""
    line = F.col("line_no") if "line_no" in edges.columns else F.lit(0).cast("long")
    down = F.when(F.col("u").isNull(), False).when(F.col("v").isNull(), True).otherwise(F.col("u") > F.col("v"))
    either = lambda x, y: F.when(down, F.col(x)).otherwise(F.col(y))
    pairs = edges.select(either("v", "u").alias("a"), either("u", "v").alias("b"), "w",
                         (line * 2 + down.cast("long")).alias("up"), (line * 2 + 1 - down.cast("long")).alias("back"))
    if parts:
        pairs = pairs.repartition(parts, "a", "b")
    met = pairs.groupBy("a", "b").agg(F.max_by("w", "up").alias("wu"), F.max_by("w", "back").alias("wb"))
    up, back = (F.struct(F.col(x).alias("u"), F.col(y).alias("v"), F.col(w).alias("w")) for x, y, w in (("a", "b", "wu"), ("b", "a", "wb")))
    return met.select(F.inline(F.when(F.col("a").eqNullSafe(F.col("b")), F.array(up)).otherwise(F.array(up, back))))


def ranked_neighbours(adj: DataFrame, parts: int | None = None) -> DataFrame:
    """(u, v, w, rank): neighbours numbered from 0 in id order.

    No node is one task: edges are range-partitioned by (u, v), numbered
    inside their partition, and a hub's partitions are put behind each other
    by their counts, in ``parts`` tasks again.  Written, as the numbers hold
    for one evaluation."""
    dealt = adj.select("u", "v", "w").repartitionByRange(*([parts] if parts else []), "u", "v").sortWithinPartitions("u", "v")
    placed = materialize(dealt.select("u", "v", "w", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "adjacency")
    starts = placed.groupBy("u", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("u").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(starts.select("u", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")), "adjacency-starts")
    if parts and parts > 1:
        placed, starts = placed.repartition(parts, "u", "part"), starts.repartition(parts, "u", "part")
    return placed.join(starts, ["u", "part"]).select("u", "v", "w", (F.col("place") + F.col("shift")).alias("rank"))


def _running(rows: DataFrame, fan: int, parts: int | None = None) -> DataFrame:
    """(u, idx, child, w, running): children in rank order, with running weights inside ranges of ``fan`` ranks."""
    cut = rows.select("u", F.floor(F.col("rank") / F.lit(fan)).cast("long").alias("idx"), "rank", "child", "w")
    if parts:
        cut = cut.repartition(parts, "u", "idx")
    inner = Window.partitionBy("u", "idx").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cut.withColumn("running", F.sum("w").over(inner))


def cumulative_weights(adj: DataFrame, chunk: int = 1024, parts: int | None = None) -> DataFrame:
    """running weight per node in neighbour order and the node total.

    A two-level prefix sum: running sums inside ranges of ``chunk`` neighbours
    (by rank, so a hub has degree / chunk ranges however its ids lie), and a
    prefix over the ranges' totals."""
    local = _running(ranked_neighbours(adj, parts).withColumn("child", F.col("v")), chunk, parts)
    totals = local.groupBy("u", "idx").agg(F.max("running").alias("range_w"))
    before = Window.partitionBy("u").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("u", "idx", F.coalesce(F.sum("range_w").over(before), F.lit(0.0)).alias("offset"),
                           F.sum("range_w").over(Window.partitionBy("u")).alias("total"))
    return local.join(totals, ["u", "idx"]).select("u", F.col("child").alias("v"), "w", (F.col("offset") + F.col("running")).alias("running"), "total")


INDEX = ["u", "level", "idx", "entries"]


def neighbour_index(adj: DataFrame, fan: int = 256, parts: int | None = None) -> tuple[DataFrame, int]:
    """(index, levels) of an adjacency (u, v, w >= 0).

    index(u, level, idx, entries ARRAY<STRUCT<running, child>>, root): at
    level 0 the children are neighbours, above it the ranges (idx) of the
    level below.  Each node has one root; ``levels`` is 1 unless a node has
    more than ``fan`` neighbours."""
    rows, out, level = ranked_neighbours(adj, parts).withColumnRenamed("v", "child"), None, 0
    while True:
        entries = F.array_sort(F.collect_list(F.struct("rank", "running", "child")))
        ranges = _running(rows, fan, parts).groupBy("u", "idx").agg(F.transform(entries, lambda e: F.struct(e["running"], e["child"])).alias("entries"), F.sum("w").alias("w"))
        ranges = materialize(ranges.withColumn("level", F.lit(level)), "neighbour-ranges")
        more = ranges.where("idx > 0").select("u").distinct()
        part = ranges.join(more.withColumn("more", F.lit(True)), "u", "left").select(*INDEX, F.col("more").isNull().alias("root"))
        out = part if out is None else out.unionByName(part)
        level += 1
        rows = ranges.join(more, "u", "left_semi").select("u", F.col("idx").alias("rank"), F.col("idx").alias("child"), "w")
        if more.isEmpty():
            return materialize(out, "neighbour-index"), level


def choice_key(seed: int, walk_id: Column, step: Column, v: Column, w: Column) -> Column:
    """-ln(u)/w with u = (md5(seed:walk:step:v) + 0.5) / 2^32.  A weight of 0 (or
    less) is never drawn while another is positive."""
    u = sampling.uniform(seed, walk_id.cast("string"), step.cast("string"), v.cast("string"))
    return F.when(w > 0, -F.ln(u) / w).otherwise(F.lit(float("inf")))


#: Draws of a walk, for each node of its length, after which it ends (fixed value).
TRIALS_FACTOR = 20


def _drawn(entries: Column, u: Column) -> Column:
    """The child whose running weight is the first above the share ``u`` of the total (all weights 0: the last child)."""
    total = F.element_at(entries, -1)["running"]
    above = F.filter(entries, lambda e: e["running"] > u * total)
    return F.coalesce(F.get(above, F.lit(0)), F.element_at(entries, -1))["child"]


def draw_uniform(seed: int, walk_id: Column, draw: Column, level: int) -> Column:
    """The number in (0, 1) of a walk's draw; levels above the neighbours have numbers of their own."""
    key = [walk_id.cast("string"), draw.cast("string")]
    return sampling.uniform(seed, *key, *([F.lit(f"level{level}")] if level else []))


WALK = ["walk_id", "path", "draws", "live"]


def _been(v: Column) -> Column:
    """Whether a walk (its ``path``) has been to a node; its start doesn't count."""
    return F.array_contains(F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))), v)


def walk_step(frontier: DataFrame, index: DataFrame, levels: int, walk_length: int, seed: int) -> DataFrame:
    """D7 + I3: one step for every live walk.  ``frontier``: walk_id, path
    ARRAY<BIGINT>, draws INT, live BOOLEAN.  A walk ends where there is no
    neighbour, or with its last draw."""
    trials = TRIALS_FACTOR * walk_length
    roots = index.where("root").select("u", "level", "entries")
    at = frontier.withColumn("u", F.when(F.col("live"), F.element_at("path", -1))).join(roots, "u", "left")
    # where one range holds all neighbours: every draw in the row, up to the first node that the walk has not been to
    none = F.struct(F.lit(None).cast("long").alias("v"), F.lit(None).cast("int").alias("n"))

    def trial(found, i):
        v = _drawn(F.col("entries"), draw_uniform(seed, F.col("walk_id"), i, 0))
        one = F.transform(F.array(v), lambda x: F.when(~_been(x), F.struct(x.alias("v"), (i + 1).alias("n"))).otherwise(none))[0]
        return F.when(found["n"].isNotNull(), found).otherwise(one)

    near = F.coalesce(F.col("live") & (F.col("level") == 0) & (F.col("draws") < trials), F.lit(False))
    hit = F.when(near, F.aggregate(F.sequence(F.col("draws"), F.lit(trials - 1)), none, trial))
    at = at.withColumn("hit", hit).select("walk_id", "path", "draws", "live", "level", F.col("hit.v").alias("v"), F.col("hit.n").alias("n"))
    at = at.withColumn("hub", F.coalesce(F.col("live") & (F.col("level") > 0), F.lit(False)))
    path = F.when(F.col("v").isNotNull(), F.concat("path", F.array("v"))).otherwise(F.col("path"))
    out = at.select("walk_id", path.alias("path"), F.coalesce("n", "draws").alias("draws"), (F.col("v").isNotNull() | F.col("hub")).alias("live"), "hub")
    if levels == 1:
        return out.select(*WALK)
    out = materialize(out, "walk-step")
    return reduce(DataFrame.unionByName, [out.where("not hub").select(*WALK), *_hub_steps(out.where("hub").select(*WALK), index, levels, trials, seed)])


def _hub_steps(waiting: DataFrame, index: DataFrame, levels: int, trials: int, seed: int) -> list[DataFrame]:
    """The step of walks at hubs: one draw follows a row for each level; draws of nodes that a walk has been to are
    repeated.  Every round is written."""
    roots, inner = index.where("root").select("u", "level", "entries"), index.where("not root").select("u", "level", "idx", "entries")
    done = []
    while True:
        at = waiting.withColumn("u", F.element_at("path", -1)).join(roots, "u")
        for level in range(levels - 1, 0, -1):  # the rows of this level go one down, the others wait
            idx = F.when(F.col("level") == level, _drawn(F.col("entries"), draw_uniform(seed, F.col("walk_id"), F.col("draws"), level)))
            at = at.withColumn("idx", idx).withColumn("level", F.least("level", F.lit(level - 1)))
            below = inner.where(F.col("level") == level - 1).select("u", "idx", F.col("entries").alias("below"))
            at = at.join(below, ["u", "idx"], "left").withColumn("entries", F.coalesce("below", "entries")).drop("below", "idx")
        v = _drawn(F.col("entries"), draw_uniform(seed, F.col("walk_id"), F.col("draws"), 0))
        drawn = materialize(at.withColumn("v", v).select(*WALK, "v", _been(F.col("v")).alias("again")), "hub-draws")
        next_draw = (F.col("draws") + 1).alias("draws")
        done.append(drawn.where("not again").select("walk_id", F.concat("path", F.array("v")).alias("path"), next_draw, "live"))
        again = drawn.where("again").select("walk_id", "path", next_draw, "live")
        done.append(again.where(F.col("draws") >= trials).withColumn("live", F.lit(False)))
        waiting = again.where(F.col("draws") < trials)
        if waiting.isEmpty():
            return done


def graph_walks(adj: DataFrame, number_walks: int, walk_length: int, seed: int = 12345,
                checkpoint_every: int = 4, fan: int = 256, parts: int | None = None) -> DataFrame:
    """``number_walks`` walks from every node, at most ``walk_length``
    nodes, never stepping onto a node already walked to (the start node is not
    in the refused set).  -> walk_id STRING, start, path ARRAY<BIGINT>."""
    index, levels = neighbour_index(adj, fan, parts)
    walks = index.where("root").select(F.col("u").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(number_walks - 1))).alias("i"))
    frontier = walks.select(F.concat_ws(":", F.col("i").cast("string"), F.col("start").cast("string")).alias("walk_id"),
                            F.array("start").alias("path"), F.lit(0).alias("draws"), F.lit(True).alias("live"))
    for step in range(1, walk_length):
        frontier = walk_step(frontier, index, levels, walk_length, seed)
        if step % checkpoint_every == 0 or levels > 1:
            frontier = materialize(frontier, "walk-frontier")
    return frontier.select("walk_id", F.col("path")[0].alias("start"), "path")


def walk_terms(walks: DataFrame, terms: DataFrame) -> DataFrame:
    """D6 + I7 + C5: node ids -> encoded terms along each walk; terms with an
    unknown prefix are dropped.  -> walk_id, tokens ARRAY<STRING>, walk STRING."""
    ex = walks.select("walk_id", F.posexplode("path").alias("pos", "id"))
    # a term is encoded once, not for every walk that comes by
    j = ex.join(terms.select("id", tx.encode_prefixed_term(F.col("term")).alias("tok")), "id", "left").select("walk_id", "pos", "tok")
    g = (j.groupBy("walk_id")
         .agg(F.array_sort(F.collect_list(F.struct("pos", "tok"))).alias("s")))
    toks = F.transform(F.filter("s", lambda x: x["tok"].isNotNull()), lambda x: x["tok"])
    return g.select("walk_id", toks.alias("tokens"), F.array_join(toks, " ").alias("walk"))


def unknown_terms(terms: DataFrame) -> DataFrame:
    """Terms whose prefix is neither h# nor d# (reported by the encoder)."""
    return terms.where(tx.encode_prefixed_term(F.col("term")).isNull())


# --- web tables ------------------------------------------------------------------
def webtable_rows(tables: DataFrame, min_columns: int) -> DataFrame:
    """Rows of each web table: ``relation`` is transposed unless
    headerPosition = FIRST_COLUMN (Python ``zip``: length of the shortest
    inner array); a table whose first row has fewer than ``min_columns``
    non-empty cells is dropped.  -> table_id, row_idx, cells ARRAY<STRING>."""
    rel = F.col("relation")
    min_len = F.array_min(F.transform(rel, lambda c: F.size(c)))
    transposed = F.transform(F.sequence(F.lit(0), min_len - 1),
                             lambda i: F.transform(rel, lambda c: F.element_at(c, i + 1)))
    transposed = F.when(min_len > 0, transposed).otherwise(F.array().cast("array<array<string>>"))
    rows = F.when(F.col("headerPosition") == "FIRST_COLUMN", rel).otherwise(transposed)
    t = tables.select(F.inline(F.array(F.struct("table_id", rows.alias("rows")))))  # inline: transposed once, for the test and the rows
    nonempty = lambda arr: F.size(F.filter(arr, lambda x: x.isNotNull() & (F.length(x) > 0)))
    t = t.where(F.coalesce(nonempty(F.try_element_at("rows", F.lit(1))), F.lit(0)) >= min_columns)
    return t.select("table_id", F.posexplode("rows").alias("row_idx", "cells"))


def first_rows(rows: DataFrame, max_rows: int) -> DataFrame:
    """the first ``max_rows`` rows of each table (position filter, no shuffle)."""
    return rows.where(F.col("row_idx") < F.lit(max_rows))


def row_walks(rows: DataFrame, walk_type: str, min_columns: int, max_rows: int) -> DataFrame:
    """I6: 'base' joins the raw non-empty cells of every row; 'row'/'combo'
    take the first ``max_rows`` rows, drop newlines, header-encode row 0 and
    data-encode the others, drop empty tokens and keep rows with at least
    ``min_columns`` tokens.  -> table_id, row_idx, walk STRING."""
    nonempty = F.filter("cells", lambda x: x.isNotNull() & (F.length(x) > 0))
    if walk_type == "base":
        return rows.select("table_id", "row_idx", F.array_join(nonempty, " ").alias("walk"))
    if walk_type not in ("row", "combo"):
        raise ValueError(f"unknown walk type {walk_type!r}")
    r = first_rows(rows, max_rows).select("table_id", "row_idx", nonempty.alias("cells"))
    clean = lambda x: F.regexp_replace(x, "\n", "")
    toks = F.when(F.col("row_idx") == 0, F.transform("cells", lambda x: tx.encode_header(clean(x)))) \
        .otherwise(F.transform("cells", lambda x: tx.encode_data(clean(x))))
    r = r.select("table_id", "row_idx", F.filter(toks, lambda x: F.length(x) > 0).alias("toks"))
    return r.where(F.size("toks") >= min_columns).select("table_id", "row_idx", F.array_join("toks", " ").alias("walk"))


def combo_walks(row_walks_df: DataFrame, graph_walks_df: DataFrame) -> DataFrame:
    """H2: row walks followed by encoded graph walks, one corpus (walk STRING)."""
    return row_walks_df.select(F.lit(0).alias("part"), "walk").unionByName(
        graph_walks_df.select(F.lit(1).alias("part"), "walk"))


def walk_corpus(walk_type: str, *, tables: DataFrame | None = None, adj: DataFrame | None = None,
                walks: DataFrame | None = None, terms: DataFrame | None = None, min_columns: int = 2,
                max_rows: int = 100, number_walks: int = 1, walk_length: int = 5, seed: int = 12345, parts: int | None = None) -> DataFrame:
    """I8: one corpus (walk STRING) by walk type; an unknown type is an error."""
    if walk_type not in WALK_TYPES:
        raise ValueError(f"Unknown walks_type: {walk_type}")
    if walk_type in ("base", "row"):
        return row_walks(webtable_rows(tables, min_columns), walk_type, min_columns, max_rows).select("walk")
    if walk_type == "tax-from-ids":
        return walk_terms(walks, terms).select("walk")
    gw = walk_terms(graph_walks(adj, number_walks, walk_length, seed, parts=parts), terms)
    if walk_type == "tax":
        return gw.select("walk")
    rw = row_walks(webtable_rows(tables, min_columns), "combo", min_columns, max_rows)
    return combo_walks(rw, gw).select("walk")


def fit_word_vectors(corpus: DataFrame, dim: int = 64, min_count: int = 1, lr: float = 0.025, seed: int = 12345,
                     num_partitions: int | None = None, walks_per_task: int = 20_000):
    """Word vectors on the walks (window 10, one pass); Spark's trainer
    is hierarchical softmax.  Every task trains on its part of the walks, and
    the parts' vectors are averaged word by word.  ``num_partitions`` defaults
    to a task for ``walks_per_task`` walks.  -> (word, vec ARRAY<DOUBLE>)."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array
    toks = materialize(corpus.select(F.split("walk", " ").alias("tokens")), "walk-tokens")
    parts = num_partitions or max(1, -(-toks.count() // walks_per_task))
    model = Word2Vec(vectorSize=dim, minCount=min_count, windowSize=10, maxIter=1, stepSize=lr, seed=seed, numPartitions=parts,
                     inputCol="tokens", outputCol="v").fit(toks)
    return model.getVectors().select("word", vector_to_array("vector").alias("vec"))
