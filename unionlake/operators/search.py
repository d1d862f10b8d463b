"""Table union search (U1) and its parts: backend merge (D5), score ECDF
(F1), best column per candidate table (E2), ECDF-weighted table score (E3),
score aggregation (E4), top-k with matches (G1-G3), name backend (U8).

All queries run in one job: the query tables are rows, not a driver loop.

Hit frames have the columns q_table, q_column, c_table, c_column and either
``score`` (one backend) or ``scores`` ARRAY<DOUBLE> (merged backends).
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unionlake.functions import vectors as V
from unionlake.operators import lsh, signature_blocks
from unionlake.session import materialize

Q_KEYS = ["q_table", "q_column"]
PAIR = ["q_table", "q_column", "c_table", "c_column"]


def mean_aggregator(scores: Column) -> Column:
    """E4 default: arithmetic mean of the per-backend scores."""
    return F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)


def merge_backends(*hits: DataFrame) -> DataFrame:
    """Align the hits of several backends by column pair; a backend that
    did not return a pair scores 0.0.  -> PAIR + scores ARRAY<DOUBLE>."""
    n = len(hits)
    if n == 1:
        return hits[0].select(*PAIR, F.array(F.col("score")).alias("scores"))
    tagged = None
    for i, h in enumerate(hits):
        t = h.select(*PAIR, F.lit(i).alias("backend"), "score")
        tagged = t if tagged is None else tagged.unionByName(t)
    merged = tagged.groupBy(*PAIR).agg(*[
        F.coalesce(F.max(F.when(F.col("backend") == i, F.col("score"))), F.lit(0.0)).alias(f"s{i}")
        for i in range(n)])
    return merged.select(*PAIR, F.array(*[F.col(f"s{i}") for i in range(n)]).alias("scores"))


def score_ecdf(hits: DataFrame, n_backends: int) -> DataFrame:
    """F1: weight_j = (#hits of the same query column with score_j <= this
    score_j) / #hits, per backend j -- ``searchsorted(side='right')/n``.

    Scores are rounded, so the distinct scores of one query column are few
    (bounded by the score resolution, not by the lake).  The running count is
    taken over those distinct values and joined back; no task ever holds all
    hits of a hot query column.  -> hits + weights ARRAY<DOUBLE>."""
    out = hits
    for j in range(n_backends):
        s = F.col("scores")[j]
        dist = hits.select(*Q_KEYS, s.alias("s")).groupBy(*Q_KEYS, "s").agg(F.count(F.lit(1)).alias("c"))
        w = Window.partitionBy(*Q_KEYS).orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        dist = dist.select(*Q_KEYS, "s",
                           (F.sum("c").over(w) / F.sum("c").over(Window.partitionBy(*Q_KEYS))).alias(f"w{j}"))
        out = out.withColumn("s", s).join(dist, [*Q_KEYS, "s"]).drop("s")
    return out.withColumn("weights", F.array(*[F.col(f"w{j}") for j in range(n_backends)])) \
              .drop(*[f"w{j}" for j in range(n_backends)])


def best_column_per_table(weighted: DataFrame) -> DataFrame:
    """Per (query column, candidate table) the candidate column with the
    largest score sum; ties -> smallest candidate column name (K5).  A hash
    aggregate over a struct minimum -- no sort."""
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    best = F.min(F.struct((-F.round(total, V.SCORE_DIGITS)).alias("neg"), F.col("c_column"),
                          F.col("scores"), F.col("weights"))).alias("b")
    return (weighted.groupBy("q_table", "q_column", "c_table").agg(best)
            .select("q_table", "q_column", "c_table", F.col("b.c_column").alias("c_column"),
                    F.col("b.scores").alias("scores"), F.col("b.weights").alias("weights")))


def ecdf_weighted_score(best: DataFrame, n_backends: int) -> DataFrame:
    """Per (query table, candidate table) and backend: sum(s*w)/sum(w)
    over the matched query columns only."""
    aggs = []
    for j in range(n_backends):
        s, w = F.col("scores")[j], F.col("weights")[j]
        aggs += [F.sum(s * w).alias(f"sw{j}"), F.sum(w).alias(f"w{j}")]
    g = best.groupBy("q_table", "c_table").agg(*aggs, F.count(F.lit(1)).alias("n_matched"))
    return g.select("q_table", "c_table", "n_matched",
                    F.array(*[F.round(F.col(f"sw{j}") / F.col(f"w{j}"), V.SCORE_DIGITS)
                              for j in range(n_backends)]).alias("table_scores"))


def rank_tables(scored: DataFrame, k: int | None, aggregator: Callable[[Column], Column] | None = mean_aggregator
                ) -> DataFrame:
    """E4 + G2: one score per candidate table (or the score vector when
    ``aggregator`` is None, compared lexicographically), ranked per query
    table; ties by candidate table name.  ``k`` None keeps all."""
    if aggregator is None:
        scored = scored.withColumn("score", F.col("table_scores"))
    else:
        scored = scored.withColumn("score", F.round(aggregator(F.col("table_scores")), V.SCORE_DIGITS))
    w = Window.partitionBy("q_table").orderBy(F.col("score").desc(), F.col("c_table"))
    ranked = scored.withColumn("rank", F.row_number().over(w))
    if k is not None:
        ranked = ranked.where(F.col("rank") <= k)
    return ranked


def table_scores_from_hits(merged: DataFrame, n_backends: int) -> tuple[DataFrame, DataFrame]:
    """F1 -> E2 -> E3 (the ECDF must see every hit before E2 reduces them)."""
    weighted = score_ecdf(merged, n_backends)
    best = best_column_per_table(weighted)
    return ecdf_weighted_score(best, n_backends), best


def rep_hits(query_vecs: DataFrame, lake: DataFrame | lsh.Index, threshold: float = 0.7, method: str = "lsh",
             **lsh_kw) -> lsh.RepHits:
    """U5 on distinct vectors; ``lake`` may be a stored index, which has a threshold of its own."""
    if isinstance(lake, lsh.Index):
        return lsh.lookup(query_vecs, lake, **lsh_kw)
    if method == "lsh":
        return lsh.lsh_rep_hits(query_vecs, lake, threshold, **lsh_kw)
    if method == "exact":
        return lsh.exact_rep_hits(query_vecs, lake, threshold)
    raise ValueError(f"unknown method {method!r}")


def column_hits(query_vecs: DataFrame, lake: DataFrame | lsh.Index, threshold: float = 0.7, method: str = "lsh",
                **lsh_kw) -> DataFrame:
    """Scored lake columns of every query column (one backend)."""
    return rep_hits(query_vecs, lake, threshold, method, **lsh_kw).columns()


# --- search on distinct vectors -------------------------------------------------
def rep_weights(hits: lsh.RepHits) -> DataFrame:
    """F1/D10 on distinct vectors: (q_id, c_id, score, weight).  A distinct
    vector stands for all columns that hold it, so the running counts carry
    the number of those columns.  The pairs are dealt once, by query vector,
    and sorted by score; equal scores count together."""
    held = hits.c_members.groupBy(F.col("id").alias("c_id")).agg(F.count(F.lit(1)).alias("columns"))
    w = Window.partitionBy("q_id")
    weight = F.sum("columns").over(w.orderBy("score")) / F.sum("columns").over(w)
    return hits.pairs.join(held, "c_id").select("q_id", "c_id", "score", weight.alias("weight"))


def table_classes(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables with the same vectors, each as often, are one class:
    (class, id, columns) and (class, table_name)."""
    held = members.groupBy("table_name", "id").agg(F.count(F.lit(1)).alias("columns"))
    sets = held.groupBy("table_name").agg(F.sort_array(F.collect_list(F.struct("id", "columns"))).alias("set"))
    sets = materialize(sets.withColumn("class", F.struct(F.xxhash64("set").alias("h1"), F.xxhash64(F.lit(7), F.col("set")).alias("h2"))), "table-classes")
    parts = sets.groupBy("class").agg(F.first("set").alias("set")).select("class", F.inline("set"))
    return parts, sets.select("class", "table_name")


def class_scores(weighted: DataFrame, q_parts: DataFrame, c_parts: DataFrame) -> DataFrame:
    """E2 + E3 on classes: (q_class, c_class, n_matched, table_scores).  Per
    query vector and candidate class the best vector counts, once for each of
    the query's columns that hold it."""
    q = q_parts.select(F.col("class").alias("q_class"), F.col("id").alias("q_id"), "columns")
    c = c_parts.select(F.col("class").alias("c_class"), F.col("id").alias("c_id"))
    best = (weighted.join(c, "c_id").groupBy("q_id", "c_class").agg(F.max(F.struct("score", "weight")).alias("b"))
            .select("q_id", "c_class", F.col("b.score").alias("s"), F.col("b.weight").alias("w")))
    times = best.join(q, "q_id").select("q_class", "c_class", (F.col("s") * F.col("w") * F.col("columns")).alias("sw"), (F.col("w") * F.col("columns")).alias("sum_w"), F.col("columns").alias("n_matched"))
    return table_scores(times)


def table_scores(parts: DataFrame) -> DataFrame:
    """(q_class, c_class, n_matched, table_scores) of parts of the sums."""
    sums = parts.groupBy("q_class", "c_class").agg(*[F.sum(c).alias(c) for c in ("sw", "sum_w", "n_matched")])
    return sums.select("q_class", "c_class", "n_matched", F.array(F.round(F.col("sw") / F.col("sum_w"), V.SCORE_DIGITS)).alias("table_scores"))


def search_reps(hits: lsh.RepHits, k: int | None, aggregator: Callable[[Column], Column] | None,
                with_matches: bool) -> DataFrame:
    """U1 on distinct vectors and classes of equal tables; tables come back
    only for the k best classes, so that hits don't grow with the square of
    equal columns or tables.  Where blocks of vectors are compared, scores and
    weights (F1, E2, E3) are summed in their tasks, and no pair is a row,
    unless the matches are asked for."""
    q_parts, q_tables = table_classes(hits.q_members)
    c_parts, c_tables = (q_parts, q_tables) if hits.q_members is hits.c_members else table_classes(hits.c_members)
    if hits.blocks and not with_matches:
        scored = table_scores(signature_blocks.class_sums(hits.blocks, q_parts, q_tables, c_parts, c_tables))
    else:
        weighted = rep_weights(hits)
        if with_matches:  # read twice
            weighted = materialize(weighted, "rep-weights")
        scored = class_scores(weighted, q_parts, c_parts)
    score = F.col("table_scores") if aggregator is None else F.round(aggregator(F.col("table_scores")), V.SCORE_DIGITS)
    names = c_tables.select(F.col("class").alias("c_class"), F.col("table_name").alias("cand_table"))
    if k is not None:  # the k first tables of a class are all that a list of k can need
        by_name = Window.partitionBy("c_class").orderBy("cand_table")
        names = names.withColumn("n", F.row_number().over(by_name)).where(F.col("n") <= k).drop("n")
        first = names.groupBy("c_class").agg(F.min("cand_table").alias("first"))
        w = Window.partitionBy("q_class").orderBy(score.desc(), "first")
        scored = scored.join(first, "c_class").withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n", "first")
    w = Window.partitionBy("q_class").orderBy(F.col("score").desc(), "cand_table")
    ranked = scored.withColumn("score", score).join(names, "c_class").withColumn("rank", F.row_number().over(w))
    if k is not None:
        ranked = ranked.where(F.col("rank") <= k)
    out = ranked.join(q_tables.select(F.col("class").alias("q_class"), F.col("table_name").alias("query_table")), "q_class")
    out = out.select("query_table", "rank", "cand_table", "score", "n_matched")
    if not with_matches:
        return out
    q = hits.q_members.select(F.col("table_name").alias("query_table"), F.col("column_name").alias("query_column"), F.col("id").alias("q_id"))
    c = hits.c_members.select(F.col("table_name").alias("cand_table"), F.col("column_name").alias("cand_column"), F.col("id").alias("c_id"))
    found = out.select("query_table", "cand_table").join(q, "query_table").join(c, "cand_table").join(weighted, ["q_id", "c_id"])
    best = found.groupBy("query_table", "cand_table", "query_column").agg(F.min(F.struct((-F.col("score")).alias("o"), "cand_column")).alias("b"))
    one = F.struct("query_column", F.col("b.cand_column").alias("cand_column"), F.array(-F.col("b.o")).alias("scores"))
    matches = best.groupBy("query_table", "cand_table").agg(F.array_sort(F.collect_list(one)).alias("matches"))
    return out.join(matches, ["query_table", "cand_table"], "left")


def search(query_vecs: DataFrame | None, lake_vecs: DataFrame | lsh.Index | None = None, k: int | None = 10,
           threshold: float = 0.7, method: str = "lsh", backends: Sequence[DataFrame] = (),
           aggregator: Callable[[Column], Column] | None = mean_aggregator, with_matches: bool = False,
           exclude_self: bool = False, **lsh_kw) -> DataFrame:
    """Top-k lake tables for every query table.

    ``query_vecs`` / ``lake_vecs``: (table_name, column_name, vec); the lake
    may be a stored index.  Extra ``backends`` are ready hit frames (e.g.
    ``name_hits``) merged with the vector backend.  Backends and
    ``exclude_self`` need pairs of columns; without them the search stays on
    distinct vectors to the end.  Output: query_table, rank, cand_table,
    score, n_matched [, matches ARRAY<STRUCT<query_column, cand_column, scores>>].
    """
    lake_vecs = query_vecs if lake_vecs is None else lake_vecs
    found = rep_hits(query_vecs, lake_vecs, threshold, method, **lsh_kw)
    if not backends and not exclude_self:
        return search_reps(found, k, aggregator, with_matches)
    hits = [found.columns()] + list(backends)
    if exclude_self:
        hits = [h.where(F.col("q_table") != F.col("c_table")) for h in hits]
    n = len(hits)
    # the merged hits are read twice (score distribution and join back):
    # materialise them once in the checkpoint folder
    merged = materialize(merge_backends(*hits), "hits")
    scored, best = table_scores_from_hits(merged, n)
    ranked = rank_tables(scored, k, aggregator)
    out = ranked.select(F.col("q_table").alias("query_table"), "rank", F.col("c_table").alias("cand_table"),
                        "score", "n_matched")
    if with_matches:
        out = topk_with_matches(out, best)
    return out


def topk_with_matches(ranked: DataFrame, best: DataFrame) -> DataFrame:
    """Attach the matched (query column, candidate column, scores) list."""
    m = (best.join(ranked.select(F.col("query_table").alias("q_table"), F.col("cand_table").alias("c_table")),
                   ["q_table", "c_table"], "left_semi")
         .groupBy("q_table", "c_table")
         .agg(F.array_sort(F.collect_list(F.struct(F.col("q_column").alias("query_column"),
                                                   F.col("c_column").alias("cand_column"),
                                                   F.col("scores").alias("scores")))).alias("matches")))
    return ranked.join(m.withColumnsRenamed({"q_table": "query_table", "c_table": "cand_table"}),
                       ["query_table", "cand_table"], "left")


def nearest_columns(hits: lsh.RepHits, k: int | None) -> DataFrame:
    """The k nearest lake columns of every query column (PAIR, score): ranked
    on distinct vectors, with the first k columns of each."""
    c = hits.c_members.select(F.col("id").alias("c_id"), F.col("table_name").alias("c_table"), F.col("column_name").alias("c_column"))
    pairs = hits.pairs
    if k is not None:
        by_name = Window.partitionBy("c_id").orderBy("c_table", "c_column")
        c = c.withColumn("n", F.row_number().over(by_name)).where(F.col("n") <= k).drop("n")
        first = c.groupBy("c_id").agg(F.min(F.struct("c_table", "c_column")).alias("first"))
        w = Window.partitionBy("q_id").orderBy(F.col("score").desc(), "first")
        pairs = pairs.join(first, "c_id").withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n", "first")
    out = pairs.join(c, "c_id")
    if k is not None:
        w = Window.partitionBy("q_id").orderBy(F.col("score").desc(), "c_table", "c_column")
        out = out.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")
    q = hits.q_members.select(F.col("id").alias("q_id"), F.col("table_name").alias("q_table"), F.col("column_name").alias("q_column"))
    return out.join(q, "q_id").select(*PAIR, "score")


def column_search(query_vecs: DataFrame, lake_vecs: DataFrame | lsh.Index, k: int | None = 10, threshold: float = 0.7,
                  method: str = "lsh", backends: Sequence[DataFrame] = (),
                  aggregator: Callable[[Column], Column] | None = None, **lsh_kw) -> DataFrame:
    """Nearest lake columns per query column: top k per backend, merge
    (missing = 0), order by the mean (or ``aggregator``), cut to k."""
    hits = [nearest_columns(rep_hits(query_vecs, lake_vecs, threshold, method, **lsh_kw), k)]
    if k is None:
        hits += list(backends)
    else:
        w = Window.partitionBy(*Q_KEYS).orderBy(F.col("score").desc(), F.col("c_table"), F.col("c_column"))
        hits += [h.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r") for h in backends]
    merged = merge_backends(*hits)
    agg = aggregator or mean_aggregator
    merged = merged.withColumn("score", F.round(agg(F.col("scores")), V.SCORE_DIGITS))
    w2 = Window.partitionBy(*Q_KEYS).orderBy(F.col("score").desc(), F.col("c_table"), F.col("c_column"))
    out = merged.withColumn("rank", F.row_number().over(w2))
    if k is not None:
        out = out.where(F.col("rank") <= k)
    return out.select(*PAIR, "rank", "score", "scores")


# --- U8: name backend ---------------------------------------------------------
def _gram_array(name: Column, q: int) -> Column:
    padded = F.concat(F.lit("#"), F.lower(name), F.lit("#"))
    grams = F.when(F.length(padded) < q, F.array(padded)).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(padded) - q + 1), lambda i: F.substring(padded, i, q)))
    return F.array_distinct(grams)


def name_grams(names: DataFrame, q: int = 3) -> DataFrame:
    """(table_name, column_name, gram): distinct q-grams of the lower-cased
    name padded with '#'; names shorter than q give the padded name itself."""
    return names.select("table_name", "column_name", F.explode(_gram_array(F.col("column_name"), q)).alias("gram"))


def name_hits(query_names: DataFrame, lake_names: DataFrame, threshold: float = 0.7, q: int = 3) -> DataFrame:
    """U8: Jaccard of name q-gram sets >= threshold, exact.

    Work is done on *distinct* lower-cased names (a name like 'id' shared by
    millions of columns is one row), and candidates come from prefix
    filtering: each name is indexed only under its ``|g| - ceil(t|g|) + 1``
    rarest grams (global frequency order), which any pair with Jaccard >= t
    must share -- so common grams never form a hot join key.  Pairs are
    verified exactly and expanded back to columns at the end."""
    qn = query_names.select("table_name", "column_name", F.lower("column_name").alias("name")).distinct()
    cn = lake_names.select("table_name", "column_name", F.lower("column_name").alias("name")).distinct()
    qd = qn.select("name").distinct().withColumn("g", _gram_array(F.col("name"), q))
    cd = cn.select("name").distinct().withColumn("g", _gram_array(F.col("name"), q))
    freq = (qd.select(F.explode("g").alias("gram")).unionAll(cd.select(F.explode("g").alias("gram")))
            .groupBy("gram").agg(F.count(F.lit(1)).alias("f")))

    def prefix(d):
        ex = d.select("name", "g", F.explode("g").alias("gram")).join(freq, "gram")
        ranked = ex.groupBy("name").agg(F.first("g").alias("g"),
                                        F.array_sort(F.collect_list(F.struct("f", "gram"))).alias("o"))
        n = F.size("g")
        plen = n - F.ceil(F.lit(threshold - 1e-9) * n) + 1
        return ranked.select("name", "g", F.explode(F.slice(F.transform("o", lambda x: x["gram"]), 1, plen))
                             .alias("gram"))

    cand = (prefix(qd).select(F.col("name").alias("q_name"), F.col("g").alias("qg"), "gram")
            .join(prefix(cd).select(F.col("name").alias("c_name"), F.col("g").alias("cg"), "gram"), "gram")
            .select("q_name", "c_name", "qg", "cg").dropDuplicates(["q_name", "c_name"]))
    inter = F.size(F.array_intersect("qg", "cg"))
    score = F.round(inter / (F.size("qg") + F.size("cg") - inter), V.SCORE_DIGITS)
    pairs = cand.select("q_name", "c_name", score.alias("score")).where(F.col("score") >= F.lit(threshold))
    out = (pairs.join(qn.select(F.col("table_name").alias("q_table"), F.col("column_name").alias("q_column"),
                                F.col("name").alias("q_name")), "q_name")
           .join(cn.select(F.col("table_name").alias("c_table"), F.col("column_name").alias("c_column"),
                           F.col("name").alias("c_name")), "c_name"))
    return out.select(*PAIR, "score")


# ---------------------------------------------------------------------------
# DuckDB rendering of the scoring half (hits view with q/c columns + score).
def sql_search_from_hits(hits_view: str, k: int | None) -> str:
    lim = f"WHERE rank <= {k}" if k is not None else ""
    d = V.SCORE_DIGITS
    return f"""
    WITH w AS (
      SELECT *, cume_dist() OVER (PARTITION BY q_table, q_column ORDER BY score) AS weight FROM {hits_view}),
    best AS (
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY q_table, q_column, c_table
                                     ORDER BY round(score, {d}) DESC, c_column) AS rn FROM w)
      WHERE rn = 1),
    tab AS (
      SELECT q_table, c_table, count(*) AS n_matched, round(sum(score * weight) / sum(weight), {d}) AS ts
      FROM best GROUP BY ALL),
    ranked AS (
      SELECT q_table AS query_table, c_table AS cand_table, round(ts, {d}) AS score, n_matched,
             CAST(row_number() OVER (PARTITION BY q_table ORDER BY round(ts, {d}) DESC, c_table) AS INTEGER) AS rank
      FROM tab)
    SELECT query_table, rank, cand_table, score, n_matched FROM ranked {lim}"""
