"""Evaluation against a truth set.

``results``: query_table, rank, cand_table, score (ranked, any k).
``truth``:   query_table, data_lake_table (duplicates allowed, K11).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flag_hits(results: DataFrame, truth: DataFrame) -> DataFrame:
    """in_truth = the candidate table is in the query's truth list."""
    t = (truth.select("query_table", F.col("data_lake_table").alias("cand_table")).distinct()
         .withColumn("in_truth", F.lit(True)))
    return results.join(t, ["query_table", "cand_table"], "left").withColumn(
        "in_truth", F.coalesce("in_truth", F.lit(False)))


def per_query_metrics(results: DataFrame, truth: DataFrame, ks: Sequence[int], queries: DataFrame) -> DataFrame:
    """E5 for every k of ``ks`` (E8: one ranking, sliced per k -- no re-run).

    ``queries`` (query_table) lists the non-empty query tables; one with no
    hit scores 0.  Queries without truth rows are left out (see
    ``queries_without_truth``).  -> query_table, k, hits, precision, recall."""
    ks_arr = F.array(*[F.lit(int(k)) for k in ks])
    flagged = flag_hits(results, truth)
    per_k = (flagged.where("in_truth")
             .select("query_table", F.explode(F.filter(ks_arr, lambda k: F.col("rank") <= k)).alias("k"))
             .groupBy("query_table", "k").agg(F.count(F.lit(1)).alias("hits")))
    n_truth = truth.groupBy("query_table").agg(F.count(F.lit(1)).alias("n_truth"))
    grid = queries.select("query_table").distinct().select("query_table", F.explode(ks_arr).alias("k"))
    return (grid.join(n_truth, "query_table")
            .join(per_k, ["query_table", "k"], "left")
            .select("query_table", "k", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"),
                    (F.coalesce("hits", F.lit(0)) / F.col("k")).alias("precision"),
                    (F.coalesce("hits", F.lit(0)) / F.col("n_truth")).alias("recall")))


def queries_without_truth(queries: DataFrame, truth: DataFrame) -> DataFrame:
    """Query tables that have no truth row (reported, not scored)."""
    return queries.select("query_table").distinct().join(truth.select("query_table"), "query_table", "left_anti")


def macro_metrics(per_query: DataFrame, digits: int = 6) -> DataFrame:
    """Mean precision / recall over the scored queries, per k."""
    return per_query.groupBy("k").agg(
        F.count(F.lit(1)).alias("num_queries"),
        F.round(F.avg("precision"), digits).alias("precision"),
        F.round(F.avg("recall"), digits).alias("recall"))


def evaluate(results: DataFrame, truth: DataFrame, ks: Sequence[int], queries: DataFrame | None = None) -> DataFrame:
    """Per-k macro metrics of a ranked result (ranks up to max(ks) are
    enough: search with ``k=max(ks)`` so the ranking is a group limit)."""
    if queries is None:
        queries = results.select("query_table").distinct()
    return macro_metrics(per_query_metrics(results, truth, ks, queries))
