"""Sinks (A12-A16): walk corpora, search results, metrics.  ``mode`` is
Spark's save mode: 'overwrite' recreates the folder, 'errorifexists' fails if
it is there (A16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def walk_sink(walks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One walk per line (append mode adds another corpus part)."""
    walks.select("walk").write.mode(mode).text(path)


def search_result_sink(results: DataFrame, truth: DataFrame, path: str, mode: str = "overwrite",
                       fmt: str = "parquet") -> None:
    """Ranked results with the in-truth flag and, if the search gives
    them, the matched column pairs with their scores.  Rows of a query stand
    together in files of bounded number; a reader prunes by query_table."""
    t = (truth.select("query_table", F.col("data_lake_table").alias("cand_table")).distinct()
         .withColumn("in_ground_truth", F.lit(True)))
    out = results.join(t, ["query_table", "cand_table"], "left").withColumn(
        "in_ground_truth", F.coalesce("in_ground_truth", F.lit(False)))
    out.repartitionByRange("query_table", "rank").sortWithinPartitions("query_table", "rank").write.mode(mode).format(fmt).save(path)


def metrics_sink(metrics: DataFrame, args: dict, path: str, mode: str = "overwrite", lookup_seconds: float | None = None) -> None:
    """Run arguments + metrics rows as JSON, with the lookup time per
    query if the caller has measured ``lookup_seconds`` for all of them."""
    out = metrics
    for k, v in sorted(args.items()):
        out = out.withColumn(f"arg_{k}", F.lit(str(v)))
    if lookup_seconds is not None:
        out = out.withColumn("seconds_per_query", F.lit(float(lookup_seconds)) / F.greatest("num_queries", F.lit(1)))
    out.coalesce(1).write.mode(mode).json(path)
