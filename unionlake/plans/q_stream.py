"""Streaming query: the fragment lake's tables stream in as query tables and
are searched against the lake index (same answer as the batch flagship)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from unionlake.operators import lsh, search as S
from unionlake.plans import lake as L
from unionlake.plans.registry import register
from unionlake.session import scratch_path
from unionlake.streaming import query_stream as QS


@register("query_stream", f"""WITH {L.sql_lake_ctes()},
hits AS ({lsh.sql_lsh_hits('vecs', 'vecs', L.THRESHOLD)})
SELECT * FROM ({S.sql_search_from_hits('hits', L.K)})""")
def query_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    QS.write_query_tables(L.raw_cells(spark, sf_dir), f"{run}/in")
    q = QS.search_stream(spark, f"{run}/in/tables", L.lake_vectors(spark, sf_dir), f"{run}/out", f"{run}/ckpt",
                         k=L.K, threshold=L.THRESHOLD, method="lsh", dim=L.DIM)
    q.awaitTermination()
    return QS.read_results(spark, f"{run}/out")
