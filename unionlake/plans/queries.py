"""Search queries (U1, D2, D3, U3); importing this module also imports
the other plan modules so that the registry is complete.

Registered queries: key -> (spark, sf_dir) -> DataFrame, and their DuckDB
oracles (key -> SQL over the driver's views).  Every query reads the given
tables in full; outputs are scalar columns with aliases equal on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unionlake.functions import vectors as V
from unionlake.operators import lsh, search as S
from unionlake.plans import lake as L

from unionlake.plans.registry import ORACLES, QUERIES, register  # noqa: F401


def _vec_checksum(df: DataFrame) -> DataFrame:
    """Vectors as comparable scalars: norm, sum and first component, rounded."""
    return df.select("table_name", "column_name",
                     F.round(V.norm("vec"), 6).alias("vec_norm"),
                     F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("vec_sum"),
                     F.round(F.col("vec")[0], 6).alias("vec_first"),
                     F.size("vec").alias("vec_dim"))


def _sql_vec_checksum(view: str) -> str:
    return (f"SELECT table_name, column_name, round(sqrt(list_dot_product(vec, vec)), 6) AS vec_norm, "
            f"round(list_sum(vec), 6) AS vec_sum, round(vec[1], 6) AS vec_first, "
            f"CAST(len(vec) AS INTEGER) AS vec_dim FROM {view}")


# --- U1 flagship ----------------------------------------------------------------
def table_union_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = L.lake_vectors(spark, sf_dir)
    return S.search(vecs, vecs, k=L.K, threshold=L.THRESHOLD, method="lsh")


register("table_union_search", f"""
WITH {L.sql_lake_ctes()},
hits AS ({lsh.sql_lsh_hits('vecs', 'vecs', L.THRESHOLD)})
SELECT * FROM ({S.sql_search_from_hits('hits', L.K)})
""")(table_union_search)


@register("table_union_search_exact", f"""
WITH {L.sql_lake_ctes()},
hits AS ({lsh.sql_exact_hits('vecs', 'vecs', L.THRESHOLD)})
SELECT * FROM ({S.sql_search_from_hits('hits', L.K)})
""")
def table_union_search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = L.lake_vectors(spark, sf_dir)
    return S.search(vecs, vecs, k=L.K, threshold=L.THRESHOLD, method="exact")


@register("embed_lake_columns", f"""
WITH {L.sql_lake_ctes()}
{_sql_vec_checksum('vecs')}
""")
def embed_lake_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vec_checksum(L.lake_vectors(spark, sf_dir))


@register("cosine_threshold_join", f"""
WITH {L.sql_lake_ctes()}
{lsh.sql_exact_hits('vecs', 'vecs', L.THRESHOLD)}
""")
def cosine_threshold_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = L.lake_vectors(spark, sf_dir)
    return lsh.cosine_join(vecs, vecs, L.THRESHOLD)


@register("lsh_band_join", f"""
WITH {L.sql_lake_ctes()}
SELECT * FROM ({lsh.sql_lsh_hits('vecs', 'vecs', L.THRESHOLD)})
""")
def lsh_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = L.lake_vectors(spark, sf_dir)
    return lsh.lsh_join(vecs, vecs, L.THRESHOLD)


# the other plan modules register on import
from unionlake.plans import (  # noqa: E402,F401
    q_text, q_clean, q_search, q_eval, q_train, q_walks, q_linearize, q_sources, q_stream,
)
