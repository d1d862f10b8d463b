"""Shared plan fragments: the cleaned, indexable fragment lake and its
column vectors, as Spark plans and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from unionlake.operators import embed, records
from unionlake.sources import fixtures as fx
from unionlake.operators import clean as C
from unionlake.session import materialize as materialize_df

DIM = 64
THRESHOLD = 0.7
K = 10


def raw_cells(spark: SparkSession, sf_dir: str, dirty: bool = False) -> DataFrame:
    return fx.fragment_cells(spark, sf_dir, dirty=dirty)


def clean_records(spark: SparkSession, sf_dir: str, dirty: bool = False, policy: str = "any") -> DataFrame:
    return records.clean(fx.fragment_records(spark, sf_dir, dirty), policy)


def clean_cells(spark: SparkSession, sf_dir: str, dirty: bool = False, policy: str = "any") -> DataFrame:
    return records.cells(clean_records(spark, sf_dir, dirty, policy))


def indexable_records(spark: SparkSession, sf_dir: str, dirty: bool = False, policy: str = "any") -> DataFrame:
    return records.indexable(clean_records(spark, sf_dir, dirty, policy))


def indexable(spark: SparkSession, sf_dir: str, dirty: bool = False, policy: str = "any") -> DataFrame:
    return records.cells(indexable_records(spark, sf_dir, dirty, policy))


def lake_vectors(spark: SparkSession, sf_dir: str, dim: int = DIM, dirty: bool = False,
                 materialize: bool = True) -> DataFrame:
    """Column vectors of the lake: the index input, read by both sides of the
    search.  The lake is read once; the vectors are written (a Parquet table
    in the shared checkpoint folder) so the plans that use them do not
    re-embed the lake per reference."""
    vecs = embed.embed_records(fx.fragment_records(spark, sf_dir, dirty), dim)
    return materialize_df(vecs, "lake-vectors") if materialize else vecs


# ---------------------------------------------------------------------------
def sql_cells(dirty: bool = False) -> str:
    return fx.sql_fragment_cells(dirty)


def sql_drop_empty_columns(cells: str) -> str:
    return (f"SELECT * FROM {cells} WHERE (table_name, column_name) IN "
            f"(SELECT table_name, column_name FROM {cells} GROUP BY ALL HAVING count(value) > 0)")


def sql_drop_rows(cells: str, policy: str = "any") -> str:
    agg = "bool_or(value IS NULL)" if policy == "any" else "bool_and(value IS NULL)"
    return (f"SELECT c.* FROM {cells} c WHERE (c.table_name, c.row_id) NOT IN "
            f"(SELECT table_name, row_id FROM {cells} GROUP BY ALL HAVING {agg})")


def sql_numeric_columns(cells: str) -> str:
    return (f"SELECT table_name, column_name FROM {cells} GROUP BY ALL "
            f"HAVING bool_and(CASE WHEN value IS NULL THEN NULL ELSE regexp_full_match(value, "
            f"'{C.NUMERIC_RE}') END)")


def sql_indexable(cells: str) -> str:
    return (f"SELECT * FROM {cells} WHERE (table_name, column_name) IN ("
            f"SELECT table_name, column_name FROM {cells} GROUP BY ALL HAVING count(value) > 0 AND NOT "
            f"coalesce(bool_and(CASE WHEN value IS NULL THEN NULL ELSE regexp_full_match(value, "
            f"'{C.NUMERIC_RE}') END), false))")


def sql_lake_ctes(dirty: bool = False, policy: str = "any", dim: int = DIM) -> str:
    """CTEs: raw_cells, cells1 (empty columns dropped), clean_cells, idx_cells, vecs."""
    return f"""
    raw_cells AS ({sql_cells(dirty)}),
    cells1 AS ({sql_drop_empty_columns('raw_cells')}),
    clean_cells AS ({sql_drop_rows('cells1', policy)}),
    idx_cells AS ({sql_indexable('clean_cells')}),
    vecs AS ({embed.sql_embed_columns('idx_cells', dim)})"""
