"""Cleaning and column filters (B1-B8, B13, B14, E15) over the fragment lake
with nulls injected by key (FIXTURES.md section 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unionlake.operators import clean, records
from unionlake.plans import lake as L
from unionlake.plans.registry import register
from unionlake.sources import fixtures as fx

DIRTY = f"raw_cells AS ({L.sql_cells(dirty=True)})"
CELL_COLS = "table_name, column_name, col_pos, row_id, value"


def _dirty(spark, sf_dir):
    return L.raw_cells(spark, sf_dir, dirty=True)


@register("drop_empty_columns", f"WITH {DIRTY} SELECT {CELL_COLS} FROM ({L.sql_drop_empty_columns('raw_cells')})")
def drop_empty_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.cells(records.drop_empty_columns(fx.fragment_records(spark, sf_dir, dirty=True)))


@register("drop_rows_any_null", f"""WITH {DIRTY}, c1 AS ({L.sql_drop_empty_columns('raw_cells')})
SELECT {CELL_COLS} FROM ({L.sql_drop_rows('c1', 'any')})""")
def drop_rows_any_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.clean_cells(spark, sf_dir, dirty=True)


@register("drop_rows_all_null", f"""WITH {DIRTY}, c1 AS ({L.sql_drop_empty_columns('raw_cells')})
SELECT {CELL_COLS} FROM ({L.sql_drop_rows('c1', 'all')})""")
def drop_rows_all_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.clean_cells(spark, sf_dir, dirty=True, policy="all")


@register("drop_empty_tables", f"""WITH {DIRTY}, c1 AS ({L.sql_drop_empty_columns('raw_cells')}),
c2 AS ({L.sql_drop_rows('c1', 'any')})
SELECT table_name, CAST(count(DISTINCT column_name) AS BIGINT) AS n_columns,
       CAST(count(DISTINCT row_id) AS BIGINT) AS n_rows,
       count(DISTINCT column_name) < 1 AS few_columns, count(DISTINCT row_id) < 3 AS few_rows
FROM c2 GROUP BY table_name""")
def drop_empty_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.table_flags(L.clean_cells(spark, sf_dir, dirty=True))


@register("exclude_numeric_columns", f"""WITH {DIRTY}
SELECT DISTINCT table_name, column_name FROM raw_cells
WHERE (table_name, column_name) NOT IN ({L.sql_numeric_columns('raw_cells')})""")
def exclude_numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.exclude_numeric_columns(_dirty(spark, sf_dir)).select("table_name", "column_name").distinct()


@register("text_columns", f"""WITH {DIRTY}, c1 AS ({L.sql_drop_empty_columns('raw_cells')})
SELECT table_name, column_name, count(*) AS n_cells FROM c1
WHERE (table_name, column_name) NOT IN ({L.sql_numeric_columns('c1')}) GROUP BY ALL""")
def text_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clean.text_columns(clean.drop_empty_columns(_dirty(spark, sf_dir)))
    return c.groupBy("table_name", "column_name").agg(F.count(F.lit(1)).alias("n_cells"))


@register("nonnull_columns", f"""WITH {DIRTY}
SELECT table_name, column_name, count(value) AS n_values FROM raw_cells GROUP BY ALL HAVING count(value) > 0""")
def nonnull_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.column_stats(_dirty(spark, sf_dir)).where(F.col("n_values") > 0).select(
        "table_name", "column_name", "n_values")


@register("unpivot_lake", f"""SELECT 'part__' || CAST(p_partkey % 6 AS VARCHAR) AS table_name, column_name,
  CAST(col_pos AS INTEGER) AS col_pos, p_partkey AS row_id, value FROM (
  SELECT p_partkey, unnest(['p_name', 'p_brand', 'p_type']) AS column_name, unnest([0, 1, 2]) AS col_pos,
         unnest([p_name, p_brand, p_type]) AS value FROM part)""")
def unpivot_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fx.read_table(spark, sf_dir, "part")
    tname = F.concat(F.lit("part__"), F.pmod("p_partkey", F.lit(6)).cast("string"))
    return clean.unpivot_lake(part, tname, ["p_name", "p_brand", "p_type"], row_id="p_partkey")


@register("lake_stats", f"""WITH {DIRTY}, c1 AS ({L.sql_drop_empty_columns('raw_cells')}),
c2 AS ({L.sql_drop_rows('c1', 'any')}), idx AS ({L.sql_indexable('c2')})
SELECT (SELECT count(DISTINCT table_name) FROM raw_cells) AS n_tables,
       (SELECT count(DISTINCT table_name) FROM c2) AS n_nonempty,
       (SELECT count(DISTINCT table_name) FROM idx) AS n_indexed,
       (SELECT count(DISTINCT table_name) FROM raw_cells) - (SELECT count(DISTINCT table_name) FROM c2) AS n_skipped""")
def lake_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _dirty(spark, sf_dir)
    c2 = L.clean_cells(spark, sf_dir, dirty=True)
    idx = L.indexable(spark, sf_dir, dirty=True).select("table_name")
    return clean.lake_stats(raw, c2, idx)


# related columns: the annotated columns of each query are those whose name
# appears in every fragment of its seed (derived from the lake itself)
def related_columns(cells: DataFrame) -> DataFrame:
    cols = cells.select("table_name", "column_name").distinct()
    return cols.where(F.col("column_name") != "c_acctbal").select(F.col("table_name").alias("query_table"),
                                                                   "column_name")


@register("related_column_filter", f"""WITH {DIRTY}
SELECT {CELL_COLS} FROM raw_cells WHERE column_name <> 'c_acctbal'""")
def related_column_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    # names alone, read from the records: no value is made for them
    names = fx.fragment_records(spark, sf_dir).select("table_name", F.explode("cells.column_name").alias("column_name"))
    return clean.related_column_filter(_dirty(spark, sf_dir), related_columns(names))
