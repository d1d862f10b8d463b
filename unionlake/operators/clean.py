"""Cleaning and column filters over long-form ``cells``
(table_name, column_name, col_pos, row_id, value).

Column-level facts are small (one row per column) and are computed by a
partial hash aggregate and written to the checkpoint folder; the join back
then plans on their real size (a broadcast below the broadcast threshold, a
shuffle join above it) without shuffling the cells to find out.
Row-level facts use a window partitioned by (table, row): a group is one row
of one table, bounded by the table's width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unionlake.session import materialize

TABLE, COLUMN, ROW, VALUE = "table_name", "column_name", "row_id", "value"

# Fixed value: a numeric value (optional sign, digits with optional fraction or
# a bare fraction, optional exponent, surrounding blanks allowed).
NUMERIC_RE = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def column_stats(cells: DataFrame) -> DataFrame:
    """Per column: non-null count and whether every non-null value is numeric."""
    return (cells.groupBy(TABLE, COLUMN)
            .agg(F.count(VALUE).alias("n_values"),
                 F.bool_and(F.when(F.col(VALUE).isNotNull(), F.col(VALUE).rlike(NUMERIC_RE))).alias("numeric")))


def drop_empty_columns(cells: DataFrame) -> DataFrame:
    """B1: drop columns whose values are all null."""
    keep = materialize(column_stats(cells).where(F.col("n_values") > 0).select(TABLE, COLUMN), "nonempty-cols")
    return cells.join(keep, [TABLE, COLUMN], "left_semi")


def _row_flag(cells: DataFrame, agg: Column) -> DataFrame:
    w = Window.partitionBy(TABLE, ROW)
    return cells.withColumn("_flag", agg.over(w))


def drop_rows_any_null(cells: DataFrame) -> DataFrame:
    """B2 (after B1): drop rows holding any null cell."""
    return _row_flag(cells, F.max(F.col(VALUE).isNull())).where(~F.col("_flag")).drop("_flag")


def drop_rows_all_null(cells: DataFrame) -> DataFrame:
    """Drop rows whose cells are all null."""
    return _row_flag(cells, F.min(F.col(VALUE).isNull())).where(~F.col("_flag")).drop("_flag")


def clean_lake(cells: DataFrame, policy: str = "any") -> DataFrame:
    """K2 order: empty columns first, then rows (``any`` or ``all`` null).
    Tables left without cells vanish (B4)."""
    cells = drop_empty_columns(cells)
    if policy == "any":
        return drop_rows_any_null(cells)
    if policy == "all":
        return drop_rows_all_null(cells)
    if policy == "none":
        return cells
    raise ValueError(f"unknown cleaning policy {policy!r}")


def table_flags(cells: DataFrame, min_rows: int = 3) -> DataFrame:
    """B4 warnings: tables with < 1 column or < ``min_rows`` rows are flagged, not dropped."""
    cols = cells.groupBy(TABLE, COLUMN).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(TABLE, ROW).agg(F.count(F.lit(1)).alias("n"))
    n_cols = cols.groupBy(TABLE).agg(F.count(F.lit(1)).alias("n_columns"))
    n_rows = rows.groupBy(TABLE).agg(F.count(F.lit(1)).alias("n_rows"))
    return (n_cols.join(n_rows, TABLE, "full")
            .select(TABLE, F.coalesce("n_columns", F.lit(0)).alias("n_columns"),
                    F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
            .withColumn("few_columns", F.col("n_columns") < 1)
            .withColumn("few_rows", F.col("n_rows") < min_rows))


def numeric_columns(cells: DataFrame) -> DataFrame:
    """(table_name, column_name) of numeric columns (K4)."""
    return column_stats(cells).where(F.col("numeric")).select(TABLE, COLUMN)


def exclude_numeric_columns(cells: DataFrame) -> DataFrame:
    """Drop numeric columns (they are neither indexed nor queried)."""
    return cells.join(materialize(numeric_columns(cells), "numeric-cols"), [TABLE, COLUMN], "left_anti")


def text_columns(cells: DataFrame) -> DataFrame:
    """B5 in long form: the textual columns are the non-numeric ones."""
    return exclude_numeric_columns(cells)


def text_columns_wide(df: DataFrame) -> DataFrame:
    """B5 in wide form: keep STRING columns."""
    return df.select(*[c for c, t in df.dtypes if t == "string"])


def nonnull_columns(cells: DataFrame) -> DataFrame:
    """Columns with at least one non-null value."""
    return drop_empty_columns(cells)


def indexable_cells(cells: DataFrame) -> DataFrame:
    """B6 + B7 in one column aggregate: non-numeric columns with values."""
    keep = materialize(column_stats(cells)
                       .where((F.col("n_values") > 0) & ~F.coalesce(F.col("numeric"), F.lit(False)))
                       .select(TABLE, COLUMN), "indexable-cols")
    return cells.join(keep, [TABLE, COLUMN], "left_semi")


def unpivot_lake(df: DataFrame, table_name: str | Column, columns: list[str] | None = None,
                 row_id: str | None = None) -> DataFrame:
    """Wide table -> cells.  Row ids come from ``row_id`` if given, else
    ``monotonically_increasing_id`` (deterministic for a fixed file split)."""
    columns = columns or [c for c in df.columns if c != row_id]
    tname = F.lit(table_name) if isinstance(table_name, str) else table_name
    rid = F.col(row_id).cast("long") if row_id else F.monotonically_increasing_id()
    packed = F.array(*[F.struct(F.lit(c).alias(COLUMN), F.lit(i).alias("col_pos"),
                                F.col(c).cast("string").alias(VALUE)) for i, c in enumerate(columns)])
    return df.select(tname.alias(TABLE), rid.alias(ROW), F.inline(packed)).select(
        TABLE, COLUMN, "col_pos", ROW, VALUE)


def column_id(table: str | Column, column: str | Column) -> Column:
    """Compose 'table!column'."""
    t = F.col(table) if isinstance(table, str) else table
    c = F.col(column) if isinstance(column, str) else column
    return F.concat_ws("!", t, c)


def split_column_id(cid: str | Column) -> tuple[Column, Column]:
    """Split on the last '!' -> (table, column)."""
    c = F.col(cid) if isinstance(cid, str) else cid
    col = F.substring_index(c, "!", -1)
    tbl = F.substring(c, F.lit(1), F.length(c) - F.length(col) - 1)
    return tbl, col


def nonzero_columns(pairs: DataFrame, vec_i: str = "view_i", vec_j: str = "view_j") -> DataFrame:
    """Keep columns whose vector is non-zero in both views."""
    nz = lambda v: F.aggregate(F.col(v), F.lit(0.0), lambda acc, x: acc + F.abs(x)) > 0
    return pairs.where(nz(vec_i) & nz(vec_j))


def related_column_filter(query_cells: DataFrame, related: DataFrame, missing: str = "none") -> DataFrame:
    """Keep only annotated query columns.  ``related`` is
    (query_table, column_name); a query without annotation keeps no column
    (``missing='none'``) or all its columns (``missing='all'``)."""
    # a row per column: written, so that the cells need not be dealt by column to find out
    rel = materialize(related.select(F.col("query_table").alias(TABLE), COLUMN).distinct(), "related-columns")
    kept = query_cells.join(rel, [TABLE, COLUMN], "left_semi")
    if missing == "none":
        return kept
    annotated = rel.select(TABLE).distinct()
    unannotated = query_cells.join(annotated, TABLE, "left_anti")
    return kept.unionByName(unannotated)


def lake_stats(raw_cells: DataFrame, clean_cells: DataFrame, indexed_vectors: DataFrame) -> DataFrame:
    """#tables, #tables left after cleaning, #tables with an indexed column."""
    tagged = (raw_cells.select(TABLE, F.lit(0).alias("stage"))
              .unionByName(clean_cells.select(TABLE, F.lit(1).alias("stage")))
              .unionByName(indexed_vectors.select(TABLE, F.lit(2).alias("stage")))
              .distinct())
    return (tagged.agg(F.count_if(F.col("stage") == 0).alias("n_tables"),
                       F.count_if(F.col("stage") == 1).alias("n_nonempty"),
                       F.count_if(F.col("stage") == 2).alias("n_indexed"))
            .withColumn("n_skipped", F.col("n_tables") - F.col("n_nonempty")))
