"""Lakes in record form: one row per table row, with its cells in one array.

records(table_name, row_id, cells ARRAY<STRUCT<column_name, col_pos, value>>)

Null tests look inside the array, so they need no shuffle.  Facts about
columns are one partial aggregate; their small result is written and joined
by table name, on its real size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unionlake.operators.clean import COLUMN, NUMERIC_RE, ROW, TABLE, VALUE
from unionlake.session import materialize

CELLS = "cells"


def cells(records: DataFrame) -> DataFrame:
    """Records -> cells(table_name, column_name, col_pos, row_id, value)."""
    return records.select(TABLE, ROW, F.inline(CELLS)).select(TABLE, COLUMN, "col_pos", ROW, VALUE)


def pack(names: list[str], values: list[Column]) -> Column:
    """The cells of one row, in column order."""
    return F.array(*[F.struct(F.lit(n).alias(COLUMN), F.lit(i).alias("col_pos"), v.cast("string").alias(VALUE)) for i, (n, v) in enumerate(zip(names, values))])


def null_count() -> Column:
    return F.size(F.filter(CELLS, lambda c: c[VALUE].isNull()))


def is_numeric(value: Column) -> Column:
    """Null for null, so that aggregates pass over it."""
    return F.when(value.isNotNull(), value.rlike(NUMERIC_RE))


def empty_columns(records: DataFrame) -> DataFrame:
    """(table_name, empty ARRAY<STRING>) of the tables with columns that are null in every row; written."""
    facts = cells(records).groupBy(TABLE, COLUMN).agg(F.count(VALUE).alias("n"))
    return materialize(facts.where("n = 0").groupBy(TABLE).agg(F.collect_list(COLUMN).alias("empty")), "empty-columns")


def drop_empty_columns(records: DataFrame) -> DataFrame:
    """Drop the columns whose values are all null; a table of such columns only is gone."""
    found = records.join(empty_columns(records), TABLE, "left")
    kept = F.when(F.col("empty").isNull(), F.col(CELLS)).otherwise(F.filter(CELLS, lambda c: ~F.array_contains("empty", c[COLUMN])))
    return found.withColumn(CELLS, kept).where(F.size(CELLS) > 0).select(*records.columns)


def drop_rows_any_null(records: DataFrame) -> DataFrame:
    """B2 (after B1): drop rows holding any null cell."""
    return records.where(~F.exists(CELLS, lambda c: c[VALUE].isNull()))


def drop_rows_all_null(records: DataFrame) -> DataFrame:
    """Drop rows whose cells are all null."""
    return records.where(F.exists(CELLS, lambda c: c[VALUE].isNotNull()))


def clean(records: DataFrame, policy: str = "any") -> DataFrame:
    """K2 order: empty columns first, then rows (``any``, ``all`` or ``none``);
    tables left without rows vanish (B4)."""
    rules = {"any": drop_rows_any_null, "all": drop_rows_all_null, "none": lambda r: r}
    if policy not in rules:
        raise ValueError(f"unknown cleaning policy {policy!r}")
    return rules[policy](drop_empty_columns(records))


def indexable(records: DataFrame) -> DataFrame:
    """B6 + B7: keep the columns that hold values and are not numeric."""
    facts = cells(records).groupBy(TABLE, COLUMN).agg(F.count(VALUE).alias("n"), F.bool_and(is_numeric(F.col(VALUE))).alias("numeric"))
    keep = materialize(facts.where("n > 0 and not coalesce(numeric, false)").groupBy(TABLE).agg(F.collect_list(COLUMN).alias("keep")), "indexable-columns")
    return records.join(keep, TABLE).withColumn(CELLS, F.filter(CELLS, lambda c: F.array_contains("keep", c[COLUMN]))).select(*records.columns)


def token_counts(records: DataFrame, token) -> DataFrame:
    """One pass over the lake: (table, column, token, nulls, n, n_values, numeric).

    ``nulls`` is the number of null cells of a token's row.  A row passes the
    any-null test after B1 exactly if it is null in the table's empty columns
    only, that is if ``nulls`` equals their number; so the row tests can be
    applied to the counts and the lake need not be read again."""
    each = records.withColumn("nulls", null_count()).select(TABLE, "nulls", F.inline(CELLS))
    return (each.select(TABLE, COLUMN, "nulls", token(F.col(VALUE)).alias("token"), VALUE)
            .groupBy(TABLE, COLUMN, "token", "nulls")
            .agg(F.count(F.lit(1)).alias("n"), F.count(VALUE).alias("n_values"), F.bool_and(is_numeric(F.col(VALUE))).alias("numeric")))


def indexable_counts(counts: DataFrame, policy: str = "any") -> DataFrame:
    """The token counts (table, column, token, n) of the cleaned, indexable
    columns: B1, the row test, B4, B6 and B7 on written ``token_counts``."""
    facts = counts.groupBy(TABLE, COLUMN, "nulls").agg(F.sum("n_values").alias("values"), F.bool_and("numeric").alias("numeric"))
    by_column, by_table = Window.partitionBy(TABLE, COLUMN), Window.partitionBy(TABLE)
    facts = facts.withColumn("empty", F.sum("values").over(by_column) == 0)
    facts = facts.withColumn("n_empty", F.size(F.collect_set(F.when(F.col("empty"), F.col(COLUMN))).over(by_table)))
    facts = facts.withColumn("width", F.size(F.collect_set(COLUMN).over(by_table)))
    passes = {"any": F.col("nulls") == F.col("n_empty"), "all": F.col("nulls") < F.col("width"), "none": F.lit(True)}[policy]
    facts = facts.where(passes & ~F.col("empty"))
    numeric = F.bool_and("numeric").over(by_column)
    keep = facts.withColumn("text", (F.sum("values").over(by_column) > 0) & ~F.coalesce(numeric, F.lit(False))).where("text")
    keep = materialize(keep.select(TABLE, COLUMN, "nulls"), "indexable-counts")
    kept = counts.join(keep, [TABLE, COLUMN, "nulls"], "left_semi")
    return kept.groupBy(TABLE, COLUMN, "token").agg(F.sum("n").alias("n"))
