"""Reproducible sampling (I1, I2, I4) and batch assignment.

Every draw is a pure function of (seed, keys) -- md5 of ``seed:keys`` --
never ``rand()``, so results do not depend on partitioning or retries and
the same draw can be written in SQL (K9).  ``row_number() <= n`` is planned
as a WindowGroupLimit: each map partition keeps its n best rows per group
before the shuffle, so a huge table sends n rows per partition, not all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TABLE, COLUMN, ROW = "table_name", "column_name", "row_id"


def hash_order(seed: int, *keys) -> Column:
    """The md5 hex string of 'seed:k1:k2...' -- sorts like a uniform draw."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k
                                                      for k in keys]))


def uniform(seed: int, *keys) -> Column:
    """u = (h + 0.5) / 2^32 with h the first 8 hex digits of the md5 (0 < u < 1)."""
    h = F.conv(F.substring(hash_order(seed, *keys), 1, 8), 16, 10).cast("double")
    return (h + 0.5) / F.lit(4294967296.0)


def sample_rows(cells: DataFrame, n: int, seed: int = 12345) -> DataFrame:
    """At most ``n`` rows per table (the whole table when it has <= n).
    ``cells`` or records: all that has a row's id shares its rank, so no list
    of rows is made and joined back."""
    if n is None or n <= 0:
        return cells
    w = Window.partitionBy(TABLE).orderBy(hash_order(seed, TABLE, ROW), F.col(ROW))
    return cells.withColumn("_rank", F.dense_rank().over(w)).where(F.col("_rank") <= n).drop("_rank")


def sample_column_values(cells: DataFrame, n: int, seed: int = 12345) -> DataFrame:
    """At most ``n`` values per column; n <= 0 or n >= size keeps all."""
    if n is None or n <= 0:
        return cells
    w = Window.partitionBy(TABLE, COLUMN).orderBy(hash_order(seed, TABLE, COLUMN, ROW), F.col(ROW))
    return cells.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def two_view_sample(cells: DataFrame, n: int, seeds: tuple[int, int] = (1, 2)) -> tuple[DataFrame, DataFrame]:
    """I4: two independent row samples of every table."""
    return sample_rows(cells, n, seeds[0]), sample_rows(cells, n, seeds[1])


def assign_batches(tables: DataFrame, batch_size: int, seed: int = 12345, n_tables: int | None = None) -> DataFrame:
    """(table_name, batch_id): tables spread over ceil(#tables / batch_size)
    batches by their hash draw -- no global sort, no single task."""
    t = tables.select(TABLE).distinct()
    if n_tables is None:
        n_tables = t.count()
    n_batches = max(1, -(-n_tables // batch_size))
    h = F.conv(F.substring(hash_order(seed, TABLE), 1, 8), 16, 10).cast("long")
    return t.select(TABLE, F.pmod(h, F.lit(n_batches)).cast("int").alias("batch_id"))


def sql_sample_rows(cells_view: str, n: int, seed: int) -> str:
    return f"""SELECT c.* FROM {cells_view} c JOIN (
      SELECT table_name, row_id FROM (
        SELECT table_name, row_id, row_number() OVER (PARTITION BY table_name
               ORDER BY md5('{seed}:' || table_name || ':' || CAST(row_id AS VARCHAR)), row_id) AS rn
        FROM (SELECT DISTINCT table_name, row_id FROM {cells_view})) WHERE rn <= {n}) k
      ON k.table_name = c.table_name AND k.row_id = c.row_id"""
