"""Fixtures derived from the driver's parquet tables (see FIXTURES.md).

The *fragment lake*: each seed table is cut into ``n`` fragments by
``key % n`` (every row lands in exactly one fragment), named ``<seed>__<i>``;
all values become STRING.  Truth = fragments of the same seed.  The same
definitions are rendered as DuckDB SQL in ``sql_*`` functions so the oracle
reads the same lake.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unionlake.operators import records

# Fixed fixture definition: (seed table, key, row id expression, lake columns, fragments).
FRAGMENT_SEEDS = [
    ("customer", "c_custkey", ["c_name", "c_mktsegment", "c_acctbal"], 5),
    ("supplier", "s_suppkey", ["s_name", "s_acctbal"], 4),
    ("part", "p_partkey", ["p_name", "p_brand", "p_type", "p_size"], 6),
    ("orders", "o_orderkey", ["o_orderstatus", "o_orderpriority", "o_totalprice"], 6),
    ("events", "event_id", ["event_type", "props", "value"], 5),
    ("documents", "doc_id", ["lang", "source"], 4),
    ("pages", "page_id", ["url"], 3),
    ("conversations", "conv_id", ["role"], 3),
    ("nation", "n_nationkey", ["n_name"], 2),
]
# conv_id repeats over turns: its row id is conv_id * 1000 + turn.
ROW_ID_SQL = {"conversations": "conv_id * 1000 + turn"}
# Cleaning fixture: a cell is nulled when row_id % 7 = 0 in these columns,
# one column is null throughout, one table is null throughout.
DIRTY_COLUMNS = ["c_mktsegment", "p_brand", "o_orderpriority", "event_type"]
DIRTY_MOD = 7
ALL_NULL_COLUMN = ("supplier__0", "s_acctbal")
ALL_NULL_TABLE = "nation__1"

CELLS_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("col_pos", T.IntegerType()),
    T.StructField("row_id", T.LongType()),
    T.StructField("value", T.StringType()),
])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _as_string(df: DataFrame, c: str):
    t = dict(df.dtypes)[c]
    if t in ("double", "float"):
        return F.col(c).cast("decimal(18,2)").cast("string")
    return F.col(c).cast("string")


def _seed_records(spark: SparkSession, sf_dir: str, seed: str, key: str, cols: list[str], n: int) -> DataFrame:
    df = read_table(spark, sf_dir, seed)
    row_id = F.expr(ROW_ID_SQL[seed]) if seed in ROW_ID_SQL else F.col(key)
    return df.select(
        F.concat(F.lit(seed + "__"), F.pmod(F.col(key), F.lit(n)).cast("string")).alias("table_name"),
        row_id.cast("long").alias("row_id"), records.pack(cols, [_as_string(df, c) for c in cols]).alias("cells"))


def fragment_records(spark: SparkSession, sf_dir: str, dirty: bool = False) -> DataFrame:
    """The fragment lake in record form (one scan per seed table, unioned)."""
    out = None
    for seed, key, cols, n in FRAGMENT_SEEDS:
        part = _seed_records(spark, sf_dir, seed, key, cols, n)
        out = part if out is None else out.unionByName(part)
    if dirty:
        def dirtied(c):
            value = dirty_value(F.col("table_name"), c["column_name"], F.col("row_id"), c["value"])
            return F.struct(c["column_name"], c["col_pos"], value.alias("value"))
        out = out.withColumn("cells", F.transform("cells", dirtied))
    return out


def fragment_cells(spark: SparkSession, sf_dir: str, dirty: bool = False) -> DataFrame:
    """Long-form ``cells`` of the fragment lake."""
    return records.cells(fragment_records(spark, sf_dir, dirty))


def dirty_value(t, c, r, v):
    nulled = ((c.isin(DIRTY_COLUMNS) & (F.pmod(r, F.lit(DIRTY_MOD)) == 0))
              | ((t == ALL_NULL_COLUMN[0]) & (c == ALL_NULL_COLUMN[1]))
              | (t == ALL_NULL_TABLE))
    return F.when(nulled, F.lit(None).cast("string")).otherwise(v)


def fragment_truth(cells: DataFrame) -> DataFrame:
    """Truth pairs (query_table, data_lake_table): fragments of the same seed,
    derived from the table names present in ``cells``."""
    tables = cells.select("table_name").distinct().withColumn("seed", F.substring_index("table_name", "__", 1))
    q = tables.select(F.col("table_name").alias("query_table"), "seed")
    c = tables.select(F.col("table_name").alias("data_lake_table"), "seed")
    return q.join(c, "seed").select("query_table", "data_lake_table")


def fragment_wide(spark: SparkSession, sf_dir: str, seed: str) -> DataFrame:
    """One seed in wide form with its fragment name: (table_name, row_id, <cols as string>)."""
    spec = {s: (k, cols, n) for s, k, cols, n in FRAGMENT_SEEDS}[seed]
    key, cols, n = spec
    df = read_table(spark, sf_dir, seed)
    row_id = F.expr(ROW_ID_SQL[seed]) if seed in ROW_ID_SQL else F.col(key)
    return df.select(
        F.concat(F.lit(seed + "__"), F.pmod(F.col(key), F.lit(n)).cast("string")).alias("table_name"),
        row_id.cast("long").alias("row_id"),
        *[_as_string(df, c).alias(c) for c in cols])


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Externally encoded column vectors: table = label, column = vec_id."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("table_name"),
                    F.col("vec_id").cast("string").alias("column_name"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


# ---------------------------------------------------------------------------
# DuckDB renderings.
def _sql_as_string(seed_types: dict, c: str) -> str:
    if seed_types.get(c) in ("double", "float"):
        return f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)"
    return f"CAST({c} AS VARCHAR)"


# Column types of the seed tables that need a fixed decimal rendering.
_FLOAT_COLUMNS = {"c_acctbal", "s_acctbal", "o_totalprice", "value"}


def sql_fragment_cells(dirty: bool = False) -> str:
    parts = []
    for seed, key, cols, n in FRAGMENT_SEEDS:
        rid = ROW_ID_SQL.get(seed, key)
        for i, c in enumerate(cols):
            v = f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)" if c in _FLOAT_COLUMNS else f"CAST({c} AS VARCHAR)"
            parts.append(
                f"SELECT '{seed}__' || CAST(({key} % {n}) AS VARCHAR) AS table_name, '{c}' AS column_name, "
                f"CAST({i} AS INTEGER) AS col_pos, CAST({rid} AS BIGINT) AS row_id, {v} AS value FROM {seed}")
    body = "\nUNION ALL\n".join(parts)
    if not dirty:
        return body
    cols = ", ".join(f"'{c}'" for c in DIRTY_COLUMNS)
    return (f"SELECT table_name, column_name, col_pos, row_id, CASE WHEN "
            f"(column_name IN ({cols}) AND row_id % {DIRTY_MOD} = 0) "
            f"OR (table_name = '{ALL_NULL_COLUMN[0]}' AND column_name = '{ALL_NULL_COLUMN[1]}') "
            f"OR table_name = '{ALL_NULL_TABLE}' THEN NULL ELSE value END AS value FROM ({body})")


def sql_fragment_truth(cells_view: str = "cells") -> str:
    return (f"SELECT q.table_name AS query_table, c.table_name AS data_lake_table FROM "
            f"(SELECT DISTINCT table_name, split_part(table_name, '__', 1) AS seed FROM {cells_view}) q JOIN "
            f"(SELECT DISTINCT table_name, split_part(table_name, '__', 1) AS seed FROM {cells_view}) c "
            f"ON q.seed = c.seed")


def sql_embedding_vectors() -> str:
    return ("SELECT 'label_' || CAST(label AS VARCHAR) AS table_name, CAST(vec_id AS VARCHAR) AS column_name, "
            "CAST(embedding AS DOUBLE[]) AS vec FROM embeddings")
