"""Writers that lay the fixtures down as files (CSV lake, Parquet lake, lists,
truth, web-table dump, edge list, term list, vector file) in the shared
scratch folder, so the file sources read what Spark wrote from the given
tables.  All writers are Spark jobs; none routes data through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unionlake.session import materialize

LINE_SEP = "\u0001"  # a separator that no fixture line holds: the CSV writer writes whole lines
_PLAIN = {"sep": LINE_SEP, "quote": "\u0000", "escapeQuotes": "false", "emptyValue": "", "header": "false"}


def csv_field(v: Column) -> Column:
    """One CSV field: null -> empty, quoted when it holds a comma or quote."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(v, '"', '""'), F.lit('"'))
    return F.when(v.isNull(), F.lit("")).when(v.rlike('[",\r\n]'), quoted).otherwise(v)


def _write_lines(lines: DataFrame, path: str, partition_col: str | None = None, mode: str = "overwrite",
                 compression: str | None = None, single_file: bool = False) -> None:
    """Write pre-rendered lines (column ``line``, ordered by ``ord``) as .csv
    files: one file per ``partition_col`` value, lines in ``ord`` order.
    Without a partition column the lines are range-partitioned on ``ord``:
    part files follow each other in name order, so a reader that numbers
    lines by (file name, position) sees one ordered file, written by many
    tasks.  ``single_file`` keeps one file (for formats whose every file
    starts with a header line)."""
    if partition_col:
        lines = lines.repartition(partition_col).sortWithinPartitions(partition_col, "ord")
    elif single_file:
        lines = lines.coalesce(1).sortWithinPartitions("ord")
    else:
        # lines of equal order are dealt to many tasks as well
        lines = lines.repartitionByRange("ord", F.xxhash64("line")).sortWithinPartitions("ord")
    w = lines.drop("ord").write.mode(mode).options(**_PLAIN)
    if compression:
        w = w.option("compression", compression)
    if partition_col:
        w = w.partitionBy(partition_col)
    w.csv(path)


def write_csv_lake(records: DataFrame, root: str, mode: str = "overwrite", rows_per_file: int = 250_000) -> None:
    """records -> ``root/piece=<n>/table_name=<t>/part-*.csv``, header line first.

    A file is written and read by one task, so a table of more than
    ``rows_per_file`` rows is several files: tables with the same name.  A row
    goes to the piece of its row id's hash.  All columns of a table are in the
    header, as its rows have the same."""
    sizes = materialize(records.groupBy("table_name").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_file)).alias("pieces"), F.first("cells").alias("h")), "lake-sizes")
    line = lambda cells, field: F.concat_ws(",", F.transform(cells, lambda c: csv_field(c[field])))
    rows = records.join(sizes.select("table_name", "pieces"), "table_name").select(
        "table_name", F.pmod(F.xxhash64("row_id"), F.col("pieces")).alias("piece"), F.lit(1).alias("ord"), line("cells", "value").alias("line"))
    header = sizes.select("table_name", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), F.lit(0).alias("ord"), line("h", "column_name").alias("line"))
    n = sizes.agg(F.sum("pieces")).first()[0] or 1  # a task is a file or so
    lines = header.unionByName(rows).repartition(n, "table_name", "piece").sortWithinPartitions("piece", "table_name", "ord")
    lines.drop("ord").write.mode(mode).options(**_PLAIN).partitionBy("piece", "table_name").csv(root)


def write_parquet_lake(wide: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Wide (table_name, <columns>) -> ``root/table_name=<t>/part-*.parquet``."""
    wide.repartition("table_name").write.mode(mode).partitionBy("table_name").parquet(root)


def write_text_lines(df: DataFrame, col: str, path: str, order: str | None = None, mode: str = "overwrite",
                     compression: str | None = None, single_file: bool = False) -> None:
    lines = df.select(F.col(col).alias("line"), (F.col(order) if order else F.lit(0)).alias("ord"))
    _write_lines(lines, path, None, mode, compression, single_file)
