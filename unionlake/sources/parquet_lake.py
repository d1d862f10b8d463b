"""Parquet lakes whose files differ in schema (A3).

Tasks read the footers of the files (names, types and row counts, never the
pages) and give each a schema fingerprint.  Files of one fingerprint are one
native Parquet scan, so decoding, column vectors and splitting of large files
are Spark's; a scan is unpivoted into cells with its own column list.  The
driver holds the list of files, as every file scan of Spark does, and one
schema per fingerprint.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unionlake.operators import records
from unionlake.session import materialize
from unionlake.sources.names import glob_escaped, quoted, table_name_from_path

FOOTER = "table_name string, path string, file string, rows long, print string"
RECORDS = "table_name string, row_id long, cells array<struct<column_name: string, col_pos: int, value: string>>"


def lake_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(table_name, path, file) of every file below ``root``: ``path`` names it for readers, ``file`` is its URI.
    Contents are not read."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
             .select("path", F.col("_metadata.file_path").alias("file")))
    return files.select(table_name_from_path(F.col("file"), encoded=True).alias("table_name"), "path", "file")


def _footers(batches):
    """Row count and fingerprint of every file; none where the worker can't open the store or the footer."""
    import hashlib
    from urllib.parse import unquote, urlsplit

    import pyarrow as pa
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    def read(uri):
        parts = urlsplit(uri)
        store, path = (fs.LocalFileSystem(), unquote(parts.path)) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(uri)
        with store.open_input_file(path) as f:
            meta = pq.ParquetFile(f).metadata
        columns = [meta.schema.column(i) for i in range(len(meta.schema))]
        shape = [(c.path, c.physical_type, str(c.logical_type), str(c.converted_type), c.length, c.max_definition_level, c.max_repetition_level) for c in columns]
        return meta.num_rows, hashlib.sha256(repr(shape).encode()).hexdigest()

    for batch in batches:
        rows, prints = [], []
        for uri in batch.column("file").to_pylist():
            try:
                n, shape = read(uri)
            except (pa.ArrowException, OSError):
                n = shape = None
            rows.append(n)
            prints.append(shape)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("table_name", "path", "file")), pa.array(rows, pa.int64()), pa.array(prints, pa.string())],
                                         names=["table_name", "path", "file", "rows", "print"])


def _by_spark(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Footers of files in stores that only Spark opens: a schema read each, and row counts from one scan without columns."""
    found = files.collect()
    with ThreadPoolExecutor(8) as pool:
        prints = list(pool.map(lambda r: _schema(spark, r["path"]).json(), found))
    shapes = spark.createDataFrame([(r["table_name"], r["path"], r["file"], p) for r, p in zip(found, prints)], "table_name string, path string, file string, print string")
    scan = spark.read.schema("none int").option("recursiveFileLookup", "true").parquet(*[glob_escaped(r["path"]) for r in found])
    counts = scan.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    return shapes.join(counts, "file", "left").select("table_name", "path", "file", F.coalesce("rows", F.lit(0)).alias("rows"), "print")


def _schema(spark: SparkSession, path: str) -> T.StructType:
    return spark.read.option("recursiveFileLookup", "true").parquet(glob_escaped(path)).schema


def _text(value: Column, kind: T.DataType) -> Column:
    """A cell's text: nested values as JSON, bytes in base64, all else as Spark writes it."""
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value)
    return F.base64(value) if isinstance(kind, T.BinaryType) else value.cast("string")


def _records(spark: SparkSession, schema: T.StructType, paths: list[str], before: DataFrame | None) -> DataFrame:
    scan = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*[glob_escaped(p) for p in paths])
    meta = scan.metadataColumn("_metadata")
    packed = records.pack(schema.names, [_text(F.col(quoted(f.name)), f.dataType) for f in schema])
    rows = scan.select(meta["file_path"].alias("file"), meta["row_index"].alias("row_id"), packed.alias("cells"))
    if before is not None:
        rows = rows.join(before, "file", "left").withColumn("row_id", F.col("row_id") + F.coalesce("before", F.lit(0)))
    return rows.select(table_name_from_path(F.col("file"), encoded=True).alias("table_name"), "row_id", "cells")


def parquet_records(spark: SparkSession, root: str, glob: str = "*.parquet", tables: DataFrame | None = None) -> DataFrame:
    """A3: every Parquet table below ``root`` in record form.  A row id is the
    row's place in its table: its place in the file plus the rows of the
    table's files before it in path order.  ``tables`` (table_name) keeps the files of those tables.  A file
    that is no Parquet file fails the scan."""
    files = lake_files(spark, root, glob)
    if tables is not None:
        files = files.join(tables.select("table_name").distinct(), "table_name", "left_semi")
    read = materialize(files.mapInArrow(_footers, FOOTER), "lake-footers")
    known, unknown = read.where("print is not null"), read.where("print is null")
    if not unknown.isEmpty():
        known = materialize(known.unionByName(_by_spark(spark, unknown)), "lake-footers")
    w = Window.partitionBy("table_name").orderBy("path")
    before = known.withColumn("before", F.sum("rows").over(w) - F.col("rows")).select("file", "print", "before")
    before = materialize(before.where("before > 0"), "lake-row-starts")
    later = {r["print"] for r in before.select("print").distinct().collect()}
    groups = known.where("rows > 0").groupBy("print").agg(F.collect_list("path").alias("paths")).collect()
    with ThreadPoolExecutor(8) as pool:
        schemas = list(pool.map(lambda g: _schema(spark, min(g["paths"])), groups))
    scans = [_records(spark, s, sorted(g["paths"]), before.where(F.col("print") == g["print"]).drop("print") if g["print"] in later else None)
             for g, s in zip(groups, schemas) if len(s)]
    return reduce(DataFrame.unionByName, scans) if scans else spark.createDataFrame([], RECORDS)


def lake_scan_parquet(spark: SparkSession, root: str, glob: str = "*.parquet", tables: DataFrame | None = None) -> DataFrame:
    """A3: ``parquet_records`` as cells(table_name, column_name, col_pos, row_id, value)."""
    return records.cells(parquet_records(spark, root, glob, tables))
