"""Corpus sources (A8-A11): web-table dumps, edge lists, term lists and
word-vector files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unionlake.session import materialize

WEBTABLE_SCHEMA = T.StructType([
    T.StructField("table_id", T.StringType()),
    T.StructField("relation", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("headerPosition", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])


def webtable_scan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON-lines web tables (gzip or plain).  Returns (tables, corrupt):
    parsed tables (the metadata line falls out: it has no ``relation``) and
    the unparsable lines as a side output.  A gzip file does not split: one
    task per file; callers repartition after the scan."""
    raw = (spark.read.schema(WEBTABLE_SCHEMA).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    raw = raw.select("*", F.col("_metadata.file_path").alias("file_path"))
    corrupt = raw.where(F.col("_corrupt_record").isNotNull()).select("file_path", "_corrupt_record")
    tables = raw.where(F.col("_corrupt_record").isNull() & F.col("relation").isNotNull()).drop("_corrupt_record")
    return tables, corrupt


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their 0-based line number across the files of ``path``
    (file order by name, then position).

    Lines keep the block of their file that they were read from and their
    place in it; blocks are counted, a prefix sum over the counts (a row per
    block, then a row per file) says how many lines come before each.  The
    lines are written once: blocks and places hold for one scan."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                         F.monotonically_increasing_id().alias("place"), "value")
    lines = materialize(lines, "lines")
    blocks = lines.groupBy("file", "block").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = blocks.groupBy("file").agg(F.sum("n").alias("n"))
    files = files.select("file", ahead(Window.orderBy("file")).alias("files_ahead"))
    blocks = blocks.withColumn("ahead", ahead(Window.partitionBy("file").orderBy("block"))).join(files, "file")
    starts = materialize(blocks.select("file", "block", (F.col("files_ahead") + F.col("ahead") - F.col("first")).alias("shift")), "line-starts")
    return lines.join(starts, ["file", "block"]).select((F.col("place") + F.col("shift")).alias("line_no"), "value")


def edge_scan(spark: SparkSession, path: str) -> DataFrame:
    """A9: 'u v w' lines -> (u, v, w, line_no); unparsable lines dropped."""
    parts = _numbered_lines(spark, path).select("line_no", F.split(F.trim("value"), " ").alias("p"))
    e = parts.select("line_no", F.expr("try_cast(p[0] AS BIGINT)").alias("u"),
                     F.expr("try_cast(p[1] AS BIGINT)").alias("v"),
                     F.expr("try_cast(p[2] AS DOUBLE)").alias("w"), F.size("p").alias("n"))
    return e.where((F.col("n") == 3) & F.col("u").isNotNull() & F.col("v").isNotNull() & F.col("w").isNotNull()) \
            .select("u", "v", "w", "line_no")


def termlist_scan(spark: SparkSession, path: str) -> DataFrame:
    """A10: one term per line; id = line number from 0."""
    return _numbered_lines(spark, path).select(F.col("line_no").alias("id"), F.col("value").alias("term"))


def vector_file_scan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Header 'n d', then 'word v1 ... vd'.  Returns (vectors, bad):
    rows of exactly d numbers are kept, others reported."""
    lines = _numbered_lines(spark, path)
    head = lines.where(F.col("line_no") == 0).first()  # one line: 'n d'
    d = int(head["value"].split()[1])
    body = lines.where(F.col("line_no") > 0).select("line_no", F.split(F.trim("value"), r"\s+").alias("p"))
    parsed = body.select("line_no", F.col("p")[0].alias("word"),
                         F.transform(F.slice("p", F.lit(2), F.size("p")), lambda x: x.try_cast("double")).alias("vec"))
    ok = (F.size("vec") == F.lit(d)) & F.forall("vec", lambda x: x.isNotNull())
    return parsed.where(ok).select("word", "vec"), parsed.where(~ok).select("line_no", "word")
