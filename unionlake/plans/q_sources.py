"""Source and sink queries (A1-A12, A14-A16): each writes its fixture from
the given tables into the shared scratch folder with Spark, reads it back
with the source under test and returns what was read."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unionlake.operators import evaluate as EV, lsh, search as S, walks as W
from unionlake.plans import lake as L
from unionlake.plans import q_eval as QE
from unionlake.plans import q_search as QS
from unionlake.plans import q_walks as QW
from unionlake.plans.registry import register
from unionlake.session import materialize, scratch_path
from unionlake.sources import corpus, fixture_files as FF, fixtures as fx, lake as LK, sinks

DIRTY = f"raw_cells AS ({L.sql_cells(dirty=True)})"


def _path(spark, tag):
    return scratch_path(spark, f"{tag}-{uuid.uuid4().hex}")


def _csv_lake(spark, sf_dir, dirty=True):
    root = _path(spark, "csv-lake")
    FF.write_csv_lake(fx.fragment_records(spark, sf_dir, dirty), root)
    return root


def _rows(recs: DataFrame) -> DataFrame:
    """Whole rows with their column places and names, and how often each comes in its table."""
    cell = lambda c: F.concat(c["col_pos"].cast("string"), F.lit(":"), c["column_name"], F.lit("="), F.coalesce(c["value"], F.lit("<null>")))
    row = recs.select("table_name", "row_id", F.array_join(F.transform("cells", cell), "|").alias("row"))
    return row.groupBy("table_name", "row").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("n_ids"))


def _sql_rows(cells: str, where: str = "") -> str:
    """``_rows`` of a cells view: every row has an id of its own."""
    return f"""SELECT table_name, "row", count(*) AS n, count(*) AS n_ids FROM (
  SELECT table_name, row_id, string_agg(col_pos || ':' || column_name || '=' || coalesce(value, '<null>'), '|' ORDER BY col_pos) AS "row"
  FROM {cells} {where} GROUP BY table_name, row_id) GROUP BY ALL"""


# single-column rows that are all null render as blank lines: a blank line is no row
_SQL_CSV_CELLS = f"""{DIRTY},
width AS (SELECT table_name, count(DISTINCT column_name) AS w FROM raw_cells GROUP BY ALL),
csv_cells AS (SELECT c.* FROM raw_cells c JOIN width USING (table_name) WHERE NOT (w = 1 AND value IS NULL))"""


@register("lake_catalog", f"WITH {DIRTY} SELECT DISTINCT table_name FROM raw_cells")
def lake_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LK.lake_catalog(spark, _csv_lake(spark, sf_dir)).select("table_name").distinct()


@register("lake_scan_csv", f"WITH {_SQL_CSV_CELLS} {_sql_rows('csv_cells')}")
def lake_scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(LK.csv_records(spark, _csv_lake(spark, sf_dir)))


def _parquet_lake(spark, sf_dir):
    root = _path(spark, "parquet-lake")
    for seed, _, _, _ in fx.FRAGMENT_SEEDS:  # one write per fixture seed table
        FF.write_parquet_lake(fx.fragment_wide(spark, sf_dir, seed).drop("row_id"), f"{root}/{seed}")
    return root


@register("lake_scan_parquet", f"WITH raw_cells AS ({L.sql_cells()}) {_sql_rows('raw_cells')}")
def lake_scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(LK.parquet_records(spark, _parquet_lake(spark, sf_dir)))


def _roster(spark, root, glob, suffix):
    names = LK.lake_files(spark, root, glob).select("table_name").distinct().where(F.col("table_name").endswith("__0"))
    roster = _path(spark, "roster")
    FF.write_text_lines(names.select(F.concat("table_name", F.lit(suffix)).alias("f")), "f", roster)
    return roster


@register("roster_scan", f"WITH {_SQL_CSV_CELLS} {_sql_rows('csv_cells', "WHERE table_name LIKE '%\\_\\_0' ESCAPE '\\'")}")
def roster_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _csv_lake(spark, sf_dir)
    return _rows(LK.roster_records(spark, root, _roster(spark, root, LK.CSV_GLOB, ".csv")))


@register("roster_scan_parquet", f"WITH raw_cells AS ({L.sql_cells()}) {_sql_rows('raw_cells', "WHERE table_name LIKE '%\\_\\_0' ESCAPE '\\'")}")
def roster_scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _parquet_lake(spark, sf_dir)
    return _rows(LK.roster_records(spark, root, _roster(spark, root, "*.parquet", ".parquet")))


@register("query_list", f"""WITH {DIRTY}, t AS (SELECT DISTINCT table_name FROM raw_cells)
SELECT 1 AS form, table_name AS query_table FROM t UNION ALL SELECT 2, table_name FROM t
UNION ALL SELECT 3, table_name FROM t""")
def query_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _csv_lake(spark, sf_dir)
    names = LK.lake_catalog(spark, root).select("table_name").distinct()
    p1, p2 = _path(spark, "queries-1"), _path(spark, "queries-2")
    FF.write_text_lines(names, "table_name", p1)
    hdr = spark.createDataFrame([("query_table,recall",)], "line STRING")  # the CSV header line
    body = names.select(F.concat(F.col("table_name"), F.lit(".csv,1")).alias("line"))
    FF.write_text_lines(hdr.withColumn("o", F.lit(0)).unionByName(body.withColumn("o", F.lit(1))), "line", p2,
                        order="o", single_file=True)  # a CSV file starts with its header
    return (LK.query_list_lines(spark, p1).select(F.lit(1).alias("form"), "query_table")
            .unionByName(LK.query_list_csv(spark, p2).select(F.lit(2).alias("form"), "query_table"))
            .unionByName(LK.query_list_dir(spark, root).select(F.lit(3).alias("form"), "query_table")))


_SQL_TRUTH = f"{DIRTY}, truth AS ({fx.sql_fragment_truth('raw_cells')})"


@register("ground_truth_scan", f"WITH {_SQL_TRUTH} SELECT query_table, data_lake_table FROM truth")
def ground_truth_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = fx.fragment_truth(L.raw_cells(spark, sf_dir, dirty=True))
    p = _path(spark, "truth")
    (truth.select(F.concat("query_table", F.lit(".csv")).alias("query_table"),
                  F.concat("data_lake_table", F.lit(".csv")).alias("data_lake_table"))
     .coalesce(1).write.mode("overwrite").option("header", "true").csv(p))
    return LK.ground_truth_scan(spark, p)


@register("ground_truth_lists", f"""WITH {_SQL_TRUTH}
SELECT query_table, count(*) AS n_truth, min(data_lake_table) AS first_table FROM truth GROUP BY ALL""")
def ground_truth_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = fx.fragment_truth(L.raw_cells(spark, sf_dir, dirty=True))
    p = _path(spark, "truth-json")
    LK.ground_truth_lists(truth).withColumnRenamed("query_table", "query").write.mode("overwrite").json(p)
    lists = LK.ground_truth_lists(LK.ground_truth_json(spark, p))
    return lists.select("query_table", F.size("groundtruth").cast("long").alias("n_truth"),
                        F.array_min("groundtruth").alias("first_table"))


@register("related_columns_scan", f"""WITH {DIRTY}
SELECT DISTINCT table_name AS query_table, column_name FROM raw_cells WHERE column_name <> 'c_acctbal'""")
def related_columns_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = L.raw_cells(spark, sf_dir, dirty=True)
    rel = (cells.select("table_name", "column_name").distinct().where(F.col("column_name") != "c_acctbal")
           .groupBy("table_name").agg(F.collect_list("column_name").alias("columns"))
           .select(F.concat("table_name", F.lit(".csv")).alias("table"), "columns"))
    p = _path(spark, "related")
    rel.write.mode("overwrite").json(p)
    return LK.related_columns_scan(spark, p)


@register("webtable_scan", f"""WITH {QW.SQL_WEB}
SELECT table_id, headerPosition, CAST(len(relation) AS INTEGER) AS n_inner,
       CAST(len(relation[1]) AS INTEGER) AS first_len FROM web""")
def webtable_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _path(spark, "webtables")
    web = QW.web_tables(spark, sf_dir)
    meta = spark.createDataFrame([('{"corpus": "fragment lake", "format": "web tables"}', -1),
                                  ('{"relation": [["unterminated"', 1 << 40)], "line STRING, o LONG")
    body = web.select(F.to_json(F.struct("table_id", "relation", "headerPosition")).alias("line"),
                      F.lit(0).cast("long").alias("o"))
    FF.write_text_lines(meta.unionByName(body), "line", p, order="o", compression="gzip")
    tables, corrupt = corpus.webtable_scan(spark, p)
    return tables.select("table_id", "headerPosition", F.size("relation").alias("n_inner"),
                         F.size(F.try_element_at("relation", F.lit(1))).alias("first_len"))


@register("edge_scan", f"WITH {QW._SQL_EDGES} SELECT u, v, w FROM edges")
def edge_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _path(spark, "edges")
    e = QW.graph_edges(spark, sf_dir)
    FF.write_text_lines(e.select(F.concat_ws(" ", "u", "v", "w").alias("l"), "line_no"), "l", p, order="line_no")
    return corpus.edge_scan(spark, p).select("u", "v", "w")


@register("termlist_scan", "SELECT c_custkey AS id, 'd#' || c_mktsegment AS term FROM customer")
def termlist_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _path(spark, "terms")
    c = fx.read_table(spark, sf_dir, "customer")
    FF.write_text_lines(c.select(F.concat(F.lit("d#"), "c_mktsegment").alias("t"), "c_custkey"), "t", p,
                        order="c_custkey")
    return corpus.termlist_scan(spark, p)


@register("vector_file_scan", f"WITH voc AS ({QS._sql_vocab(8)}) SELECT word, round(list_sum(vec), 6) AS vec_sum FROM voc")
def vector_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _path(spark, "vectors")
    voc = QS.vocabulary(spark, sf_dir, dim=8)
    n = voc.count()
    head = spark.createDataFrame([(f"{n} 8", -1)], "l STRING, o LONG")
    bad = spark.createDataFrame([("broken 1.0 x", 1 << 40)], "l STRING, o LONG")
    body = voc.select(F.concat_ws(" ", "word", F.array_join(F.transform("vec", lambda x: x.cast("string")), " "))
                      .alias("l"), F.lit(0).cast("long").alias("o"))
    FF.write_text_lines(head.unionByName(body).unionByName(bad), "l", p, order="o")
    vecs, _ = corpus.vector_file_scan(spark, p)
    return vecs.select("word", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("vec_sum"))


@register("walk_sink", f"""WITH {QW.SQL_WEB}, {QW._SQL_ROWS}, {QW._SQL_ROW_TOKENS}
SELECT walk AS value FROM row_corpus UNION ALL SELECT walk FROM row_corpus""")
def walk_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    rw = materialize(W.row_walks(W.webtable_rows(QW.web_tables(spark, sf_dir), QW.MIN_COLUMNS), "row", QW.MIN_COLUMNS,
                                 QW.MAX_ROWS), "row-walks")
    p = _path(spark, "walks")
    sinks.walk_sink(rw, p)
    sinks.walk_sink(rw, p, mode="append")  # a second corpus part
    return spark.read.text(p)


@register("search_result_sink", f"""WITH {L.sql_lake_ctes()},
truth AS ({fx.sql_fragment_truth('clean_cells')}),
hits AS ({lsh.sql_exact_hits('vecs', 'vecs', L.THRESHOLD)}),
best AS ({QS._SQL_BEST}),
ranked AS ({S.sql_search_from_hits('hits', L.K)}),
matched AS (SELECT q_table, c_table, string_agg(q_column || '>' || c_column, ',' ORDER BY q_column, c_column) AS matches FROM best GROUP BY ALL)
SELECT r.query_table, r.rank, r.cand_table, r.score,
       EXISTS (SELECT 1 FROM truth t WHERE t.query_table = r.query_table AND t.data_lake_table = r.cand_table)
       AS in_ground_truth, m.matches FROM ranked r JOIN matched m ON m.q_table = r.query_table AND m.c_table = r.cand_table""")
def search_result_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = L.lake_vectors(spark, sf_dir)
    res = S.search(v, v, k=L.K, threshold=L.THRESHOLD, method="exact", with_matches=True).drop("n_matched")
    truth = fx.fragment_truth(L.clean_cells(spark, sf_dir))
    p = _path(spark, "results")
    sinks.search_result_sink(res, truth, p)
    pairs = F.array_join(F.transform("matches", lambda m: F.concat_ws(">", m["query_column"], m["cand_column"])), ",")
    return spark.read.parquet(p).select("query_table", "rank", "cand_table", "score", "in_ground_truth", pairs.alias("matches"))


@register("metrics_sink", f"""WITH {L.sql_lake_ctes()},
truth AS ({fx.sql_fragment_truth('idx_cells')}), queries AS (SELECT DISTINCT table_name AS query_table FROM idx_cells),
hits AS ({lsh.sql_exact_hits('vecs', 'vecs', L.THRESHOLD)}), ranked AS ({S.sql_search_from_hits('hits', 20)}), {QE._SQL_FLAGGED},
m AS (WITH {QE._sql_macro([10, 20])})
SELECT k, num_queries, precision, recall, 'exact' AS arg_method, '{L.THRESHOLD}' AS arg_threshold, true AS timed FROM m""")
def metrics_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = L.lake_vectors(spark, sf_dir)
    began = time.monotonic()
    res = materialize(S.search(v, v, k=20, threshold=L.THRESHOLD, method="exact"), "results")
    took = time.monotonic() - began
    cells = L.indexable(spark, sf_dir)
    m = EV.evaluate(res, fx.fragment_truth(cells), [10, 20], cells.select(F.col("table_name").alias("query_table")))
    p = _path(spark, "metrics")
    sinks.metrics_sink(m, {"threshold": L.THRESHOLD, "method": "exact"}, p, lookup_seconds=took)
    return spark.read.json(p).select(F.col("k").cast("int").alias("k"), "num_queries", "precision", "recall", "arg_method", "arg_threshold",
                                     (F.col("seconds_per_query") > 0).alias("timed"))
