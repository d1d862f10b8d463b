"""Evaluation queries (D4, E5-E8, U6) on the fragment lake: truth = the
fragments of the same seed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unionlake.operators import evaluate as EV, lsh, search as S
from unionlake.plans import lake as L
from unionlake.plans.registry import register
from unionlake.sources import fixtures as fx

SWEEP = [10, 20, 30, 40, 50]
LAKE = L.sql_lake_ctes()
TRUTH = f"truth AS ({fx.sql_fragment_truth('clean_cells')})"
QUERIES = "queries AS (SELECT DISTINCT table_name AS query_table FROM clean_cells)"


def _setup(spark, sf_dir, k=None, method="exact", query_filter=None):
    cells = L.clean_cells(spark, sf_dir)
    vecs = L.lake_vectors(spark, sf_dir)
    qv = vecs if query_filter is None else vecs.join(query_filter, ["table_name", "column_name"], "left_semi")
    res = S.search(qv, vecs, k=k, threshold=L.THRESHOLD, method=method)
    truth = fx.fragment_truth(cells)
    queries = cells.select(F.col("table_name").alias("query_table")).distinct()
    return res, truth, queries


def _sql_ranked(hits: str = "hits", k: int | None = None) -> str:
    return f"ranked AS ({S.sql_search_from_hits(hits, k)})"


_SQL_FLAGGED = """flagged AS (
  SELECT r.*, t.query_table IS NOT NULL AS in_truth FROM ranked r
  LEFT JOIN (SELECT DISTINCT query_table, data_lake_table FROM truth) t
    ON t.query_table = r.query_table AND t.data_lake_table = r.cand_table)"""


def _sql_per_query(ks) -> str:
    arr = "[" + ", ".join(str(k) for k in ks) + "]"
    return f"""per_query AS (
  SELECT g.query_table, g.k, coalesce(h.hits, 0) AS hits, coalesce(h.hits, 0) / g.k AS precision,
         coalesce(h.hits, 0) / n.n_truth AS recall
  FROM (SELECT query_table, unnest({arr}) AS k FROM queries) g
  JOIN (SELECT query_table, count(*) AS n_truth FROM truth GROUP BY ALL) n ON n.query_table = g.query_table
  LEFT JOIN (SELECT f.query_table, kk.k, count(*) AS hits FROM flagged f, (SELECT unnest({arr}) AS k) kk
             WHERE f.in_truth AND f.rank <= kk.k GROUP BY ALL) h ON h.query_table = g.query_table AND h.k = g.k)"""


_EXACT = f"hits AS ({lsh.sql_exact_hits('vecs', 'vecs', L.THRESHOLD)})"
_LSH = f"hits AS ({lsh.sql_lsh_hits('vecs', 'vecs', L.THRESHOLD)})"


@register("ground_truth_semi_join", f"""WITH {LAKE}, {TRUTH}, {_EXACT}, {_sql_ranked('hits', L.K)}, {_SQL_FLAGGED}
SELECT query_table, rank, cand_table, in_truth FROM flagged""")
def ground_truth_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    res, truth, _ = _setup(spark, sf_dir, k=L.K)
    return EV.flag_hits(res, truth).select("query_table", "rank", "cand_table", "in_truth")


@register("precision_recall_at_k", f"""WITH {LAKE}, {TRUTH}, {QUERIES}, {_EXACT}, {_sql_ranked()}, {_SQL_FLAGGED},
{_sql_per_query([L.K])}
SELECT query_table, k, hits, round(precision, 6) AS precision, round(recall, 6) AS recall FROM per_query""")
def precision_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    res, truth, queries = _setup(spark, sf_dir, k=L.K)
    pq = EV.per_query_metrics(res, truth, [L.K], queries)
    return pq.select("query_table", "k", "hits", F.round("precision", 6).alias("precision"),
                     F.round("recall", 6).alias("recall"))


def _sql_macro(ks) -> str:
    return f"""{_sql_per_query(ks)}
SELECT k, count(*) AS num_queries, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall
FROM per_query GROUP BY k"""


@register("macro_metrics", f"""WITH {LAKE}, {TRUTH}, {QUERIES}, {_EXACT}, {_sql_ranked()}, {_SQL_FLAGGED},
{_sql_macro([L.K])}""")
def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    res, truth, queries = _setup(spark, sf_dir, k=L.K)
    return EV.evaluate(res, truth, [L.K], queries)


@register("topk_sweep", f"""WITH {LAKE}, {TRUTH}, {QUERIES}, {_EXACT}, {_sql_ranked()}, {_SQL_FLAGGED},
{_sql_macro(SWEEP)}""")
def topk_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    res, truth, queries = _setup(spark, sf_dir, k=max(SWEEP))  # ranks beyond the largest k are never read
    return EV.evaluate(res, truth, SWEEP, queries)


@register("search_and_evaluate", f"""WITH {LAKE}, {TRUTH}, {QUERIES}, {_LSH}, {_sql_ranked()}, {_SQL_FLAGGED},
{_sql_macro(SWEEP)}""")
def search_and_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    res, truth, queries = _setup(spark, sf_dir, k=max(SWEEP), method="lsh")
    return EV.evaluate(res, truth, SWEEP, queries)


# Only the annotated query columns take part (annotation = every column
# except the type/status columns, derived from the lake's column names)
UNANNOTATED = ("p_type", "o_orderstatus")


def related_columns(cells: DataFrame) -> DataFrame:
    return (cells.select(F.col("table_name").alias("query_table"), "column_name").distinct()
            .where(~F.col("column_name").isin(*UNANNOTATED)))


_REL_HITS = f"""hits AS (
  SELECT * FROM ({lsh.sql_exact_hits('vecs', 'vecs', L.THRESHOLD)})
  WHERE q_column NOT IN ({', '.join(repr(c) for c in UNANNOTATED)}))"""


@register("related_column_metrics", f"""WITH {LAKE}, {TRUTH}, {QUERIES}, {_REL_HITS}, {_sql_ranked()}, {_SQL_FLAGGED},
{_sql_macro([L.K])}""")
def related_column_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = L.clean_cells(spark, sf_dir)
    rel = related_columns(cells).select(F.col("query_table").alias("table_name"), "column_name")
    res, truth, queries = _setup(spark, sf_dir, k=L.K, query_filter=rel)
    return EV.evaluate(res, truth, [L.K], queries)
