"""Row linearisation queries (F3, L2-L7, E10, E11, B13).  Fixture: every
document is a row of the table ``doc__<lang>``; its lines are the cells
(column i = line i), so long documents cross the 512-token limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unionlake.functions import text as tx
from unionlake.functions import vectors as V
from unionlake.operators import clean, contrastive as CT, linearize as LZ, sampling
from unionlake.plans import lake as L
from unionlake.plans import q_train as QT
from unionlake.plans.registry import register
from unionlake.sources import fixtures as fx
from unionlake.session import materialize

TOKEN_DIM = 8
BATCH = 2


def doc_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.read_table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("doc__"), "lang").alias("table_name"), F.col("doc_id").alias("row_id"),
                    F.posexplode(F.split("text", "\n")).alias("col_pos", "value")).select(
        "table_name", F.concat(F.lit("line_"), F.col("col_pos").cast("string")).alias("column_name"),
        F.col("col_pos").cast("int").alias("col_pos"), "row_id", "value")


def _offsets(spark, sf_dir):
    return LZ.cell_offsets(LZ.tokenize_cells(doc_cells(spark, sf_dir)))


SQL_OFF = f"""dc AS (SELECT 'doc__' || lang AS table_name, 'line_' || CAST(i AS VARCHAR) AS column_name,
                    CAST(i AS INTEGER) AS col_pos, doc_id AS row_id, line AS value
             FROM (SELECT lang, doc_id, unnest(string_split(text, chr(10))) AS line,
                          unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
tc AS (SELECT *, {tx.sql_tokenize_cell('value')} AS tokens FROM dc WHERE col_pos < {LZ.MAX_COLS}),
off0 AS (SELECT *, CAST(len(tokens) AS INTEGER) AS n_tokens,
                CAST(coalesce(sum(len(tokens) + 1) OVER (PARTITION BY table_name, row_id ORDER BY col_pos
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS INTEGER) AS start FROM tc),
off AS (SELECT *, CAST(least(n_tokens, {LZ.MAX_TOKENS - 1} - start) AS INTEGER) AS kept FROM off0
        WHERE start <= {LZ.MAX_TOKENS - 2})"""

SQL_LIN = f"""{SQL_OFF},
lin AS (SELECT table_name, row_id,
          list_concat(['[CLS]'], flatten(list(list_concat(tokens[1:kept], ['[SEP]']) ORDER BY col_pos))) AS tokens,
          list_concat([{LZ.FILLER}], flatten(list(list_concat(list_resize([]::INTEGER[], kept, col_pos), [{LZ.FILLER}])
                      ORDER BY col_pos))) AS col_ids,
          CAST(count(*) AS INTEGER) AS n_cols
        FROM off GROUP BY table_name, row_id)"""


@register("cell_token_offsets", f"WITH {SQL_OFF} SELECT table_name, row_id, col_pos, n_tokens, start, kept FROM off")
def cell_token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offsets(spark, sf_dir).select("table_name", "row_id", "col_pos", "n_tokens", "start", "kept")


def _lin(spark, sf_dir):
    return LZ.linearize_rows(_offsets(spark, sf_dir))


@register("linearize_rows", f"""WITH {SQL_LIN}
SELECT table_name, row_id, CAST(len(tokens) AS INTEGER) AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM lin""")
def linearize_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lin = _lin(spark, sf_dir)
    return lin.select("table_name", "row_id", F.size("tokens").alias("n_tokens"),
                      F.array_join("tokens", " ").alias("tokens"))


@register("token_column_ids", f"""WITH {SQL_LIN}
SELECT table_name, row_id, n_cols, array_to_string(col_ids, ' ') AS col_ids FROM lin""")
def token_column_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    lin = _lin(spark, sf_dir)
    return lin.select("table_name", "row_id", "n_cols",
                      F.array_join(F.transform("col_ids", lambda x: x.cast("string")), " ").alias("col_ids"))


def _sql_batches(view: str) -> str:
    return QT._sql_batches(view, BATCH)


@register("pad_and_mask", f"""WITH {SQL_LIN}, b AS ({_sql_batches('lin')}),
x AS (SELECT b.batch_id, lin.*, CAST(len(tokens) AS INTEGER) AS seq_len,
             max(len(tokens)) OVER (PARTITION BY b.batch_id) AS max_seq_len,
             max(n_cols) OVER (PARTITION BY b.batch_id) AS max_col_num
      FROM lin JOIN b ON b.table_name = lin.table_name)
SELECT batch_id, table_name, row_id, seq_len, CAST(max_seq_len AS INTEGER) AS max_seq_len,
       CAST(max_col_num AS INTEGER) AS max_col_num,
       array_to_string(list_concat(list_resize([]::INTEGER[], n_cols, 1),
                                   list_resize([]::INTEGER[], max_col_num - n_cols, 0)), '') AS table_mask,
       CAST(seq_len AS BIGINT) AS mask_sum,
       array_to_string(list_transform(list_concat(col_ids, list_resize([]::INTEGER[], max_seq_len - seq_len, {LZ.FILLER})),
                       lambda v: CASE WHEN v = {LZ.FILLER} THEN max_col_num ELSE v END), ' ') AS cell_token_col_ids
FROM x""")
def pad_and_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    lin = _lin(spark, sf_dir)
    batches = sampling.assign_batches(lin, BATCH)
    p = LZ.pad_and_mask(lin, batches)
    return p.select("batch_id", "table_name", "row_id", "seq_len", "max_seq_len", "max_col_num",
                    F.array_join(F.transform("table_mask", lambda x: x.cast("string")), "").alias("table_mask"),
                    F.aggregate("sequence_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("mask_sum"),
                    F.array_join(F.transform("cell_token_col_ids", lambda x: x.cast("string")), " ")
                    .alias("cell_token_col_ids"))


@register("truncated_query_columns", f"WITH {SQL_OFF} SELECT DISTINCT table_name, column_name FROM off")
def truncated_query_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LZ.truncated_query_columns(_offsets(spark, sf_dir))


def token_vectors(offsets: DataFrame, dim: int = TOKEN_DIM) -> DataFrame:
    toks = offsets.select(F.explode(F.slice("tokens", 1, F.col("kept"))).alias("token")).distinct()
    comp = lambda i: ((F.conv(F.substring(F.md5(F.concat_ws(":", F.col("token"), i.cast("string"))), 1, 8), 16, 10)
                       .cast("double") + 0.5) / 4294967296.0 * 2.0 - 1.0)
    return toks.select("token", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), comp).alias("vec"))


SQL_POOL = f"""{SQL_OFF},
tv AS (SELECT token, list(((('0x' || substr(md5(token || ':' || i), 1, 8))::BIGINT + 0.5) / 4294967296.0 * 2.0 - 1.0)
              ORDER BY i) AS vec
       FROM (SELECT DISTINCT unnest(tokens[1:kept]) AS token FROM off), range({TOKEN_DIM}) r(i) GROUP BY token),
ex AS (SELECT table_name, row_id, col_pos, column_name, unnest(tokens[1:kept]) AS token FROM off),
dims AS (SELECT ex.table_name, ex.row_id, ex.col_pos, ex.column_name, unnest(range({TOKEN_DIM})) AS d, unnest(tv.vec) AS x
         FROM ex JOIN tv ON tv.token = ex.token),
cell_vec AS (SELECT table_name, row_id, col_pos, column_name, d, avg(x) AS x FROM dims GROUP BY ALL)"""


@register("token_pool_columns", f"""WITH {SQL_POOL}
SELECT table_name, row_id, col_pos, round(sum(x), 6) AS vec_sum, round(max(x), 6) AS vec_max FROM cell_vec GROUP BY ALL""")
def token_pool_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = materialize(_offsets(spark, sf_dir), "offsets")
    cv = LZ.token_pool_columns(off, materialize(token_vectors(off), "token-vectors"))
    return cv.select("table_name", "row_id", "col_pos",
                     F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("vec_sum"),
                     F.round(F.array_max("vec"), 6).alias("vec_max"))


@register("row_pool_columns", f"""WITH {SQL_POOL},
nr AS (SELECT table_name, count(DISTINCT row_id) AS n_rows FROM off GROUP BY ALL),
cv AS (SELECT c.table_name, c.column_name, c.d, sum(c.x) / any_value(nr.n_rows) AS x
       FROM cell_vec c JOIN nr ON nr.table_name = c.table_name GROUP BY ALL)
SELECT table_name, column_name, round(sum(x), 6) AS vec_sum, round(max(x), 6) AS vec_max FROM cv GROUP BY ALL""")
def row_pool_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = materialize(_offsets(spark, sf_dir), "offsets")
    cv = materialize(LZ.token_pool_columns(off, materialize(token_vectors(off), "token-vectors")), "cell-vectors")
    rv = LZ.row_pool_columns(cv, off.select("table_name", "row_id"))
    return rv.select("table_name", "column_name",
                     F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("vec_sum"),
                     F.round(F.array_max("vec"), 6).alias("vec_max"))


@register("instance_inputs", f"""WITH {SQL_OFF.replace('FROM tc)', 'FROM tc2)').replace(
    f"tc AS (SELECT *, {tx.sql_tokenize_cell('value')} AS tokens FROM dc WHERE col_pos < {LZ.MAX_COLS}),",
    f"tc AS (SELECT *, {tx.sql_tokenize_cell('value')} AS tokens FROM dc WHERE col_pos < {LZ.MAX_COLS}), "
    f"tc2 AS ({sampling.sql_sample_rows('tc', 3, 5)}),")}
SELECT table_name, row_id, CAST(count(*) AS INTEGER) AS n_cells, CAST(sum(kept) + count(*) + 1 AS INTEGER) AS n_tokens
FROM off GROUP BY ALL""")
def instance_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tc = LZ.tokenize_cells(doc_cells(spark, sf_dir))
    lin = LZ.linearize_rows(LZ.cell_offsets(sampling.sample_rows(tc, 3, seed=5)))
    return lin.select("table_name", "row_id", F.col("n_cols").alias("n_cells"), F.size("tokens").alias("n_tokens"))


@register("nonzero_columns", f"""WITH {QT.CLEAN},
v1c AS ({sampling.sql_sample_rows('text_cells', 5, 1)}), v2c AS ({sampling.sql_sample_rows('text_cells', 5, 2)}),
e1 AS ({QT.embed.sql_embed_columns('v1c')}), e2 AS ({QT.embed.sql_embed_columns('v2c')})
SELECT e1.table_name, e1.column_name FROM e1 JOIN e2 ON e1.table_name = e2.table_name AND e1.column_name = e2.column_name
WHERE list_sum(list_transform(e1.vec, lambda x: abs(x))) > 0 AND list_sum(list_transform(e2.vec, lambda x: abs(x))) > 0""")
def nonzero_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = QT._text_cells(spark, sf_dir)
    pairs = CT.pretraining_pairs(cells, 5, QT.BATCH, L.DIM)
    return clean.nonzero_columns(pairs).select("table_name", "column_name")
