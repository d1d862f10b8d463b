"""Sampling and contrastive-training queries (I1, I2, I4, D8, D9, E12, E13,
H3, L5, U9, U10).  Positive pairs of the ``embeddings`` fixture: view i =
even vec_id, view j = vec_id + 1, batch = vec_id div 32."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unionlake.functions import vectors as V
from unionlake.operators import contrastive as CT, embed, lsh, records, sampling
from unionlake.plans import lake as L
from unionlake.plans.q_text import sql_project
from unionlake.plans.registry import register
from unionlake.sources import fixtures as fx
from unionlake.session import materialize

TAU = 0.1
CLEAN = f"""raw_cells AS ({L.sql_cells()}), cells1 AS ({L.sql_drop_empty_columns('raw_cells')}),
clean_cells AS ({L.sql_drop_rows('cells1', 'any')}), text_cells AS ({L.sql_indexable('clean_cells')})"""
CELL_COLS = "table_name, column_name, col_pos, row_id, value"


def _text_records(spark, sf_dir):
    """Records with a text column; one without any has no row in the cells."""
    return L.indexable_records(spark, sf_dir).where(F.size("cells") > 0)


def _text_cells(spark, sf_dir):
    return L.indexable(spark, sf_dir)


@register("sample_rows", f"WITH {CLEAN} SELECT {CELL_COLS} FROM ({sampling.sql_sample_rows('text_cells', 5, 1)})")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.cells(sampling.sample_rows(_text_records(spark, sf_dir), 5, seed=1))


@register("sample_column_values", f"""WITH {CLEAN}
SELECT {CELL_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY table_name, column_name
  ORDER BY md5('7:' || table_name || ':' || column_name || ':' || CAST(row_id AS VARCHAR)), row_id) AS rn
  FROM text_cells) WHERE rn <= 3""")
def sample_column_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_column_values(_text_cells(spark, sf_dir), 3, seed=7)


@register("two_view_sample", f"""WITH {CLEAN}
SELECT DISTINCT 0 AS view, table_name, row_id FROM ({sampling.sql_sample_rows('text_cells', 5, 1)})
UNION ALL SELECT DISTINCT 1 AS view, table_name, row_id FROM ({sampling.sql_sample_rows('text_cells', 5, 2)})""")
def two_view_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = sampling.two_view_sample(_text_cells(spark, sf_dir), 5, (1, 2))
    return (a.select(F.lit(0).alias("view"), "table_name", "row_id").distinct()
            .unionByName(b.select(F.lit(1).alias("view"), "table_name", "row_id").distinct()))


# --- embeddings positive pairs ---------------------------------------------------
def _views(spark, sf_dir):
    e = fx.read_table(spark, sf_dir, "embeddings").select("vec_id", V.to_double_array("embedding").alias("vec"))
    vi = e.where(F.col("vec_id") % 2 == 0).select((F.col("vec_id") / 32).cast("long").alias("batch_id"),
                                                   (F.col("vec_id") / 2).cast("long").alias("pair"), "vec")
    vj = e.where(F.col("vec_id") % 2 == 1).select(((F.col("vec_id") - 1) / 32).cast("long").alias("batch_id"),
                                                   ((F.col("vec_id") - 1) / 2).cast("long").alias("pair"), "vec")
    return vi, vj


_SQL_VIEWS = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
vi AS (SELECT vec_id // 32 AS batch_id, vec_id // 2 AS pair, vec FROM e WHERE vec_id % 2 = 0),
vj AS (SELECT (vec_id - 1) // 32 AS batch_id, (vec_id - 1) // 2 AS pair, vec FROM e WHERE vec_id % 2 = 1),
st AS (SELECT batch_id, pair, 0 AS side, vec FROM vi UNION ALL SELECT batch_id, pair, 1 AS side, vec FROM vj
       WHERE (batch_id, pair) IN (SELECT batch_id, pair FROM vi))"""


def _pairs(spark, sf_dir):
    vi, vj = _views(spark, sf_dir)
    return CT.pair_views(vi, vj, keys=("batch_id", "pair"))


@register("view_pair_join", f"""WITH {_SQL_VIEWS}
SELECT vi.batch_id, vi.pair, round({lsh.sql_cosine('vi.vec', 'vj.vec')}, 6) AS cosine
FROM vi JOIN vj ON vi.batch_id = vj.batch_id AND vi.pair = vj.pair""")
def view_pair_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("batch_id", "pair", V.round_score(V.cosine("view_i", "view_j")).alias("cosine"))


@register("view_concat", f"WITH {_SQL_VIEWS} SELECT batch_id, pair, side, round(list_sum(vec), 6) AS vec_sum FROM st")
def view_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = CT.stack_views(_pairs(spark, sf_dir), keys=("batch_id", "pair"))
    return st.select("batch_id", "pair", "side", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6)
                     .alias("vec_sum"))


_SQL_SIM = f"""{_SQL_VIEWS},
sim AS (SELECT a.batch_id, a.pair, a.side, b.pair AS pair_k, b.side AS side_k,
               {lsh.sql_cosine('a.vec', 'b.vec')} / {TAU} AS s
        FROM st a JOIN st b ON a.batch_id = b.batch_id AND NOT (a.pair = b.pair AND a.side = b.side)),
per_vec AS (SELECT batch_id, pair, side, sum(exp(s)) AS neg_sum,
                   max(CASE WHEN pair_k = pair AND side_k <> side THEN s END) AS s_pos FROM sim GROUP BY ALL)"""


@register("batch_all_pairs", f"""WITH {_SQL_SIM}
SELECT batch_id, pair, side, round(neg_sum, 4) AS neg_sum, round(ln(neg_sum) - s_pos, 6) AS loss FROM per_vec""")
def batch_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = CT.stack_views(_pairs(spark, sf_dir), keys=("batch_id", "pair"))
    pv = CT.per_vector_loss(st, TAU)
    return pv.select("batch_id", "pair", "side", F.round("neg_sum", 4).alias("neg_sum"),
                     F.round("loss", 6).alias("loss"))


@register("ntxent_loss", f"""WITH {_SQL_SIM}
SELECT batch_id, round(avg(ln(neg_sum) - s_pos), 6) AS loss, count(*) AS n_vectors FROM per_vec GROUP BY batch_id""")
def ntxent_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = CT.stack_views(_pairs(spark, sf_dir), keys=("batch_id", "pair"))
    return CT.ntxent_loss(st, TAU).select("batch_id", F.round("loss", 6).alias("loss"), "n_vectors")


# --- lake batches, pre-training pairs, projection ----------------------------------------
BATCH = 8


def _sql_batches(view: str, batch: int, seed: int = 12345) -> str:
    return f"""SELECT table_name, CAST((('0x' || substr(md5('{seed}:' || table_name), 1, 8))::BIGINT
      % (SELECT CAST(ceil(count(DISTINCT table_name) / {batch}) AS BIGINT) FROM {view})) AS INTEGER) AS batch_id
      FROM (SELECT DISTINCT table_name FROM {view})"""


@register("flatten_batch_columns", f"""WITH {L.sql_lake_ctes()}, b AS ({_sql_batches('vecs', BATCH)})
SELECT v.table_name, v.column_name, b.batch_id FROM vecs v JOIN b ON b.table_name = v.table_name""")
def flatten_batch_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CT.flatten_batch_columns(L.lake_vectors(spark, sf_dir), BATCH).select("table_name", "column_name",
                                                                                  "batch_id")


@register("pretraining_pairs", f"""WITH {CLEAN},
v1c AS ({sampling.sql_sample_rows('text_cells', 5, 1)}), v2c AS ({sampling.sql_sample_rows('text_cells', 5, 2)}),
e1 AS ({embed.sql_embed_columns('v1c')}), e2 AS ({embed.sql_embed_columns('v2c')}),
b AS ({_sql_batches('text_cells', BATCH)})
SELECT b.batch_id, e1.table_name, e1.column_name, round({lsh.sql_cosine('e1.vec', 'e2.vec')}, 6) AS cosine,
       round(sqrt(list_dot_product(e1.vec, e1.vec)), 6) AS norm_i, round(sqrt(list_dot_product(e2.vec, e2.vec)), 6) AS norm_j
FROM e1 JOIN e2 ON e1.table_name = e2.table_name AND e1.column_name = e2.column_name
JOIN b ON b.table_name = e1.table_name""")
def pretraining_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = CT.pretraining_pairs(_text_cells(spark, sf_dir), 5, BATCH, L.DIM)
    return p.select("batch_id", "table_name", "column_name", V.round_score(V.cosine("view_i", "view_j")).alias("cosine"),
                    F.round(V.norm("view_i"), 6).alias("norm_i"), F.round(V.norm("view_j"), 6).alias("norm_j"))


@register("infer_projected_vectors", f"""WITH {L.sql_lake_ctes()},
x AS (SELECT table_name || '!' || column_name AS vec_id, vec FROM vecs), p AS ({sql_project('x', 64, 64, 64)})
SELECT vec_id AS col_id, round(sqrt(list_dot_product(out, out)), 6) AS out_norm, round(list_sum(out), 6) AS out_sum
FROM p""")
def infer_projected_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = CT.infer_projected_vectors(L.lake_vectors(spark, sf_dir), V.init_projection(64, 64, 64))
    return p.select(F.concat_ws("!", "table_name", "column_name").alias("col_id"),
                    F.round(V.norm("vec"), 6).alias("out_norm"),
                    F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("out_sum"))


@register("fit_projection")
def fit_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E13 (rows-only check): steps and losses of 3 epochs on the lake's pairs, a quarter of the batches held out."""
    pairs = materialize(CT.pretraining_pairs(_text_cells(spark, sf_dir), 5, BATCH, L.DIM), "pairs")
    held = F.col("batch_id") % 4 == 0
    _, hist = CT.fit_projection(pairs.where(~held), V.init_projection(L.DIM, L.DIM, L.DIM), epochs=3, lr=5e-3, valid=pairs.where(held))
    return spark.createDataFrame([(e.epoch, e.steps, e.loss, e.valid_loss) for e in hist], "epoch INT, steps INT, loss DOUBLE, valid_loss DOUBLE")
