"""Search building blocks (D1, D5, D10, E1-E4, F1, G1, G3, U2, U4, U5, U7,
U8, A13) over the fragment lake and the ``embeddings`` table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unionlake.functions import text as tx
from unionlake.functions import vectors as V
from unionlake.operators import embed, lsh, search as S
from unionlake.plans import lake as L
from unionlake.plans.registry import register
from unionlake.session import scratch_path
from unionlake.sources import fixtures as fx
from unionlake.session import materialize

LAKE = L.sql_lake_ctes()
EXACT_HITS = f"hits AS ({lsh.sql_exact_hits('vecs', 'vecs', L.THRESHOLD)})"
D = V.SCORE_DIGITS


def _vecs(spark, sf_dir):
    return L.lake_vectors(spark, sf_dir)


def _exact_hits(spark, sf_dir):
    v = _vecs(spark, sf_dir)
    return lsh.cosine_join(v, v, L.THRESHOLD)


_SQL_ECDF = f"""SELECT q_table, q_column, c_table, c_column, score,
  round(cume_dist() OVER (PARTITION BY q_table, q_column ORDER BY score), {D}) AS weight FROM hits"""


def _ecdf(spark, sf_dir):
    merged = S.merge_backends(_exact_hits(spark, sf_dir))
    w = S.score_ecdf(merged, 1)
    return w.select("q_table", "q_column", "c_table", "c_column", F.col("scores")[0].alias("score"),
                    F.round(F.col("weights")[0], D).alias("weight"))


@register("score_ecdf", f"WITH {LAKE}, {EXACT_HITS} {_SQL_ECDF}")
def score_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ecdf(spark, sf_dir)


@register("score_distribution_join", f"WITH {LAKE}, {EXACT_HITS} {_SQL_ECDF}")
def score_distribution_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ecdf(spark, sf_dir)


_SQL_BEST = f"""SELECT q_table, q_column, c_table, c_column, score, weight FROM (
  SELECT *, row_number() OVER (PARTITION BY q_table, q_column, c_table ORDER BY score DESC, c_column) AS rn
  FROM ({_SQL_ECDF})) WHERE rn = 1"""


@register("best_column_per_table", f"WITH {LAKE}, {EXACT_HITS} {_SQL_BEST}")
def best_column_per_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = S.merge_backends(_exact_hits(spark, sf_dir))
    best = S.best_column_per_table(S.score_ecdf(merged, 1))
    return best.select("q_table", "q_column", "c_table", "c_column", F.col("scores")[0].alias("score"),
                       F.round(F.col("weights")[0], D).alias("weight"))


@register("ecdf_weighted_score", f"""WITH {LAKE}, {EXACT_HITS}, best AS ({_SQL_BEST.replace(
    f'round(cume_dist() OVER (PARTITION BY q_table, q_column ORDER BY score), {D})',
    'cume_dist() OVER (PARTITION BY q_table, q_column ORDER BY score)')})
SELECT q_table, c_table, count(*) AS n_matched, round(sum(score * weight) / sum(weight), {D}) AS table_score
FROM best GROUP BY ALL""")
def ecdf_weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = S.merge_backends(_exact_hits(spark, sf_dir))
    scored, _ = S.table_scores_from_hits(merged, 1)
    return scored.select("q_table", "c_table", "n_matched", F.col("table_scores")[0].alias("table_score"))


# --- name backend and merged backends ---------------------------------------------
def _sql_name_hits(cols_view: str, threshold: float, q: int = 3) -> str:
    padded = "('#' || lower(column_name) || '#')"
    return f"""
    WITH g AS (
      SELECT DISTINCT table_name, column_name, unnest(CASE WHEN length({padded}) < {q} THEN [{padded}]
             ELSE list_transform(range(1, length({padded}) - {q} + 2), lambda i: substring({padded}, i, {q})) END) AS gram
      FROM (SELECT DISTINCT table_name, column_name FROM {cols_view})),
    n AS (SELECT table_name, column_name, count(*) AS n FROM g GROUP BY ALL),
    i AS (SELECT a.table_name AS q_table, a.column_name AS q_column, b.table_name AS c_table,
                 b.column_name AS c_column, count(*) AS i
          FROM g a JOIN g b ON a.gram = b.gram GROUP BY ALL)
    SELECT i.q_table, i.q_column, i.c_table, i.c_column, round(i.i / (nq.n + nc.n - i.i), {D}) AS score
    FROM i JOIN n nq ON nq.table_name = i.q_table AND nq.column_name = i.q_column
           JOIN n nc ON nc.table_name = i.c_table AND nc.column_name = i.c_column
    WHERE round(i.i / (nq.n + nc.n - i.i), {D}) >= {threshold}"""


NAME_THRESHOLD = 0.5


@register("name_search", f"WITH {LAKE} SELECT * FROM ({_sql_name_hits('vecs', NAME_THRESHOLD)})")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names need no vectors: the columns that would be indexed."""
    names = materialize(L.indexable(spark, sf_dir).select("table_name", "column_name").distinct(), "column-names")
    return S.name_hits(names, names, NAME_THRESHOLD)


_SQL_MERGED = f"""merged AS (
  SELECT coalesce(h.q_table, n.q_table) AS q_table, coalesce(h.q_column, n.q_column) AS q_column,
         coalesce(h.c_table, n.c_table) AS c_table, coalesce(h.c_column, n.c_column) AS c_column,
         coalesce(h.score, 0.0) AS s0, coalesce(n.score, 0.0) AS s1
  FROM hits h FULL OUTER JOIN ({_sql_name_hits('vecs', NAME_THRESHOLD)}) n
    ON h.q_table = n.q_table AND h.q_column = n.q_column AND h.c_table = n.c_table AND h.c_column = n.c_column)"""


def _merged(spark, sf_dir):
    v = _vecs(spark, sf_dir)
    return S.merge_backends(lsh.cosine_join(v, v, L.THRESHOLD), S.name_hits(v, v, NAME_THRESHOLD))


@register("merge_backends", f"WITH {LAKE}, {EXACT_HITS}, {_SQL_MERGED} SELECT * FROM merged")
def merge_backends(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _merged(spark, sf_dir)
    return m.select(*S.PAIR, F.col("scores")[0].alias("s0"), F.col("scores")[1].alias("s1"))


@register("aggregate_scores", f"""WITH {LAKE}, {EXACT_HITS}, {_SQL_MERGED},
w AS (SELECT *, cume_dist() OVER (PARTITION BY q_table, q_column ORDER BY s0) AS w0,
                cume_dist() OVER (PARTITION BY q_table, q_column ORDER BY s1) AS w1 FROM merged),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_table, q_column, c_table
                                                     ORDER BY round(s0 + s1, {D}) DESC, c_column) AS rn FROM w)
         WHERE rn = 1),
t AS (SELECT q_table, c_table, round(sum(s0 * w0) / sum(w0), {D}) AS t0, round(sum(s1 * w1) / sum(w1), {D}) AS t1
      FROM best GROUP BY ALL)
SELECT q_table, c_table, t0 AS score_vector, t1 AS score_name, round((t0 + t1) / 2, {D}) AS score FROM t""")
def aggregate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = S.table_scores_from_hits(_merged(spark, sf_dir), 2)
    return scored.select("q_table", "c_table", F.col("table_scores")[0].alias("score_vector"),
                         F.col("table_scores")[1].alias("score_name"),
                         F.round(S.mean_aggregator(F.col("table_scores")), D).alias("score"))


# --- column search (G1/U2) and matches (G3) ------------------------------------------
COL_K = 5


@register("column_search", f"""WITH {LAKE}, {EXACT_HITS},
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q_table, q_column ORDER BY score DESC, c_table, c_column) AS INTEGER) AS rank
      FROM hits)
SELECT q_table, q_column, c_table, c_column, rank, score FROM r WHERE rank <= {COL_K}""")
def column_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vecs(spark, sf_dir)
    return S.column_search(v, v, k=COL_K, threshold=L.THRESHOLD, method="exact").drop("scores")


@register("topk_with_matches", f"""WITH {LAKE}, {EXACT_HITS},
best AS ({_SQL_BEST.replace('FROM hits', 'FROM hits')}),
ranked AS ({S.sql_search_from_hits('hits', L.K)})
SELECT r.query_table, r.rank, r.cand_table, b.q_column AS query_column, b.c_column AS cand_column,
       b.score AS column_score
FROM ranked r JOIN best b ON b.q_table = r.query_table AND b.c_table = r.cand_table""")
def topk_with_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vecs(spark, sf_dir)
    res = S.search(v, v, k=L.K, threshold=L.THRESHOLD, method="exact", with_matches=True)
    return res.select("query_table", "rank", "cand_table", F.inline("matches")).select(
        "query_table", "rank", "cand_table", "query_column", "cand_column",
        F.col("scores")[0].alias("column_score"))


# --- externally encoded vectors (U7) ---------------------------------------------------
ENC_THRESHOLD = 0.3


@register("table_search_encoded", f"""WITH vecs AS ({fx.sql_embedding_vectors()}),
hits AS ({lsh.sql_lsh_hits('vecs', 'vecs', ENC_THRESHOLD)})
SELECT * FROM ({S.sql_search_from_hits('hits', L.K)})""")
def table_search_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx.embedding_vectors(spark, sf_dir)
    return S.search(v, v, k=L.K, threshold=ENC_THRESHOLD, method="lsh")


# --- stored index (A13/U4/U5) -------------------------------------------------------------
def _stored_index(spark, sf_dir):
    """The lake's index, written in two generations and loaded again."""
    v = _vecs(spark, sf_dir)
    path = scratch_path(spark, f"index-{uuid.uuid4().hex}")
    late = F.col("table_name").endswith("__1")
    lsh.build_index(v.where(~late), path, L.THRESHOLD, dim=L.DIM)
    lsh.append_to_index(v.where(late), path)
    return v, lsh.load_or_build_index(v, path, L.THRESHOLD)


@register("signature_index_build", f"""WITH {LAKE},
bits AS (SELECT v.table_name, v.column_name, h.bit,
                CASE WHEN round(sum(v.vec[h.dim + 1] * h.sgn), {V.SIGN_DIGITS}) >= 0 THEN 1 ELSE 0 END AS b
         FROM vecs v, ({lsh.sql_hyperplanes(lsh.DEFAULT_BITS, L.DIM, lsh.DEFAULT_SEED)}) h
         WHERE list_dot_product(v.vec, v.vec) > 0 GROUP BY ALL)
SELECT table_name, column_name, CAST(sum(b) AS INTEGER) AS ones FROM bits GROUP BY ALL""")
def signature_index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, idx = _stored_index(spark, sf_dir)
    ones = F.aggregate("bits", F.lit(0), lambda a, x: a + F.bit_count(x))
    return idx.signatures().select("table_name", "column_name", ones.alias("ones"))


@register("index_lookup", f"WITH {LAKE} SELECT * FROM ({lsh.sql_lsh_hits('vecs', 'vecs', L.THRESHOLD)})")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, idx = _stored_index(spark, sf_dir)
    return lsh.lookup(v, idx).columns()


# --- vocabulary (D1, E1) ------------------------------------------------------------------
VOCAB_DIM = L.DIM


def vocabulary(spark: SparkSession, sf_dir: str, dim: int = VOCAB_DIM) -> DataFrame:
    """Distinct lower-case words of ``benchmark.text`` with md5-derived
    vectors; words whose md5 starts with 0-3 are left out (misses)."""
    b = fx.read_table(spark, sf_dir, "benchmark")
    words = b.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where(F.col("word") != "") \
        .distinct().where(F.substring(F.md5("word"), 1, 1) >= F.lit("4"))
    comp = lambda i: ((F.conv(F.substring(F.md5(F.concat_ws(":", F.col("word"), i.cast("string"))), 1, 8), 16, 10)
                       .cast("double") + 0.5) / 4294967296.0 * 2.0 - 1.0)
    return words.select("word", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), comp).alias("vec"))


def _sql_vocab(dim: int = VOCAB_DIM) -> str:
    return f"""SELECT word, list(((('0x' || substr(md5(word || ':' || i), 1, 8))::BIGINT + 0.5) / 4294967296.0 * 2.0
                                 - 1.0) ORDER BY i) AS vec
    FROM (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM benchmark),
         range({dim}) r(i)
    WHERE word <> '' AND substr(md5(word), 1, 1) >= '4' GROUP BY word"""


def _conv_cells(spark, sf_dir):
    """conversations.text as a lake column per role: words are the tokens."""
    c = fx.read_table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("conv__"), F.col("role")).alias("table_name"), F.lit("text").alias("column_name"),
                    (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"),
                    F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("value")).where(F.col("value") != "")


_SQL_CONV_CELLS = """SELECT 'conv__' || role AS table_name, 'text' AS column_name, conv_id * 1000 + turn AS row_id,
  unnest(string_split_regex(lower(text), '[^a-z]+')) AS value FROM conversations"""


@register("token_vector_join", f"""WITH voc AS ({_sql_vocab()}),
cells AS (SELECT * FROM ({_SQL_CONV_CELLS}) WHERE value <> ''),
toks AS (SELECT DISTINCT {tx.sql_cell_token('value')} AS token FROM cells)
SELECT t.token, v.word IS NOT NULL AS in_vocab, round(list_sum(v.vec), 6) AS vocab_sum
FROM toks t LEFT JOIN voc v ON v.word = t.token""")
def token_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = _conv_cells(spark, sf_dir).select(tx.cell_token("value").alias("token"))
    tv = embed.token_vectors(toks, VOCAB_DIM, vocabulary(spark, sf_dir))
    return tv.select("token", "in_vocab",
                     F.when(F.col("in_vocab"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6))
                     .alias("vocab_sum"))


@register("mean_pool_columns", f"""WITH voc AS ({_sql_vocab()}),
cells AS (SELECT * FROM ({_SQL_CONV_CELLS}) WHERE value <> ''),
tok AS (SELECT table_name, column_name, {tx.sql_cell_token('value')} AS token, count(*) AS n FROM cells GROUP BY ALL),
known AS (SELECT t.table_name, t.column_name, unnest(range({VOCAB_DIM})) AS bucket, unnest(v.vec) * t.n AS w
          FROM tok t JOIN voc v ON v.word = t.token),
miss AS (SELECT table_name, column_name, n, unnest(gl) AS gram, len(gl) AS ng
         FROM (SELECT *, {tx.sql_subword_ngrams('token')} AS gl FROM tok WHERE token NOT IN (SELECT word FROM voc))),
feats AS (SELECT * FROM known UNION ALL
          SELECT table_name, column_name, {tx.sql_ngram_bucket('gram', VOCAB_DIM)}, ({tx.sql_ngram_sign('gram')} / ng) * n
          FROM miss),
tot AS (SELECT table_name, column_name, sum(n) AS total FROM tok GROUP BY ALL),
s AS (SELECT table_name, column_name, bucket, sum(w) AS w FROM feats GROUP BY ALL),
vecs AS (SELECT t.table_name, t.column_name, list(coalesce(s.w, 0.0) / t.total ORDER BY d.i) AS vec
         FROM tot t CROSS JOIN range({VOCAB_DIM}) d(i)
         LEFT JOIN s ON s.table_name = t.table_name AND s.column_name = t.column_name AND s.bucket = d.i
         GROUP BY t.table_name, t.column_name)
SELECT table_name, column_name, round(sqrt(list_dot_product(vec, vec)), 6) AS vec_norm,
       round(list_sum(vec), 6) AS vec_sum, round(vec[1], 6) AS vec_first FROM vecs""")
def mean_pool_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = embed.embed_columns(_conv_cells(spark, sf_dir), VOCAB_DIM, vocab=vocabulary(spark, sf_dir))
    return v.select("table_name", "column_name", F.round(V.norm("vec"), 6).alias("vec_norm"),
                    F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("vec_sum"),
                    F.round(F.col("vec")[0], 6).alias("vec_first"))
