"""Scalar text and vector functions (B9, B10, C1-C11, L1) run over the whole
lake, the conversation texts and the ``embeddings`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unionlake.functions import text as tx
from unionlake.functions import vectors as V
from unionlake.operators import clean, lsh
from unionlake.plans import lake as L
from unionlake.plans.registry import register
from unionlake.sources import fixtures as fx

CELLS = f"raw_cells AS ({L.sql_cells()})"
DIRTY = f"raw_cells AS ({L.sql_cells(dirty=True)})"


def _values(spark, sf_dir):
    return L.raw_cells(spark, sf_dir).select("value").distinct()


def _texts(spark, sf_dir):
    conv = fx.read_table(spark, sf_dir, "conversations")
    return conv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "text")


@register("normalize_cell", f"WITH {CELLS} SELECT DISTINCT value, {tx.sql_normalize_cell('value')} AS token "
                            f"FROM raw_cells")
def normalize_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir).select("value", tx.normalize_cell("value").alias("token"))


@register("normalize_cell_text", f"SELECT conv_id * 1000 + turn AS row_id, {tx.sql_normalize_cell('text')} AS token,"
                                 f" {tx.sql_normalize_cell_wildcards('text')} AS token_wild FROM conversations")
def normalize_cell_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _texts(spark, sf_dir)
    return t.select("row_id", tx.normalize_cell("text").alias("token"),
                    tx.normalize_cell_wildcards("text").alias("token_wild"))


@register("normalize_cell_wildcards", f"WITH {CELLS} SELECT DISTINCT value, "
                                      f"{tx.sql_normalize_cell_wildcards('value')} AS token FROM raw_cells")
def normalize_cell_wildcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir).select("value", tx.normalize_cell_wildcards("value").alias("token"))


@register("encode_header", f"WITH {CELLS} SELECT DISTINCT value, {tx.sql_encode_header('value')} AS code, "
                           f"{tx.sql_encode_header('value', True)} AS code_wild FROM raw_cells")
def encode_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir).select("value", tx.encode_header("value").alias("code"),
                                         tx.encode_header("value", True).alias("code_wild"))


@register("decode_header", f"WITH {CELLS} SELECT DISTINCT value, {tx.sql_normalize_cell('value')} AS decoded, "
                           f"{tx.sql_normalize_cell('value')} = {tx.sql_normalize_cell('value')} AS round_trip "
                           f"FROM raw_cells")
def decode_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _values(spark, sf_dir)
    dec = tx.decode_header(tx.encode_header("value"))
    return v.select("value", dec.alias("decoded"), (dec == tx.normalize_cell("value")).alias("round_trip"))


_TERMS_SQL = ("SELECT DISTINCT 'h#' || column_name AS term FROM raw_cells UNION "
              "SELECT DISTINCT 'd#' || value FROM raw_cells WHERE value IS NOT NULL UNION "
              "SELECT DISTINCT 'x#' || table_name FROM raw_cells")


def _terms(spark, sf_dir):
    c = L.raw_cells(spark, sf_dir)
    return (c.select(F.concat(F.lit("h#"), "column_name").alias("term"))
            .union(c.where(F.col("value").isNotNull()).select(F.concat(F.lit("d#"), "value")))
            .union(c.select(F.concat(F.lit("x#"), "table_name"))).distinct())


@register("encode_prefixed_term", f"""WITH {CELLS}, terms AS ({_TERMS_SQL})
SELECT term, CASE WHEN starts_with(term, 'h#') THEN {tx.sql_encode_header('substr(term, 3)', True)}
                  WHEN starts_with(term, 'd#') THEN {tx.sql_normalize_cell_wildcards('substr(term, 3)')} END AS code
FROM terms""")
def encode_prefixed_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir).select("term", tx.encode_prefixed_term("term").alias("code"))


@register("subword_ngrams", f"""WITH {CELLS}, toks AS (SELECT DISTINCT {tx.sql_cell_token('value')} AS token
FROM raw_cells)
SELECT token, CAST(len({tx.sql_subword_ngrams('token')}) AS INTEGER) AS n_grams,
       array_to_string({tx.sql_subword_ngrams('token')}, ' ') AS grams FROM toks""")
def subword_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = L.raw_cells(spark, sf_dir).select(tx.cell_token("value").alias("token")).distinct()
    g = tx.subword_ngrams("token")
    return toks.select("token", F.size(g).alias("n_grams"), F.array_join(g, " ").alias("grams"))


@register("null_token", f"""WITH {DIRTY}
SELECT DISTINCT value, CASE WHEN value IS NULL OR value = '' THEN '_' ELSE value END AS filled,
       {tx.sql_cell_token('value')} AS token FROM raw_cells""")
def null_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = L.raw_cells(spark, sf_dir, dirty=True).select("value").distinct()
    return c.select("value", tx.null_token("value").alias("filled"), tx.cell_token("value").alias("token"))


@register("tokenize_cells", f"""SELECT conv_id * 1000 + turn AS row_id,
  CAST(len({tx.sql_tokenize_cell('text')}) AS INTEGER) AS n_tokens,
  array_to_string({tx.sql_tokenize_cell('text')}, ' ') AS tokens FROM conversations""")
def tokenize_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _texts(spark, sf_dir)
    tok = tx.tokenize_cell("text")
    return t.select("row_id", F.size(tok).alias("n_tokens"), F.array_join(tok, " ").alias("tokens"))


@register("column_id", f"""WITH {CELLS}, ids AS (SELECT DISTINCT table_name || '!x!' || column_name AS t,
  column_name AS c FROM raw_cells)
SELECT t AS table_name, c AS column_name, t || '!' || c AS col_id,
  substr(t || '!' || c, 1, length(t || '!' || c) - length(c) - 1) AS split_table,
  c AS split_column FROM ids""")
def column_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    # table names carrying '!' check the split on the last '!'
    ids = L.raw_cells(spark, sf_dir).select(
        F.concat_ws("!x!", "table_name", "column_name").alias("table_name"), "column_name").distinct()
    cid = clean.column_id("table_name", "column_name")
    t, c = clean.split_column_id(cid)
    return ids.select("table_name", "column_name", cid.alias("col_id"), t.alias("split_table"),
                      c.alias("split_column"))


# --- vectors over the embeddings table ------------------------------------------
_EMB = ("SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings")


def _emb(spark, sf_dir):
    e = fx.read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", V.to_double_array("embedding").alias("vec"))


@register("l2_normalize", f"""WITH e AS ({_EMB}),
n AS (SELECT vec_id, list_transform(vec, lambda x: x / greatest(sqrt(list_dot_product(vec, vec)), 1e-12)) AS u
      FROM e)
SELECT vec_id, round(sqrt(list_dot_product(u, u)), 6) AS unit_norm, round(u[1], 6) AS u_first,
       round(list_sum(u), 6) AS u_sum FROM n""")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _emb(spark, sf_dir).select("vec_id", V.l2_normalize("vec").alias("u"))
    return u.select("vec_id", F.round(V.norm("u"), 6).alias("unit_norm"), F.round(F.col("u")[0], 6).alias("u_first"),
                    F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("u_sum"))


@register("cosine_similarity", f"""WITH e AS ({_EMB})
SELECT a.vec_id AS vec_i, b.vec_id AS vec_j, round({lsh.sql_cosine('a.vec', 'b.vec')}, 6) AS cosine
FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0""")
def cosine_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir)
    a = e.where(F.col("vec_id") % 2 == 0).select(F.col("vec_id").alias("vec_i"), F.col("vec").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_i"), F.col("vec_id").alias("vec_j"), F.col("vec").alias("b"))
    return a.join(b, "vec_i").select("vec_i", "vec_j", V.round_score(V.cosine("a", "b")).alias("cosine"))


_SIG_THRESHOLD = 0.7


@register("simhash_bits", f"""WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS table_name, 'v' AS column_name,
  CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)
SELECT CAST(table_name AS BIGINT) AS vec_id, CAST(band_id AS INTEGER) AS band_id, CAST(band_key AS BIGINT) AS band_key
FROM ({lsh.sql_band_keys('e', _SIG_THRESHOLD)})""")
def simhash_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir)
    n_bands, rows = V.lsh_params(_SIG_THRESHOLD)
    sig = e.withColumn("bits", V.signature_bits(F.col("vec"), lsh.DEFAULT_BITS, 64, lsh.DEFAULT_SEED))
    return sig.select("vec_id", F.inline(V.band_keys(F.col("bits"), n_bands, rows))).select(
        "vec_id", F.col("band_id").cast("int"), F.col("band_key").cast("long"))


def _sql_bits(view: str, bits: int = lsh.DEFAULT_BITS, seed: int = lsh.DEFAULT_SEED, dim: int = 64) -> str:
    return (f"SELECT v.vec_id, h.bit, CASE WHEN round(sum(v.vec[h.dim + 1] * h.sgn), {V.SIGN_DIGITS}) >= 0 "
            f"THEN 1 ELSE 0 END AS b FROM {view} v, ({lsh.sql_hyperplanes(bits, dim, seed)}) h GROUP BY ALL")


@register("signature_similarity", f"""WITH e AS ({_EMB}), bits AS ({_sql_bits('e')}),
h AS (SELECT a.vec_id AS vec_i, count(*) FILTER (WHERE a.b <> b.b) AS hamming
      FROM bits a JOIN bits b ON b.vec_id = a.vec_id + 1 AND a.bit = b.bit WHERE a.vec_id % 2 = 0 GROUP BY ALL)
SELECT vec_i, CAST(hamming AS INTEGER) AS hamming, round(cos(pi() * hamming / {lsh.DEFAULT_BITS}.0), 6) AS estimate
FROM h""")
def signature_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir).withColumn("bits", V.signature_bits(F.col("vec"), lsh.DEFAULT_BITS, 64, lsh.DEFAULT_SEED))
    a = e.where(F.col("vec_id") % 2 == 0).select(F.col("vec_id").alias("vec_i"), F.col("bits").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_i"), F.col("bits").alias("b"))
    return a.join(b, "vec_i").select("vec_i", V.hamming("a", "b").alias("hamming"),
                                     V.round_score(V.signature_similarity("a", "b", lsh.DEFAULT_BITS)).alias("estimate"))


def _sql_md5_weight(tag: str, i: str, j: str, scale: float) -> str:
    return (f"((((('0x' || substr(md5('{tag}:' || {i} || ':' || {j}), 1, 8))::BIGINT) + 0.5) / 4294967296.0 * 2.0 "
            f"- 1.0) * {scale!r})")


def sql_project(view: str, in_dim: int, hidden: int, out_dim: int, tag: str = "proj") -> str:
    """MLP over ``view(vec_id, vec)`` in SQL; returns (vec_id, out DOUBLE[])."""
    import math
    s1, s2 = 1 / math.sqrt(in_dim), 1 / math.sqrt(hidden)
    return f"""
    WITH x AS (SELECT vec_id, unnest(range({in_dim})) AS i, unnest(vec) AS v FROM {view}),
    w1 AS (SELECT a.i, b.j, {_sql_md5_weight(tag + ':w1', 'a.i', 'b.j', s1)} AS w
           FROM range({in_dim}) a(i), range({hidden}) b(j)),
    b1 AS (SELECT b.j, {_sql_md5_weight(tag + ':b1', '0', 'b.j', s1)} AS b FROM range({hidden}) b(j)),
    h AS (SELECT x.vec_id, w1.j, greatest(sum(x.v * w1.w) + any_value(b1.b), 0.0) AS h
          FROM x JOIN w1 ON x.i = w1.i JOIN b1 ON b1.j = w1.j GROUP BY ALL),
    w2 AS (SELECT a.j, b.k, {_sql_md5_weight(tag + ':w2', 'a.j', 'b.k', s2)} AS w
           FROM range({hidden}) a(j), range({out_dim}) b(k)),
    b2 AS (SELECT b.k, {_sql_md5_weight(tag + ':b2', '0', 'b.k', s2)} AS b FROM range({out_dim}) b(k)),
    o AS (SELECT h.vec_id, w2.k, sum(h.h * w2.w) + any_value(b2.b) AS o
          FROM h JOIN w2 ON h.j = w2.j JOIN b2 ON b2.k = w2.k GROUP BY ALL)
    SELECT vec_id, list(o ORDER BY k) AS out FROM o GROUP BY vec_id"""


@register("project_vectors", f"""WITH e AS ({_EMB}), p AS ({sql_project('e', 64, 64, 64)})
SELECT vec_id, round(sqrt(list_dot_product(out, out)), 6) AS out_norm, round(list_sum(out), 6) AS out_sum,
       round(out[1], 6) AS out_first FROM p""")
def project_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = V.init_projection(64, 64, 64)
    p = _emb(spark, sf_dir).select("vec_id", V.project_vectors("vec", params).alias("out"))
    return p.select("vec_id", F.round(V.norm("out"), 6).alias("out_norm"),
                    F.round(F.aggregate("out", F.lit(0.0), lambda a, x: a + x), 6).alias("out_sum"),
                    F.round(F.col("out")[0], 6).alias("out_first"))
