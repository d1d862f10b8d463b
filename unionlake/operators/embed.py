"""Column vectors from cells (U3): cell token -> word vector -> mean per column.

Plan: cells --(partial agg)--> distinct (table, column, token, n)
      --explode n-gram features--> (table, column, bucket, weight)
      --(partial agg)--> per column and bucket --> dense ARRAY<DOUBLE>.
Repeated values are counted once per map partition before the first shuffle,
so a hot value costs one row per partition, not one per cell; the second
shuffle carries at most (dim + 1) rows per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unionlake.functions import text as tx
from unionlake.functions.vectors import project_vectors
from unionlake.operators import records as rec
from unionlake.session import materialize

TABLE, COLUMN = "table_name", "column_name"
COUNT_BUCKET = -1  # pseudo bucket carrying the number of cells of a column


def column_token_counts(cells: DataFrame) -> DataFrame:
    """D1 step 1: distinct lookup tokens per column with their multiplicity."""
    return (cells.select(TABLE, COLUMN, tx.cell_token(F.col("value")).alias("token"))
            .groupBy(TABLE, COLUMN, "token").agg(F.count(F.lit(1)).alias("n")))


def hashed_token_features(dim: int):
    """Feature list of a token: (bucket, sign / #ngrams) for each n-gram."""
    def feats(token):
        grams = tx.subword_ngrams(token)
        ng = F.size(grams).cast("double")
        return F.transform(grams, lambda g: F.struct(tx.ngram_bucket(g, dim).alias("bucket"),
                                                     (tx.ngram_sign(g) / ng).alias("w")))
    return feats


def _dense(sparse: DataFrame, dim: int) -> DataFrame:
    """(table, column, bucket, w) incl. the count bucket -> (table, column, vec)."""
    return (sparse.groupBy(TABLE, COLUMN)
            .agg(F.map_from_entries(F.collect_list(F.struct("bucket", "w"))).alias("m"))
            .select(TABLE, COLUMN,
                    F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                                lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))
                                / F.try_element_at("m", F.lit(COUNT_BUCKET))).alias("vec")))


def _hashed_feature_rows(tokens: DataFrame, dim: int) -> DataFrame:
    """Explode each (table, column, token, n) into its n-grams; the md5 bucket
    and sign are then plain (codegen'd) expressions, one md5 per n-gram."""
    # the n-gram list and its size are computed once per token, below the
    # generator (an expression beside ``explode`` is evaluated per output row)
    gl = tokens.select(TABLE, COLUMN, "n", tx.subword_ngrams(F.col("token")).alias("gl"))
    gl = gl.select(TABLE, COLUMN, "n", "gl", F.size("gl").cast("double").alias("ng"))
    # explode_outer: an inner explode makes the optimizer infer size(gl) > 0
    # and push that filter under the token aggregate, recomputing the n-gram
    # list per cell instead of per distinct token
    g = gl.select(TABLE, COLUMN, "n", "ng", F.explode_outer("gl").alias("g")).where(F.col("g").isNotNull())
    h = g.select(TABLE, COLUMN, "n", "ng", F.md5("g").alias("h"))
    bucket = F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")
    sign = F.when(F.substring("h", 9, 1) >= F.lit("8"), F.lit(1.0)).otherwise(F.lit(-1.0))
    return h.select(TABLE, COLUMN, bucket.alias("bucket"), ((sign / F.col("ng")) * F.col("n")).alias("w"))


def embed_columns(cells: DataFrame, dim: int = 64, vocab: DataFrame | None = None,
                  projection: dict | None = None) -> DataFrame:
    """Mean of the cells' word vectors per column (duplicates count).

    ``vocab`` (word, vec ARRAY<DOUBLE> of size ``dim``) is joined on the token
    (D1); tokens it misses fall back to hashed n-grams (C6).  With
    ``projection`` the pooled vector goes through the MLP (C9/U10).
    Columns whose cells are all null produce no vector.
    """
    return embed_token_counts(column_token_counts(cells), dim, vocab, projection)


def embed_records(records: DataFrame, dim: int = 64, policy: str = "any", vocab: DataFrame | None = None,
                  projection: dict | None = None) -> DataFrame:
    """U3 from raw records: cleaning, column filters and embedding on one read
    of the lake.  The token counts are written; what the rules drop is decided
    on them."""
    counts = materialize(rec.token_counts(records, tx.cell_token), "token-counts")
    return embed_token_counts(rec.indexable_counts(counts, policy), dim, vocab, projection)


def embed_token_counts(tokens: DataFrame, dim: int = 64, vocab: DataFrame | None = None,
                       projection: dict | None = None) -> DataFrame:
    """Vectors from (table, column, token, n)."""
    counts = tokens.select(TABLE, COLUMN, F.lit(COUNT_BUCKET).alias("bucket"), F.col("n").cast("double").alias("w"))
    if vocab is None:
        feats = _hashed_feature_rows(tokens, dim)
    else:
        v = vocab.select(F.col("word").alias("token"), F.col("vec").alias("wvec"))
        joined = tokens.join(v, "token", "left")
        known = joined.where(F.col("wvec").isNotNull()).select(
            TABLE, COLUMN, "n", F.posexplode("wvec").alias("bucket", "x"))
        known = known.select(TABLE, COLUMN, F.col("bucket").cast("int").alias("bucket"),
                             (F.col("x") * F.col("n")).alias("w"))
        missing = _hashed_feature_rows(joined.where(F.col("wvec").isNull()).drop("wvec"), dim)
        feats = known.unionByName(missing)
    summed = feats.unionByName(counts).groupBy(TABLE, COLUMN, "bucket").agg(F.sum("w").alias("w"))
    out = _dense(summed, dim)
    if projection is not None:
        out = out.withColumn("vec", project_vectors(F.col("vec"), projection))
    return out


def token_vectors(tokens: DataFrame, dim: int = 64, vocab: DataFrame | None = None) -> DataFrame:
    """(token) -> dense vector; vocabulary first, hashed n-grams for misses."""
    distinct = tokens.select("token").distinct()
    feats = hashed_token_features(dim)
    hashed = distinct.select("token", F.explode_outer(feats(F.col("token"))).alias("f")) \
        .where(F.col("f").isNotNull()) \
        .groupBy("token", F.col("f.bucket").alias("bucket")).agg(F.sum("f.w").alias("w")) \
        .groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "w"))).alias("m"))
    hashed = distinct.join(hashed, "token", "left").select(
        "token", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                             lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("hvec"))
    if vocab is None:
        return hashed.select("token", F.col("hvec").alias("vec"), F.lit(False).alias("in_vocab"))
    v = vocab.select(F.col("word").alias("token"), F.col("vec").alias("wvec"))
    return hashed.join(v, "token", "left").select(
        "token", F.coalesce("wvec", "hvec").alias("vec"), F.col("wvec").isNotNull().alias("in_vocab"))


# ---------------------------------------------------------------------------
def sql_embed_columns(cells_view: str, dim: int = 64) -> str:
    """DuckDB twin of ``embed_columns`` (hashed encoder, no projection)."""
    grams = tx.sql_subword_ngrams("token")
    return f"""
    WITH tok AS (
      SELECT table_name, column_name, {tx.sql_cell_token('value')} AS token, count(*) AS n
      FROM {cells_view} GROUP BY ALL),
    grams AS (
      SELECT table_name, column_name, n, unnest(gl) AS gram, len(gl) AS ng
      FROM (SELECT *, {grams} AS gl FROM tok)),
    sparse AS (
      SELECT table_name, column_name, {tx.sql_ngram_bucket('gram', dim)} AS bucket,
             sum(({tx.sql_ngram_sign('gram')} / ng) * n) AS w
      FROM grams GROUP BY ALL),
    tot AS (SELECT table_name, column_name, sum(n) AS total FROM tok GROUP BY ALL),
    dims AS (SELECT t.table_name, t.column_name, t.total, d.i FROM tot t, range({dim}) d(i))
    SELECT d.table_name, d.column_name,
           list(coalesce(s.w, 0.0) / d.total ORDER BY d.i) AS vec
    FROM dims d LEFT JOIN sparse s
      ON s.table_name = d.table_name AND s.column_name = d.column_name AND s.bucket = d.i
    GROUP BY d.table_name, d.column_name"""
