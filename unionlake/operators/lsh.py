"""Similarity joins between column vectors.

* ``cosine_join`` (D3): exact, by an inverted index of clusters and products
  that stop when the remaining norms can't reach the threshold (exact_join).
* ``lsh_join`` (D2): signatures (C10) are cut into bands; columns sharing a
  band key are candidates, which the exact cosine verifies.
* ``build_index`` / ``append_to_index`` / ``lookup`` (A13, U4, U5): signatures
  and band rows stored as Parquet in generations; a lookup joins the stored
  bands, and new tables are a new generation.  Bands of few bits (a low
  threshold) hold large shares of all pairs: then blocks of vectors are
  compared, and a pair still needs a band in common (signature_blocks).

All of them work on distinct vectors: a lake full of copies (constant columns,
copied tables) does not turn one bucket into a quadratic hot spot.  ``RepHits``
holds their pairs and the columns behind them; ``columns`` expands the pairs
for callers that want pairs of columns.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unionlake.functions import vectors as V
from unionlake.operators import exact_join, signature_blocks
from unionlake.session import materialize, scratch_path

TABLE, COLUMN = "table_name", "column_name"
DEFAULT_BITS = 1024
DEFAULT_SEED = 12345
#: Rows that may meet in the bands at any rate, and the products of vectors that are as much work as one of them.
MATCHES, PRODUCTS = 1_000_000, 400


def _nonzero(vecs: DataFrame) -> DataFrame:
    """Zero vectors have no direction: they can match nothing and are not indexed."""
    return vecs.where(V.norm("vec") > 0)


def vector_key(vec: str):
    """128-bit content key of a vector (two independently seeded xxhash64)."""
    return F.struct(F.xxhash64(F.col(vec)).alias("h1"), F.xxhash64(F.lit(0x5EED), F.col(vec)).alias("h2"))


def representatives(vecs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct non-zero vectors as (id, vec), numbered once and written, and
    the columns that hold each: (id, table_name, column_name)."""
    keyed = _nonzero(vecs).withColumn("key", vector_key("vec"))
    # one shuffle by key; a vector that many columns share is one row per task before it
    reps = keyed.groupBy("key").agg(F.first("vec").alias("vec")).withColumn("id", F.monotonically_increasing_id())
    reps = materialize(reps, "representatives")
    return reps.select("id", "vec"), keyed.select("key", TABLE, COLUMN).join(reps.select("key", "id"), "key").select("id", TABLE, COLUMN)


def scored_pairs(q: DataFrame, c: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(q_id, c_id, score) of the pairs whose rounded exact cosine reaches the threshold."""
    scored = (pairs.join(q.select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec")), "q_id")
              .join(c.select(F.col("id").alias("c_id"), F.col("vec").alias("c_vec")), "c_id")
              .select("q_id", "c_id", V.round_score(V.cosine("q_vec", "c_vec")).alias("score")))
    return scored.where(F.col("score") >= F.lit(threshold))


def expand(scored: DataFrame, q_members: DataFrame, c_members: DataFrame) -> DataFrame:
    """Pairs of representatives -> pairs of columns: q_table, q_column, c_table, c_column, score."""
    q = q_members.select(F.col("id").alias("q_id"), F.col(TABLE).alias("q_table"), F.col(COLUMN).alias("q_column"))
    c = c_members.select(F.col("id").alias("c_id"), F.col(TABLE).alias("c_table"), F.col(COLUMN).alias("c_column"))
    return scored.join(q, "q_id").join(c, "c_id").select("q_table", "q_column", "c_table", "c_column", "score")


@dataclass
class RepHits:
    """Scored pairs of representatives (q_id, c_id, score) and the columns behind them (id, table_name, column_name).
    blocks: what the pairs are found in, if blocks of vectors are compared."""

    pairs: DataFrame
    q_members: DataFrame
    c_members: DataFrame
    blocks: signature_blocks.Blocks | None = None

    def columns(self) -> DataFrame:
        return expand(self.pairs, self.q_members, self.c_members)


def exact_rep_hits(queries: DataFrame, lake: DataFrame, threshold: float) -> RepHits:
    """D3 on distinct vectors (see exact_join)."""
    if threshold is None or not -1.0 < threshold <= 1.0:
        raise ValueError(f"an exact join needs a threshold in (-1, 1], not {threshold!r}: without one it is every pair")
    c_reps, c_mem = representatives(lake)
    q_reps, q_mem = (c_reps, c_mem) if queries is lake else representatives(queries)
    pairs = exact_join.candidate_pairs(q_reps, c_reps, threshold)
    return RepHits(scored_pairs(q_reps, c_reps, pairs, threshold), q_mem, c_mem)


def cosine_join(queries: DataFrame, lake: DataFrame, threshold: float) -> DataFrame:
    """D3: exact cosine of every (query column, lake column) pair with
    ``score >= threshold`` (in (-1, 1]).  -> q_table, q_column, c_table, c_column, score (rounded)."""
    return exact_rep_hits(queries, lake, threshold).columns()


# --- D2 / A13 / U4: signatures, bands and the stored index ---------------------
def signatures(vecs: DataFrame, bits: int = DEFAULT_BITS, seed: int = DEFAULT_SEED,
               dim: int | None = None) -> DataFrame:
    """(table_name, column_name, vec, bits ARRAY<BIGINT>)."""
    return vecs.withColumn("bits", V.signature_bits(F.col("vec"), bits, dim or dimension(vecs), seed))


def dimension(vecs: DataFrame) -> int:
    """Components of the vectors (0 if there are none); it sizes the planes."""
    return vecs.agg(F.max(F.size("vec"))).first()[0] or 0


INDEX_PARAMS = "threshold double, bits int, seed long, dim int"


@dataclass
class Index:
    """A written index: distinct vectors by content key (key, vec, bits), one
    band row for each of their bands (band_id, band_key, key), and the columns
    that hold them (key, table_name, column_name)."""

    path: str
    threshold: float
    bits: int
    seed: int
    dim: int
    reps: DataFrame
    bands: DataFrame
    members: DataFrame

    def signatures(self) -> DataFrame:
        """(table_name, column_name, vec, bits) of every indexed column."""
        return self.members.join(self.reps, "key").select(TABLE, COLUMN, "vec", "bits")


def band_rows(sigs: DataFrame, threshold: float, bits: int) -> DataFrame:
    n_bands, rows = V.lsh_params(threshold, bits)
    return sigs.select("key", F.inline(V.band_keys(F.col("bits"), n_bands, rows)))


def _generation(path: str, n: int) -> str:
    return os.path.join(path, f"generation-{n:06d}")


def generations(spark: SparkSession, path: str) -> list[str]:
    """The complete generations of an index: their parameters are written last."""
    jvm, hconf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    while True:
        mark = jvm.org.apache.hadoop.fs.Path(os.path.join(_generation(path, len(out)), "params", "_SUCCESS"))
        if not mark.getFileSystem(hconf).exists(mark):
            return out
        out.append(_generation(path, len(out)))


def _write_generation(vecs: DataFrame, path: str, n: int, threshold: float, bits: int, seed: int, dim: int,
                      known: DataFrame | None) -> None:
    here = _generation(path, n)
    write = lambda df, part: df.write.mode("overwrite").parquet(os.path.join(here, part))
    keyed = _nonzero(vecs).withColumn("key", vector_key("vec"))
    new = keyed.groupBy("key").agg(F.first("vec").alias("vec"))
    if known is not None:
        new = new.join(known.select("key"), "key", "left_anti")
    write(new.withColumn("bits", V.signature_bits(F.col("vec"), bits, dim, seed)), "reps")
    written = vecs.sparkSession.read.parquet(os.path.join(here, "reps"))
    write(band_rows(written, threshold, bits), "bands")
    write(keyed.select("key", TABLE, COLUMN), "members")
    write(vecs.sparkSession.createDataFrame([(float(threshold), bits, seed, dim)], INDEX_PARAMS).coalesce(1), "params")


def load_index(spark: SparkSession, path: str) -> Index:
    """The stored index with all of its complete generations."""
    parts = generations(spark, path)
    if not parts:
        raise FileNotFoundError(f"no complete index at {path}")
    read = lambda part: spark.read.parquet(*[os.path.join(g, part) for g in parts])
    return Index(path, *spark.read.parquet(os.path.join(parts[0], "params")).first(), read("reps"), read("bands"), read("members"))


def build_index(vecs: DataFrame, path: str, threshold: float, bits: int = DEFAULT_BITS, seed: int = DEFAULT_SEED,
                dim: int | None = None) -> Index:
    """Write the index of (table_name, column_name, vec) as the first
    generation below ``path``, which must hold no complete index."""
    if generations(vecs.sparkSession, path):
        raise FileExistsError(f"{path} holds an index: load it, or append to it")
    _write_generation(vecs, path, 0, threshold, bits, seed, dim or dimension(vecs), None)
    return load_index(vecs.sparkSession, path)


def append_to_index(vecs: DataFrame, path: str) -> Index:
    """Index further columns as a new generation.  What is written stays
    as it is; vectors that the index knows get no second signature, only
    members."""
    spark = vecs.sparkSession
    index = load_index(spark, path)
    _write_generation(vecs, path, len(generations(spark, path)), index.threshold, index.bits, index.seed, index.dim, index.reps)
    return load_index(spark, path)


def load_or_build_index(vecs: DataFrame, path: str, threshold: float, bits: int = DEFAULT_BITS, seed: int = DEFAULT_SEED,
                        dim: int | None = None) -> Index:
    """A13 reuse: read the stored index if it is complete.  Signatures of other
    bits, seed, dimension or threshold can't be compared: that is an error."""
    if not generations(vecs.sparkSession, path):
        return build_index(vecs, path, threshold, bits, seed, dim)
    index = load_index(vecs.sparkSession, path)
    have, want = (index.threshold, index.bits, index.seed, index.dim), (float(threshold), bits, seed, dim or index.dim)
    if have != want:
        raise ValueError(f"the index at {path} has (threshold, bits, seed, dim) = {have}, not {want}")
    return index


def lookup(queries: DataFrame | None, index: Index, score: str = "exact") -> RepHits:
    """Hits of query columns in a stored index, on distinct vectors.  The
    lake's bands are read as they are stored; ``queries`` None makes every
    indexed column a query, whose bands are stored as well.  Candidates are
    verified by the exact cosine (``score='exact'``) or the signature estimate
    (``score='signature'``)."""
    if score not in ("exact", "signature"):
        raise ValueError(f"unknown score {score!r}")
    as_id = lambda df: df.withColumnRenamed("key", "id")
    members = index.members
    if queries is None:
        q_sig, q_bands, q_mem = index.reps, index.bands, members
    else:
        keyed = _nonzero(queries).withColumn("key", vector_key("vec"))
        reps = keyed.groupBy("key").agg(F.first("vec").alias("vec"))
        q_sig = materialize(reps.withColumn("bits", V.signature_bits(F.col("vec"), index.bits, index.dim, index.seed)), "query-signatures")
        q_bands, q_mem = band_rows(q_sig, index.threshold, index.bits), keyed.select("key", TABLE, COLUMN)
    if unselective(q_bands, index.bands, q_sig.count(), index.reps.count()):
        c_blocks, c_ids = signature_blocks.blocks(index.reps)
        q_blocks, q_ids = (c_blocks, c_ids) if queries is None else signature_blocks.blocks(q_sig)
        by_id = lambda mem, ids: mem.join(ids, "key").select("id", TABLE, COLUMN)
        members = by_id(members, c_ids)
        pairs = signature_blocks.compared(q_blocks, c_blocks, index.threshold, index.bits, index.dim, score)
        meeting = signature_blocks.Meeting(index.threshold, index.bits, index.dim, score)
        return RepHits(pairs, members if queries is None else by_id(q_mem, q_ids), members, signature_blocks.Blocks(q_blocks, c_blocks, meeting))
    members = as_id(members)
    cand = q_bands.withColumnRenamed("key", "q_id").join(index.bands.withColumnRenamed("key", "c_id"), ["band_id", "band_key"]).select("q_id", "c_id").distinct()
    q, c = as_id(q_sig), as_id(index.reps)
    if score == "exact":
        pairs = scored_pairs(q, c, cand, index.threshold)
    else:
        both = (cand.join(q.select(F.col("id").alias("q_id"), F.col("bits").alias("q_bits")), "q_id")
                .join(c.select(F.col("id").alias("c_id"), F.col("bits").alias("c_bits")), "c_id"))
        pairs = both.select("q_id", "c_id", V.round_score(V.signature_similarity("q_bits", "c_bits", index.bits)).alias("score"))
        pairs = pairs.where(F.col("score") >= F.lit(index.threshold))
    return RepHits(pairs, members if queries is None else as_id(q_mem), members)


def unselective(q_bands: DataFrame, c_bands: DataFrame, n_q: int, n_c: int) -> bool:
    """Whether so many rows meet in the bands that blocks of vectors are compared instead (signature_blocks)."""
    count = lambda df, n: df.groupBy("band_id", "band_key").agg(F.count(F.lit(1)).alias(n))
    both = count(q_bands, "q").withColumn("c", F.col("q")) if q_bands is c_bands else count(q_bands, "q").join(count(c_bands, "c"), ["band_id", "band_key"])
    met = both.agg(F.sum(F.col("q").cast("double") * F.col("c"))).first()[0] or 0
    return met > max(MATCHES, n_q * n_c / PRODUCTS)


def lsh_rep_hits(queries: DataFrame, lake: DataFrame, threshold: float, bits: int = DEFAULT_BITS,
                 seed: int = DEFAULT_SEED, dim: int | None = None, score: str = "exact") -> RepHits:
    """D2 on distinct vectors: the lake is indexed in the checkpoint folder and looked up."""
    path = scratch_path(lake.sparkSession, f"index-{uuid.uuid4().hex}")
    return lookup(None if queries is lake else queries, build_index(lake, path, threshold, bits, seed, dim), score)


def lsh_join(queries: DataFrame, lake: DataFrame, threshold: float, **kw) -> DataFrame:
    """Band equi-join on signatures, verified.  Output like ``cosine_join``."""
    return lsh_rep_hits(queries, lake, threshold, **kw).columns()


# ---------------------------------------------------------------------------
# DuckDB renderings
def sql_hyperplanes(bits: int, dim: int, seed: int) -> str:
    return (f"SELECT b.b AS bit, d.d AS dim, CASE WHEN substr(md5('{seed}:' || b.b || ':' || d.d), 1, 1) >= '8' "
            f"THEN 1.0 ELSE -1.0 END AS sgn FROM range({bits}) b(b), range({dim}) d(d)")


def sql_band_keys(vec_view: str, threshold: float, bits: int = DEFAULT_BITS, seed: int = DEFAULT_SEED,
                  dim: int = 64) -> str:
    """(table_name, column_name, band_id, band_key) for non-zero vectors."""
    n_bands, rows = V.lsh_params(threshold, bits)
    used = n_bands * rows
    return f"""
    SELECT table_name, column_name, bit // {rows} AS band_id,
           sum(CASE WHEN round(dotp, {V.SIGN_DIGITS}) >= 0 THEN (1::BIGINT << (bit % {rows})) ELSE 0 END) AS band_key
    FROM (
      SELECT v.table_name, v.column_name, h.bit, sum(v.vec[h.dim + 1] * h.sgn) AS dotp
      FROM {vec_view} v, ({sql_hyperplanes(bits, dim, seed)}) h
      WHERE h.bit < {used}
      GROUP BY ALL)
    GROUP BY ALL"""


def sql_cosine(a: str, b: str) -> str:
    return (f"(CASE WHEN sqrt(list_dot_product({a},{a})) * sqrt(list_dot_product({b},{b})) > 0 "
            f"THEN list_dot_product({a},{b}) / (sqrt(list_dot_product({a},{a})) * sqrt(list_dot_product({b},{b}))) "
            f"ELSE 0.0 END)")


def sql_exact_hits(q_view: str, c_view: str, threshold: float) -> str:
    return f"""
    SELECT q.table_name AS q_table, q.column_name AS q_column, c.table_name AS c_table,
           c.column_name AS c_column, round({sql_cosine('q.vec', 'c.vec')}, {V.SCORE_DIGITS}) AS score
    FROM {q_view} q, {c_view} c
    WHERE list_dot_product(q.vec, q.vec) > 0 AND list_dot_product(c.vec, c.vec) > 0
      AND round({sql_cosine('q.vec', 'c.vec')}, {V.SCORE_DIGITS}) >= {threshold}"""


def sql_lsh_hits(q_view: str, c_view: str, threshold: float, **kw) -> str:
    return f"""
    WITH qb AS ({sql_band_keys(q_view, threshold, **kw)}),
         cb AS ({sql_band_keys(c_view, threshold, **kw)}),
         cand AS (SELECT DISTINCT qb.table_name AS q_table, qb.column_name AS q_column,
                         cb.table_name AS c_table, cb.column_name AS c_column
                  FROM qb JOIN cb ON qb.band_id = cb.band_id AND qb.band_key = cb.band_key)
    SELECT cand.*, round({sql_cosine('q.vec', 'c.vec')}, {V.SCORE_DIGITS}) AS score
    FROM cand
    JOIN {q_view} q ON q.table_name = cand.q_table AND q.column_name = cand.q_column
    JOIN {c_view} c ON c.table_name = cand.c_table AND c.column_name = cand.c_column
    WHERE round({sql_cosine('q.vec', 'c.vec')}, {V.SCORE_DIGITS}) >= {threshold}"""
