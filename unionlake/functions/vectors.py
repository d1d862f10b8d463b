"""Vector column expressions (ARRAY<DOUBLE>) and the two Arrow UDFs that need
a matrix product: random-projection signatures (C10) and the projection MLP
(C9).  Dot products and cosines are higher-order functions, JVM side.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Scores are rounded before ranking and thresholding so that sums taken in a
# different order (other engine, other partitioning) rank identically.
SCORE_DIGITS = 6
# Dot products are rounded before the sign test of a signature bit.
SIGN_DIGITS = 9


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(_col(a), lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x))


def l2_normalize(a, eps: float = 1e-12) -> Column:
    """Unit vector; a zero vector stays zero."""
    n = F.greatest(norm(a), F.lit(eps))
    return F.transform(_col(a), lambda x: x / n)


def cosine(a, b) -> Column:
    """Cosine similarity; 0.0 when either side is a zero vector."""
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den).otherwise(F.lit(0.0))


def round_score(c) -> Column:
    return F.round(_col(c), SCORE_DIGITS)


def to_double_array(c) -> Column:
    return F.transform(_col(c), lambda x: x.cast("double"))


# --- C10: random-projection signatures --------------------------------------
@lru_cache(maxsize=16)
def hyperplanes(bits: int, dim: int, seed: int) -> np.ndarray:
    """(bits x dim) matrix of +-1: entry (b, d) is +1 when the first hex digit
    of md5('seed:b:d') is >= 8.  A pure function of its parameters (same rule
    in SQL), so every executor and the oracle build the same planes."""
    h = np.empty((bits, dim), dtype=np.float64)
    for b in range(bits):
        for d in range(dim):
            h[b, d] = 1.0 if hashlib.md5(f"{seed}:{b}:{d}".encode()).hexdigest()[0] >= "8" else -1.0
    return h


def collision_probability(cos: float) -> float:
    return 1.0 - math.acos(max(-1.0, min(1.0, cos))) / math.pi


@lru_cache(maxsize=64)
def lsh_params(threshold: float, bits: int = 1024, fp_weight: float = 0.5, fn_weight: float = 0.5,
               steps: int = 60) -> tuple[int, int]:
    """(bands, rows) minimising fp_weight*FP + fn_weight*FN, where FP and FN are
    the areas under / over the band curve 1-(1-p^r)^b below / above the
    threshold's collision probability, with b*r <= bits."""
    t = collision_probability(threshold)

    def integrate(f, a, b):
        if b <= a:
            return 0.0
        h = (b - a) / steps
        xs = [a + (i + 0.5) * h for i in range(steps)]
        return sum(f(x) for x in xs) * h

    best, best_err = (1, bits), float("inf")
    for b in range(1, bits + 1):
        for r in range(1, bits // b + 1):
            fp = integrate(lambda p: 1 - (1 - p ** r) ** b, 0.0, t)
            fn = integrate(lambda p: (1 - p ** r) ** b, t, 1.0)
            err = fp_weight * fp + fn_weight * fn
            if err < best_err:
                best, best_err = (b, r), err
    return best


def signature_bits(vec_col, bits: int, dim: int, seed: int) -> Column:
    """The signature as ``bits/64`` packed BIGINT words (bit t of word w is
    plane 64w+t), computed by one matmul per Arrow batch."""
    planes = hyperplanes(bits, dim, seed)
    n_words = (bits + 63) // 64
    weights = (np.uint64(1) << np.arange(64, dtype=np.uint64))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def _bits(vs: pd.Series) -> pd.Series:
        if len(vs) == 0:
            return pd.Series([], dtype=object)
        m = np.stack([np.asarray(v, dtype=np.float64) for v in vs])
        on = np.round(m @ planes.T, SIGN_DIGITS) >= 0.0
        pad = n_words * 64 - bits
        if pad:
            on = np.concatenate([on, np.zeros((on.shape[0], pad), dtype=bool)], axis=1)
        words = (on.reshape(on.shape[0], n_words, 64).astype(np.uint64) * weights).sum(axis=2, dtype=np.uint64)
        return pd.Series(list(words.view(np.int64)))

    return _bits(_col(vec_col))


def band_keys(bits_col, bands: int, rows: int) -> Column:
    """Band j's key = the ``rows`` bits j*rows .. j*rows+rows-1 as an integer
    (bit order preserved).  Returns ARRAY<STRUCT<band_id, band_key>>."""
    assert rows <= 63
    mask = (1 << rows) - 1

    def key(j):
        start = j * rows
        w, off = start // 64, start % 64
        if off + rows <= 64:
            word = F.element_at(_col(bits_col), F.lit(w + 1))
            return F.shiftrightunsigned(word, off).bitwiseAND(F.lit(mask))
        # band straddles two words
        lo_n = 64 - off
        lo = F.shiftrightunsigned(F.element_at(_col(bits_col), F.lit(w + 1)), off).bitwiseAND(F.lit((1 << lo_n) - 1))
        hi = F.element_at(_col(bits_col), F.lit(w + 2)).bitwiseAND(F.lit((1 << (rows - lo_n)) - 1))
        return lo.bitwiseOR(F.shiftleft(hi, lo_n))

    return F.array(*[F.struct(F.lit(j).alias("band_id"), key(j).alias("band_key")) for j in range(bands)])


def hamming(bits_a, bits_b) -> Column:
    return F.aggregate(F.zip_with(_col(bits_a), _col(bits_b), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                       F.lit(0), lambda acc, x: acc + x)


def signature_similarity(bits_a, bits_b, bits: int) -> Column:
    """C11: cosine estimated from signatures, cos(pi * hamming / bits)."""
    return F.cos(F.lit(math.pi) * hamming(bits_a, bits_b) / F.lit(float(bits)))


# --- C9: projection MLP -------------------------------------------------------
def md5_weights(rows: int, cols: int, tag: str, scale: float) -> np.ndarray:
    """Deterministic weights for tests/oracles: u in (0,1) from md5('tag:i:j'),
    mapped to (-scale, scale)."""
    w = np.empty((rows, cols), dtype=np.float64)
    for i in range(rows):
        for j in range(cols):
            h = int(hashlib.md5(f"{tag}:{i}:{j}".encode()).hexdigest()[:8], 16)
            w[i, j] = ((h + 0.5) / 2 ** 32 * 2.0 - 1.0) * scale
    return w


def init_projection(in_dim: int, hidden: int, out_dim: int, tag: str = "proj") -> dict:
    """Linear(in, hidden) -> ReLU -> Linear(hidden, out) with md5 weights
    (uniform +-1/sqrt(fan_in), the usual Linear init range)."""
    return {
        "w1": md5_weights(in_dim, hidden, f"{tag}:w1", 1 / math.sqrt(in_dim)),
        "b1": md5_weights(1, hidden, f"{tag}:b1", 1 / math.sqrt(in_dim))[0],
        "w2": md5_weights(hidden, out_dim, f"{tag}:w2", 1 / math.sqrt(hidden)),
        "b2": md5_weights(1, out_dim, f"{tag}:b2", 1 / math.sqrt(hidden))[0],
    }


def project_vectors(vec_col, params: dict) -> Column:
    """Apply the MLP to every vector, one matmul per Arrow batch.  The
    weights travel inside the UDF closure (a few thousand doubles)."""
    w1, b1, w2, b2 = (np.asarray(params[k], dtype=np.float64) for k in ("w1", "b1", "w2", "b2"))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _proj(vs: pd.Series) -> pd.Series:
        if len(vs) == 0:
            return pd.Series([], dtype=object)
        x = np.stack([np.asarray(v, dtype=np.float64) for v in vs])
        h = np.maximum(x @ w1 + b1, 0.0)
        return pd.Series(list(h @ w2 + b2))

    return _proj(_col(vec_col))
