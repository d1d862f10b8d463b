import numpy as np
from pyspark.sql import functions as F

from unionlake.functions import vectors as V
from unionlake.operators import lsh
from unionlake.sources import fixtures as fx

from conftest import SF_SMALL


def test_band_parameters():
    assert V.lsh_params(0.7) == (64, 16)


def test_signature_bits_match_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(f"t{i}", "c", [float(x) for x in rng.normal(size=8)]) for i in range(20)]
    df = spark.createDataFrame(rows, "table_name STRING, column_name STRING, vec ARRAY<DOUBLE>")
    got = {r["table_name"]: r["bits"] for r in lsh.signatures(df, bits=128, seed=3, dim=8).collect()}
    planes = V.hyperplanes(128, 8, 3)
    for t, _, v in rows:
        on = (np.asarray(v) @ planes.T) >= 0
        words = [int(sum(1 << j for j in range(64) if on[64 * w + j])) for w in range(2)]
        words = [x - (1 << 64) if x >= 1 << 63 else x for x in words]
        assert got[t] == words


def test_band_join_is_subset_of_exact(spark):
    v = fx.embedding_vectors(spark, SF_SMALL)
    ex = {tuple(r) for r in lsh.cosine_join(v, v, 0.3).select("q_table", "q_column", "c_table", "c_column").collect()}
    ap = {tuple(r) for r in lsh.lsh_join(v, v, 0.3).select("q_table", "q_column", "c_table", "c_column").collect()}
    assert ap <= ex
    # self pairs always collide
    n = v.count()
    assert sum(1 for a, b, c, d in ap if (a, b) == (c, d)) == n


def test_identical_vectors_collapse_but_expand(spark):
    rows = [(f"t{i}", "c", [1.0, 2.0, 3.0]) for i in range(30)] + [("u", "d", [3.0, 2.0, 1.0])]
    df = spark.createDataFrame(rows, "table_name STRING, column_name STRING, vec ARRAY<DOUBLE>")
    out = lsh.lsh_join(df, df, 0.9, dim=3)
    assert out.where("q_table like 't%' and c_table like 't%'").count() == 30 * 30
    assert out.where(F.col("score") > 1.0).count() == 0


def test_recall_by_band_curve(spark):
    """Candidate recall of pairs at cosine c follows 1-(1-p^r)^b."""
    rng = np.random.default_rng(7)
    b, r = V.lsh_params(0.7)
    base = rng.normal(size=(200, 16))
    noise = rng.normal(size=(200, 16))
    cos_t = 0.8
    # unit vectors with cosine cos_t to their partner
    u = base / np.linalg.norm(base, axis=1, keepdims=True)
    w = noise - (noise * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    partner = cos_t * u + np.sqrt(1 - cos_t ** 2) * w
    q = spark.createDataFrame([(f"q{i}", "c", u[i].tolist()) for i in range(200)],
                              "table_name STRING, column_name STRING, vec ARRAY<DOUBLE>")
    c = spark.createDataFrame([(f"q{i}", "p", partner[i].tolist()) for i in range(200)],
                              "table_name STRING, column_name STRING, vec ARRAY<DOUBLE>")
    band = lambda df, id_: lsh.band_rows(lsh.signatures(df).withColumn("key", F.col("table_name")), 0.7, lsh.DEFAULT_BITS).withColumnRenamed("key", id_)
    cand = band(q, "q").join(band(c, "c"), ["band_id", "band_key"]).where("q = c").select("q").distinct().count()
    p = V.collision_probability(cos_t)
    expect = 1 - (1 - p ** r) ** b
    assert abs(cand / 200 - expect) < 0.12


def test_exact_join_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(12, 10))
    vecs = np.concatenate([base[rng.integers(0, 12, 150)] + 0.6 * rng.normal(size=(150, 10)),
                           rng.normal(size=(50, 10))])
    rows = [(f"t{i // 7}", f"c{i}", v.tolist()) for i, v in enumerate(vecs)] + [("z", "zero", [0.0] * 10)]
    df = spark.createDataFrame(rows, "table_name STRING, column_name STRING, vec ARRAY<DOUBLE>")
    u = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 6)
    for t in (0.2, 0.6, 0.9):
        got = {(r["q_column"], r["c_column"]) for r in lsh.cosine_join(df, df, t).collect()}
        exp = {(f"c{i}", f"c{j}") for i in range(len(vecs)) for j in range(len(vecs)) if sims[i, j] >= t}
        assert got == exp, t


def test_index_of_other_parameters_is_an_error(spark, tmp_path):
    import pytest
    from unionlake.operators import lsh
    vecs = spark.createDataFrame([("t", f"c{i}", [1.0, float(i)] + [0.5] * 62) for i in range(4)],
                                 "table_name string, column_name string, vec array<double>")
    path = str(tmp_path / "index")
    built = lsh.load_or_build_index(vecs, path, 0.7, seed=1)
    assert lsh.load_or_build_index(vecs, path, 0.7, seed=1).signatures().count() == built.signatures().count() == 4
    with pytest.raises(ValueError):
        lsh.load_or_build_index(vecs, path, 0.7, seed=2)


def test_unselective_bands_are_compared_in_blocks(spark, monkeypatch):
    from unionlake.operators import signature_blocks as B

    rng = np.random.default_rng(5)
    base = rng.normal(size=(90, 8))
    base[60:] = base[:30] + 0.05 * rng.normal(size=(30, 8))
    base[89] = base[0]  # one vector twice
    rows = [(f"t{i % 7}", f"c{i}", [float(x) for x in v]) for i, v in enumerate(base)] + [("t0", "zero", [0.0] * 8)]
    df = spark.createDataFrame(rows, "table_name STRING, column_name STRING, vec ARRAY<DOUBLE>").repartition(3)
    some = df.where("table_name in ('t1', 't3')")
    both = lambda q, **kw: sorted(map(tuple, lsh.lsh_join(q, df, 0.3, **kw).collect()))
    cases = [(df, {}), (some, {}), (df, {"score": "signature"}), (df, {"bits": 100})]
    joined = [both(q, **kw) for q, kw in cases]
    shapes, compared = [], B.compared
    monkeypatch.setattr(lsh, "MATCHES", 0)
    monkeypatch.setattr(lsh, "PRODUCTS", 1 << 40)
    monkeypatch.setattr(B, "compared", lambda *a: shapes.append(a[1].count()) or compared(*a))
    for size in (2048, 7):
        monkeypatch.setattr(B.blocks, "__defaults__", (size,))
        assert [both(q, **kw) for q, kw in cases] == joined
    assert len(shapes) == 8 and shapes[-1] >= 89 // 7  # no candidate pair was a row
