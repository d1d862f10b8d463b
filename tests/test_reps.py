"""Joins and searches on distinct vectors: brute force, pruning, copies, the stored index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from unionlake.operators import exact_join, lsh, search as S
from unionlake.sources import fixtures as fx

from conftest import SF_SMALL, vecs_df


def ids(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id LONG, vec ARRAY<DOUBLE>")


@pytest.mark.parametrize("seed", [0, 1])
def test_exact_pairs_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 24))
    rows = np.concatenate([centres[rng.integers(0, 9, 700)] + rng.choice([0.05, 0.5, 1.0], (700, 1)) * rng.normal(size=(700, 24)), rng.normal(size=(200, 24))])
    other = rng.normal(size=(150, 24)) + centres[rng.integers(0, 9, 150)]
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    lake, asked = ids(spark, rows).repartition(5), ids(spark, other).repartition(2)
    for q_rows, q in ((rows, lake), (other, asked)):
        cos = unit(q_rows) @ unit(rows).T
        for t in (-0.5, 0.0, 0.3, 0.7, 0.95):
            got = {(r["q_id"], r["c_id"]) for r in exact_join.candidate_pairs(q, lake, t).collect()}
            sure, may = cos >= t, cos >= t - 2e-6
            assert {(i, j) for i, j in zip(*np.nonzero(sure))} <= got <= {(i, j) for i, j in zip(*np.nonzero(may))}, t
    assert exact_join.candidate_pairs(lake.limit(0), lake, 0.5).count() == 0


def test_pruning_on_embeddings(spark):
    """Vectors without structure: nearly all pairs go before half of the components are read."""
    e = fx.embedding_vectors(spark, SF_SMALL)
    reps, _ = lsh.representatives(e)
    shares = exact_join.pruning(reps, reps, 0.7)
    print("pairs left by lists and stages at 0.7:", [round(s, 4) for s in shares])
    assert shares == sorted(shares, reverse=True) and shares[3] < 0.1 and shares[-1] < 0.01
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 32))
    clustered = ids(spark, centres[rng.integers(0, 20, 1500)] + 0.05 * rng.normal(size=(1500, 32)))
    assert exact_join.pruning(clustered, clustered, 0.9)[0] < 0.5  # lists alone


def test_exact_join_needs_a_threshold(spark):
    v = vecs_df(spark, [("a", "x", [1.0, 0.0])])
    for t in (None, -1.0, 1.5):
        with pytest.raises(ValueError):
            lsh.cosine_join(v, v, t)


def expanded_search(v, k, threshold, with_matches=False):
    """The search on pairs of columns, as its parts define it."""
    merged = S.merge_backends(lsh.cosine_join(v, v, threshold))
    scored, best = S.table_scores_from_hits(merged, 1)
    r = S.rank_tables(scored, k).select(F.col("q_table").alias("query_table"), "rank", F.col("c_table").alias("cand_table"), "score", "n_matched")
    return S.topk_with_matches(r, best) if with_matches else r


def random_lake(spark, seed):
    """Tables that share vectors, whole copies of tables, and a vector that a third of the columns hold."""
    rng = np.random.default_rng(seed)
    pool = rng.normal(size=(12, 6))
    rows = []
    for t in range(14):
        for c in range(rng.integers(1, 5)):
            v = pool[0] if rng.random() < 0.33 else pool[rng.integers(0, 12)] + (rng.random() < 0.5) * 0.2 * rng.normal(size=6)
            rows.append((f"t{t}", f"c{c}", v.tolist()))
    rows += [(f"copy{i}", c, v) for i in range(5) for t, c, v in rows if t == "t3"] + [("zero", "z", [0.0] * 6)]
    return vecs_df(spark, rows)


@pytest.mark.parametrize("k", [1, 4, None])
def test_search_on_representatives_equals_search_on_columns(spark, k):
    key = lambda df: sorted(tuple(r) for r in df.collect())
    for seed in (1, 2):
        v = random_lake(spark, seed)
        got = S.search(v, v, k=k, threshold=0.4, method="exact", with_matches=True)
        want = expanded_search(v, k, 0.4, with_matches=True).select(*got.columns)
        assert key(got) == key(want)
        hits = lsh.exact_rep_hits(v, v, 0.4)
        by_column = S.nearest_columns(hits, k)
        if k:
            order = lambda r: (-r["score"], r["c_table"], r["c_column"])
            all_hits, best = {}, {}
            for r in hits.columns().collect():
                all_hits.setdefault((r["q_table"], r["q_column"]), []).append(r)
            for r in by_column.collect():
                best.setdefault((r["q_table"], r["q_column"]), []).append(r)
            assert {q: sorted(map(order, x))[:k] for q, x in all_hits.items()} == {q: sorted(map(order, x)) for q, x in best.items()}


def test_search_by_blocks_makes_no_pairs(spark, monkeypatch):
    """Where blocks are compared, scores and weights are summed in the tasks: same tables and scores, and no pair is a row."""
    from unionlake.operators import signature_blocks as B

    v = random_lake(spark, 1).repartition(3)
    some = v.where("table_name in ('t1', 't3', 'copy2', 'zero')")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    cases = [(v, 2, {}), (some, None, {}), (v, None, {"score": "signature", "bits": 100})]
    found = lambda: [key(S.search(q, v, k=k, threshold=0.3, **kw)) for q, k, kw in cases]
    want = found()
    assert all(want) and want[0] == key(expanded_search(v, 2, 0.3))
    monkeypatch.setattr(lsh, "MATCHES", 0)
    monkeypatch.setattr(lsh, "PRODUCTS", 1 << 40)
    pairs = B.compared
    monkeypatch.setattr(B, "compared", lambda *a: None)
    for size, hits, entries, tasks in ((2048, 1 << 20, 2_000_000, 3), (5, 3, 0, 40)):
        monkeypatch.setattr(B.blocks, "__defaults__", (size,))
        for name, value in (("HITS", hits), ("ENTRIES", entries), ("TASKS", tasks)):
            monkeypatch.setattr(B, name, value)
        assert found() == want
    assert S.search(v.limit(0), v, k=2, threshold=0.3, dim=6).count() == 0
    monkeypatch.setattr(B, "compared", pairs)
    matched = S.search(v, v, k=2, threshold=0.3, with_matches=True)
    assert key(matched.select("query_table", "rank", "cand_table", "score", "n_matched")) == want[0]


def test_hits_do_not_grow_with_copies(spark):
    n = 40
    v = vecs_df(spark, [(f"t{i:03d}", c, x) for i in range(n) for c, x in (("a", [1.0, 0.2, 0.0]), ("b", [0.9, 0.3, 0.1]))])
    hits = lsh.exact_rep_hits(v, v, 0.5)
    assert hits.pairs.count() == 4 and hits.columns().count() == (2 * n) ** 2
    parts, tables = S.table_classes(hits.q_members)
    assert tables.select("class").distinct().count() == 1
    assert S.class_scores(S.rep_weights(hits), parts, parts).count() == 1
    out = S.search(v, v, k=3, threshold=0.5, method="exact").collect()
    assert len(out) == 3 * n and {r["cand_table"] for r in out} == {"t000", "t001", "t002"}


def test_index_generations(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(f"t{i}", "c", rng.normal(size=8).tolist()) for i in range(30)]
    rows += [(f"t{i}", "d", rows[0][2]) for i in range(20, 30)]
    first, late = vecs_df(spark, rows[:20]), vecs_df(spark, rows[20:])
    everything = vecs_df(spark, rows)
    path = str(tmp_path / "index")
    lsh.build_index(first, path, 0.8, seed=3)
    import os
    before = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs}
    index = lsh.append_to_index(late, path)
    after = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(os.path.join(path, "generation-000000")) for f in fs}
    assert before == after  # adding tables rewrites nothing
    assert index.reps.count() == 30 and index.members.count() == 40 and index.reps.select("key").distinct().count() == 30
    key = lambda df: sorted(tuple(r) for r in df.collect())
    want = key(lsh.lsh_join(everything, everything, 0.8, seed=3))
    again = lsh.load_or_build_index(everything, path, 0.8, seed=3)
    for found in (lsh.lookup(everything, again), lsh.lookup(None, again)):
        assert key(found.columns()) == want
    plan = lsh.lookup(everything, again).pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "generation-000000/bands" in plan or "band_key" in plan
    lake_side = lsh.lookup(None, again).pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in lake_side  # stored bands are read, no signature is exploded
    assert key(S.search(everything, again, k=3)) == key(S.search(everything, everything, k=3, threshold=0.8, seed=3))
    with pytest.raises(FileExistsError):
        lsh.build_index(first, path, 0.8)
    with pytest.raises(FileNotFoundError):
        lsh.load_index(spark, str(tmp_path / "none"))
