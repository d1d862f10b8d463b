import numpy as np

from unionlake.functions import vectors as V
from unionlake.operators import contrastive as CT


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(0)
    p = V.init_projection(6, 5, 4, tag="t")
    xi, xj = rng.normal(size=(3, 6)), rng.normal(size=(3, 6))
    loss, g = CT._grads(xi, xj, p, 0.5)
    eps = 1e-6
    for k in ("w1", "b1", "w2", "b2"):
        idx = (0, 0) if p[k].ndim == 2 else (1,)
        q = {kk: vv.copy() for kk, vv in p.items()}
        q[k][idx] += eps
        l2, _ = CT._grads(xi, xj, q, 0.5)
        assert abs((l2 - loss) / eps - g[k][idx]) < 1e-4, k


def pair_rows(seed, batches, size=8, dim=8):
    rng = np.random.default_rng(seed)
    rows = []
    for b in range(batches):
        for i in range(size):
            base = rng.normal(size=dim)
            rows.append((b, f"t{b}", f"c{i}", (base + 0.1 * rng.normal(size=dim)).tolist(), (base + 0.1 * rng.normal(size=dim)).tolist()))
    return rows


PAIRS = "batch_id INT, table_name STRING, column_name STRING, view_i ARRAY<DOUBLE>, view_j ARRAY<DOUBLE>"


def plain_training(rows, params, epochs, lr, ranks, seed=12345, tau=0.1, decay=1e-2):
    """The same steps without Spark."""
    import hashlib

    p = {k: np.array(v, float) for k, v in params.items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    ids, t = sorted({r[0] for r in rows}), 0
    for epoch in range(epochs):
        low = lr / 50
        rate = low + (lr - low) * (1 + np.cos(np.pi * epoch / epochs)) / 2
        order = sorted(ids, key=lambda b: hashlib.md5(f"{seed}:{epoch}:{b}".encode()).hexdigest())
        for at in range(0, len(order), ranks):
            grads = []
            for b in order[at : at + ranks]:
                xi, xj = (np.array([r[c] for r in rows if r[0] == b]) for c in (3, 4))
                grads.append(CT._grads(xi, xj, p, tau)[1])
            t += 1
            for k in p:
                g = np.mean([x[k] for x in grads], axis=0)
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] * (1 - rate * decay) - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return p, t


def test_training_equals_plain_steps(spark):
    rows = pair_rows(3, 5)
    pairs = spark.createDataFrame(rows, PAIRS).repartition(3)
    for ranks in (1, 2):
        like = V.init_projection(8, 6, 4)
        got, hist = CT.fit_projection(pairs, like, epochs=2, lr=1e-2, ranks=ranks)
        want, steps = plain_training(rows, like, 2, 1e-2, ranks)
        assert sum(e.steps for e in hist) == steps == 2 * -(-5 // ranks)
        last = hist[-1].loss <= hist[0].loss  # the best epoch is returned
        if last:
            assert all(np.allclose(got[k], want[k], atol=1e-9) for k in got)


def test_training_lowers_the_held_out_loss(spark):
    train, valid = (spark.createDataFrame(pair_rows(s, n), PAIRS) for s, n in ((1, 6), (2, 3)))
    untrained = V.init_projection(8, 8, 8)
    best, hist = CT.fit_projection(train, untrained, epochs=4, lr=2e-3, valid=valid)
    assert [e.steps for e in hist] == [6] * 4
    assert min(e.valid_loss for e in hist) < 0.9 * CT.validation_loss(valid, untrained, 0.1) and hist[-1].loss < hist[0].loss
    assert CT.validation_loss(valid, best, 0.1) == min(e.valid_loss for e in hist)
    same, none = CT.fit_projection(train.limit(0), best, epochs=2)
    assert none == [] and all((same[k] == best[k]).all() for k in best)


def test_tiled_loss_equals_one_matrix(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for b, n in ((0, 37), (1, 1), (2, 5)):
        zi, zj = rng.normal(size=(n, 6)), rng.normal(size=(n, 6))
        if b == 2:
            zj[1] = zi[1] = 0.0  # no direction
        _, losses, _ = CT._ntxent_batch(zi, zj, 0.05)
        for i in range(n):
            rows += [(b, i, 0, zi[i].tolist()), (b, i, 1, zj[i].tolist())]
            want[b, i, 0], want[b, i, 1] = losses[i], losses[n + i]
    df = spark.createDataFrame(rows, "batch_id LONG, pair LONG, side INT, vec ARRAY<DOUBLE>").repartition(5)
    for tile in (4, 2048):
        got = {(r["batch_id"], r["pair"], r["side"]): r["loss"] for r in CT.per_vector_loss(df, 0.05, tile=tile).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert CT.per_vector_loss(df.limit(0)).count() == 0


def test_tiles_are_bounded(spark):
    df = spark.range(1000).selectExpr("0L AS batch_id", "id DIV 2 AS pair", "CAST(id % 2 AS INT) AS side", "array(sin(id), cos(id), 0.3) AS vec")
    sizes = [len(r["pairs"]) // 8 for r in CT._tiles(df, "batch_id", 64).collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 64
