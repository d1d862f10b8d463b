"""Operators on embeddings against plain computations."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from unionlake.llm import dictionary_clusters, pivot_codes, posting_search, queries
from unionlake.llm.centroid_graph import CentroidGraph

SCHEMA = "vec_id long, embedding array<float>, label int"
#: Nulls in every column, a null, NaN or infinite component, no components, zeros, ties, repeated rows.
ODD = [(0, None, 1), (1, [1.0] * 64, None), (None, [0.5] * 64, 2), (2, [None] + [1.0] * 63, 1), (3, [float("nan")] * 64, 1), (4, [float("inf")] + [0.0] * 63, 1), (5, [], 1), (6, [0.0] * 64, 1),
       (7, [1.0] * 64, 3), (7, [1.0] * 64, 3), (100, [1.0] * 64, None), (100, [1.0] * 64, None), (200, [-1.0] * 64, 2), (8, [1.0, -1.0] * 32, 2)]


def table(spark, rows, clash=()):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in clash:
        df = df.withColumn(c, F.lit("x"))
    return df


def random_rows(n, seed, copies=0.0, dims=64):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, dims))
    for i in range(1, n):
        if r.random() < copies:
            base[i] = base[int(r.integers(0, i))] + (r.random() < 0.5) * 0.01 * r.normal(size=dims)
    base /= np.linalg.norm(base, axis=1)[:, None]
    return [(int(i), [float(x) for x in v], int(i % 3) if i % 5 else None) for i, v in enumerate(base.astype(np.float32))]


def whole(rows, dims=None):
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    return [r for r in good if dims is None or len(r[1]) == dims]


# clustering

def plain_clusters(rows, k=40, rounds=5):
    kept = whole(rows, 64)
    x = [[math.floor(256 * v) for v in r[1]] for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, hashlib.sha256(f"2:{kept[i][0]}".encode()).hexdigest(), kept[i][1]))
    cents = [list(x[i]) for i in order[:k]]

    def assign():
        far = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents] for v in x]
        return [(f.index(min(f)), min(f)) for f in far]

    for _ in range(rounds):
        got = assign()
        for c in range(len(cents)):
            mine = [x[i] for i, g in enumerate(got) if g[0] == c]
            if mine:
                cents[c] = [sum(col) // len(mine) for col in zip(*mine)]
    got = assign()
    total = sum(g[1] for g in got)
    per = {c: sum(g[1] for g in got if g[0] == c) for c in range(len(cents))}
    sha = {c: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for c, v in enumerate(cents)}
    return sorted(((r[0], g[0], g[1], per[g[0]], total, sha[g[0]]) for r, g in zip(kept, got)), key=str)


def clustered(df, **kw):
    rows, cents = dictionary_clusters.cluster(df, **kw)
    return sorted((tuple(r) for r in dictionary_clusters.with_inertia(rows, cents).collect()), key=str)


def test_clusters_plain(spark):
    rows = random_rows(230, 5, copies=0.3)
    assert clustered(table(spark, rows, clash=("id", "cluster", "distance", "n", "sums")).repartition(3), chunk=50) == plain_clusters(rows)


def test_clusters_odd_rows(spark):
    assert clustered(table(spark, ODD)) == plain_clusters(ODD)
    assert clustered(table(spark, [])) == []
    assert clustered(table(spark, ODD[:1])) == []


def test_blocks_lose_nothing():
    r = np.random.default_rng(2)
    for rows in (r.integers(-3, 3, (40, 12)), r.integers(-10**6, 10**6, (30, 5)), np.repeat(r.integers(-99, 99, (3, 16)), 50, axis=0), np.zeros((1, 4), np.int64)):
        blocks = dictionary_clusters.encode(rows)
        assert (np.hstack([b.entries[b.codes] for b in blocks]) == rows).all()
        cents = r.integers(-5, 5, (7, rows.shape[1]))
        assert (dictionary_clusters.distances(blocks, len(rows), cents) == ((rows[:, None] - cents[None]) ** 2).sum(axis=2)).all()
    assert max(b.width for b in dictionary_clusters.encode(np.repeat(r.integers(-99, 99, (3, 16)), 50, axis=0))) == 16  # copies share wide blocks


# codes

def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = whole(rows)
    size = -(-max(len(r[1]) for r in kept) // parts)
    x = [[math.floor(4096 * v) for v in r[1]] + [0] * (parts * size - len(r[1])) for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    part = lambda v, j: v[j * size : (j + 1) * size]
    books = [[part(x[i], j) for i in order] for j in range(parts)]

    def assign():
        out = []
        for v in x:
            code, error = [], 0
            for j in range(parts):
                far = [sum((a - b) ** 2 for a, b in zip(part(v, j), e)) for e in books[j]]
                code.append(far.index(min(far)))
                error += min(far)
            out.append((code, error))
        return out

    for _ in range(rounds):
        got = assign()
        for j in range(parts):
            for e in range(len(books[j])):
                mine = [part(v, j) for v, g in zip(x, got) if g[0][j] == e]
                if mine:
                    books[j][e] = [sum(c) // len(mine) for c in zip(*mine)]
    got = assign()
    per = {}
    for r, g in zip(kept, got):
        per[r[2]] = per.get(r[2], 0) + g[1]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{c:02x}" for c in g[0]), g[1], per[r[2]], sha) for r, g in zip(kept, got)), key=str)


def coded(df):
    found = pivot_codes.compress(df)
    sha = pivot_codes.books_digest(found.books)
    return sorted(((r["id"], r["code"], r["error"], r["label_error"], sha) for r in pivot_codes.label_errors(found.rows).collect()), key=str), found


def test_codes_plain(spark):
    rows = random_rows(250, 7, copies=0.2)
    got, found = coded(table(spark, rows, clash=("id", "code", "far", "parts", "v", "n")).repartition(3))
    assert got == plain_codes(rows)
    assert all(n < 250 * 8 * 16 for n in found.evaluations)  # the bounds spare exact evaluations


def test_codes_odd_rows(spark):
    assert coded(table(spark, ODD))[0] == plain_codes(ODD)
    assert coded(table(spark, []))[0] == []
    rows = random_rows(40, 3, dims=11)  # not a multiple of eight
    assert coded(table(spark, rows))[0] == plain_codes(rows)


def test_nearest_entry_with_pivots():
    r = np.random.default_rng(4)
    for scale in (2, 300, 1 << 26):  # small numbers tie often
        rows, entries = r.integers(-scale, scale, (500, 8)), r.integers(-scale, scale, (16, 8))
        entries[9] = entries[3]
        pivots = pivot_codes.choose_pivots(entries, 4)
        index, best, done = pivot_codes.nearest(rows, pivot_codes._distance(rows, pivots).astype(np.float32), entries, pivots)
        far = ((rows[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
        assert (best == far.min(axis=1)).all() and (index == far.argmin(axis=1)).all() and done < 500 * 16


# search

def plain_search(rows, every=100, k=10):
    kept = [r for r in whole(rows) if any(r[1])]
    dims = max((len(r[1]) for r in kept), default=0)
    x = np.array([r[1] + [0.0] * (dims - len(r[1])) for r in kept], np.float32).astype(np.float64).reshape(len(kept), dims)
    out = {}
    for i, r in enumerate(kept):
        if r[0] is not None and r[0] % every == 0:
            d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
            near = sorted((d[j], kept[j][0] if kept[j][0] is not None else 1 << 70, j) for j in range(len(kept)) if j != i)[:k]
            out.setdefault(r[0], []).append([(s, c) for s, c, _ in near])
    return out


def searched(df, params=posting_search.SearchParams(), ratio=None, every=100):
    index = posting_search.build_index(df, params=params)
    if index is None:
        return {}, None
    got = {}
    for r in posting_search.search(index, df.where(F.col("vec_id") % every == 0), ratio=ratio).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"] if r["vec_id"] is not None else 1 << 70))
    return {q: sorted(v) for q, v in got.items()}, index


def same(got, want, once=True):
    assert got.keys() == {q for q, v in want.items() if v[0]}
    for q, v in got.items():
        lists = sorted((n, s, c) for one in want[q] for n, (s, c) in enumerate(one, 1))
        assert [(n, c) for n, _, c in v] == [(n, c) for n, _, c in lists]
        assert np.allclose([s for _, s, _ in v], [s for _, s, _ in lists], rtol=1e-12, atol=1e-12)


def recall(got, want):
    hits = [(c in {x for _, _, x in got.get(q, [])}) for q, v in want.items() for _, c in v[0]]
    return sum(hits) / len(hits)


def test_search_all_lists_is_exact(spark):
    rows = random_rows(400, 11, copies=0.4) + [(1000 + i, [0.1] * 64, 0) for i in range(60)]  # a large group of copies
    got, index = searched(table(spark, rows, clash=("rep", "list", "q", "h1", "id")).repartition(4), posting_search.SearchParams(block=16), ratio=math.inf, every=20)
    same(got, plain_search(rows, 20))
    assert index.blocks.agg(F.max("n")).first()[0] <= 16


def test_search_odd_rows(spark):
    got, _ = searched(table(spark, ODD), ratio=math.inf)
    same(got, plain_search(ODD))
    assert searched(table(spark, []))[0] == {} and searched(table(spark, ODD[:1] + ODD[7:8]))[0] == {}
    assert searched(table(spark, [(100, [1.0] * 4, 0)]))[0] == {}  # no candidate
    got, _ = searched(table(spark, [(100, [1.0, 0.0], 0), (1, [1.0, 0.0, 0.5], 0), (2, [2.0], 0)]))
    assert got == {100: [(1, 0.5, 1), (2, 1.0, 2)]}  # shorter vectors are filled up with zeros


@pytest.mark.parametrize("seed", [1, 2])
def test_search_recall(spark, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(30, 16)) * 3
    clusters = [(int(i), [float(v) for v in (centres[i % 30] + r.normal(size=16)).astype(np.float32)], 0) for i in range(3000)]
    for rows in (clusters, random_rows(1500, seed)):
        got, index = searched(table(spark, rows).repartition(4), every=10)
        assert recall(got, plain_search(rows, 10)) >= 0.93
    assert len(index.graph) > 30


def test_search_reads_few_lists_of_clusters(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(40, 32)) * 5
    rows = [(int(i), [float(v) for v in (centres[i % 40] + 0.3 * r.normal(size=32)).astype(np.float32)], 0) for i in range(4000)]
    df = table(spark, rows).repartition(4)
    index = posting_search.build_index(df)
    asked = index.reps.where(F.col("first") % 100 == 0)
    ratio = posting_search.fit_ratio(index, asked)
    points = np.array([r[0] for r in asked.select("v").collect()])
    row, _ = index.graph.within((points / index.unit).astype(np.float32), ratio)  # centroids near the queries
    assert len(row) / len(points) < 0.2 * len(index.graph)
    stored = index.blocks.agg(F.sum("n")).first()[0]
    assert 4000 <= stored <= 4 * 4000
    n_list = [r[0] for r in index.blocks.groupBy("list").agg(F.sum("n")).collect()]
    assert max(n_list) < 8 * np.mean(n_list)


def test_graph_finds_near_centroids():
    r = np.random.default_rng(0)
    points = r.normal(size=(2000, 12))
    graph, rows = CentroidGraph(points), r.normal(size=(200, 12)).astype(np.float32)
    far = np.sqrt(((rows[:, None] - points[None]) ** 2).sum(axis=2))
    node, dist = graph.beam(rows, 16)
    assert (node[:, 0] == far.argmin(axis=1)).mean() > 0.95 and (np.diff(dist, axis=1) >= 0).all()
    row, c = graph.within(rows, 1.2, at_least=1)
    want = far <= 1.2 * far.min(axis=1)[:, None]
    assert want[row, c].mean() > 0.95 and len(row) >= 0.95 * want.sum()


def test_registered_queries(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op11_subvector_dictionaries"](spark, SF).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)
    assert got == plain_clusters(rows)
    found = {}
    for r in queries.QUERIES["op13_balanced_posting_lists"](spark, SF).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    want = plain_search(rows)
    assert recall(found, want) >= 0.9 and all([x[0] for x in sorted(v)] == list(range(1, 11)) for v in found.values())


def test_boundary_vectors_are_in_several_lists(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(r.random((3000, 2)).astype(np.float32))]
    got, index = searched(table(spark, rows).repartition(4), every=30)
    assert recall(got, plain_search(rows, 30)) >= 0.93
    assert index.sizes.sum() > 1.1 * 3000
