from collections import Counter

from pyspark.sql import functions as F

from unionlake.operators import sampling, walks as W


def lake(spark, n_rows=50):
    rows = [(f"t{t}", "c", 0, r, f"v{r}") for t in range(3) for r in range(n_rows)]
    return spark.createDataFrame(rows, "table_name STRING, column_name STRING, col_pos INT, row_id BIGINT, value STRING")


def test_sample_rows_deterministic_and_bounded(spark):
    c = lake(spark)
    a = sorted(map(tuple, sampling.sample_rows(c, 5, seed=3).collect()))
    b = sorted(map(tuple, sampling.sample_rows(c.repartition(7), 5, seed=3).collect()))
    assert a == b
    per = Counter(r[0] for r in a)
    assert set(per.values()) == {5}
    assert sampling.sample_rows(c, 500, seed=3).count() == c.count()


def test_weighted_choice_distribution(spark):
    nbrs = F.array(F.struct(F.lit(1).cast("long").alias("v"), F.lit(1.0).alias("w")),
                   F.struct(F.lit(2).cast("long").alias("v"), F.lit(3.0).alias("w")))
    walks = spark.range(4000).select(F.col("id").cast("string").alias("walk_id"), F.inline(nbrs))
    key = W.choice_key(5, F.col("walk_id"), F.lit(1), F.col("v"), F.col("w"))
    ch = (walks.groupBy("walk_id").agg(F.min(F.struct(key.alias("k"), "v")).alias("c"))
          .groupBy("c.v").count().collect())
    frac = {r["v"]: r["count"] / 4000 for r in ch}
    assert abs(frac[2] - 0.75) < 0.03


def test_walks_refuse_visited_nodes(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0), (2, 3, 1.0)], "u BIGINT, v BIGINT, w DOUBLE")
    adj = W.symmetrize(e)
    walks = W.graph_walks(adj, 3, 6, seed=1).collect()
    for w in walks:
        p = w["path"]
        assert len(p) <= 6
        assert len(set(p[1:])) == len(p[1:])  # only the start may come back
    assert sorted(map(tuple, W.graph_walks(adj, 3, 6, seed=1).select("walk_id", "path").collect())) == \
        sorted((w["walk_id"], w["path"]) for w in walks)


def test_symmetrize_last_weight_wins(spark):
    e = spark.createDataFrame([(1, 2, 1.0, 0), (2, 1, 5.0, 1)], "u BIGINT, v BIGINT, w DOUBLE, line_no BIGINT")
    got = {(r["u"], r["v"]): r["w"] for r in W.symmetrize(e).collect()}
    assert got == {(1, 2): 5.0, (2, 1): 5.0}


def test_cumulative_weights_two_level(spark):
    import random
    rnd = random.Random(2)
    rows = [(0, v, float(rnd.randint(1, 5))) for v in rnd.sample(range(1, 5000), 400)] + [(7, 3, 2.0), (7, 9, 1.0)]
    adj = spark.createDataFrame(rows, "u BIGINT, v BIGINT, w DOUBLE")
    got = {(r["u"], r["v"]): (r["running"], r["total"]) for r in W.cumulative_weights(adj, chunk=64).collect()}
    for u in (0, 7):
        nb = sorted((v, w) for uu, v, w in rows if uu == u)
        run, tot = 0.0, sum(w for _, w in nb)
        for v, w in nb:
            run += w
            assert got[(u, v)] == (run, tot)


def plain_walks(edges, number, length, seed, fan):
    """Draws from running weights, range by range, as the operator states them."""
    import hashlib

    def u(*parts):
        return (int(hashlib.md5(":".join([str(seed), *map(str, parts)]).encode()).hexdigest()[:8], 16) + 0.5) / 2**32

    near = {}
    for a, b, w in edges:
        near.setdefault(a, {})[b] = w
    levels = {}
    for a, ws in near.items():
        rows = sorted(ws.items())
        levels[a] = [[rows[i : i + fan] for i in range(0, len(rows), fan)]]
        while len(levels[a][-1]) > 1:
            rows = [(i, sum(w for _, w in r)) for i, r in enumerate(levels[a][-1])]
            levels[a].append([rows[i : i + fan] for i in range(0, len(rows), fan)])

    def pick(row, x):
        total = run = 0.0
        total = sum(w for _, w in row)
        for v, w in row:
            run += w
            if run > x * total:
                return v
        return row[-1][0]

    out = []
    for i in range(number):
        for start in near:
            path, draws, name = [start], 0, f"{i}:{start}"
            while len(path) < length and draws < 20 * length and path[-1] in near:
                idx, node = 0, levels[path[-1]]
                for level in range(len(node) - 1, -1, -1):
                    idx = pick(node[level][idx], u(name, draws, *([f"level{level}"] if level else [])))
                draws += 1
                if idx not in path[1:]:
                    path.append(idx)
            out.append((name, path))
    return sorted(out)


def test_walks_equal_plain_draws_at_hubs(spark):
    import random

    rnd = random.Random(9)
    edges = {(0, v): float(rnd.choice([0, 1, 2, 9])) for v in rnd.sample(range(1, 10**12), 70)}  # a hub with sparse ids
    edges |= {(rnd.randrange(1, 30), rnd.randrange(1, 30)): float(rnd.randint(1, 4)) for _ in range(60)}
    edges |= {(v, 0): 1.0 for _, v in list(edges)[:70]} | {(5, 31): 1.0, (32, 33): 0.0}  # 31 and 33 are dead ends
    rows = [(a, b, w) for (a, b), w in edges.items()]
    adj = spark.createDataFrame(rows, "u BIGINT, v BIGINT, w DOUBLE").repartition(5)
    for fan, depth in ((4, 4), (256, 1)):
        index, levels = W.neighbour_index(adj, fan)
        assert levels == depth and index.agg(F.max(F.size("entries"))).first()[0] <= fan
        got = sorted((r["walk_id"], r["path"]) for r in W.graph_walks(adj, 2, 5, seed=4, fan=fan).collect())
        assert got == plain_walks(rows, 2, 5, 4, fan)


def test_walks_end_when_all_draws_are_known_nodes(spark):
    adj = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "u BIGINT, v BIGINT, w DOUBLE")
    assert sorted(r["path"] for r in W.graph_walks(adj, 1, 6, seed=1).collect()) == [[1, 2, 1], [2, 1, 2]]


def test_hub_ranges_follow_rank(spark):
    rows = [(0, v * 10**9, 1.0) for v in range(1000)]
    adj = spark.createDataFrame(rows, "u BIGINT, v BIGINT, w DOUBLE").repartition(6)
    index, levels = W.neighbour_index(adj, 100)
    assert index.where("level = 0").count() == 10 and levels == 2


def test_word_vectors_of_several_tasks(spark):
    import numpy as np

    rnd, rows = __import__("random").Random(1), []
    for _ in range(3000):
        group = rnd.randrange(2)
        rows.append((" ".join(f"g{group}w{rnd.randrange(8)}" for _ in range(8)),))
    corpus = spark.createDataFrame(rows, "walk STRING").repartition(4)
    for parts in (1, 4):
        v = {r["word"]: np.array(r["vec"]) for r in W.fit_word_vectors(corpus, dim=16, num_partitions=parts, lr=0.2).collect()}
        cos = lambda a, b: float(v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]))
        inside = np.mean([cos(f"g{g}w{i}", f"g{g}w{j}") for g in (0, 1) for i in range(8) for j in range(i)])
        across = np.mean([cos(f"g0w{i}", f"g1w{j}") for i in range(8) for j in range(8)])
        assert len(v) == 16 and inside > across + 0.2
