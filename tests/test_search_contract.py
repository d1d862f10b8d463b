import numpy as np
from pyspark.sql import functions as F

from unionlake.operators import clean, search as S

from conftest import vecs_df


def hits_df(spark, rows):
    return spark.createDataFrame(rows, "q_table STRING, q_column STRING, c_table STRING, c_column STRING, score DOUBLE")


def test_ecdf_is_searchsorted_right(spark):
    scores = [0.9, 0.8, 0.8, 0.75, 0.95]
    h = hits_df(spark, [("q", "a", f"t{i}", "c", s) for i, s in enumerate(scores)])
    w = S.score_ecdf(S.merge_backends(h), 1).select("c_table", F.col("weights")[0].alias("w")).collect()
    srt = np.sort(scores)
    expect = {f"t{i}": np.searchsorted(srt, s, side="right") / len(scores) for i, s in enumerate(scores)}
    assert {r["c_table"]: r["w"] for r in w} == expect


def test_best_column_tie_takes_smallest_name(spark):
    h = hits_df(spark, [("q", "a", "t", "zeta", 0.9), ("q", "a", "t", "alpha", 0.9), ("q", "a", "t", "mid", 0.8)])
    best = S.best_column_per_table(S.score_ecdf(S.merge_backends(h), 1)).collect()
    assert len(best) == 1 and best[0]["c_column"] == "alpha"


def test_table_score_uses_matched_columns_only(spark):
    # query column b hits nothing in t2: t2's score is its column a score alone
    h = hits_df(spark, [("q", "a", "t1", "x", 0.9), ("q", "b", "t1", "y", 0.7), ("q", "a", "t2", "x", 0.8)])
    scored, _ = S.table_scores_from_hits(S.merge_backends(h), 1)
    got = {r["c_table"]: r["table_scores"][0] for r in scored.collect()}
    # weights: a -> {0.9: 1.0, 0.8: 0.5}; b -> {0.7: 1.0}
    assert got["t2"] == 0.8
    assert abs(got["t1"] - (0.9 * 1.0 + 0.7 * 1.0) / 2.0) < 1e-9


def test_rank_ties_by_table_name(spark):
    sc = spark.createDataFrame([("q", "b", 1, [0.5]), ("q", "a", 1, [0.5]), ("q", "c", 1, [0.9])],
                               "q_table STRING, c_table STRING, n_matched INT, table_scores ARRAY<DOUBLE>")
    r = S.rank_tables(sc, 2).orderBy("rank").collect()
    assert [x["c_table"] for x in r] == ["c", "a"]


def test_split_on_last_bang(spark):
    df = spark.createDataFrame([("a!b!c",)], "id STRING")
    t, c = clean.split_column_id("id")
    r = df.select(t.alias("t"), c.alias("c")).first()
    assert (r["t"], r["c"]) == ("a!b", "c")


def test_empty_and_numeric_queries_find_nothing(spark):
    v = vecs_df(spark, [("q", "zero", [0.0, 0.0]), ("l", "x", [1.0, 0.0])])
    out = S.search(v.where("table_name = 'q'"), v, k=5, threshold=0.5, method="exact")
    assert out.count() == 0
    cells = spark.createDataFrame([("t", "n", 0, 1, "1.5"), ("t", "n", 0, 2, " -2e3 "), ("t", "s", 1, 1, "x1")],
                                  "table_name STRING, column_name STRING, col_pos INT, row_id BIGINT, value STRING")
    assert [r["column_name"] for r in clean.exclude_numeric_columns(cells).select("column_name").distinct().collect()] == ["s"]


def test_self_match_and_exclude_self(spark):
    v = vecs_df(spark, [("a", "x", [1.0, 0.1]), ("b", "y", [1.0, 0.12]), ("c", "z", [0.0, 1.0])])
    with_self = S.search(v, v, k=None, threshold=0.9, method="exact").where("query_table = 'a'").collect()
    assert {r["cand_table"] for r in with_self} == {"a", "b"}
    no_self = S.search(v, v, k=None, threshold=0.9, method="exact", exclude_self=True).where(
        "query_table = 'a'").collect()
    assert {r["cand_table"] for r in no_self} == {"b"}


def test_cleaning_order(spark):
    rows = [("t", "a", 0, 1, "x"), ("t", "a", 0, 2, "y"), ("t", "b", 1, 1, None), ("t", "b", 1, 2, None),
            ("t", "c", 2, 1, "p"), ("t", "c", 2, 2, None)]
    cells = spark.createDataFrame(rows, "table_name STRING, column_name STRING, col_pos INT, row_id BIGINT, value STRING")
    out = clean.clean_lake(cells, "any").collect()
    # all-null column b goes first, then row 2 (null in c) goes
    assert sorted((r["column_name"], r["row_id"]) for r in out) == [("a", 1), ("c", 1)]


def test_name_join_equals_brute_force(spark):
    import random
    rnd = random.Random(3)
    alphabet = "abcde_"
    names = sorted({"".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 7))) for _ in range(120)})
    rows = [(f"t{i % 7}", n) for i, n in enumerate(names)] + [("big", "id"), ("big2", "ID"), ("x", "ids")]
    df = spark.createDataFrame(rows, "table_name STRING, column_name STRING")

    def grams(n):
        p = "#" + n.lower() + "#"
        return {p} if len(p) < 3 else {p[i:i + 3] for i in range(len(p) - 2)}

    for t in (0.3, 0.5, 0.8):
        got = {(r["q_table"], r["q_column"], r["c_table"], r["c_column"], r["score"])
               for r in S.name_hits(df, df, t).collect()}
        exp = set()
        for qt, qc in rows:
            for ct, cc in rows:
                a, b = grams(qc), grams(cc)
                j = round(len(a & b) / len(a | b), 6)
                if j >= t:
                    exp.add((qt, qc, ct, cc, j))
        assert got == exp, t
