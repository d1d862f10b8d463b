"""What a task holds and what is shuffled does not grow with a table (findings of round 3)."""
import os
import tempfile

from pyspark.sql import functions as F

from unionlake.operators import clean, records, sampling, walks as W
from unionlake.plans import q_walks as QW
from unionlake.sources import fixture_files as FF, lake as LK
from conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_symmetrize_is_dealt_to_parts(spark):
    rows = [(1, 2, 1.0, 0), (2, 1, 5.0, 1), (3, 3, 2.0, 2), (3, 3, 4.0, 3), (None, 7, 1.0, 4), (7, None, 3.0, 5), (5, 4, 9.0, 6)]
    e = spark.createDataFrame(rows, "u BIGINT, v BIGINT, w DOUBLE, line_no BIGINT")
    want = {(1, 2): 5.0, (2, 1): 5.0, (3, 3): 4.0, (None, 7): 3.0, (7, None): 3.0, (5, 4): 9.0, (4, 5): 9.0}
    for parts in (None, 13):
        got = W.symmetrize(e, parts).collect()
        assert {(r["u"], r["v"]): r["w"] for r in got} == want and len(got) == len(want)
    assert W.symmetrize(e, 13).rdd.getNumPartitions() == 13 and plan(W.symmetrize(e, 13)).count("Exchange") == 1


def test_ranked_neighbours_are_dealt_to_parts(spark):
    adj = spark.range(600).selectExpr("IF(id < 300, 0, id % 7) u", "id v", "1.0D w").union(spark.createDataFrame([(None, 5, 1.0)], "u BIGINT, v BIGINT, w DOUBLE"))
    want = {}
    for u, v in sorted((r["u"], r["v"]) for r in adj.where("u is not null").collect()):
        want.setdefault(u, []).append(v)
    for join in ("-1", "10485760"):  # both joins that Spark may choose
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", join)
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", join)
        ranked = W.ranked_neighbours(adj, 13)
        assert ranked.rdd.getNumPartitions() == 13
        got = sorted((r["u"], r["rank"], r["v"]) for r in ranked.collect())
        assert got == [(u, k, v) for u in sorted(want) for k, v in enumerate(want[u])]
        assert got == sorted((r["u"], r["rank"], r["v"]) for r in W.ranked_neighbours(adj).collect())
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_web_tables_meet_once(spark):
    web = QW.web_tables(spark, SF_SMALL)
    assert plan(web).count("Exchange") == 1


def test_sample_rows_makes_no_list_of_rows(spark):
    c = spark.createDataFrame([(f"t{t}", f"c{k}", k, r, "x") for t in range(3) for r in range(9) for k in range(2)],
                              "table_name STRING, column_name STRING, col_pos INT, row_id BIGINT, value STRING")
    got = sampling.sample_rows(c, 4, seed=1)
    assert "Join" not in plan(got) and got.count() == 3 * 4 * 2
    packed = c.groupBy("table_name", "row_id").agg(F.sort_array(F.collect_list(F.struct("column_name", "col_pos", "value"))).alias("cells"))
    same = records.cells(sampling.sample_rows(packed, 4, seed=1))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, got.collect()))


def test_related_columns_do_not_deal_the_cells(spark):
    c = spark.range(200).select(F.lit("t").alias("table_name"), (F.col("id") % 2).cast("string").alias("column_name"), "id")
    got = clean.related_column_filter(c, c.where("column_name = '1'").select(F.col("table_name").alias("query_table"), "column_name"))
    assert "Exchange hashpartitioning" not in plan(got) and got.count() == 100


def test_lines_of_equal_order_are_dealt(spark):
    root = os.path.join(tempfile.mkdtemp(prefix="unionlake-lines-"), "x")
    df = spark.range(5000).select(F.col("id").cast("string").alias("l"), F.lit(0).alias("o")).union(spark.createDataFrame([("head", -1)], "l STRING, o INT"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    FF.write_text_lines(df, "l", root, order="o")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [sum(1 for _ in open(os.path.join(root, f))) for f in sorted(os.listdir(root)) if f.startswith("part-")]
    assert sum(sizes) == 5001 and max(sizes) < 4000
    first = sorted(f for f in os.listdir(root) if f.startswith("part-"))[0]
    assert open(os.path.join(root, first)).readline() == "head\n"


def test_large_tables_are_several_csv_files(spark):
    root = os.path.join(tempfile.mkdtemp(prefix="unionlake-csv-"), "x")
    r = spark.range(90).select(F.concat(F.lit("a b%"), (F.col("id") % 2).cast("string")).alias("table_name"), F.col("id").alias("row_id"),
                               records.pack(["k", "v,x"], [F.col("id").cast("string"), F.lit('q",')]).alias("cells"))
    FF.write_csv_lake(r, root, rows_per_file=10)
    assert len({f for _, _, fs in os.walk(root) for f in fs if f.endswith(".csv")}) >= 4
    got = [(x["table_name"], [(c["column_name"], c["value"]) for c in x["cells"]]) for x in LK.csv_records(spark, root).collect()]
    want = [(x["table_name"], [(c["column_name"], c["value"]) for c in x["cells"]]) for x in r.collect()]
    assert sorted(got) == sorted(want)


def test_pooling_reads_offsets_and_token_vectors_once(spark):
    from unionlake.plans import q_linearize as QL

    assert "Window" not in plan(QL.token_pool_columns(spark, SF_SMALL))
    assert "Generate" not in plan(QL.row_pool_columns(spark, SF_SMALL))
