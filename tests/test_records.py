import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from unionlake.functions import text as tx
from unionlake.operators import clean, embed, records
from unionlake.sources import lake as LK

RECORDS = "table_name string, row_id long, cells array<struct<column_name: string, col_pos: int, value: string>>"


def random_lake(spark, seed):
    r = random.Random(seed)
    rows = []
    for t in range(12):
        width = r.randint(1, 4)
        empty, numeric = {c for c in range(width) if r.random() < 0.25}, {c for c in range(width) if r.random() < 0.3}
        for i in range(r.choice([0, 1, 3, 15])):
            value = lambda c: None if c in empty or r.random() < 0.15 else str(r.randint(0, 9)) if c in numeric else r.choice(["a", "b b", "7", ""])
            rows.append((f"t{t}", i, [(f"c{c}", c, value(c)) for c in range(width)]))
    return spark.createDataFrame(rows, RECORDS)


@pytest.mark.parametrize("policy", ["any", "all", "none"])
def test_record_cleaning_equals_cell_cleaning(spark, policy):
    for seed in (1, 2):
        recs = random_lake(spark, seed)
        want = {tuple(r) for r in clean.clean_lake(records.cells(recs), policy).collect()}
        assert {tuple(r) for r in records.cells(records.clean(recs, policy)).collect()} == want
        text = {tuple(r) for r in clean.indexable_cells(clean.clean_lake(records.cells(recs), policy)).collect()}
        assert {tuple(r) for r in records.cells(records.indexable(records.clean(recs, policy))).collect()} == text
        # the one-pass counts drop the same rows and columns
        cells = clean.indexable_cells(clean.clean_lake(records.cells(recs), policy))
        counts = records.indexable_counts(records.token_counts(recs, tx.cell_token), policy)
        key = lambda df: {(r["table_name"], r["column_name"], r["token"], r["n"]) for r in df.collect()}
        assert key(counts) == key(embed.column_token_counts(cells))
    with pytest.raises(ValueError):
        records.clean(recs, "some")


def test_row_cleaning_does_not_shuffle_cells(spark):
    recs = random_lake(spark, 3)
    plan = records.drop_rows_any_null(recs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def write(root, name, table, **kw):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    pq.write_table(table, path, **kw)


def rows_of(df, table):
    return [(r["row_id"], [(c["column_name"], c["value"]) for c in r["cells"]]) for r in df.where(F.col("table_name") == table).orderBy("row_id").collect()]


def test_parquet_lake_odd_files(spark, tmp_path):
    root = str(tmp_path)
    write(root, "nested.parquet", pa.table({"s": [{"x": 1, "y": None}, None], "l": [[1, 2], []], "m": pa.array([[("k", 1)], None], pa.map_(pa.string(), pa.int32())), "b": [b"\xff\x00", None]}))
    write(root, "a [1] {x}*50%+é.parquet", pa.table({"dot.ted": ["v"], "tick`s": ["w"], "_metadata": ["m"]}))
    write(root, "table_name=parted/part-0.parquet", pa.table({"k": ["p0", "p1"]}))
    write(root, "table_name=parted/part-1.parquet", pa.table({"k": ["p2"]}))
    write(root, "table_name=parted/part-2.parquet", pa.table({"k": pa.array([], pa.string())}))
    write(root, "table_name=parted/part-3.parquet", pa.table({"k": [3, 4]}))  # another type: another scan, the same table
    write(root, "table_name=p%25q/part-0.parquet", pa.table({"k": ["z"]}))
    write(root, "long.parquet", pa.table({"k": ["x" * 3_000_000, None]}), row_group_size=1)
    write(root, "none.parquet", pa.table({"k": pa.array([], pa.int32())}))
    recs = LK.parquet_records(spark, root)
    assert rows_of(recs, "nested") == [(0, [("s", '{"x":1}'), ("l", "[1,2]"), ("m", '{"k":1}'), ("b", "/wA=")]), (1, [("s", None), ("l", "[]"), ("m", None), ("b", None)])]
    assert rows_of(recs, "a [1] {x}*50%+é") == [(0, [("dot.ted", "v"), ("tick`s", "w"), ("_metadata", "m")])]
    assert rows_of(recs, "parted") == [(i, [("k", v)]) for i, v in enumerate(["p0", "p1", "p2", "3", "4"])]
    assert rows_of(recs, "p%q") == [(0, [("k", "z")])]
    assert [len(c[0][1] or "") for _, c in rows_of(recs, "long")] == [3_000_000, 0]
    assert rows_of(recs, "none") == []
    empty = tmp_path / "empty"
    empty.mkdir()
    assert LK.lake_scan_parquet(spark, str(empty)).count() == 0


def test_parquet_footers_that_only_spark_reads(spark, tmp_path, monkeypatch):
    from unionlake.sources import parquet_lake

    def unreadable(batches):  # as in a store that workers can't open
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("table_name", "path", "file")), pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, pa.string())], names=["table_name", "path", "file", "rows", "print"])

    root = str(tmp_path)
    write(root, "table_name=t/part-0.parquet", pa.table({"k": ["a", "b"]}))
    write(root, "table_name=t/part-1.parquet", pa.table({"k": ["c"]}))
    write(root, "u.parquet", pa.table({"n": [1]}))
    monkeypatch.setattr(parquet_lake, "_footers", unreadable)
    recs = LK.parquet_records(spark, root)
    assert [i for i, _ in rows_of(recs, "t")] == [0, 1, 2] and rows_of(recs, "u") == [(0, [("n", "1")])]


def test_roster_of_both_formats(spark, tmp_path):
    root = str(tmp_path / "lake")
    write(root, "p.parquet", pa.table({"k": ["x"]}))
    write(root, "q.parquet", pa.table({"k": ["y"]}))
    for name in ("c", "d"):
        with open(os.path.join(root, f"{name}.csv"), "w") as f:
            f.write(f"k\n{name}1\n")
    roster = str(tmp_path / "roster.txt")
    for lines, want in (("p.parquet\nc.csv\n", {"x", "c1"}), ("q.PARQUET\n", {"y"}), ("d.csv\n\n", {"d1"}), ("missing.csv\n", set()), ("", set())):
        with open(roster, "w") as f:
            f.write(lines)
        assert {r["value"] for r in LK.roster_scan(spark, root, roster).collect()} == want


def test_csv_classes_cut_narrow_files_narrowly(spark, tmp_path):
    for i, width in enumerate((1, 2, 3, 4, 5, 300)):
        with open(tmp_path / f"w{width}.csv", "w") as f:
            f.write(",".join(f"c{j}" for j in range(width)) + "\n" + ",".join(str(j) for j in range(width)) + "\n" + "x\n")
    recs = LK.csv_records(spark, str(tmp_path))
    got = {r["table_name"]: r["n"] for r in recs.groupBy("table_name").agg(F.collect_list(F.size("cells")).alias("n")).collect()}
    assert got == {f"w{w}": [w, w] for w in (1, 2, 3, 4, 5, 300)}
    assert recs.select("row_id").distinct().count() == 12
