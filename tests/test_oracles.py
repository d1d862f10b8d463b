"""Registered queries against their DuckDB oracles on the smallest fixture."""
import math

import duckdb
import pytest

import __spark_entry__ as E

from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
FAST = ["table_union_search", "table_union_search_exact", "normalize_cell", "encode_header", "drop_rows_any_null",
        "score_ecdf", "name_search", "macro_metrics", "sample_rows", "ntxent_loss", "graph_walks", "row_walks",
        "linearize_rows", "pad_and_mask", "lake_scan_csv", "signature_similarity", "project_vectors"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def canon(cols, rows):
    def norm(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
        return repr(v)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("key", FAST)
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF_SMALL)
    res = con.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(dcols, res.fetchall())


def test_every_query_has_a_callable_and_entry_runs(spark):
    qs, os_ = E.queries(), E.oracle_sql()
    assert set(os_) <= set(qs)
    assert len(qs) >= 100
    assert E.entry(spark).count() >= 0
