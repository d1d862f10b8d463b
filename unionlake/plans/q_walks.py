"""Corpus queries: graph from ``lineitem`` x ``orders`` (u = customer,
v = 1,000,000 + part, w = order lines in common), terms from customer
segments / part types, web tables packed from the fragment lake."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unionlake.functions import text as tx
from unionlake.operators import walks as W
from unionlake.plans import lake as L
from unionlake.plans.registry import register
from unionlake.sources import fixtures as fx

PART_OFFSET = 1_000_000
SEED = 12345
NUMBER_WALKS = 2
WALK_LENGTH = 4
WEIGHT_LIMIT = 2
MIN_COLUMNS = 2
MAX_ROWS = 10
WEB_ROWS = 100  # rows of a fragment packed into one web table (by row id range)


EDGES_PER_TASK = 500_000


# --- graph fixture -----------------------------------------------------------------
def graph_parts(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that the graph is dealt to: order lines are counted in the footers."""
    return 1 + fx.read_table(spark, sf_dir, "lineitem").count() // EDGES_PER_TASK


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = graph_parts(spark, sf_dir)
    li = fx.read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    o = fx.read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    if parts > 1:
        li, o = li.repartition(parts, "l_orderkey"), o.repartition(parts, "o_orderkey")
    e = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("u"), (F.col("l_partkey") + PART_OFFSET).alias("v"))
    e = e.repartition(parts, "u", "v").groupBy("u", "v").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return e.withColumn("line_no", F.col("u") * 10_000_000 + F.col("v"))


_SQL_EDGES = f"""edges AS (SELECT o_custkey AS u, l_partkey + {PART_OFFSET} AS v, CAST(count(*) AS DOUBLE) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""
_SQL_ADJ = f"""{_SQL_EDGES},
adj AS (SELECT u, v, w FROM edges UNION ALL SELECT v AS u, u AS v, w FROM edges)"""


def graph_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"),
                                                        F.concat(F.lit("d#"), "c_mktsegment").alias("term"))
    p = fx.read_table(spark, sf_dir, "part").select((F.col("p_partkey") + PART_OFFSET).alias("id"),
                                                    F.concat(F.lit("h#"), "p_type").alias("term"))
    return c.unionByName(p)


_SQL_TERMS = f"""terms AS (SELECT c_custkey AS id, 'd#' || c_mktsegment AS term FROM customer
  UNION ALL SELECT p_partkey + {PART_OFFSET}, 'h#' || p_type FROM part)"""


@register("edge_weight_filter", f"WITH {_SQL_EDGES} SELECT u, v, w FROM edges WHERE w >= {WEIGHT_LIMIT}")
def edge_weight_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.edge_weight_filter(graph_edges(spark, sf_dir), WEIGHT_LIMIT).select("u", "v", "w")


def _adjacency(spark, sf_dir):
    return W.symmetrize(graph_edges(spark, sf_dir), graph_parts(spark, sf_dir))


@register("edge_symmetrize", f"WITH {_SQL_ADJ} SELECT u, v, w FROM adj")
def edge_symmetrize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjacency(spark, sf_dir)


@register("edge_union", f"WITH {_SQL_ADJ} SELECT u, count(*) AS degree, sum(w) AS weight FROM adj GROUP BY u")
def edge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    adj = _adjacency(spark, sf_dir)
    return adj.groupBy("u").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("weight"))


@register("cumulative_edge_weight", f"""WITH {_SQL_ADJ}
SELECT u, v, w, sum(w) OVER (PARTITION BY u ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running,
       sum(w) OVER (PARTITION BY u) AS total FROM adj""")
def cumulative_edge_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.cumulative_weights(_adjacency(spark, sf_dir), parts=graph_parts(spark, sf_dir))


def _sql_u(seed: int, *parts: str) -> str:
    key = " || ':' || ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"((('0x' || substr(md5({key}), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


@register("weighted_neighbor_choice", f"""WITH {_SQL_ADJ},
k AS (SELECT u, v, -ln({_sql_u(SEED, "'n' || CAST(u AS VARCHAR)", '1', 'v')}) / w AS key FROM adj)
SELECT u, v AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY key, v) AS rn FROM k) WHERE rn = 1""")
def weighted_neighbor_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One weighted draw per node (walk id 'n<u>', step 1)."""
    adj = _adjacency(spark, sf_dir)
    key = W.choice_key(SEED, F.concat(F.lit("n"), F.col("u").cast("string")), F.lit(1), F.col("v"), F.col("w"))
    return adj.groupBy("u").agg(F.min(F.struct(key.alias("k"), F.col("v"))).alias("c")).select(
        "u", F.col("c.v").alias("chosen"))


def _sql_walks(number_walks: int, walk_length: int, seed: int) -> str:
    """Draws from running weights; nodes of the fixture have one range of neighbours (see W.neighbour_index)."""
    trials = W.TRIALS_FACTOR * walk_length
    parts = [f"""near AS (SELECT u, list(v ORDER BY v) AS vs, list(running ORDER BY v) AS rs, max(running) AS total FROM (
      SELECT u, v, sum(w) OVER (PARTITION BY u ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM adj) GROUP BY u),
    s0 AS (SELECT CAST(r.i AS VARCHAR) || ':' || CAST(n.u AS VARCHAR) AS walk_id, [n.u] AS path, 0 AS draws, true AS live
      FROM (SELECT DISTINCT u FROM adj) n, range({number_walks}) r(i))"""]
    for s in range(1, walk_length):
        p = f"s{s - 1}"
        draw = f"vs[len(list_filter(rs, lambda r: r <= {_sql_u(seed, 'walk_id', 'i')} * total)) + 1]"
        # the first draws of every walk, then the others of those that found no node in them
        parts.append(f"""a{s} AS (SELECT walk_id, i, {draw} AS v, path
        FROM (SELECT f.walk_id, f.path, n.*, unnest(range(f.draws, least(f.draws + 3, {trials}))) AS i FROM {p} f JOIN near n ON n.u = f.path[-1] WHERE f.live)),
    b{s} AS (SELECT walk_id, min(i) AS i, arg_min(v, i) AS v FROM a{s} WHERE NOT list_contains(path[2:], v) GROUP BY walk_id),
    d{s} AS (SELECT walk_id, i, {draw} AS v, path
        FROM (SELECT f.walk_id, f.path, n.*, unnest(range(f.draws + 3, {trials})) AS i FROM {p} f JOIN near n ON n.u = f.path[-1]
              WHERE f.live AND f.walk_id NOT IN (SELECT walk_id FROM b{s}))),
    c{s} AS (SELECT * FROM b{s} UNION ALL
        SELECT walk_id, min(i) AS i, arg_min(v, i) AS v FROM d{s} WHERE NOT list_contains(path[2:], v) GROUP BY walk_id),
    s{s} AS (SELECT f.walk_id, CASE WHEN c.v IS NOT NULL THEN list_append(f.path, c.v) ELSE f.path END AS path,
        CASE WHEN c.v IS NOT NULL THEN c.i + 1 ELSE f.draws END AS draws, f.live AND c.v IS NOT NULL AS live FROM {p} f LEFT JOIN c{s} c ON c.walk_id = f.walk_id)""")
    return ",\n".join(parts) + f",\nwalks AS (SELECT walk_id, path FROM s{walk_length - 1})"


def _walks(spark, sf_dir):
    adj = _adjacency(spark, sf_dir)
    return W.graph_walks(adj, NUMBER_WALKS, WALK_LENGTH, SEED, parts=graph_parts(spark, sf_dir))


@register("graph_walks", f"""WITH {_SQL_ADJ}, {_sql_walks(NUMBER_WALKS, WALK_LENGTH, SEED)}
SELECT walk_id, path[1] AS start, array_to_string(path, ' ') AS walk FROM walks""")
def graph_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _walks(spark, sf_dir)
    return w.select("walk_id", "start", F.array_join(F.transform("path", lambda x: x.cast("string")), " ").alias("walk"))


@register("walk_step_join", f"""WITH {_SQL_ADJ}, {_sql_walks(1, 2, SEED)}
SELECT walk_id, array_to_string(path, ' ') AS walk FROM walks""")
def walk_step_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    adj = _adjacency(spark, sf_dir)
    w = W.graph_walks(adj, 1, 2, SEED, parts=graph_parts(spark, sf_dir))
    return w.select("walk_id", F.array_join(F.transform("path", lambda x: x.cast("string")), " ").alias("walk"))


_SQL_ENCODED = f"""enc AS (
  SELECT x.walk_id, x.pos, CASE WHEN starts_with(t.term, 'h#') THEN {tx.sql_encode_header('substr(t.term, 3)', True)}
                                WHEN starts_with(t.term, 'd#') THEN {tx.sql_normalize_cell_wildcards('substr(t.term, 3)')}
                           END AS tok
  FROM (SELECT walk_id, unnest(path) AS id, unnest(range(len(path))) AS pos FROM walks) x
  LEFT JOIN terms t ON t.id = x.id)"""


@register("encoded_graph_walks", f"""WITH {_SQL_ADJ}, {_SQL_TERMS}, {_sql_walks(NUMBER_WALKS, WALK_LENGTH, SEED)},
{_SQL_ENCODED}
SELECT walk_id, coalesce(string_agg(tok, ' ' ORDER BY pos) FILTER (WHERE tok IS NOT NULL), '') AS walk
FROM enc GROUP BY walk_id""")
def encoded_graph_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.walk_terms(_walks(spark, sf_dir), graph_terms(spark, sf_dir)).select("walk_id", "walk")


@register("walk_term_join", f"""WITH {_SQL_ADJ}, {_SQL_TERMS}, {_sql_walks(NUMBER_WALKS, WALK_LENGTH, SEED)},
{_SQL_ENCODED}
SELECT walk_id, CAST(count(tok) AS INTEGER) AS n_tokens, coalesce(string_agg(tok, '|' ORDER BY pos) FILTER (WHERE tok IS NOT NULL), '') AS tokens
FROM enc GROUP BY walk_id""")
def walk_term_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.walk_terms(_walks(spark, sf_dir), graph_terms(spark, sf_dir))
    return w.select("walk_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", "|").alias("tokens"))


# --- web tables ----------------------------------------------------------------------
def web_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of the (null-injected) lake packed into web tables of at most
    ``WEB_ROWS`` row-id range each; even fragments are stored column-major
    (headerPosition FIRST_ROW, transposed on read), odd ones row-major
    (FIRST_COLUMN).  The rows of a web table meet once, in record form.
    -> table_id, headerPosition, relation."""
    r = fx.fragment_records(spark, sf_dir, dirty=True).select(
        F.concat_ws("#", "table_name", (F.col("row_id") / WEB_ROWS).cast("long").cast("string")).alias("table_id"),
        F.substring_index("table_name", "__", -1).cast("int").alias("frag"), "row_id",
        F.transform("cells", lambda c: c["column_name"]).alias("names"), F.transform("cells", lambda c: c["value"]).alias("values"))
    t = r.groupBy("table_id").agg(F.first("frag").alias("frag"), F.first("names").alias("names"),
                                  F.sort_array(F.collect_list(F.struct("row_id", "values"))).alias("rows"))
    # inline: what follows reads the sorted rows, and does not sort them again for every column
    t = t.select(F.inline(F.array(F.struct("table_id", "frag", "names", F.col("rows.values").alias("rows")))))
    columns = F.transform("names", lambda name, i: F.concat(F.array(name), F.transform("rows", lambda x: F.get(x, i))))
    even = F.col("frag") % 2 == 0
    return t.select(F.inline(F.array(F.struct("table_id", F.when(even, "FIRST_ROW").otherwise("FIRST_COLUMN").alias("headerPosition"),
                                              F.when(even, columns).otherwise(F.concat(F.array("names"), F.col("rows"))).alias("relation")))))


SQL_WEB = f"""c AS (SELECT *, table_name || '#' || CAST(CAST(floor(row_id / {WEB_ROWS}) AS BIGINT) AS VARCHAR) AS table_id,
                  CAST(split_part(table_name, '__', 2) AS INTEGER) AS frag FROM ({L.sql_cells(dirty=True)})),
cols AS (SELECT table_id, frag, col_pos, list_concat([column_name], list(value ORDER BY row_id)) AS col
         FROM c GROUP BY table_id, frag, col_pos, column_name),
cm AS (SELECT table_id, 'FIRST_ROW' AS headerPosition, list(col ORDER BY col_pos) AS relation
       FROM cols WHERE frag % 2 = 0 GROUP BY table_id),
rws AS (SELECT table_id, frag, row_id, list(value ORDER BY col_pos) AS r FROM c GROUP BY ALL
        UNION ALL SELECT table_id, frag, -1, list(column_name ORDER BY col_pos)
        FROM (SELECT DISTINCT table_id, frag, col_pos, column_name FROM c) GROUP BY ALL),
rm AS (SELECT table_id, 'FIRST_COLUMN' AS headerPosition, list(r ORDER BY row_id) AS relation
       FROM rws WHERE frag % 2 = 1 GROUP BY table_id),
web AS (SELECT * FROM cm UNION ALL SELECT * FROM rm)"""

_SQL_ROWS = f"""rows0 AS (
  SELECT table_id, CASE WHEN headerPosition = 'FIRST_COLUMN' THEN relation ELSE
         list_transform(range(list_min(list_transform(relation, lambda c: len(c)))),
                        lambda i: list_transform(relation, lambda c: c[i + 1])) END AS rows
  FROM web),
wrows AS (SELECT table_id, unnest(range(len(rows))) AS row_idx, unnest(rows) AS cells FROM rows0
          WHERE len(list_filter(rows[1], lambda x: x IS NOT NULL AND length(x) > 0)) >= {MIN_COLUMNS})"""


def _show_cells(col):
    return F.array_join(F.transform(col, lambda x: F.coalesce(x, F.lit("<null>"))), "|")


@register("webtable_rows", f"""WITH {SQL_WEB}, {_SQL_ROWS}
SELECT table_id, CAST(row_idx AS INTEGER) AS row_idx,
       array_to_string(list_transform(cells, lambda x: coalesce(x, '<null>')), '|') AS cells FROM wrows""")
def webtable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = W.webtable_rows(web_tables(spark, sf_dir), MIN_COLUMNS)
    return r.select("table_id", "row_idx", _show_cells(F.col("cells")).alias("cells"))


@register("first_rows", f"""WITH {SQL_WEB}, {_SQL_ROWS}
SELECT table_id, CAST(row_idx AS INTEGER) AS row_idx FROM wrows WHERE row_idx < {MAX_ROWS}""")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = W.first_rows(W.webtable_rows(web_tables(spark, sf_dir), MIN_COLUMNS), MAX_ROWS)
    return r.select("table_id", "row_idx")


_NONEMPTY = "list_filter(cells, lambda x: x IS NOT NULL AND length(x) > 0)"


@register("row_walks", f"""WITH {SQL_WEB}, {_SQL_ROWS},
t AS (SELECT table_id, row_idx, CASE WHEN row_idx = 0
        THEN list_transform({_NONEMPTY}, lambda x: {tx.sql_encode_header("replace(x, chr(10), '')")})
        ELSE list_transform({_NONEMPTY}, lambda x: {tx.sql_normalize_cell("replace(x, chr(10), '')")}) END AS toks
      FROM wrows WHERE row_idx < {MAX_ROWS}),
f AS (SELECT table_id, row_idx, list_filter(toks, lambda x: length(x) > 0) AS toks FROM t)
SELECT table_id, CAST(row_idx AS INTEGER) AS row_idx, array_to_string(toks, ' ') AS walk FROM f
WHERE len(toks) >= {MIN_COLUMNS}""")
def row_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = W.webtable_rows(web_tables(spark, sf_dir), MIN_COLUMNS)
    return W.row_walks(r, "row", MIN_COLUMNS, MAX_ROWS)


@register("row_walks_base", f"""WITH {SQL_WEB}, {_SQL_ROWS}
SELECT table_id, CAST(row_idx AS INTEGER) AS row_idx, array_to_string({_NONEMPTY}, ' ') AS walk FROM wrows""")
def row_walks_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = W.webtable_rows(web_tables(spark, sf_dir), MIN_COLUMNS)
    return W.row_walks(r, "base", MIN_COLUMNS, MAX_ROWS)


_SQL_ROW_TOKENS = f"""t AS (SELECT table_id, row_idx, CASE WHEN row_idx = 0
        THEN list_transform({_NONEMPTY}, lambda x: {tx.sql_encode_header("replace(x, chr(10), '')")})
        ELSE list_transform({_NONEMPTY}, lambda x: {tx.sql_normalize_cell("replace(x, chr(10), '')")}) END AS toks
      FROM wrows WHERE row_idx < {MAX_ROWS}),
f AS (SELECT table_id, row_idx, list_filter(toks, lambda x: length(x) > 0) AS toks FROM t),
row_corpus AS (SELECT array_to_string(toks, ' ') AS walk FROM f WHERE len(toks) >= {MIN_COLUMNS})"""


def _sql_corpus(number_walks: int) -> str:
    return f"""WITH {SQL_WEB}, {_SQL_ROWS}, {_SQL_ROW_TOKENS}, {_SQL_ADJ}, {_SQL_TERMS}, {_sql_walks(number_walks, WALK_LENGTH, SEED)},
{_SQL_ENCODED},
graph_corpus AS (SELECT coalesce(string_agg(tok, ' ' ORDER BY pos) FILTER (WHERE tok IS NOT NULL), '') AS walk FROM enc GROUP BY walk_id)"""


@register("combo_walks", f"{_sql_corpus(NUMBER_WALKS)} SELECT 0 AS part, walk FROM row_corpus UNION ALL SELECT 1, walk FROM graph_corpus")
def combo_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rw = W.row_walks(W.webtable_rows(web_tables(spark, sf_dir), MIN_COLUMNS), "combo", MIN_COLUMNS, MAX_ROWS)
    gw = W.walk_terms(_walks(spark, sf_dir), graph_terms(spark, sf_dir))
    return W.combo_walks(rw, gw)


@register("walk_corpus", f"{_sql_corpus(1)} SELECT walk FROM row_corpus UNION ALL SELECT walk FROM graph_corpus")
def walk_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = graph_parts(spark, sf_dir)
    adj = W.symmetrize(W.edge_weight_filter(graph_edges(spark, sf_dir), 1), parts)
    return W.walk_corpus("combo", tables=web_tables(spark, sf_dir), adj=adj, terms=graph_terms(spark, sf_dir),
                         min_columns=MIN_COLUMNS, max_rows=MAX_ROWS, number_walks=1, walk_length=WALK_LENGTH,
                         seed=SEED, parts=parts)


@register("fit_word_vectors")
def fit_word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = W.row_walks(W.webtable_rows(web_tables(spark, sf_dir), MIN_COLUMNS), "row", MIN_COLUMNS, MAX_ROWS)
    v = W.fit_word_vectors(corpus.select("walk"), dim=32, min_count=1)
    return v.select("word", F.size("vec").alias("dim"))
