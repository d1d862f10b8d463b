"""Row linearisation for a table encoder.

A row becomes ``[CLS] cell [SEP] cell ... [SEP]`` over at most ``max_cols``
columns, each cell at most 30 word tokens (an empty cell is '-'), at most
``max_tokens`` tokens in all.  The cut has a closed form (K8): with
len_i the cell's token count, start_i = 1 + sum_{j<i}(len_j + 1); the cell is
kept iff start_i <= max_tokens - 2, and keeps min(len_i, max_tokens - 1 -
start_i) tokens.  The running sum is a window over one row (bounded by the
row's width), so no row ever leaves its group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unionlake.functions import text as tx
from unionlake.session import materialize

TABLE, ROW = "table_name", "row_id"
MAX_TOKENS = 512
MAX_COLS = 20
FILLER = 65535  # column id of special tokens (uint16 max)
CLS, SEP = "[CLS]", "[SEP]"


def tokenize_cells(cells: DataFrame, max_cols: int = MAX_COLS) -> DataFrame:
    """L1 on the first ``max_cols`` columns: + tokens ARRAY<STRING>."""
    return cells.where(F.col("col_pos") < max_cols).withColumn("tokens", tx.tokenize_cell(F.col("value")))


def cell_offsets(tok_cells: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """start offset of each cell in its row and the tokens it keeps; only
    cells that survive the cut are returned.  + n_tokens, start, kept."""
    payload = max_tokens - 2
    w = Window.partitionBy(TABLE, ROW).orderBy("col_pos").rowsBetween(Window.unboundedPreceding, -1)
    n = F.size("tokens")
    out = tok_cells.withColumn("n_tokens", n).withColumn(
        "start", (F.coalesce(F.sum(n + 1).over(w), F.lit(0)) + 1).cast("int"))
    out = out.where(F.col("start") <= payload)
    return out.withColumn("kept", F.least(F.col("n_tokens"), F.lit(payload + 1) - F.col("start")).cast("int"))


def linearize_rows(offsets: DataFrame) -> DataFrame:
    """L2 + L3: per row the token sequence and each token's column id
    (special tokens -> FILLER).  -> table_name, row_id, tokens, col_ids, n_cols."""
    cells = (offsets.groupBy(TABLE, ROW)
             .agg(F.array_sort(F.collect_list(F.struct("col_pos", F.slice("tokens", 1, F.col("kept")).alias("t"),
                                                       "kept"))).alias("cells")))
    toks = F.concat(F.array(F.lit(CLS)), F.flatten(F.transform("cells", lambda c: F.concat(c["t"], F.array(F.lit(SEP))))))
    ids = F.concat(F.array(F.lit(FILLER)), F.flatten(F.transform(
        "cells", lambda c: F.concat(F.array_repeat(c["col_pos"], c["kept"]), F.array(F.lit(FILLER))))))
    return cells.select(TABLE, ROW, toks.alias("tokens"), ids.alias("col_ids"), F.size("cells").alias("n_cols"))


def pad_and_mask(lin: DataFrame, batches: DataFrame) -> DataFrame:
    """L4: pad every row to the longest row of its batch; sequence mask,
    segment ids, table mask over the batch's widest row, column ids with the
    filler mapped to that width.  ``batches``: table_name, batch_id."""
    b = lin.join(batches, TABLE).withColumn("seq_len", F.size("tokens"))
    # a row per batch, summed up before the shuffle; rows of a batch never meet in one task
    widest = materialize(b.groupBy("batch_id").agg(F.max("seq_len").alias("max_seq_len"), F.max("n_cols").alias("max_col_num")), "batch-widths")
    b = b.join(widest, "batch_id")
    pad = F.col("max_seq_len") - F.col("seq_len")
    return b.select(
        "batch_id", TABLE, ROW, "seq_len", "max_seq_len", "max_col_num",
        F.concat(F.array_repeat(F.lit(1), F.col("seq_len")), F.array_repeat(F.lit(0), pad)).alias("sequence_mask"),
        F.concat(F.array_repeat(F.lit(1), F.col("seq_len")), F.array_repeat(F.lit(0), pad)).alias("segment_ids"),
        F.concat(F.array_repeat(F.lit(1), F.col("n_cols")),
                 F.array_repeat(F.lit(0), F.col("max_col_num") - F.col("n_cols"))).alias("table_mask"),
        F.transform(F.concat(F.col("col_ids"), F.array_repeat(F.lit(FILLER), pad)),
                    lambda x: F.when(x == FILLER, F.col("max_col_num")).otherwise(x)).alias("cell_token_col_ids"))


def truncated_query_columns(offsets: DataFrame) -> DataFrame:
    """Columns that survive the cut in at least one row (only those are
    indexed / queried by the table encoder)."""
    return offsets.select(TABLE, "column_name").distinct()


def token_pool_columns(offsets: DataFrame, token_vecs: DataFrame, how: str = "mean") -> DataFrame:
    """Per (row, column) the mean, the max or the first of its kept token vectors;
    special tokens take no part, a token without a vector counts as zero.
    ``token_vecs``: token, vec.  -> table, row, col_pos, column_name, vec."""
    if how not in ("mean", "max", "first"):
        raise ValueError(f"unknown pooling {how!r}")
    kept = F.least(F.col("kept"), F.lit(1)) if how == "first" else F.col("kept")
    dim = dimension(token_vecs)
    ex = offsets.select(TABLE, ROW, "col_pos", "column_name",
                        F.explode(F.slice("tokens", 1, kept)).alias("token"))
    agg = F.avg if how == "mean" else F.max
    pooled = F.array(*[agg(F.coalesce(F.col("vec")[d], F.lit(0.0))) for d in range(dim)])
    return ex.join(token_vecs.select("token", "vec"), "token", "left").groupBy(TABLE, ROW, "col_pos", "column_name").agg(pooled.alias("vec"))


def dimension(vecs: DataFrame) -> int:
    return vecs.agg(F.max(F.size("vec"))).first()[0] or 0


def row_pool_columns(cell_vecs: DataFrame, rows: DataFrame) -> DataFrame:
    """Column vector = sum over the rows that have the column / number of
    rows of the table (a column cut from a row counts as zero).
    ``rows``: table_name, row_id (all linearised rows)."""
    n_rows = rows.groupBy(TABLE).agg(F.countDistinct(ROW).alias("n_rows"))
    sums = F.array(*[F.sum(F.col("vec")[d]) for d in range(dimension(cell_vecs))])
    s = cell_vecs.groupBy(TABLE, "column_name").agg(sums.alias("sums")).join(n_rows, TABLE)
    return s.select(TABLE, "column_name", F.transform("sums", lambda x: x / F.col("n_rows")).alias("vec"))
