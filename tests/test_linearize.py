from unionlake.operators import linearize as LZ


def cells(spark, lens):
    rows = [("t", f"c{i}", i, 1, " ".join(["w"] * n)) for i, n in enumerate(lens)]
    return spark.createDataFrame(rows, "table_name STRING, column_name STRING, col_pos INT, row_id BIGINT, value STRING")


def simulate(lens, max_len=510, max_cols=20):
    """Step-by-step cutting rule (tokens before [CLS]/[SEP] framing)."""
    row, out = 0, []
    for i, n in enumerate(lens):
        if i >= max_cols:
            break
        n = max(1, min(n, 30))
        cell = n + 1
        if row + cell > max_len:
            keep = max_len - row
            out.append(min(keep, n))
            break
        out.append(n)
        row += cell
        if row == max_len:
            break
    return out


def test_cut_matches_simulation(spark):
    for lens in ([30] * 20, [30] * 16 + [13, 30], [30] * 16 + [14, 30], [30] * 16 + [15, 30], [0, 5, 30], [30] * 3):
        off = LZ.cell_offsets(LZ.tokenize_cells(cells(spark, lens))).orderBy("col_pos").collect()
        assert [r["kept"] for r in off] == simulate(lens), lens
        lin = LZ.linearize_rows(LZ.cell_offsets(LZ.tokenize_cells(cells(spark, lens)))).first()
        kept = simulate(lens)
        assert len(lin["tokens"]) == 1 + sum(kept) + len(kept)
        assert len(lin["tokens"]) <= 512
        assert lin["tokens"][0] == "[CLS]" and lin["tokens"][-1] == "[SEP]"
        assert lin["col_ids"][0] == LZ.FILLER and lin["col_ids"][-1] == LZ.FILLER


def test_exact_fit_510(spark):
    # 16 cells of 31 = 496, then a cell of 13 (+SEP) = 510 exactly: the next cell is dropped
    lens = [30] * 16 + [13, 30]
    off = LZ.cell_offsets(LZ.tokenize_cells(cells(spark, lens))).collect()
    assert len(off) == 17
