import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheafline.operators import layout, pages


def page(lines, width=6.0, height=10.0, leading=12.0):
    """Glyphs of monospaced lines; text positions give the columns."""
    return pd.DataFrame([{"text": c, "x0": i * width, "x1": i * width + width, "top": n * leading, "bottom": n * leading + height, "size": height} for n, line in enumerate(lines) for i, c in enumerate(line)])


def grid(lines):
    status, cells = layout.rebuild(page(lines))
    return status, {(r, c): t for r, c, t in cells}


def test_three_rows():
    status, g = grid(["Year          A      B", "2020 total   3.5    4.1", "2021 total   5.5   14.2", "2022 total   6.0   24.3"])
    assert status == "rebuilt"
    assert [g[r, 1] for r in (1, 2, 3)] == ["3.5", "5.5", "6.0"] and [g[r, 2] for r in (1, 2, 3)] == ["4.1", "14.2", "24.3"]
    assert g[1, 0] == "2020 total"


def test_leaders_are_not_text():
    status, g = grid(["Coal .......... 12   7", "Gas ........... 13   8", "Oil ........... 14   9"])
    assert status == "rebuilt" and g[0, 0] == "Coal" and (g[0, 1], g[0, 2]) == ("12", "7")


@pytest.mark.parametrize("lines,why", [(["only words here", "and here"], "no body lines"), (["a 1", "b has more words without any value", "c has more words without any value", "d 2"], "prose"), (["one 5", "two"], "no dense band")])
def test_fallbacks(lines, why):
    assert grid(lines) == (f"fallback: {why}", {})


def test_lines_follow_their_first_glyph():
    import numpy as np

    assert layout.group_lines(np.array([0.0, 4, 5, 9, 20]), np.full(5, 10.0)).tolist() == [0, 0, 0, 1, 2]


def test_bands_merge_on_overlap():
    assert layout.cluster_bands([(0, 10), (2, 11), (30, 40), (28, 55)], 2) == [(0, 11), (28, 55)]


def test_label_matching_takes_each_once():
    got = layout.match_labels(["Total energy", "Total energy", "Coal (net)", "Natural gas plants"], ["total energy", "coal", "natural gas plant", "total energy use"])
    assert got == [(0, "exact"), (3, "affix"), (1, "affix"), (2, "affix")]
    assert layout.match_labels(["petroleum products"], ["petrolum product"]) == [(0, "fuzzy")]
    assert layout.match_labels(["coal"], ["wind"]) == [None] and layout.match_labels(["a"], []) == [None]


def test_best_mapping_drops_columns():
    assert layout.best_mapping([["1", "x", "2"], ["3", "x", "4"]], [["1", "2"], ["3", "4"]]) == ((0, 2), 4)


def test_markdown_rows(spark):
    df = spark.createDataFrame([(r"| a \| b | 1.5 | x ���� |",), ("|:--|--:|",), ("| 3 �� 4 | ��� 7 |�|",), ("a �� b",)], "r string")
    rows = df.select(layout.split_cells(F.col("r")).alias("c"), layout.is_separator(F.col("r")).alias("s"), layout.strip_leaders(F.col("r")).alias("t"), layout.strip_leaders(layout.strip_leaders(F.col("r"))).alias("u")).collect()
    assert rows[0].c == [r"a \| b", "1.5", "x ����"] and [r.s for r in rows] == [False, True, False, False]
    # Runs of replacement characters go, unless digits stand on both sides or they are outside cells; dots are text.
    assert [r.t for r in rows] == [r"| a \| b | 1.5 | x  |", "|:--|--:|", "| 3 �� 4 |  7 |�|", "a �� b"] == [r.u for r in rows]


def test_units_ids_and_scores(spark):
    df = spark.createDataFrame([("ＧＷｈ ²",), (None,)], "s string")
    assert [r.x for r in df.select(layout.normal_unit("s").alias("x")).collect()] == ["gwh 2", None]
    assert df.select(layout.point_id("s").alias("x")).first().x[14] == "5"
    t = spark.createDataFrame([("u", 0, 1, "1"), ("u", 0, 2, "2"), ("u", 1, 1, "3")], "unit string, row_no int, col_no int, text string")
    p = spark.createDataFrame([("u", 0, 1, "2"), ("u", 0, 2, "2"), ("u", 1, 1, "3")], "unit string, row_no int, col_no int, text string")
    r = layout.score_cells(t, p, ["unit"]).first()
    assert (r.n, r.strict, r.lenient) == (3, 2, 2)


def test_stitched_columns(spark):
    up = spark.createDataFrame([("t", 0, 100.0), ("t", 1, 200.0), ("t", 2, 300.0)], "unit string, col_no long, x double")
    low = spark.createDataFrame([("t", 0, 110.0), ("t", 1, 250.0), ("t", 2, 360.0), ("t", 3, 30.0)], "unit string, col_no long, x double")
    got = {(r.half, r.col_no): r.new_no for r in pages.stitched_columns(up, low, ["unit"]).collect()}
    # 110 is the first upper column, 250 lies half a pitch from 200 and 300 (the left one), 360 and 30 are new.
    assert got == {("upper", 0): 1, ("upper", 1): 2, ("upper", 2): 3, ("lower", 0): 1, ("lower", 1): 2, ("lower", 2): 4, ("lower", 3): 0}


def test_page_class(spark):
    rows = [(10, 1, "Header", ["note"]), (100, 1, "Figure 3", ["note"]), (100, 0, "x", ["table", "note"]), (100, 0, "x", ["table"]), (12, 0, "x", []), (13, 0, "x", [])]
    df = spark.createDataFrame(rows, "w int, i int, f string, n array<string>")
    assert [r.c for r in df.select(pages.page_class(*map(F.col, "wifn")).alias("c")).collect()] == ["image-only", "figure", "notes", "headed table", "divider", "text"]


def test_trigger_counts_bands(spark):
    t = [("t", 0, 0, "Total", 0.0, 50.0), ("t", 0, 1, "2020", 100.0, 140.0), ("t", 1, 0, "a", 0.0, 10.0), ("t", 1, 1, "12.5", 100.0, 140.0), ("t", 1, 2, "7", 230.0, 240.0), ("t", 2, 1, "(3)", 111.0, 141.0)]
    g = [("t", 1, 1, "12.5 7", False), ("t", 0, 1, "2020", True), ("u", 1, 1, "9", False)]
    tokens = spark.createDataFrame(t, "unit string, line_no int, pos int, text string, x0 double, x1 double")
    grid = spark.createDataFrame(g, "unit string, row_no int, col_no int, text string, header boolean")
    got = {r.unit: tuple(r)[1:] for r in pages.trigger_counts(tokens, grid, ["unit"]).select("unit", "numeric_lines", "bands", "grid_rows", "grid_cols", "fired").collect()}
    assert got == {"t": (2, 2, 1, 1, True), "u": (0, 0, 1, 1, True)}


def test_labels_are_spelt_out_and_confirmed():
    assert layout.spelt_out("U.S. Imports, E. N. Central") == "united state import east north central"
    assert layout.agreeing({"a": "1.3", "b": "-2", "c": "x", "d": "5"}, {"a": "1.25", "b": "-2.4", "c": "1"}) == 2
    got = layout.match_labels(["Total", "Total", "E. Coast Stocks"], ["Total", "Total demand", "East Coast stock"], [{"y": "2"}, {"y": "3"}, {"y": "7"}], [{"y": "3"}, {"y": "2"}, {"y": "7"}])
    # The first 'Total' has other values than the label that is equal, so it takes the affix; the likeness needs values too.
    assert got == [(1, "affix"), (0, "exact"), (2, "fuzzy")]
    assert layout.match_labels(["Total"], ["Total"], [{"y": "1"}], [{"y": "2"}]) == [None]
