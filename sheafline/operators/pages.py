"""Pages, headings, grids and nested objects: facts, classes, causes, differences."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits of the page classes (fixed values).
FEW_WORDS_WITH_IMAGES, FEW_WORDS = 14, 12


def page_class(words: Column, images: Column, first_line: Column, named: Column) -> Column:
    """The first class that fits: image-only, figure, notes, headed table, divider, text. named: kinds of the lines that name something (note, table)."""
    return (
        F.when((words <= FEW_WORDS_WITH_IMAGES) & (images > 0), "image-only").when(F.startswith(first_line, F.lit("Figure")), "figure").when(F.array_contains(named, "note"), "notes")
        .when(F.array_contains(named, "table"), "headed table").when(words <= FEW_WORDS, "divider").otherwise("text")
    )


def page_headings(lines: DataFrame, unit: str, page: str, y: str, text: str, height: Column, pattern: str) -> DataFrame:
    """(unit, page, id, heading): the first line in the top quarter of each page that matches; id is the pattern's first group."""
    top = lines.filter((F.col(y) < height / 4) & F.col(text).rlike(pattern))
    first = top.groupBy(unit, page).agg(F.min(F.struct(F.col(y), F.col(text))).alias("_s_"))
    return first.select(unit, page, F.regexp_extract(F.col("_s_")[text], pattern, 1).alias("id"), F.col("_s_")[text].alias("heading"))


def block_from_last(headings: DataFrame, unit: str, page: str, start: str) -> DataFrame:
    """The headings from the last page whose id is `start` on; all of them where no page has it."""
    first = headings.groupBy(unit).agg(F.coalesce(F.max(F.when(F.col("id") == start, F.col(page))), F.lit(0)).alias("_first_"))
    return headings.join(first, unit).filter(F.col(page) >= F.col("_first_")).drop("_first_")


def trigger_counts(tokens: DataFrame, grid: DataFrame, table: Sequence[str]) -> DataFrame:
    """Per table: numeric lines and right-edge bands of the page's text, numeric rows and columns of the grid, and fired: do they differ?

    tokens: table, line_no, pos, text, x0, x1 (pos 0 is the stub); lines of years alone don't count.  Bands are runs of right
    edges with gaps of at most the median width of a character.  grid: table, row_no, col_no, text, header (column 0 is the stub).
    """
    numeric = lambda c: c.rlike(r"^[-(]?[0-9][0-9,.]*\)?$")
    vals = tokens.filter((F.col("pos") > 0) & numeric(F.col("text")))
    real = vals.groupBy(*table, "line_no").agg(F.count_if(~F.col("text").rlike("^(19|20)[0-9]{2}$")).alias("_n_")).filter("_n_ > 0").drop("_n_")
    vals = vals.join(real, [*table, "line_no"], "left_semi")
    size = vals.groupBy(*table).agg(F.countDistinct("line_no").alias("numeric_lines"), F.median((F.col("x1") - F.col("x0")) / F.length("text")).alias("_tol_"))
    gap = F.col("x1") - F.lag("x1").over(Window.partitionBy(*table).orderBy("x1"))
    edges = vals.select(*table, "x1").distinct().withColumn("_gap_", gap).join(size, list(table))
    text = edges.groupBy(*table, "numeric_lines").agg((F.count_if(F.col("_gap_") > F.col("_tol_")) + 1).alias("bands"))
    cells = grid.filter((F.col("col_no") > 0) & ~F.col("header") & F.exists(F.split("text", " +"), numeric))
    shape = cells.groupBy(*table).agg(F.countDistinct("row_no").alias("grid_rows"), F.countDistinct("col_no").alias("grid_cols"))
    every = tokens.select(*table).unionByName(grid.select(*table)).distinct()
    out = every.join(text, list(table), "left").join(shape, list(table), "left").fillna(0, ["numeric_lines", "bands", "grid_rows", "grid_cols"])
    return out.withColumn("fired", (F.col("numeric_lines") != F.col("grid_rows")) | (F.col("bands") != F.col("grid_cols")))


def merge_causes(tokens: DataFrame, table: Sequence[str]) -> DataFrame:
    """Per table and cause: merged cells (two numbers or more), by the columns and rows that bands and lines have by majority.

    tokens: table, cell, col_no, row_no, band, line_no.  More bands in a cell: column collapse if these bands have one and the
    same majority column, else column straddle; more lines: row collapse or straddle alike; else a split token.
    """

    def majority(by: str, target: str) -> DataFrame:
        votes = tokens.filter(F.col(target).isNotNull()).groupBy(*table, by, target).agg(F.count("*").alias("_n_"))
        return votes.groupBy(*table, by).agg(F.max_by(target, F.struct(F.col("_n_"), -F.col(target))).alias(f"_{by}_"))

    t = tokens.join(majority("band", "col_no"), [*table, "band"], "left").join(majority("line_no", "row_no"), [*table, "line_no"], "left")
    cells = t.groupBy(*table, "cell").agg(
        F.count("*").alias("n"), F.countDistinct("band").alias("b"), F.countDistinct("_band_").alias("bc"), F.countDistinct("line_no").alias("l"), F.countDistinct("_line_no_").alias("lr")
    )
    cause = F.when(F.col("b") > 1, F.when(F.col("bc") == 1, "column collapse").otherwise("column straddle")).when(F.col("l") > 1, F.when(F.col("lr") == 1, "row collapse").otherwise("row straddle")).otherwise("split token")
    return cells.filter("n > 1").groupBy(*table, cause.alias("cause")).agg(F.count("*").alias("n"))


def stitched_columns(upper: DataFrame, lower: DataFrame, table: Sequence[str]) -> DataFrame:
    """(table, half, col_no, new_no): the columns of both halves numbered from left to right.

    upper, lower: table, col_no, x (a column's centre).  A lower column is the nearest upper one (or lower one made new before) within
    half a pitch, the median distance of neighbours in the upper half; else it is a new column.  A printed table is one group.
    """
    both = upper.withColumn("half", F.lit("upper")).unionByName(lower.withColumn("half", F.lit("lower")))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.select(*table).schema) + ", half string, col_no long, new_no long"

    def run(t: pd.DataFrame) -> pd.DataFrame:
        up = t[t.half == "upper"].sort_values(["x", "col_no"])
        centres = sorted(set(up.x))
        pitch = float(pd.Series(centres).diff().median()) if len(centres) > 1 else 50.0
        at = {("upper", c): x for c, x in zip(up.col_no, up.x, strict=True)}
        for c, x in t[t.half == "lower"].sort_values("col_no")[["col_no", "x"]].itertuples(index=False):
            near = min(centres, key=lambda v: (abs(v - x), v), default=None)
            if near is None or abs(near - x) > pitch / 2:
                centres = sorted([*centres, x])
                near = x
            at["lower", c] = near
        rows = [(*t[list(table)].iloc[0], h, c, centres.index(x)) for (h, c), x in at.items()]
        return pd.DataFrame(rows, columns=[*table, "half", "col_no", "new_no"])

    return both.groupBy(*table).applyInPandas(run, ddl)


def first_difference(shape_a: Sequence[Column], shape_b: Sequence[Column], cells_a: Column, cells_b: Column, fields: Sequence[str]) -> Column:
    """What differs first between two nested objects: the shape, the number of cells, then the first cell that differs, with its fields; null if nothing does."""
    by = lambda s: F.concat_ws("x", *[c.cast("string") for c in s])
    changed = F.zip_with(cells_a, cells_b, lambda x, y: F.filter(F.array(*[F.when(~x[f].eqNullSafe(y[f]), f) for f in sorted(fields)]), lambda k: k.isNotNull()))
    at = F.filter(F.transform(changed, lambda k, i: F.when(F.size(k) > 0, F.concat(F.lit("cell "), i.cast("string"), F.lit(": "), F.array_join(k, ",")))), lambda s: s.isNotNull())
    return (
        F.when(by(shape_a) != by(shape_b), F.concat(F.lit("shape "), by(shape_a), F.lit(" -> "), by(shape_b)))
        .when(F.size(cells_a) != F.size(cells_b), F.concat(F.lit("cells "), F.size(cells_a).cast("string"), F.lit(" -> "), F.size(cells_b).cast("string")))
        .otherwise(F.try_element_at(at, F.lit(1)))
    )


def kept_positions(text: Column, mark: str = "�") -> Column:
    """struct(header, in_number, other): where the marks of a markdown table stand. Up to the separator row all is header; behind it a row's marks count as in a number or not, and lines without a pipe as other."""
    lines = F.split(text, "\n", -1)
    n = lambda x: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit("")))
    sep = F.array_position(F.transform(lines, lambda x: x.rlike(r"^\|(\s*:?-+:?\s*\|)+\s*$")), True)
    head = F.when(sep > 0, sep).otherwise(F.size(lines)).cast("int")
    body = F.slice(lines, head + 1, F.size(lines))
    total = lambda xs, f: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + f(x).cast("long"))
    numbers = lambda x: F.when(F.startswith(x, F.lit("|")), F.regexp_count(x, F.lit(f"[−–0-9-]{mark}[0-9]"))).otherwise(0)
    inside = total(body, numbers)
    return F.struct(total(F.slice(lines, F.lit(1), head), n).alias("header"), inside.alias("in_number"), (total(body, n) - inside).alias("other"))


def grown_bands(cells: DataFrame, failing: DataFrame, table: Sequence[str], cell: str, band: str) -> DataFrame:
    """Fix-point growth: the failing bands of each table, where a cell that holds one makes all its bands fail. A printed table is one group."""
    rows = cells.select(*table, cell, band).distinct().join(failing.select(*table, band).distinct().withColumn("_f_", F.lit(True)), [*table, band], "left")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*table, band).schema)

    def run(t: pd.DataFrame) -> pd.DataFrame:
        bad = set(t.loc[t["_f_"].notna(), band])
        open_ = {c: set(g) for c, g in t.groupby(cell)[band]}
        while hit := [c for c, bands in open_.items() if bands & bad]:
            for c in hit:
                bad |= open_.pop(c)
        return pd.DataFrame([(*t[list(table)].iloc[0], b) for b in sorted(bad)], columns=[*table, band])

    return rows.groupBy(*table).applyInPandas(run, ddl)


def best_columns(printed: DataFrame, served: DataFrame, table: Sequence[str], drop: int = 2) -> DataFrame:
    """Per table: the printed columns kept (all but at most `drop`) that admit most served cells, and how many. printed, served: table, row_no, col_no, text."""
    from .layout import best_mapping

    both = printed.withColumn("_s_", F.lit(0)).unionByName(served.withColumn("_s_", F.lit(1)))
    rows = both.groupBy(*table, "row_no").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("_s_") == k, F.struct("col_no", "text")))), lambda c: c["text"]).alias(n) for k, n in ((0, "p"), (1, "s"))])
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in printed.select(*table).schema) + ", columns array<long>, admitted long"

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("row_no")
        cols, hits = best_mapping([list(x) for x in t.p], [list(x) for x in t.s], drop)
        return pd.DataFrame([(*t[list(table)].iloc[0], list(cols), hits)], columns=[*table, "columns", "admitted"])

    return rows.groupBy(*table).applyInPandas(run, ddl)


def token_batches(df: DataFrame, key: str, length: str, budget: int) -> DataFrame:
    """df with batch: longest first, as many as fit the budget at the width of a batch's first (one at least); ties by key.

    Widths change only from one length to the next, so the plan has a row per distinct length; ranks are taken within lengths.
    """
    counts = sorted(((r[length], r["_n_"]) for r in df.groupBy(length).agg(F.count("*").alias("_n_")).collect()), reverse=True)  # a row per distinct length
    plan, before, start, batch = [], 0, 0, 0
    offsets = {}
    for width, n in counts:
        offsets[width] = before
        before += n
        if start < before:
            per = max(1, budget // max(width, 1))
            k = -(-(before - start) // per)
            plan.append((start, per, batch))
            start, batch = start + k * per, batch + k
    spark = df.sparkSession
    lengths = spark.createDataFrame([(w, o) for w, o in offsets.items()], f"`{length}` long, _before_ long")
    rank = F.row_number().over(Window.partitionBy(length).orderBy(key)) - 1
    ranked = df.withColumn(length, F.col(length).cast("long")).withColumn("_r_", rank).join(F.broadcast(lengths), length).withColumn("_r_", F.col("_r_") + F.col("_before_"))
    steps = F.array(*[F.struct(F.lit(s).cast("long").alias("s"), F.lit(p).cast("long").alias("p"), F.lit(b).cast("long").alias("b")) for s, p, b in plan])
    at = F.element_at(F.filter(steps, lambda x: x["s"] <= F.col("_r_")), -1)
    return ranked.withColumn("_at_", at).withColumn("batch", F.col("_at_.b") + F.floor((F.col("_r_") - F.col("_at_.s")) / F.col("_at_.p")).cast("long")).drop("_at_", "_r_", "_before_")
