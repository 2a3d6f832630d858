"""Printed tables from glyphs, markdown rows, and label matching: what needs one table's rows in order.

A group is one table of one page, so its size is bounded by a sheet of paper.
"""

from __future__ import annotations

import re
import unicodedata
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation
from difflib import SequenceMatcher
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Limits of the reconstruction (fixed values): shares of glyph height, width or size.
LINE_TOL, GAP, SMALL_GLYPH, MERGE = 0.5, 0.15, 0.75, 0.5
FUZZY_MIN = 0.85
_NUMBER = re.compile(r"^[−–-]?\(?[\d,]*\.?\d+\)?\*?$")
CELLS = T.StructType([T.StructField("unit", T.StringType()), T.StructField("table_no", T.IntegerType()), T.StructField("row_no", T.IntegerType()), T.StructField("col_no", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("status", T.StringType())])


def group_lines(top: np.ndarray, height: np.ndarray) -> np.ndarray:
    """Line numbers of glyphs: a glyph belongs to the line whose first glyph lies within half a median height."""
    if not len(top):
        return np.zeros(0, int)
    tol = LINE_TOL * float(np.median(height))
    out = np.zeros(len(top), int)
    line, first = -1, -np.inf
    for i in np.argsort(top, kind="stable"):
        if top[i] - first > tol:
            line, first = line + 1, top[i]
        out[i] = line
    return out


def words_of_line(g: pd.DataFrame) -> list[tuple[float, float, str]]:
    """(x0, x1, text) of the words of one line: split at spaces, wide gaps and leader runs."""
    out: list[tuple[float, float, str]] = []
    fresh = True
    rows = list(g.sort_values("x0").itertuples())
    for i, c in enumerate(rows):
        leader = c.text == "." and ((i and rows[i - 1].text == ".") or (i + 1 < len(rows) and rows[i + 1].text == "."))
        if leader or not c.text.strip():
            fresh = True
            continue
        if out and not fresh and c.x0 - out[-1][1] <= GAP * c.size:
            x0, _, t = out[-1]
            out[-1] = (x0, c.x1, t + c.text)
        else:
            out.append((c.x0, c.x1, c.text))
        fresh = False
    return out


def cluster_bands(spans: list[tuple[float, float]], tol: float) -> list[tuple[float, float]]:
    """Columns of right-aligned values: right edges closer than tol are one band, and bands that overlap by half the narrower merge."""
    bands: list[list[float]] = []
    for x0, x1 in sorted(spans, key=lambda s: s[1]):
        if bands and x1 - bands[-1][2] <= tol:
            bands[-1] = [min(bands[-1][0], x0), max(bands[-1][1], x1), x1]
        else:
            bands.append([x0, x1, x1])
    merged: list[list[float]] = []
    for b in sorted(bands):
        if merged and min(merged[-1][1], b[1]) - max(merged[-1][0], b[0]) > MERGE * min(merged[-1][1] - merged[-1][0], b[1] - b[0]):
            merged[-1][:2] = [min(merged[-1][0], b[0]), max(merged[-1][1], b[1])]
        else:
            merged.append(b)
    return [(b[0], b[1]) for b in merged]


def rebuild(g: pd.DataFrame) -> tuple[str, list[tuple[int, int, str]]]:
    """Status and cells (row, column, text) of one table; a fallback has no cells and names its reason."""
    g = g[g["size"] >= SMALL_GLYPH * g["size"].median()]
    if not len(g):
        return "fallback: no glyphs", []
    lines = group_lines(g["top"].to_numpy(float), (g["bottom"] - g["top"]).to_numpy(float))
    rows = [words_of_line(part) for _, part in g.groupby(lines, sort=True)]
    body = [[w for w in r[1:] if _NUMBER.match(w[2])] for r in rows]
    years = re.compile(r"^(19|20)\d\d$")
    body = [[] if r and all(years.match(w[2]) for w in r) else r for r in body]
    n_body = sum(bool(r) for r in body)
    if not n_body:
        return "fallback: no body lines", []
    tol = float((g["x1"] - g["x0"]).median())
    bands = cluster_bands([w[:2] for r in body for w in r], tol)
    need = max(2, -(-n_body // 10))
    count = [sum(any(min(w[1], b[1]) > max(w[0], b[0]) for w in r) for r in body) for b in bands]
    bands = [b for b, n in zip(bands, count, strict=True) if n >= need]
    if not bands:
        return "fallback: no dense band", []
    prose = sum(len(r) > 3 and not b for r, b in zip(rows, body, strict=True))
    if prose * 5 > len(rows):
        return "fallback: prose", []
    left = bands[0][0]
    cells, double = [], 0
    for i, r in enumerate(rows):
        parts: dict[int, list[str]] = {}
        for x0, x1, t in r:
            col = 0 if x1 <= left + 0.5 else 1 + min(range(len(bands)), key=lambda k: (abs((x0 + x1) / 2 - (bands[k][0] + bands[k][1]) / 2), k))
            parts.setdefault(col, []).append(t)
        for col, ts in sorted(parts.items()):
            double += col > 0 and sum(bool(_NUMBER.match(t)) for t in ts) > 1
            cells.append((i, col, " ".join(ts)))
    if double * 50 > sum(c > 0 for _, c, _ in cells):
        return "fallback: merged numbers", []
    return "rebuilt", cells


def tables_from_glyphs(glyphs: DataFrame) -> DataFrame:
    """Cells of every table from its glyphs (unit, table_no, text, x0, x1, top, bottom, size); a fallback is one row without a cell."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        status, cells = rebuild(g)
        key = (g["unit"].iloc[0], g["table_no"].iloc[0])
        return pd.DataFrame([(*key, *c, status) for c in cells] or [(*key, None, None, None, status)], columns=CELLS.names).astype({"row_no": "Int32", "col_no": "Int32"})

    return glyphs.groupBy("unit", "table_no").applyInPandas(run, CELLS)


#: Abbreviations in labels, and the shares of a row's values that a match by label or by likeness must have (fixed values).
ABBREVIATIONS = {"e": "east", "w": "west", "n": "north", "s": "south", "ak": "alaska", "hi": "hawaii"}
LABEL_CONFIRM, FUZZY_CONFIRM = 0.5, 0.8


def _plain(label: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", label.lower()).strip()


def spelt_out(label: str) -> str:
    """A plain label with abbreviations spelt out and the plural s of longer words gone."""
    words = re.sub(r"\bu s\b", "united states", _plain(label)).split()
    return " ".join(w[:-1] if len(w) > 4 and w.endswith("s") else w for w in (ABBREVIATIONS.get(w, w) for w in words))


def agreeing(printed: dict[str, str], served: dict[str, str]) -> int:
    """Printed values that the served ones give when rounded half up to the decimals printed."""
    n = 0
    for k, v in printed.items():
        try:
            want, have = Decimal(v), Decimal(served[k])
        except (KeyError, TypeError, InvalidOperation):
            continue
        n += have.quantize(Decimal(1).scaleb(min(0, int(want.as_tuple().exponent))), ROUND_HALF_UP) == want
    return n


def match_labels(wanted: list[str], offered: list[str], printed: list[dict[str, str]] | None = None, served: list[dict[str, str]] | None = None) -> list[tuple[int, str] | None]:
    """For each wanted label the offered one it takes, each once: exact first, then affix, then fuzzy (spelt out).

    With values, a match must also reproduce a share of the row's printed ones, and of several the one that
    reproduces most is taken.
    """
    w, o = [_plain(x) for x in wanted], [_plain(x) for x in offered]
    out: list[tuple[int, str] | None] = [None] * len(w)
    free = set(range(len(o)))

    def affix(a: str, b: str) -> bool:
        return bool(a) and bool(b) and (a.startswith(b) or b.startswith(a) or a.endswith(b) or b.endswith(a))

    def fuzzy(i: int, j: int) -> float:
        r = SequenceMatcher(None, spelt_out(wanted[i]), spelt_out(offered[j])).ratio()
        return r if r >= FUZZY_MIN else 0.0

    passes = (("exact", lambda i, j: float(w[i] == o[j]), LABEL_CONFIRM), ("affix", lambda i, j: float(affix(w[i], o[j])), LABEL_CONFIRM), ("fuzzy", fuzzy, FUZZY_CONFIRM))
    for how, test, share in passes:
        for i in range(len(w)):
            if out[i] is not None:
                continue
            found = [(s, j) for j in sorted(free) if (s := test(i, j)) > 0]
            if printed is not None and served is not None:
                need = max(1, ceil(share * len(printed[i])))
                found = [(float(n), j) for _, j in found if (n := agreeing(printed[i], served[j])) >= need]
            if found:
                j = max(found, key=lambda f: (f[0], -f[1]))[1]
                out[i] = (j, how)
                free.discard(j)
    return out


def label_matches(wanted: DataFrame, offered: DataFrame, key: str, label: str, values: str | None = None) -> DataFrame:
    """(key, label, matched, how) by match_labels within each key, both sides in label order; values: a column map<string,string> to confirm by. A key is one printed table."""
    kind = wanted.schema[key].dataType.simpleString()

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values(label), b.sort_values(label)
        x, y = list(a[label]), list(b[label])
        got = match_labels(x, y, *(([dict(v) for v in a[values]], [dict(v) for v in b[values]]) if values else ()))
        k = (a if len(a) else b)[key].iloc[0]
        return pd.DataFrame([(k, w, y[m[0]] if m else None, m[1] if m else None) for w, m in zip(x, got, strict=True)], columns=[key, label, "matched", "how"])

    return wanted.groupBy(key).cogroup(offered.groupBy(key)).applyInPandas(run, f"{key} {kind}, {label} string, matched string, how string")


def best_mapping(printed: list[list[str]], served: list[list[str]], drop: int = 2) -> tuple[tuple[int, ...], int]:
    """The printed columns (all but at most `drop`, in order) that admit most served cells when laid on the served columns; the first such."""
    from itertools import combinations

    n = max((len(r) for r in printed), default=0)
    best: tuple[tuple[int, ...], int] = ((), -1)
    for k in range(0, min(drop, n) + 1):
        for gone in combinations(range(n), k):
            cols = tuple(c for c in range(n) if c not in gone)
            hits = sum(c < len(p) and j < len(s) and p[c] == s[j] for p, s in zip(printed, served, strict=True) for j, c in enumerate(cols))
            if hits > best[1]:
                best = (cols, hits)
    return best


def split_cells(row: Column) -> Column:
    """Cells of a markdown row; an escaped pipe is part of a cell."""
    inner = F.regexp_replace(F.trim(row), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|", -1), lambda c: F.trim(c))


def is_separator(row: Column) -> Column:
    return row.rlike(r"^\|(\s*:?-+:?\s*\|)+\s*$")


def strip_leaders(row: Column) -> Column:
    """Leader runs (two replacement characters or more, and a backspace before them) go from the cells of a row.

    A run with a digit on both sides, blanks aside, stays: it may stand for digits.  Text outside the cells stays as well.
    Doing it again changes nothing.
    """
    parts = F.split(row, r"(?<!\\)\|", -1)
    n = F.size(parts)
    run = r"(?<!�)(?:\x08\s*)?(?:(?<![0-9][ \t\x08]{0,64})�{2,}+|�{2,}+(?![ \t]*[0-9]))"
    kept = F.transform(parts, lambda p, i: F.when((i > 0) & (i < n - 1), F.regexp_replace(p, run, "")).otherwise(p))
    return F.when(n > 2, F.array_join(kept, "|")).otherwise(row)


@F.pandas_udf(T.StringType())
def normal_unit(s: pd.Series) -> pd.Series:
    """Compatibility form, lower case, one space."""
    return s.map(lambda x: None if x is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x)).strip().lower())


@F.pandas_udf(T.StringType())
def point_id(s: pd.Series) -> pd.Series:
    """Name-based UUID (version 5, URL namespace) of an id."""
    import uuid

    return s.map(lambda x: None if x is None else str(uuid.uuid5(uuid.NAMESPACE_URL, x)))


def score_cells(truth: DataFrame, parsed: DataFrame, key: list[str]) -> DataFrame:
    """Per key[0]: cells, exact hits at (row, col), lenient hits in the row (as a multiset), and rates.

    truth and parsed: key, row_no, col_no, text.
    """
    t = truth.select(*key, "row_no", "col_no", "text")
    p = parsed.select(*key, "row_no", "col_no", F.col("text").alias("_p_"))
    strict = t.join(p, [*key, "row_no", "col_no"], "left").groupBy(key[0]).agg(F.count("*").alias("n"), F.count_if(F.col("text").eqNullSafe(F.col("_p_"))).alias("strict"))
    from .joins import multiset_overlap

    loose = multiset_overlap(t, parsed, [*key, "row_no"], "text").groupBy(key[0]).agg(F.sum("conserved").alias("lenient"))
    return strict.join(loose, key[0]).withColumn("rate", F.round(F.col("strict") / F.col("n"), 6))
