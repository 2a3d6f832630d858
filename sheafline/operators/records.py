"""Record-level rules: status, sets that must agree, positions, votes, boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counted(units: DataFrame, status: str = "status", notes: str = "notes", mark: str = "UNFETCHABLE") -> DataFrame:
    """Units that are not excluded and whose notes do not hold the mark."""
    return units.filter((F.col(status) != "EXCLUDED") & ~F.exists(notes, lambda n: F.contains(n, F.lit(mark))))


def table_typing(labels: Column) -> Column:
    """struct(kind, mixed) of a chunk's item labels: a table if one item is a table and all are tables, captions or footnotes."""
    some = F.exists(labels, lambda x: x == "table")
    only = F.forall(labels, lambda x: x.isin("table", "caption", "footnote"))
    return F.struct(F.when(some & only, "table").otherwise("prose").alias("kind"), (some & ~only).alias("mixed"))


def parse_path(paths: Column) -> Column:
    """'fallback' if any part fell back, else the first part's path."""
    return F.when(F.array_contains(paths, "fallback"), "fallback").otherwise(F.try_element_at(paths, F.lit(1)))


def same_sets(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: keys of a, of b, missing from either, and whether the sets are equal."""
    x, y = a.select(*key).distinct().withColumn("_a_", F.lit(1)), b.select(*key).distinct().withColumn("_b_", F.lit(1))
    both = x.join(y, list(key), "full")
    out = both.agg(F.count("_a_").alias("n_a"), F.count("_b_").alias("n_b"), F.count_if(F.col("_a_").isNull()).alias("only_b"), F.count_if(F.col("_b_").isNull()).alias("only_a"))
    return out.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def texts_in_rank_order(hits: DataFrame, texts: DataFrame, key: str, ids: str, text: str) -> DataFrame:
    """key and its texts in the order of an array of ids; n_missing counts ids without a text."""
    rows = hits.select(key, F.posexplode(ids).alias("_pos_", "_id_")).join(texts.select(F.col("id").alias("_id_"), F.col(text).alias("_text_")), "_id_", "left")
    out = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos_", "_text_"))).alias("_s_"), F.count_if(F.col("_text_").isNull()).alias("n_missing"))
    return out.select(key, F.transform("_s_", lambda s: s["_text_"]).alias("texts"), "n_missing")


def failing(df: DataFrame, key: Sequence[str], status: str, p: str, reason: str, order: str) -> DataFrame:
    """A key fails if one of its calls does: no probability then, and the reasons in call order."""
    bad = F.col(status) == "FAIL"
    out = df.groupBy(*key).agg(F.bool_or(bad).alias("_f_"), F.max(p).alias("_p_"), F.array_sort(F.collect_list(F.when(bad, F.struct(order, reason)))).alias("_r_"))
    return out.select(*key, F.when(F.col("_f_"), "FAIL").otherwise("ok").alias("status"), F.when(~F.col("_f_"), F.col("_p_")).alias("p"), F.array_join(F.transform("_r_", lambda x: x[reason]), "; ").alias("reasons"))


def majority_map(df: DataFrame, key: Sequence[str], target: str, order: str) -> DataFrame:
    """Each key's most frequent target (least on ties); of several keys with one target, the first in order keeps it."""
    votes = df.groupBy(*key, target).agg(F.count("*").alias("_n_"), F.min(order).alias("_o_"))
    best = votes.groupBy(*key).agg(F.max_by(target, F.struct(F.col("_n_"), -F.col(target))).alias(target), F.min("_o_").alias("_o_"))
    first = F.row_number().over(Window.partitionBy(*key[:-1], target).orderBy("_o_", key[-1]))
    return best.withColumn("kept", first == 1).drop("_o_")


def iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union of boxes (x0, y0, x1, y1); 0 for empty boxes."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda v: (v[2] - v[0]) * (v[3] - v[1])
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def granule_gate(text: Column) -> Column:
    """pass, or the first failing check: numeric lines without a unit phrase, or a boundary in the middle of a table."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != "")
    numeric = F.size(F.filter(lines, lambda x: F.regexp_count(x, F.lit("[0-9]+")) >= 3))
    rows = lambda part: F.size(F.filter(part, lambda x: F.contains(x, F.lit("|"))))
    n = F.size(lines)
    head, tail = F.slice(lines, 1, 5), F.slice(lines, F.greatest(F.lit(1), n - 4), 5)
    return F.when(n == 0, "field-absent").when((numeric >= 3) & ~F.lower(text).rlike("percent|million|billion|dollars"), "fail:units").when((rows(tail) >= 5) & (rows(head) >= 5), "flag:boundary").otherwise("pass")


def review_queue(last: DataFrame, lot: str, decided: Column, quota: int) -> DataFrame:
    """Undecided items of the lots whose decided items have not reached the quota."""
    rows = last.withColumn("_d_", F.coalesce(decided, F.lit(False)))
    full = rows.groupBy(lot).agg(F.count_if("_d_").alias("_k_")).filter(F.col("_k_") >= quota).select(lot)
    return rows.join(full, lot, "left_anti").filter("not _d_").drop("_d_")


def changed_pairs(old: DataFrame, new: DataFrame, lines: DataFrame, page: str, label: str, value: str, line: str) -> DataFrame:
    """Pairs of the new version that the old one lacks, and on_page: does a line of the page begin with the label and hold the number, not as part of a longer one?

    Lines meet pairs by page and label (a line's words before its first number), so a page's pairs never meet all its lines.
    """
    from ..functions.text import occurs

    changed = new.select(page, label, value).distinct().join(old.select(page, label, value).distinct(), [page, label, value], "left_anti")
    keyed = lines.select(page, F.trim(F.regexp_extract(line, r"^(.*?) [-(]?[0-9]", 1)).alias(label), line)
    hit = changed.join(keyed, [page, label], "left").withColumn("_h_", F.coalesce(occurs(F.substr(F.col(line), F.length(label) + 1), F.col(value).cast("string")), F.lit(False)))
    return hit.groupBy(page, label, value).agg(F.bool_or("_h_").alias("on_page"))


def upserted(points: DataFrame, new: DataFrame, key: str, version: str, fields: Sequence[str]) -> DataFrame:
    """The points after an upsert: the fields of each key's latest version; a partial aggregate."""
    return points.unionByName(new).groupBy(key).agg(*[F.max_by(f, version).alias(f) for f in fields])


def merged_flags(tokens: Column, gap: int) -> Column:
    """array<string> of a line's tokens (text, x0, x1, in order), where a revision mark takes in the number at most `gap` behind it."""
    none = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("flag"), F.lit(0).cast("long").alias("x1"))

    def step(acc: Column, t: Column) -> Column:
        number = t["text"].rlike("^[-(]?[0-9]")
        joins = acc["flag"].isNotNull() & number & (t["x0"] - acc["x1"] <= gap)
        is_flag = t["text"].isin("R", "E", "RE")
        before = F.when(acc["flag"].isNotNull() & ~joins, F.concat(acc["out"], F.array(acc["flag"]))).otherwise(acc["out"])
        after = F.when(joins, F.concat(before, F.array(F.concat(acc["flag"], F.lit(" "), t["text"])))).when(is_flag, before).otherwise(F.concat(before, F.array(t["text"])))
        return F.struct(after.alias("out"), F.when(is_flag, t["text"]).alias("flag"), t["x1"].cast("long").alias("x1"))

    return F.aggregate(tokens, none, step, lambda acc: F.when(acc["flag"].isNotNull(), F.concat(acc["out"], F.array(acc["flag"]))).otherwise(acc["out"]))
