"""Agreement, intervals and decision rules. Ties are decided on whole numbers, never on floats."""

from __future__ import annotations

from collections.abc import Sequence
from math import lgamma

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Normal quantile of 95 % intervals (fixed value).
Z95 = 1.96


def wilson(hits: Column, n: Column, z: float = Z95) -> Column:
    """struct(low, high), clamped to [0, 1]; (0, 0) for n = 0."""
    m = F.when(n > 0, n)  # null for n = 0, where greatest and least would skip it
    p = hits / m
    centre = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    return F.struct(F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0).alias("low"), F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(0.0).alias("high"))


def _tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial."""
    from math import exp, log

    if p <= 0:
        return float(k <= 0)
    if p >= 1:
        return 1.0
    return sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p)) for i in range(k, n + 1))


def _bisect(f, steps: int = 100) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) else (lo, mid)
    return (lo + hi) / 2


def exact_interval(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Clopper-Pearson; (0, 1) for n = 0."""
    if n == 0:
        return 0.0, 1.0
    a = (1 - level) / 2
    low = 0.0 if k == 0 else _bisect(lambda p: _tail(k, n, p) < a)
    high = 1.0 if k == n else _bisect(lambda p: 1 - _tail(k + 1, n, p) > a)
    return low, high


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def clopper_pearson(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([exact_interval(int(a), int(b)) for a, b in zip(k, n, strict=True)], columns=["low", "high"])


def t_quantile(df: float, level: float = 0.95) -> float:
    """The two-sided quantile of Student's t: 1 - I(x; df / 2, 1 / 2) = level at x = df / (df + t^2), by bisection of the incomplete beta's continued fraction."""
    from math import exp, log, log1p

    a, b = df / 2, 0.5

    def beta(x: float) -> float:
        if x <= 0 or x >= 1:
            return float(x >= 1)
        if x > (a + 1) / (a + b + 2):
            return 1 - fraction(1 - x, b, a)
        return fraction(x, a, b)

    def fraction(x: float, a: float, b: float) -> float:
        front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a
        c, d = 1.0, 1.0 / max(1e-300, 1 - (a + b) * x / (a + 1))
        out = d
        for m in range(1, 300):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + top * d)
                c = 1 + top / c
                out *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return front * out

    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta(df / (df + mid * mid)) > 1 - level else (lo, mid)
    return (lo + hi) / 2


#: t quantile of 95 % intervals by degrees of freedom (a column); null without any.
t95 = F.pandas_udf(lambda df: pd.Series([t_quantile(float(x)) if x > 0 else None for x in df], dtype="float64"), T.DoubleType())


def two_sided_mcnemar(b: int, c: int) -> float:
    """Exact two-sided p of discordant counts; 1 without any."""
    n = b + c
    return 1.0 if n == 0 else min(1.0, 2 * _tail(max(b, c), n, 0.5))


mcnemar = F.pandas_udf(lambda b, c: pd.Series([two_sided_mcnemar(int(x), int(y)) for x, y in zip(b, c, strict=True)]), T.DoubleType())


def kappa(df: DataFrame, group: Sequence[str], a: str, b: str) -> DataFrame:
    """Cohen's kappa by group from whole counts; null where chance agreement is 1 or nothing is rated."""
    cells = df.groupBy(*group, a, b).agg(F.count("*").alias("_n_"))
    side = lambda c: cells.groupBy(*group, F.col(c).alias("_v_")).agg(F.sum("_n_").alias(f"_{c}_"))
    chance = side(a).join(side(b), [*group, "_v_"]).groupBy(*group).agg(F.sum(F.col(f"_{a}_") * F.col(f"_{b}_")).alias("_e_"))
    seen = cells.groupBy(*group).agg(F.sum("_n_").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("_n_")).otherwise(0)).alias("agreed"))
    both = seen.join(chance, list(group), "left") if group else seen.join(chance)
    e = F.coalesce(F.col("_e_"), F.lit(0))
    return both.withColumn("kappa", F.try_divide(F.col("n") * F.col("agreed") - e, F.col("n") * F.col("n") - e)).drop("_e_")


def auroc(df: DataFrame, group: Sequence[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve by rank sums, ties half; null if a class is empty.

    Rows collapse to (group, score) counts first; the ordered window runs over distinct scores.
    """
    steps = df.groupBy(*group, score).agg(F.sum(label).cast("long").alias("_p_"), F.sum(1 - F.col(label)).cast("long").alias("_q_"))
    below = Window.partitionBy(*group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    wins = steps.withColumn("_w_", F.col("_p_") * (2 * F.coalesce(F.sum("_q_").over(below), F.lit(0)) + F.col("_q_")))
    return wins.groupBy(*group).agg((F.try_divide(F.sum("_w_"), 2 * F.sum("_p_") * F.sum("_q_"))).alias("auroc"))


def balanced_accuracy(df: DataFrame, group: Sequence[str], truth: str, flag: str) -> DataFrame:
    """k, m, tp, tn and their mean rate; null if k or m is 0."""
    out = df.groupBy(*group).agg(
        F.count_if(F.col(truth) == 1).alias("k"), F.count_if(F.col(truth) == 0).alias("m"),
        F.count_if((F.col(truth) == 1) & (F.col(flag) == 1)).alias("tp"), F.count_if((F.col(truth) == 0) & (F.col(flag) == 0)).alias("tn"),
    )
    return out.withColumn("ba", (F.try_divide(F.col("tp"), F.col("k")) + F.try_divide(F.col("tn"), F.col("m"))) / 2)


def eligible(k: Column, m: Column, tp: Column, tn: Column) -> Column:
    """At most a fifth of the good flagged, and two catches once there are four to catch."""
    return ((m - tn) * 5 <= m) & ((k < 4) | (tp >= 2))


def bootstrap_sums(clusters: DataFrame, cluster: str, rounds: int, sums: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Resampled sums of pre-aggregated clusters, one row per round (and group).

    Each cluster's multiplicity in round r is Poisson(1) by inverse table from a
    digest of (round, cluster): independent of order and layout, one map-side
    sum, and no draw needs to know the others.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("round"), F.col(cluster))), 1, 8), 16, 10).cast("double") / 4294967296.0
    cut = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    times = sum(((u >= c).cast("long") for c in cut), F.lit(0))
    rows = clusters.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("_t_", times)
    return rows.groupBy(*groups, "round").agg(*[F.sum(F.col("_t_") * F.col(s)).alias(s) for s in sums])


def cluster_resamples(clusters: DataFrame, cluster: str, rounds: int, sums: Sequence[str]) -> DataFrame:
    """Sums of `rounds` resamples, each of as many clusters as there are, drawn with replacement; a row per round.

    Draw j of round r takes cluster floor(u n) in the order of ids, u from a digest of r and j.  Clusters are aggregated
    before and are the questions or tables of one evaluation; for very many of them take `bootstrap_sums`, whose
    multiplicities are independent.
    """
    numbered = clusters.select((F.row_number().over(Window.orderBy(cluster)) - 1).cast("long").alias("_i_"), *sums)
    n = clusters.agg(F.count("*").alias("_n_"))  # one row
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("round"), F.col("_j_"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    draws = clusters.sparkSession.range(rounds).withColumnRenamed("id", "round").join(F.broadcast(n)).filter("_n_ > 0").withColumn("_j_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n_") - 1)))
    return draws.withColumn("_i_", F.floor(u * F.col("_n_")).cast("long")).join(numbered, "_i_").groupBy("round").agg(*[F.sum(s).alias(s) for s in sums])


def kappa_of_counts(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Cohen's kappa of a two by two table (both, first only, second only, none); null where chance agreement is 1."""
    return F.try_divide(2 * (a * d - b * c), (a + b) * (b + d) + (a + c) * (c + d))


def align_refusals(labels: DataFrame, scores: DataFrame, group: Sequence[str], key: str, status: str) -> DataFrame:
    """Per group: rows on either side, FAIL rows, ids on one side only, and the first reason to refuse the pair (null: none)."""
    a, b = labels.groupBy(*group).agg(F.count("*").alias("n_labels")), scores.groupBy(*group).agg(F.count("*").alias("n_scores"), F.count_if(F.col(status) == "FAIL").alias("n_fail"))
    x, y = labels.select(*group, key).distinct().withColumn("_a_", F.lit(1)), scores.select(*group, key).distinct().withColumn("_b_", F.lit(1))
    odd = x.join(y, [*group, key], "full").groupBy(*group).agg(F.count_if(F.col("_a_").isNull() | F.col("_b_").isNull()).alias("n_odd"), F.count("*").alias("n_ids"))
    out = odd.join(a, list(group), "left").join(b, list(group), "left").fillna(0, ["n_labels", "n_scores", "n_fail"])
    reason = F.when(F.col("n_fail") > 0, "FAIL rows").when(F.col("n_labels") != F.col("n_scores"), "row count").when((F.col("n_odd") > 0) | (F.col("n_ids") != F.col("n_scores")), "ids")
    return out.select(*group, "n_labels", "n_scores", "n_fail", "n_odd", reason.alias("refused"))


def percentile_interval(df: DataFrame, groups: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    """Linear percentiles of the defined values and how many are undefined."""
    a = (1 - level) / 2
    return df.groupBy(*groups).agg(F.percentile(value, F.lit(a)).alias("low"), F.percentile(value, F.lit(1 - a)).alias("high"), F.count_if(F.col(value).isNull()).alias("undefined"))


def order_interval(df: DataFrame, groups: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    """Order-statistic interval: sorted values at floor(a (B - 1)) and floor((1 - a) (B - 1))."""
    a = (1 - level) / 2
    v = F.array_sort(F.collect_list(value))  # one value per round: bounded by the number of rounds
    at = lambda q: F.element_at("_v_", (F.floor(q * (F.size("_v_") - 1)) + 1).cast("int"))
    return df.groupBy(*groups).agg(v.alias("_v_")).select(*groups, at(a).alias("low"), at(1 - a).alias("high"))
