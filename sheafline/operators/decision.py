"""Gates and choice rules over whole counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import eligible

#: Limits of the rules (fixed values).
READABLE, GO, TUNE, MODE_TIE = 8, 0.6, 0.5, 0.05


def readable(k: Column, m: Column) -> Column:
    return (k >= READABLE) & (m >= READABLE)


def choose_verifier(tallies: DataFrame, default: str) -> DataFrame:
    """One row with choice and rule, from a row per verifier (name, k, m, tp, tn, scored).

    None eligible: no verifier.  One: it.  Two: the default if either class is
    empty, if they differ by one claim at most, or if the balanced accuracies
    are equal as fractions; else the better.
    """
    rows = tallies.withColumn("ok", F.col("scored") & eligible(F.col("k"), F.col("m"), F.col("tp"), F.col("tn")))
    pair = rows.agg(F.count_if("ok").alias("n_ok"), F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("name", "k", "m", "tp", "tn")))).alias("v"))  # two verifiers
    a, b = F.try_element_at("v", F.lit(1)), F.try_element_at("v", F.lit(2))
    k, m = a["k"], a["m"]
    # ba = (tp m + tn k) / 2 k m: with equal k and m the numerators decide.
    lead = (a["tp"] * m + a["tn"] * k) - (b["tp"] * m + b["tn"] * k)
    near = F.abs(a["tp"] - b["tp"]) + F.abs(a["tn"] - b["tn"]) <= 1
    rule = F.when(F.col("n_ok") == 0, "none eligible").when(F.col("n_ok") == 1, "only one").when((k == 0) | (m == 0), "empty class").when(near, "one claim apart").when(lead == 0, "tie").otherwise("better")
    choice = F.when(F.col("n_ok") == 0, F.lit(None).cast("string")).when(F.col("n_ok") == 1, a["name"]).when((k == 0) | (m == 0) | near | (lead == 0), F.lit(default)).otherwise(F.when(lead > 0, a["name"]).otherwise(b["name"]))
    return pair.select(choice.alias("choice"), rule.alias("rule"), "n_ok")


def branch(kappas: DataFrame, verifier: str, mode: str, num: str, den: str) -> DataFrame:
    """Best kappa over rows (verifier, mode, num / den as whole numbers) and the branch; several verifiers at exactly the best: STOP."""
    rows = kappas.filter(F.col(den) > 0).select(verifier, mode, F.col(num).cast("decimal(19,0)").alias("_p_"), F.col(den).cast("decimal(19,0)").alias("_q_"))
    # A row is best if none is above it as a fraction, by whole products; verifiers times modes are a handful.
    all_ = F.broadcast(rows.agg(F.collect_set(F.struct(F.col("_p_").alias("p"), F.col("_q_").alias("q"))).alias("_all_")))
    tied = rows.join(all_).filter(~F.exists("_all_", lambda o: o["p"] * F.col("_q_") > F.col("_p_") * o["q"])).withColumn("_best_", (F.col("_p_") / F.col("_q_")).cast("double"))
    n = tied.groupBy("_best_").agg(F.countDistinct(verifier).alias("n_best"), F.min(verifier).alias("verifier"))
    step = F.when(F.col("n_best") > 1, "STOP").when(F.col("_best_") >= GO, "GO").when(F.col("_best_") >= TUNE, "GO, TUNE").otherwise("NO-GO CANDIDATE")
    return n.select(F.round("_best_", 6).alias("kappa"), "n_best", F.when(F.col("n_best") == 1, F.col("verifier")).alias("verifier"), step.alias("branch"))


def mode_of(concatenated: Column, per_chunk: Column) -> Column:
    """The concatenated mode unless the other's kappa is larger by more than the tie width."""
    return F.when(concatenated.isNull() | per_chunk.isNull() | (F.abs(concatenated - per_chunk) <= MODE_TIE) | (concatenated > per_chunk), "concatenated").otherwise("per_chunk_max")
