"""Evaluation of risk scores: confusion counts, ranking metrics over distinct scores, prior shift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countspark.functions.math import recalibrate
from countspark.sources.scratch import written


def _ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def _count(holds: Column, weight: str | None) -> Column:
    return F.count_if(holds) if weight is None else F.coalesce(F.sum(F.when(holds, F.col(weight))), F.lit(0))


def counted(scored: DataFrame, score: str = "risk", label: str = "y", weight: str | None = None) -> DataFrame:
    """(score, label, n): the rows of each distinct score and label. Written, so that what is asked of it later neither scores nor reads the rows again."""
    n = F.count("*") if weight is None else F.sum(weight)
    return written(scored.select(F.col(score).alias("score"), F.col(label).alias("label"), *([weight] if weight else [])).groupBy("score", "label").agg(n.alias("n")))


def confusion(scored: DataFrame, pred: Column, label: str = "y", by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """tp, fp, fn, tn and the rates that follow from them; a rate over nothing is 0. weight: a column of how many rows a row stands for."""
    y, p = F.col(label) == 1, pred == 1
    counts = scored.groupBy(*(by or [])).agg(
        _count(p & y, weight).alias("tp"), _count(p & ~y, weight).alias("fp"), _count(~p & y, weight).alias("fn"), _count(~p & ~y, weight).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    return counts.withColumns(
        {
            "sens": _ratio(tp, tp + fn), "spec": _ratio(tn, tn + fp), "ppv": _ratio(tp, tp + fp), "f1": _ratio(2 * tp, 2 * tp + fp + fn),
            "flagged": _ratio(tp + fp, n), "acc": _ratio(tp + tn, n),
        }
    )


def curve(scored: DataFrame, score: Column, label: str = "y", slices: int = 64, weight: str | None = None) -> DataFrame:
    """(score, p, n, tp, fp, all_pos, all_neg): the labels at each distinct score, at it or above, and in all.

    Scores are counted first; weight: a column of how many rows a row stands for. The running sums are taken within slices of the score range, and on top of the sums of the
    slices above, so no task sorts all distinct scores.
    """
    labels = scored.select(score.alias("score"), F.col(label).alias("_y"), *([F.col(weight).alias("_w")] if weight else []))
    of = lambda y: _count(F.col("_y") == y, "_w" if weight else None)
    at = labels.groupBy("score").agg(of(1).alias("p"), of(0).alias("n"))
    cut = at.withColumn("slice", F.floor(F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)) * slices).cast("int"))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("slice").agg(F.sum("p").alias("sp"), F.sum("n").alias("sn"))
    every = Window.partitionBy(F.lit(0))  # as many rows as slices
    before = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    base = sums.select("slice", before("sp").alias("bp"), before("sn").alias("bn"), F.sum("sp").over(every).alias("all_pos"), F.sum("sn").over(every).alias("all_neg"))
    upto = Window.partitionBy("slice").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ran = cut.withColumn("tp", F.sum("p").over(upto)).withColumn("fp", F.sum("n").over(upto))
    return ran.join(F.broadcast(base), "slice").select("score", "p", "n", (F.col("tp") + F.col("bp")).alias("tp"), (F.col("fp") + F.col("bn")).alias("fp"), "all_pos", "all_neg")


def ranking(points: DataFrame) -> DataFrame:
    """One row (roc_auc, pr_auc, f1_best) from curve(); all null where one class is absent."""
    sums = points.agg(
        F.max("all_pos").cast("double").alias("pos"), F.max("all_neg").cast("double").alias("neg"),
        F.sum(F.col("n").cast("double") * (F.col("tp") - F.col("p") / 2)).alias("a"),
        F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"),
        F.max(2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("all_pos"))).alias("f1"),
    )
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    return sums.select(
        F.when(both, F.col("a") / (F.col("pos") * F.col("neg"))).alias("roc_auc"), F.when(both, F.col("ap") / F.col("pos")).alias("pr_auc"), F.when(both, F.col("f1")).alias("f1_best")
    )


def metrics(scored: DataFrame, score: str = "risk", label: str = "y", threshold: float = 0.5, cohort_prior: float | None = None, population_prior: float = 0.015, weight: str | None = None) -> DataFrame:
    """One row: the confusion at a threshold, the ranking metrics, and the best F1 after the prior is shifted.

    The rows are read once, for counts of their scores; weight: a column of how many rows a row stands for.
    """
    points, risk = counted(scored, score, label, weight), F.col("score")
    if cohort_prior is None:
        cohort_prior = points.filter("label is not null").agg(F.try_divide(F.sum(F.col("label") * F.col("n")), F.sum("n"))).first()[0]
        cohort_prior = 0.5 if cohort_prior is None else float(cohort_prior)
    at = confusion(points, (risk >= threshold).cast("int"), "label", weight="n")
    ranks = ranking(curve(points, risk, "label", weight="n"))
    if 0 < cohort_prior < 1:
        shifted = ranking(curve(points, recalibrate(risk, cohort_prior, population_prior), "label", weight="n")).select(F.col("f1_best").alias("f1_shifted"))
    else:
        shifted = ranks.select(F.lit(None).cast("double").alias("f1_shifted"))
    one = F.broadcast
    return at.join(one(ranks)).join(one(shifted)).withColumns({"cohort_prior": F.lit(cohort_prior), "population_prior": F.lit(population_prior), "threshold": F.lit(threshold)})


def at_population_rate(points: DataFrame, cohort_rate: float, population_rate: float) -> DataFrame:
    """One row (f1_population, pr_auc_population) from curve(): what F1 and the area would be where positives have another share.

    Each class weighs as much as brings its share from the cohort's to the population's, before precision is taken; the order of the scores
    stays. Both are null where one class is absent.
    """
    wp, wn = population_rate / cohort_rate, (1 - population_rate) / (1 - cohort_rate)
    tp, fp = wp * F.col("tp"), wn * F.col("fp")
    found = points.agg(
        F.max(2.0 * tp / (tp + fp + wp * F.col("all_pos"))).alias("f1"), F.sum(F.col("p") * tp / (tp + fp)).alias("area"), F.max("all_pos").alias("pos"), F.max("all_neg").alias("neg")
    )
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    return found.select(F.when(both, F.col("f1")).alias("f1_population"), F.when(both, F.col("area") / F.col("pos")).alias("pr_auc_population"))


def screening(scored: DataFrame, cohort_rate: float, population_rate: float, threshold: float, score: str = "risk", label: str = "y") -> DataFrame:
    """One row: the referrals at a threshold, the ranking in the cohort, and both at the population's rate. The rows are read once."""
    found, risk = counted(scored, score, label), F.col("score")
    points = curve(found, risk, "label", weight="n")
    at = confusion(found, (risk >= threshold).cast("int"), "label", weight="n")
    out = at.join(F.broadcast(ranking(points))).join(F.broadcast(at_population_rate(points, cohort_rate, population_rate)))
    return out.withColumns({"population_rate": F.lit(population_rate), "threshold": F.lit(threshold)})


def evaluate_with(df: DataFrame, risk: Column, label: str = "y", threshold: float = 0.5, weight: str | None = None) -> DataFrame:
    """The confusion of any risk expression."""
    return confusion(df.withColumn("_risk", risk), (F.col("_risk") >= threshold).cast("int"), label, weight=weight)


def class_distribution(splits: dict[str, DataFrame], label: str = "y") -> DataFrame:
    """(split, n, n_pos, share_pos, drift_pp, stable): each split's share of positives against the first one's; stable below 2 points."""
    rows = None
    for name, df in splits.items():
        one = df.agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("n_pos")).withColumn("split", F.lit(name)).withColumn("_at", F.lit(0 if rows is None else 1))
        rows = one if rows is None else rows.unionByName(one)
    shares = rows.withColumn("share_pos", F.try_divide(F.col("n_pos").cast("double"), F.col("n")))
    first = F.max(F.when(F.col("_at") == 0, F.col("share_pos"))).over(Window.partitionBy(F.lit(0)))  # as many rows as splits
    drift = F.abs(F.col("share_pos") - first) * 100
    return shares.select("split", "n", "n_pos", "share_pos", drift.alias("drift_pp"), (drift < 2).alias("stable"))
