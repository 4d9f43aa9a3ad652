"""Classification metrics from one table: cumulative counts for each distinct score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigia.functions.scalar import safe_divide
from vigia.operators.ordered import ordered_counts, quantiles

TARGET = "target_4h"


def score_counts(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """For each group and distinct score: ``n, pos`` at it, ``cum_n, cum_pos`` at it or above, and the group's totals.

    Scores without a number and rows without a group are left out. Sums run inside ranges of the scores that there are, whatever
    their spread, and are carried over the ranges.
    """
    by = by or []
    usable = scored.where(F.col("score").isNotNull() & ~F.isnan("score")).select(*by, "score", F.col(TARGET).alias("_y"))
    c = ordered_counts(usable, ["score"], by, {"pos": "_y"})
    cum_n, cum_pos = F.col("total") - F.col("upto") + F.col("n"), F.col("total_pos") - F.col("upto_pos") + F.col("pos")
    return c.select(*by, "score", "n", "pos", cum_n.alias("cum_n"), cum_pos.alias("cum_pos"), F.col("total").alias("total_n"), "total_pos")


def ranking_metrics(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Step-wise average precision (``auc_pr``) and ``auc_roc`` with half credit for ties; null with one class only."""
    by = by or []
    c = score_counts(scored, by)
    positives, negatives = F.max("total_pos"), F.max("total_n") - F.max("total_pos")
    below = (F.col("total_n") - F.col("cum_n")) - (F.col("total_pos") - F.col("cum_pos"))
    wins = F.sum(F.col("pos") * (below + F.lit(0.5).cast("double") * (F.col("n") - F.col("pos"))))
    both = (positives > 0) & (negatives > 0)
    return c.withColumn("pos_share", safe_divide(F.col("pos"), F.col("total_pos"))).groupBy(*by).agg(
        F.when(positives > 0, F.sum(F.col("pos_share") * F.col("cum_pos") / F.col("cum_n"))).otherwise(F.lit(0.0)).alias("auc_pr"),
        F.when(both, wins / (positives * negatives)).alias("auc_roc"),
    )


def binary_metrics(scored: DataFrame, by: list[str] | None = None, threshold: Column | None = None) -> DataFrame:
    """Counts at the threshold, and precision, recall and F1 where an empty denominator gives 0.

    A score that isn't a number predicts nothing.
    """
    by = by or []
    threshold = F.col("threshold") if threshold is None else threshold
    hit = F.coalesce(F.nanvl(F.col("score"), F.lit(None).cast("double")) >= threshold, F.lit(False))
    y = F.col(TARGET) == 1
    counted = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.avg(y.cast("double")), F.lit(0.0)).alias("prevalence"), F.count_if(hit).alias("predicted_positive"), F.count_if(hit & y).alias("true_positive"), F.count_if(hit & ~y).alias("false_positive"), F.count_if(~hit & y).alias("false_negative")
    )
    tp, fp, fn = (F.col(c) for c in ("true_positive", "false_positive", "false_negative"))
    out = counted.withColumns({"precision": safe_divide(tp, tp + fp), "recall": safe_divide(tp, tp + fn), "f1": safe_divide(2 * tp, 2 * tp + fp + fn)})
    return out.withColumn("lift_vs_random", safe_divide(F.col("precision"), F.col("prevalence")))


def threshold_curve(scored: DataFrame, points: int = 101) -> DataFrame:
    """Metrics at each distinct quantile of the scores: predicted rate, precision, recall, F1, FP and FN."""
    usable = scored.where(F.col("score").isNotNull() & ~F.isnan("score"))
    marks = quantiles(usable, "score", [k / (points - 1) for k in range(points)]).select(F.explode(F.array_distinct("q")).alias("threshold"))
    counts = score_counts(usable)
    totals = counts.agg(F.max("total_n").alias("t_n"), F.max("total_pos").alias("t_p"))
    # There are at most ``points`` thresholds: each score is counted to those at or below it.
    met = counts.select("score", "n", "pos").join(F.broadcast(marks), F.col("score") >= F.col("threshold")).groupBy("threshold").agg(F.sum("n").alias("predicted_positive"), F.sum("pos").alias("true_positive"))
    out = met.join(F.broadcast(totals))
    tp, fp = F.col("true_positive"), F.col("predicted_positive") - F.col("true_positive")
    fn = F.col("t_p") - tp
    return out.select(
        "threshold",
        "predicted_positive",
        safe_divide(F.col("predicted_positive"), F.col("t_n")).alias("predicted_positive_rate"),
        safe_divide(tp, tp + fp).alias("precision"),
        safe_divide(tp, tp + fn).alias("recall"),
        safe_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
        fp.alias("false_positive"),
        fn.alias("false_negative"),
    )


def calibrated_threshold(scored: DataFrame, min_recall: float = 0.80) -> DataFrame:
    """The candidate of most precision with enough recall, or else of most recall; ties go to the lowest.

    A threshold that alerts on 99 % of the rows or more is degenerate.
    """
    curve = threshold_curve(scored)
    met = F.col("recall") >= min_recall
    order = [F.desc("met"), F.when(met, F.col("precision")).otherwise(F.col("recall")).desc(), F.asc("threshold")]
    best = curve.withColumn("met", met).orderBy(*order).limit(1)
    return best.select(
        "threshold", F.lit(min_recall).alias("target_recall"), F.col("recall").alias("achieved_recall"), F.col("precision").alias("achieved_precision"), F.col("predicted_positive_rate").alias("alert_rate"), F.col("met").alias("target_met"), (F.col("predicted_positive_rate") >= 0.99).alias("degenerate")
    )


def calibration_error(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over bins of equal width; the last one takes in a score of 1."""
    binned = scored.groupBy(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("s"), F.avg(F.col(TARGET).cast("double")).alias("y"))
    return binned.agg((F.sum(F.col("n") * F.abs(F.col("s") - F.col("y"))) / F.sum("n")).alias("ece"))


def curve_points(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Points of the precision-recall and ROC curves at each distinct score."""
    c = score_counts(scored, by)
    return c.select(*(by or []), "score", safe_divide(F.col("cum_pos"), F.col("cum_n")).alias("precision"), safe_divide(F.col("cum_pos"), F.col("total_pos")).alias("recall"), safe_divide(F.col("cum_n") - F.col("cum_pos"), F.col("total_n") - F.col("total_pos")).alias("fpr"))


def trapezoid_areas(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Areas under both curves by trapezoids, from the point before the first score on.

    A trapezoid needs the point before; its counts are those at the score without the score's own.
    """
    by = by or []
    c = score_counts(scored, by).withColumns({"n_before": F.col("cum_n") - F.col("n"), "p_before": F.col("cum_pos") - F.col("pos")})
    recall = lambda p: safe_divide(F.col(p), F.col("total_pos"))
    fpr = lambda n, p: safe_divide(F.col(n) - F.col(p), F.col("total_n") - F.col("total_pos"))
    precision = safe_divide(F.col("cum_pos"), F.col("cum_n"))
    before = F.when(F.col("n_before") > 0, safe_divide(F.col("p_before"), F.col("n_before"))).otherwise(F.lit(1.0))
    roc = F.sum((fpr("cum_n", "cum_pos") - fpr("n_before", "p_before")) * (recall("cum_pos") + recall("p_before")) / 2)
    pr = F.sum((recall("cum_pos") - recall("p_before")) * (precision + before) / 2)
    return c.groupBy(*by).agg(pr.alias("area_pr"), roc.alias("area_roc"))


def closest_point(curve: DataFrame, threshold: float) -> DataFrame:
    """The row of a threshold curve that is closest to a threshold, the lower one of two."""
    return curve.orderBy(F.abs(F.col("threshold") - threshold), "threshold").limit(1)
