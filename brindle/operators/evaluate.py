"""Evaluation of scored pairs: metrics, exact threshold sweeps, policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from brindle.functions.text import guarded
from brindle.operators.store import running_sums


def binary_metrics(rows: DataFrame, predicted: Column, label: str = "label", *by: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 (0 where undefined), by group."""
    p, y = predicted.cast("boolean"), F.col(label) == 1
    n = lambda c: F.count_if(c)
    counts = rows.groupBy(*by).agg(n(p & y).alias("tp"), n(p & ~y).alias("fp"), n(~p & y).alias("fn"), n(~p & ~y).alias("tn"))
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": guarded(tp, tp + fp), "recall": guarded(tp, tp + fn), "f1": guarded(2 * tp, 2 * tp + fp + fn)})


def threshold_sweep(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Metrics of predicting score >= t for t at each distinct score, 0 and 1: one pass over running sums, no quadratic scan."""
    by = rows.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    ends = rows.sparkSession.createDataFrame([(0.0, 0, 0), (1.0, 0, 0)], "threshold double, pos long, neg long")
    grid = by.union(ends).groupBy("threshold").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    out, totals = running_sums(grid, ["pos", "neg"], ["-threshold"])
    return with_rates(out.select("threshold", F.col("running_pos").alias("tp"), F.col("running_neg").alias("fp"), (F.lit(totals["pos"]) - F.col("running_pos")).alias("fn")))


def picks(sweep: DataFrame, precision: float = 0.98, recall: float = 0.95) -> DataFrame:
    """The best threshold by policy; ties go to the lowest: f1, precision at a recall, recall at a precision, f1 at both."""
    best = lambda metric, where: F.max(F.when(where, F.struct(F.col(metric).alias("value"), (-F.col("threshold")).alias("t")))).alias("b")
    high_r, high_p = F.col("recall") >= recall, F.col("precision") >= precision
    rules = {"f1": best("f1", F.lit(True)), "precision_at_recall": best("precision", high_r), "recall_at_precision": best("recall", high_p), "f1_at_both": best("f1", high_r & high_p)}
    wide = sweep.agg(*(c.alias(k) for k, c in rules.items()))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("policy"), F.col(k).alias("b")) for k in rules))).alias("r")
    return wide.select(each).select("r.policy", (-F.col("r.b.t")).alias("threshold"), F.col("r.b.value").alias("value"))


def message_metrics(rows: DataFrame, predicted: Column) -> DataFrame:
    """Share of messages whose predicted codes are exactly the true ones, that miss any, and false alarms where none is true."""
    m = rows.withColumn("_p", predicted.cast("boolean")).groupBy("message_id").agg(F.bool_and(F.col("_p") == (F.col("label") == 1)).alias("exact"), F.bool_or((F.col("label") == 1) & ~F.col("_p")).alias("missed"), F.bool_or("_p").alias("any_p"), F.count_if(F.col("label") == 1).alias("true_n"))
    rate = lambda hit, of: F.try_divide(F.count_if(of & hit).cast("double"), F.count_if(of))
    has, many, none = F.col("true_n") > 0, F.col("true_n") > 1, F.col("true_n") == 0
    return m.agg(rate(F.col("exact"), F.lit(True)).alias("exact_rate"), rate(F.col("exact"), many).alias("multi_exact_rate"), rate(F.col("missed"), has).alias("missed_rate"), rate(F.col("any_p"), none).alias("false_alarm_rate"))
