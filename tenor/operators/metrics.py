"""Evaluation: multi-label report, sentiment macro F1, threshold tuning, loss
(A7, A8, A9, A10, A11).

Every metric is one pass over the rows with a global or tiny-keyed aggregate
(partial aggregation on the map side); nothing is collected to the driver and
no two row sets are crossed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenor.functions.numeric import (DEFAULT_THRESHOLD, IRONY_SENT_EXTRA, LAMBDA_MULTI, LAMBDA_SENT,
                                     THRESHOLD_GRID, bce_with_logits, cross_entropy)
from tenor.schemas import LABELS

AVG_ROWS = ["micro avg", "macro avg", "weighted avg", "samples avg"]


def _ratio(num: Column, den: Column) -> Column:
    """num / den with 0/0 -> 0 (zero_division = 0)."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def _sum(cs) -> Column:
    return reduce(lambda a, b: a + b, cs)


def multilabel_report(df: DataFrame, labels=LABELS, pred_suffix: str = "_ft_pred") -> DataFrame:
    """Per-label precision, recall, F1, support, then micro, macro, weighted
    and samples averages -> (row_no, label, precision, recall, f1, support)."""
    y = [F.col(c).cast("int") for c in labels]
    p = [F.col(f"{c}{pred_suffix}").cast("int") for c in labels]
    inter = _sum([a * b for a, b in zip(y, p)])
    ny, np_ = _sum(y), _sum(p)
    aggs = []
    for i in range(len(labels)):
        aggs += [F.sum(y[i] * p[i]).alias(f"tp{i}"), F.sum((1 - y[i]) * p[i]).alias(f"fp{i}"),
                 F.sum(y[i] * (1 - p[i])).alias(f"fn{i}"), F.sum(y[i]).alias(f"s{i}")]
    aggs += [F.avg(_ratio(inter, np_)).alias("sp"), F.avg(_ratio(inter, ny)).alias("sr"),
             F.avg(_ratio(2 * inter, ny + np_)).alias("sf"), F.sum(ny).alias("sn")]
    t = df.agg(*aggs).fillna(0)

    def c(name):
        return F.col(name)

    per = []
    for i, name in enumerate(labels):
        tp, fp, fn, s = c(f"tp{i}"), c(f"fp{i}"), c(f"fn{i}"), c(f"s{i}")
        per.append((F.lit(name), _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn), s))
    TP = _sum([c(f"tp{i}") for i in range(len(labels))])
    FP = _sum([c(f"fp{i}") for i in range(len(labels))])
    FN = _sum([c(f"fn{i}") for i in range(len(labels))])
    S = _sum([c(f"s{i}") for i in range(len(labels))])
    k = float(len(labels))
    micro = (F.lit(AVG_ROWS[0]), _ratio(TP, TP + FP), _ratio(TP, TP + FN), _ratio(2 * TP, 2 * TP + FP + FN), S)
    macro = (F.lit(AVG_ROWS[1]), *[_sum([r[j] for r in per]) / k for j in (1, 2, 3)], S)
    weighted = (F.lit(AVG_ROWS[2]), *[_ratio(_sum([r[j] * r[4] for r in per]), S) for j in (1, 2, 3)], S)
    samples = (F.lit(AVG_ROWS[3]), c("sp"), c("sr"), c("sf"), c("sn"))
    rows = [*per, micro, macro, weighted, samples]
    arr = F.array(*[F.struct(F.lit(i).alias("row_no"), r[0].alias("label"), r[1].cast("double").alias("precision"),
                             r[2].cast("double").alias("recall"), r[3].cast("double").alias("f1"),
                             r[4].cast("bigint").alias("support"))
                    for i, r in enumerate(rows)])
    return t.select(F.inline(arr))


def macro_f1(df: DataFrame, gold: str = "sentiment", pred: str = "sent_pred") -> DataFrame:
    """Macro precision/recall/F1 over the classes present in gold or prediction.

    The confusion table (classes x classes rows) is the only aggregate over the
    data; per-class counts come from it. One row; metrics null on empty input."""
    conf = df.groupBy(F.col(gold).cast("int").alias("y"), F.col(pred).cast("int").alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    per_class = conf.select(F.explode(F.array_distinct(F.array("y", "p"))).alias("cls"), "y", "p", "n") \
        .groupBy("cls").agg(
            F.sum(F.when((F.col("y") == F.col("cls")) & (F.col("p") == F.col("cls")), F.col("n")).otherwise(0)).alias("tp"),
            F.sum(F.when((F.col("y") != F.col("cls")) & (F.col("p") == F.col("cls")), F.col("n")).otherwise(0)).alias("fp"),
            F.sum(F.when((F.col("y") == F.col("cls")) & (F.col("p") != F.col("cls")), F.col("n")).otherwise(0)).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    # Every row has exactly one gold class, so the row count is the sum of tp + fn.
    return per_class.agg(
        F.avg(_ratio(tp, tp + fp)).alias("macro_precision"),
        F.avg(_ratio(tp, tp + fn)).alias("macro_recall"),
        F.avg(_ratio(2 * tp, 2 * tp + fp + fn)).alias("macro_f1"),
        F.coalesce(F.sum(tp + fn), F.lit(0)).cast("bigint").alias("n_rows"))


def sentiment_f1(df: DataFrame, gold: str = "sentiment", pred: str = "sent_pred") -> DataFrame:
    """A8 with the output names of the evaluator."""
    return macro_f1(df, gold, pred).select(
        F.col("macro_precision").alias("sent_macro_precision"),
        F.col("macro_recall").alias("sent_macro_recall"),
        F.col("macro_f1").alias("sent_macro_f1"), "n_rows")


def sentiment_f1_irony(df: DataFrame, irony: str = "irony", gold: str = "sentiment",
                       pred: str = "sent_pred") -> DataFrame:
    """A8 on rows with irony = 1; null metrics when there are none."""
    return sentiment_f1(df.filter(F.col(irony).cast("int") == 1), gold, pred).select(
        F.col("sent_macro_precision").alias("sent_macro_precision_irony"),
        F.col("sent_macro_recall").alias("sent_macro_recall_irony"),
        F.col("sent_macro_f1").alias("sent_macro_f1_irony"), F.col("n_rows").alias("n_irony_rows"))


def long_labels(df: DataFrame, labels=LABELS, prob_suffix: str = "_ft_prob", key: str | None = None) -> DataFrame:
    """Unpivot wide gold/probability columns to (label_no, label, y, prob)."""
    arr = F.array(*[F.struct(F.lit(i).alias("label_no"), F.lit(c).alias("label"),
                             F.col(c).cast("int").alias("y"), F.col(f"{c}{prob_suffix}").cast("double").alias("prob"))
                    for i, c in enumerate(labels)])
    cols = [key] if key else []
    return df.select(*cols, F.inline(arr))


def tune_thresholds(df: DataFrame, labels=LABELS, prob_suffix: str = "_ft_prob",
                    grid=THRESHOLD_GRID) -> DataFrame:
    """A10: per label, the grid threshold with the best F1 (p >= t), lowest on ties;
    0.5 when every F1 is 0. -> (label_no, label, threshold, best_f1).

    A probability p is predicted positive at grid[i] iff k(p) > i, where k(p) is
    the number of grid values <= p. So one aggregate of positives/negatives by
    (label, k) — at most labels x 20 rows — and suffix sums over k give TP and
    FP at every threshold: no pass per threshold and no cross product."""
    g = F.array(*[F.lit(float(t)) for t in grid])
    long = long_labels(df, labels, prob_suffix)
    counts = (long.withColumn("k", F.size(F.filter(g, lambda t: t <= F.col("prob"))))
                  .groupBy("label_no", "k")
                  .agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")))
    spark = df.sparkSession
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(labels)], "label_no int, label string") \
        .select("label_no", "label", F.explode(F.sequence(F.lit(0), F.lit(len(grid)))).alias("k"))
    full = frame.join(counts, ["label_no", "k"], "left").fillna(0, ["pos", "neg"])
    w = Window.partitionBy("label_no").orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cum = full.select("label_no", "label", "k",
                      F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"),
                      F.sum("pos").over(Window.partitionBy("label_no")).alias("npos"))
    cand = cum.filter(F.col("k") >= 1).select(
        "label_no", "label", F.element_at(g, F.col("k").cast("int")).alias("t"),
        _ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("npos")).alias("f1"))
    # At most labels x grid rows: a window over this tiny table picks the best F1,
    # lowest threshold on ties.
    pick = Window.partitionBy("label_no").orderBy(F.col("f1").desc(), F.col("t").asc())
    best = cand.withColumn("__r", F.row_number().over(pick)).filter(F.col("__r") == 1)
    return best.select("label_no", "label",
                       F.when(F.col("f1") > 0, F.col("t")).otherwise(F.lit(DEFAULT_THRESHOLD)).alias("threshold"),
                       F.col("f1").alias("best_f1"))


def multitask_loss(df: DataFrame, labels=LABELS, logit_suffix: str = "_logit",
                   sent_logits=("s0", "s1", "s2"), sent_class: str = "sent_class", irony: str = "irony",
                   lambda_multi: float = LAMBDA_MULTI, lambda_sent: float = LAMBDA_SENT,
                   irony_extra: float = IRONY_SENT_EXTRA) -> DataFrame:
    """lambda_multi * mean_rows(mean_labels(BCE)) + lambda_sent * mean_rows(CE * (1 + extra*irony))."""
    bce = _sum([bce_with_logits(F.col(f"{c}{logit_suffix}"), F.col(c).cast("double")) for c in labels]) / len(labels)
    ce = cross_entropy(list(sent_logits), F.col(sent_class)) * (1.0 + irony_extra * F.col(irony).cast("double"))
    t = df.agg(F.avg(bce).alias("multi_loss"), F.avg(ce).alias("sent_loss"))
    return t.select("multi_loss", "sent_loss",
                    (lambda_multi * F.col("multi_loss") + lambda_sent * F.col("sent_loss")).alias("loss"))
