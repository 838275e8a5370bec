"""Numeric column expressions: link functions, thresholds, codes, losses."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tenor.functions.text import col

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for the same results.
DEFAULT_THRESHOLD = 0.5
POSITIVE_AT = 0.05       # compound >= 0.05 -> positive
NEGATIVE_AT = -0.05      # compound <= -0.05 -> negative
LAMBDA_MULTI = 0.7
LAMBDA_SENT = 1.0
IRONY_SENT_EXTRA = 0.5
# Threshold grid: 19 evenly spaced values from 0.05 to 0.95, built by the same
# rule (numpy.linspace), so it holds the exact doubles 0.39999999999999997 and
# 0.49999999999999994 rather than their decimal spellings.
THRESHOLD_GRID = [float(x) for x in np.linspace(0.05, 0.95, 19)]
# ---------------------------------------------------------------------------


def sigmoid(x) -> Column:
    """1 / (1 + exp(-x))."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def softmax(logits) -> list[Column]:
    """Max-shifted softmax over a fixed list of logit columns."""
    cs = [col(c) for c in logits]
    m = F.greatest(*cs)
    es = [F.exp(c - m) for c in cs]
    total = reduce(lambda a, b: a + b, es)
    return [e / total for e in es]


def argmax(values) -> Column:
    """0-based index of the largest value, first one on ties."""
    arr = F.array(*[col(c) for c in values])
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def at_threshold(prob, threshold) -> Column:
    """Inclusive threshold -> 0/1."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (col(prob) >= t).cast("int")


def whole_number(c) -> Column:
    """A number or numeric string ('1.0', as CSV writers put it next to gaps) as an int;
    anything with a fraction raises."""
    x = col(c).cast("double")
    return F.when(x.isNull() | (x == F.floor(x)), x.cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("not a whole number: "), x.cast("string")))).cast("int")


def sentiment_to_class(sentiment) -> Column:
    """-1/0/1 -> 0/1/2; null -> neutral (P9); any other value raises."""
    s = F.coalesce(whole_number(sentiment), F.lit(0))
    return F.when(s.isin(-1, 0, 1), s + 1).otherwise(
        F.raise_error(F.concat(F.lit("sentiment outside {-1,0,1}: "), s.cast("string")))).cast("int")


def class_to_sentiment(cls) -> Column:
    """0/1/2 -> -1/0/1."""
    return (col(cls) - 1).cast("int")


def sentiment_label(compound) -> Column:
    """Compound -> positive / negative / neutral."""
    c = col(compound)
    return (F.when(c >= POSITIVE_AT, "positive")
            .when(c <= NEGATIVE_AT, "negative").otherwise("neutral"))


def bce_with_logits(x, y) -> Column:
    """Numerically stable binary cross-entropy on a logit."""
    x, y = col(x), col(y)
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def cross_entropy(logits, target_class) -> Column:
    """Cross-entropy of a class index against a fixed list of logits (log-sum-exp)."""
    cs = [col(c) for c in logits]
    m = F.greatest(*cs)
    lse = m + F.log(reduce(lambda a, b: a + b, [F.exp(c - m) for c in cs]))
    picked = reduce(lambda acc, kc: acc.when(col(target_class) == kc[0], kc[1]),
                    list(enumerate(cs))[1:], F.when(col(target_class) == 0, cs[0]))
    return lse - picked


def round6(c) -> Column:
    return F.round(col(c), 6)
