"""Classifier outputs and inference plumbing (P14-P17, W8, A12), Spark ML
training and batch inference (M4, M5).

The reference fine-tunes a transformer with two heads. Here the same contract
(ten binary outputs with per-label thresholds, one 3-class sentiment output
with irony-weighted rows, word windows averaged per comment) is met with
Spark ML: hashed word features, ten binary logistic regressions and one
multinomial one. Features, numbers and quality differ; inputs, outputs,
weighting and thresholds do not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from tenor.functions.numeric import argmax, at_threshold, class_to_sentiment, softmax
from tenor.functions.text import words
from tenor.operators.terms import window_terms
from tenor.schemas import LABELS, SENTIMENT_PROB_COLS

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for the same windows.
MAX_LENGTH = 320        # tokens per window including the two marker tokens
SPECIAL_TOKENS = 2
STRIDE_FRAC = 0.5       # overlap = int(MAX_LENGTH * STRIDE_FRAC) tokens
# ---------------------------------------------------------------------------


def window_shape(max_length: int = MAX_LENGTH, stride_frac: float = STRIDE_FRAC,
                 special: int = SPECIAL_TOKENS) -> tuple[int, int]:
    """(content tokens per window, step between window starts): (318, 158) by default."""
    width = max_length - special
    step = width - int(max_length * stride_frac)
    if width <= 0 or step <= 0:
        raise ValueError(f"window of {width} tokens with step {step} does not advance")
    return width, step


def n_windows(n_tokens, max_length: int = MAX_LENGTH, stride_frac: float = STRIDE_FRAC, slide: bool = True):
    """1 + ceil(max(0, n - width) / step) windows; one window when not sliding."""
    width, step = window_shape(max_length, stride_frac)
    if not slide:
        return F.lit(1)
    n = n_tokens if not isinstance(n_tokens, str) else F.col(n_tokens)
    return (F.lit(1) + F.ceil(F.greatest(n - width, F.lit(0)) / F.lit(step))).cast("int")


def token_windows(df: DataFrame, key: str = "comment_id", text: str = "text_proc",
                  max_length: int = MAX_LENGTH, stride_frac: float = STRIDE_FRAC, slide: bool = True,
                  keep=(), hashed: tuple[int, bool] | None = None, scorer=None) -> DataFrame:
    """Overlapping word windows -> (key, *keep, window_no, n_windows, tokens).

    An empty text still yields one (empty) window, as a tokenizer does. With ``hashed``, (numbers of terms, pairs of
    neighbours too), the windows carry ``terms``, the numbers of their words (and pairs), in place of ``tokens``: every
    word of a text is hashed once, whatever windows it is in (:mod:`tenor.operators.terms`). With ``scorer``, a function
    of the terms as an Arrow column, they carry ``scores``, what it makes of them, and the terms don't leave the task."""
    width, step = window_shape(max_length, stride_frac)
    if hashed:
        return _hashed_windows(df.select(key, *keep, F.col(text).alias("__text")), width, step, slide, *hashed, scorer)
    w = words(text)
    k = n_windows(F.size(F.col("__w")), max_length, stride_frac, slide)
    wins = F.transform(F.sequence(F.lit(0), F.col("__k") - 1),
                       lambda i: F.slice(F.col("__w"), i * step + 1, width))
    return (df.select(key, *keep, w.alias("__w"))
              .withColumn("__k", k)
              .select(key, *keep, F.col("__k").alias("n_windows"), F.posexplode(wins).alias("window_no", "tokens")))


def _hashed_windows(df: DataFrame, width: int, step: int, slide: bool, features: int, pairs: bool, scorer) -> DataFrame:
    """The windows of ``__text`` in Arrow batches, the other columns repeated per window."""
    own = df.drop("__text").schema
    made = StructField("scores", ArrayType(DoubleType())) if scorer else StructField("terms", ArrayType(IntegerType()))
    out = StructType([*own.fields, StructField("n_windows", IntegerType()), StructField("window_no", IntegerType()), made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.select(own.names)
            for a, b, per, text, terms in window_terms(batch.column("__text"), width, step, slide, features, pairs):
                rows = kept.slice(a, b - a).take(pa.array(text))
                number = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(per[text], pa.int32()), pa.array(number, pa.int32()), scorer(terms) if scorer else terms], names=out.names)
    return df.mapInArrow(run, out)


def window_mean(windows: DataFrame, prob_cols, key: str = "comment_id") -> DataFrame:
    """Mean of window probabilities per sample (partial + final avg)."""
    return windows.groupBy(key).agg(F.count(F.lit(1)).alias("n_windows"),
                                    *[F.avg(c).alias(c) for c in prob_cols])


def prediction_columns(df: DataFrame, labels=LABELS, thresholds=None, prob_suffix: str = "_p",
                       sent_logits=("s0", "s1", "s2"), sent_probs=None) -> DataFrame:
    """``<label>_ft_prob``, ``<label>_ft_pred`` (inclusive per-label
    thresholds, default 0.5) and ``sent_{neg,neu,pos}_prob`` + ``sent_pred`` in
    -1/0/1 (softmax of logits, or given probabilities; argmax, first wins).
    Existing columns are left alone; all new ones are added in one projection."""
    thresholds = thresholds if thresholds is not None else [0.5] * len(labels)
    if len(thresholds) != len(labels):
        raise ValueError("one threshold per label")
    new = {}
    for name, t in zip(labels, thresholds):
        p = F.col(f"{name}{prob_suffix}")
        new[f"{name}_ft_prob"] = p
        new[f"{name}_ft_pred"] = at_threshold(p, t)
    probs = softmax(list(sent_logits)) if sent_probs is None else [F.col(c) for c in sent_probs]
    for c, p in zip(SENTIMENT_PROB_COLS, probs):
        new[c] = p
    out = df.withColumns(new)
    return out.withColumn("sent_pred", class_to_sentiment(argmax(SENTIMENT_PROB_COLS)))


def expected_windows(n_tokens: int, max_length: int = MAX_LENGTH, stride_frac: float = STRIDE_FRAC) -> int:
    """Plain-Python window count, for tests."""
    width, step = window_shape(max_length, stride_frac)
    return 1 + math.ceil(max(0, n_tokens - width) / step)
