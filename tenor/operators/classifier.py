"""Two-task text classifier: training (M4), batch inference (M5), hybrid inference (M6).

Contract kept from the reference: ten binary outputs with per-label thresholds
tuned on the validation split, one 3-class sentiment output whose rows weigh
``1 + 0.5 * irony``, one joint loss (A11), input text = cleaned text with a title
prefix, sliding word windows whose probabilities are averaged per comment,
predictions appended as ``<label>_ft_prob/_ft_pred`` and ``sent_*``.

Re-aimed: hashed words with IDF and one shared low-rank layer under both heads
(:mod:`tenor.operators.joint`) replace the transformer. "base" and "specialist"
are two feature presets (words; words + word bigrams). Training uses every window of
a text (whole texts, never a truncated prefix); each window weighs 1 / n_windows so a
comment counts once.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenor.functions.numeric import IRONY_SENT_EXTRA, at_threshold
from tenor.operators import joint as jt
from tenor.operators.hybrid import check_label_lists, hybrid_merge
from tenor.operators.labels import build_labels, stratified_split
from tenor.operators.metrics import multilabel_report, sentiment_f1, tune_thresholds
from tenor.operators.model import MAX_LENGTH, STRIDE_FRAC, prediction_columns, token_windows, window_mean
from tenor.operators.text import add_text_proc
from tenor.schemas import LABELS, PREDICTION_COLS, SENTIMENT_PROB_COLS
from tenor.staging import release, stage

PRESETS = {"base": {"bigrams": False}, "specialist": {"bigrams": True}}


@dataclass
class MultiTaskModel:
    idf: np.ndarray
    theta: np.ndarray
    shape: jt.Shape
    labels: list = field(default_factory=lambda: list(LABELS))
    thresholds: list = field(default_factory=lambda: [0.5] * len(LABELS))
    config: dict = field(default_factory=dict)
    history: list = field(default_factory=list)   # A11 on the training rows, before the first round and after each

    def with_thresholds(self, thresholds) -> "MultiTaskModel":
        return MultiTaskModel(self.idf, self.theta, self.shape, self.labels, [float(t) for t in thresholds], self.config, self.history)


def hashed_terms(tokens: str | Column, preset: str, num_features: int) -> Column:
    """The terms of a window (words; with the bigrams of the specialist preset) as numbers below ``num_features``."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    number = lambda x: F.pmod(F.hash(x), F.lit(num_features))
    words = F.transform(t, lambda x: number(x))
    if not PRESETS[preset]["bigrams"]:
        return words
    pairs = F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda x, y: number(F.concat_ws(" ", x, y)))
    return F.concat(words, pairs)


def _windows(df: DataFrame, key: str, keep, config: dict, scorer=None) -> DataFrame:
    d = add_text_proc(df, "text", "video_title", config.get("use_title_prefix", True),
                      config.get("clean_like_old", True), collapse=False)
    return token_windows(d, key, "text_proc", config.get("max_length", MAX_LENGTH),
                         config.get("stride_frac", STRIDE_FRAC), config.get("slide", True), keep=keep,
                         hashed=(config["num_features"], PRESETS[config["preset"]]["bigrams"]), scorer=scorer)


def df_parallelism(df: DataFrame) -> int:
    return max(1, df.sparkSession.sparkContext.defaultParallelism)


def inverse_frequencies(windows: DataFrame, num_features: int) -> np.ndarray:
    """log((n + 1) / (windows with the term + 1)) per hashed term."""
    seen = windows.select(F.explode(F.array_distinct("terms")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(num_features)
    for r in seen.collect():   # at most num_features rows
        counts[r["t"]] = r["n"]
    return np.log((windows.count() + 1.0) / (counts + 1.0))


def fit(labelled: DataFrame, preset: str = "base", key: str = "comment_id", labels=LABELS,
        max_iter: int = 15, reg_param: float = 1e-5, irony_extra: float = IRONY_SENT_EXTRA,
        config: dict | None = None, num_features: int = jt.NUM_FEATURES, rank: int = jt.RANK, seed: int = 42) -> MultiTaskModel:
    """M4 on rows already restricted to the training split: both heads over one shared layer, minimising A11."""
    config = {"preset": preset, "max_length": MAX_LENGTH, "stride_frac": STRIDE_FRAC, "slide": True,
              "use_title_prefix": True, "clean_like_old": True, "num_features": num_features, "rank": rank, **(config or {})}
    w = _windows(labelled, key, [*labels, "sent_class"], config)
    rows = w.select("terms", F.array(*[F.col(c).cast("double") for c in labels]).alias("y"), F.col("sent_class").cast("int").alias("sent"),
                    (F.col("irony").cast("double") if "irony" in labels else F.lit(0.0)).alias("irony"), (1.0 / F.col("n_windows")).alias("weight"))
    written = stage(rows, "training-windows")
    idf, shape = inverse_frequencies(written, num_features), jt.Shape(num_features, rank, len(labels))
    # Every round is a job over all partitions: as many as there are cores, held where they fit.
    train = jt.vectorised(written, idf, df_parallelism(labelled)).persist()
    try:
        theta, history = jt.minimise(lambda t: jt.evaluate(train, t, shape, reg_param, irony_extra), shape.start(seed), max_iter)
    finally:
        train.unpersist()
    release(written)
    return MultiTaskModel(idf, theta, shape, list(labels), [0.5] * len(labels), config, history)


def window_probabilities(model: MultiTaskModel, df: DataFrame, key: str = "comment_id") -> DataFrame:
    """Per ``key``: mean window probabilities ``<label>_p`` and ``sent_*_prob``."""
    names = [*[f"{c}_p" for c in model.labels], *SENTIMENT_PROB_COLS]
    scored = _windows(df, key, [], model.config, jt.scorer(model.theta, model.shape, model.idf))
    per_window = scored.select(key, *[F.col("scores")[i].alias(n) for i, n in enumerate(names)])
    return window_mean(per_window, names, key).drop("n_windows")


def predict(model: MultiTaskModel, df: DataFrame, key: str = "comment_id") -> DataFrame:
    """M5: append the prediction columns to ``df`` (other columns untouched).

    Every row gets the prediction of its own text: rows are told apart by key, text
    and title, so a repeated or null key mixes nothing (a mean over windows is the
    same for equal texts). Windows are averaged from the scan on; the text is
    shuffled once, to get its predictions."""
    title = [F.col("video_title")] if "video_title" in df.columns else []
    base = df.withColumn("__row", F.struct(F.col(key), F.xxhash64(F.col("text"), *title)))
    probs = window_probabilities(model, base, "__row")
    preds = prediction_columns(probs, model.labels, model.thresholds, "_p",
                               sent_probs=SENTIMENT_PROB_COLS)
    keep = [c for c in base.columns if c not in PREDICTION_COLS]
    return base.select(*keep).join(preds.select("__row", *PREDICTION_COLS), "__row", "left").drop("__row")


def at_thresholds(preds: DataFrame, labels, thresholds) -> DataFrame:
    """The same probabilities cut at other thresholds."""
    return preds.withColumns({f"{c}_ft_pred": at_threshold(f"{c}_ft_prob", t) for c, t in zip(labels, thresholds)})


def train_held_out(labelled: DataFrame, preset: str = "base", key: str = "comment_id", labels=LABELS,
                   seed: int = 42, **kw):
    """The training job: labels, split, fit on train, thresholds tuned on validation. The held-out rows are
    predicted once. Returns (model, split table, held-out predictions at 0.5, thresholds table)."""
    df = stage(stratified_split(build_labels(labelled, labels), key, seed), "split")
    model = fit(df.filter(F.col("split") == "train"), preset, key, labels, **kw)
    scored = stage(predict(model, df.filter(F.col("split") != "train"), key), "held-out")   # at 0.5
    tuned = tune_thresholds(scored.filter(F.col("split") == "val"), labels, "_ft_prob")
    rows = {r["label"]: r["threshold"] for r in tuned.collect()}   # ten rows
    return model.with_thresholds([rows[c] for c in labels]), df, scored, tuned


def default_metrics(test: DataFrame, labels=LABELS) -> tuple[DataFrame, DataFrame]:
    """Of predictions at 0.5: (micro and macro F1 of the labels, macro F1 of the sentiment)."""
    metrics = (multilabel_report(test, labels).filter(F.col("label").isin("micro avg", "macro avg"))
               .groupBy().pivot("label", ["micro avg", "macro avg"]).agg(F.first("f1"))
               .withColumnsRenamed({"micro avg": "ml_test_f1_micro_default",
                                    "macro avg": "ml_test_f1_macro_default"}))
    return metrics, sentiment_f1(test).select(F.col("sent_macro_f1").alias("sent_test_macro_f1"))


def train_main(labelled: DataFrame, preset: str = "base", key: str = "comment_id", labels=LABELS,
               seed: int = 42, **kw):
    """:func:`train_held_out` with its reports: (model, split table, test metrics, sentiment metric, thresholds table)."""
    model, df, scored, tuned = train_held_out(labelled, preset, key, labels, seed, **kw)
    metrics, sent = default_metrics(scored.filter(F.col("split") == "test"), labels)
    return model, df, metrics, sent, tuned


def predict_hybrid(base_model: MultiTaskModel, specialist: MultiTaskModel, df: DataFrame,
                   key: str = "comment_id") -> DataFrame:
    """M6: both models on the same input; irony and sentiment from the specialist."""
    check_label_lists(base_model.labels, specialist.labels)
    return hybrid_merge(predict(base_model, df, key), predict(specialist, df, key), key, base_model.labels)


def save_model(model: MultiTaskModel, path: str) -> None:
    """Persist to shared storage: the numbers in rows of a Parquet table, and a one-row config (labels, thresholds,
    preprocessing, window policy, shape)."""
    s = SparkSession.getActiveSession()
    rows = [(name, i // 1024, a[i:i + 1024].tolist()) for name, a in (("idf", model.idf), ("theta", model.theta)) for i in range(0, len(a), 1024)]
    s.createDataFrame(rows, "name string, part int, numbers array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
    cfg = {"label_names": model.labels, "thresholds": model.thresholds, **model.config}
    s.createDataFrame([(json.dumps(cfg),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load_model(path: str) -> MultiTaskModel:
    s = SparkSession.getActiveSession()
    cfg = json.loads(s.read.text(f"{path}/config").first()["value"])
    labels = cfg.pop("label_names")
    thresholds = cfg.pop("thresholds")
    parts = s.read.parquet(f"{path}/weights").orderBy("name", "part").collect()   # the model's size
    numbers = {n: np.concatenate([np.array(r["numbers"]) for r in parts if r["name"] == n]) for n in ("idf", "theta")}
    return MultiTaskModel(numbers["idf"], numbers["theta"], jt.Shape(cfg["num_features"], cfg["rank"], len(labels)), labels, thresholds, cfg)
