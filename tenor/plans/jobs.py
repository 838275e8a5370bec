"""The three jobs of the reference, end to end, as Spark jobs with sinks.

* :func:`collect_job`   landed pages -> sampled videos -> capped comments -> NDJSON per year
* :func:`lexicon_job`   NDJSON comments -> kept/removed -> cap -> scores -> CSV, samples,
                        yearly summary, term counts
* :func:`train_job`, :func:`predict_job`, :func:`hybrid_job`, :func:`evaluate_job`
                        labelled CSV -> model + split ids + metrics; predictions; merge; test metrics

Outputs go to ``out`` (shared storage). Intermediate tables with several
consumers are written once under the session's checkpoint folder and read
back, which cuts lineage so a lost executor recomputes from that table.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenor.functions.numeric import IRONY_SENT_EXTRA, LAMBDA_MULTI, LAMBDA_SENT, whole_number
from tenor.functions.text import DISTRUST_TERMS, TRUST_TERMS
from tenor.functions.time import epoch_seconds, parse_iso
from tenor.operators import classifier as clf
from tenor.operators import collect as co
from tenor.operators import labels as lb
from tenor.operators import language as lg
from tenor.operators import lexicon as lx
from tenor.operators import metrics as mt
from tenor.operators import text as tx
from tenor.operators.hybrid import hybrid_merge
from tenor.schemas import LABELS, normalize_columns, require_predictions
from tenor.session import tune
from tenor.sources import pages as pg
from tenor.sources import readers as rd
from tenor.sources import sinks as sk
from tenor.staging import release, stage


def _json(spark: SparkSession, obj: dict) -> DataFrame:
    return spark.createDataFrame([(json.dumps(obj, ensure_ascii=False),)], "value string")


def one_row(named: dict) -> DataFrame:
    """Combine one-row, one-value DataFrames {name: df with one column} into one
    row with a column per name (unpivot + pivot; no join)."""
    parts = [df.select(F.lit(name).alias("metric"), F.col(df.columns[0]).cast("double").alias("value"))
             for name, df in named.items()]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return long.groupBy().pivot("metric", list(named)).agg(F.first("value"))


def write_record(spark: SparkSession, obj: dict, path: str) -> None:
    """K3 for driver-side provenance records (config, metadata): one JSON file."""
    _json(spark, obj).coalesce(1).write.mode("overwrite").text(path)


# ----------------------------------------------------------------------------
# Collection

def collect_job(spark: SparkSession, search_pages: DataFrame, video_pages: DataFrame,
                comment_pages: DataFrame, years, terms, out: str, variant: str = "general",
                lang_profiles: DataFrame | None = None, now_iso: str | None = None,
                target: int | None = None) -> DataFrame:
    """Landed pages -> sampled videos (W6, in landed order) -> comments (U3, P4, W2,
    W3) + J1 -> K1; returns the ingest summary (A5), also written to ``out/summary``.

    ``years``: the years to collect, or (year, start, end) bounds. Pages of other
    years and windows outside the bounds (P1, with ``now_iso`` as the end of the
    current year) are left out. A video or comment that landed more than once
    counts once."""
    tune(spark)
    bounds = [b if isinstance(b, tuple) else (b, *co.year_bounds_py(int(b), now_iso or "9999")) for b in years]
    limits = spark.createDataFrame([(int(y), s, e) for y, s, e in bounds], "year int, lo string, hi string")
    staged = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        staged.append(stage(df, name))
        return staged[-1]

    videos = co.one_per_video(pg.flatten_video_pages(video_pages))
    videos = kept(videos.withColumn("year", F.substring("published_at", 1, 4).try_cast("int")), "videos")
    if lang_profiles is not None:
        videos = kept(lg.identify(videos, lang_profiles, "video_id", "title"), "videos-with-language")
    when = lambda c: epoch_seconds(parse_iso(c))  # noqa: E731  (as times: ...00Z and ...00.000Z are one)
    hits = (pg.flatten_search_pages(search_pages).withColumn("year", F.col("year").cast("int")).join(limits, "year")
            .filter((when("window_start") >= when("lo")) & (when("window_end") <= when("hi"))).drop("lo", "hi"))
    sampled = kept(co.fill_landed(hits, videos, terms, variant, target,
                                   english="pred_lang" if lang_profiles is not None else None), "sampled")
    comments = pg.flatten_comment_pages(comment_pages).join(sampled.select("year", "video_id"), "video_id")
    english = None
    if lang_profiles is not None:
        comments = kept(lg.identify(comments, lang_profiles), "comments-with-language")
        english = "pred_lang"
    collected = co.collect_comments(comments, sampled, english=english)
    final = kept(co.attach_video(collected, videos).select(
        "comment_id", "video_id", "text", "published_at", "video_title", "video_published_at", "year"), "collected")
    sk.write_ndjson_by_year(final, f"{out}/comments", years=[int(y) for y, _, _ in bounds])
    summary = stage(co.ingest_summary(sampled, final), "ingest-summary")
    sk.write_json_record(summary, f"{out}/summary")
    release(*staged)
    return summary


# ----------------------------------------------------------------------------
# Lexicon analysis

def lexicon_job(spark: SparkSession, patterns, out: str, valence_lex: DataFrame | None = None,
                polarity_lex: DataFrame | None = None, max_per_year: int = lx.MAX_PER_YEAR,
                sample_n: int = lx.SAMPLE_PER_YEAR, seed: int = lx.SAMPLE_SEED, rules: bool = True) -> DataFrame:
    """S1 -> P5 -> {M7 -> K1, W1 -> M1+M2+P9+P11 -> stage -> {K2, W4 -> K1,
    P12 -> A1 -> K2, A2 -> K2}}. Returns the yearly summary."""
    tune(spark)
    valence_lex = valence_lex if valence_lex is not None else lx.seed_valence(spark)
    polarity_lex = polarity_lex if polarity_lex is not None else lx.seed_polarity(spark)
    comments = rd.read_comments(spark, patterns)
    kept, removed = tx.split_letters(comments)
    sk.write_ndjson_by_year(lx.analyze(removed, valence_lex, polarity_lex, rules=rules), f"{out}/removed_comments")
    capped = stage(lx.cap_per_year(kept, max_per_year), "capped")
    scored = stage(lx.analyze(capped, valence_lex, polarity_lex, rules=rules), "scored")
    sk.write_csv(scored.orderBy("year", F.col("published_at").asc_nulls_last(), "comment_id"), f"{out}/comments_sentiment_analysis")
    sk.write_ndjson_by_year(lx.review_sample(scored, sample_n, seed), f"{out}/samples")
    summary = stage(lx.yearly_summary(lx.label_sentiment(scored)), "yearly-summary").orderBy("year")
    sk.write_csv(summary, f"{out}/sentiment_summary_per_year")
    counts = stage(tx.term_counts(scored, DISTRUST_TERMS + TRUST_TERMS), "term-counts")   # one pass, a row per term
    n = len(DISTRUST_TERMS)
    for name, own in (("distrust", F.col("term_no") < n), ("trust", F.col("term_no") >= n)):
        sk.write_csv(counts.filter(own).orderBy("term_no").select("term", "count"), f"{out}/{name}_term_counts")
    release(capped, scored, counts)
    return summary


# ----------------------------------------------------------------------------
# Train, predict, merge, evaluate

def train_job(spark: SparkSession, labelled_csv: str, out: str, preset: str = "base", **kw) -> clf.MultiTaskModel:
    """S2 -> P6/P10 -> A3 -> W5 -> K4 -> M4 -> metrics at 0.5 (K3) -> A10 -> config (K3) -> K5."""
    tune(spark)
    df = normalize_columns(rd.read_labelled_csv(spark, labelled_csv, schema=None))
    df, key = lb.ensure_id(df)
    df = df.withColumns({c: whole_number(c) for c in [*LABELS, "sentiment"] if c in df.columns})
    df = stage(tx.fill_defaults(df, labels=LABELS), "labelled")
    sk.write_json_record(lb.class_frequency(lb.build_labels(df)).groupBy().pivot("label", LABELS).agg(
        F.first("freq")), f"{out}/class_frequencies")
    model, split, scored, _ = clf.train_held_out(df, preset, key, **kw)
    test = scored.filter(F.col("split") == "test")
    metrics, sent = clf.default_metrics(test, model.labels)
    sk.write_split_ids(split, f"{out}/split_ids", key)
    sk.write_json_record(one_row({
        "ml_test_f1_micro_default": metrics.select("ml_test_f1_micro_default"),
        "ml_test_f1_macro_default": metrics.select("ml_test_f1_macro_default"),
        "sent_test_macro_f1": sent.select("sent_test_macro_f1")}), f"{out}/test_metrics_default")
    clf.save_model(model, f"{out}/model")
    write_record(spark, {"label_names": model.labels, "thresholds": model.thresholds,
                         "max_length": model.config.get("max_length"), "preprocessing": {
                             "use_title_prefix": model.config.get("use_title_prefix"),
                             "clean_like_old": model.config.get("clean_like_old")},
                         "seed": 42, "trained_on": labelled_csv, "model_type": f"tenor-{preset}",
                         "base_model": f"tenor-{preset}", "loss_weights": {"lambda_sent": LAMBDA_SENT, "lambda_multi": LAMBDA_MULTI, "irony_sent_extra": IRONY_SENT_EXTRA},
                         "timestamp": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")},
                 f"{out}/label_config")
    sk.write_report(mt.multilabel_report(clf.at_thresholds(test, model.labels, model.thresholds), model.labels), f"{out}/test_report_multilabel_tuned")
    release(df, split, scored)
    return model


def predict_job(spark: SparkSession, model_dir: str, input_csv: str, output_csv: str, slide: bool = True) -> None:
    """M5 -> K2 + provenance (K3)."""
    tune(spark)
    model = clf.load_model(model_dir)
    model.config["slide"] = slide
    df, key = lb.ensure_id(normalize_columns(rd.read_labelled_csv(spark, input_csv, schema=None)))
    sk.write_csv(clf.predict(model, stage(df, "to-predict"), key), output_csv)
    write_record(spark, {"model_dir": model_dir, "labels": model.labels, "thresholds": model.thresholds,
                         "slide": slide}, f"{output_csv}_meta")


def hybrid_predict_job(spark: SparkSession, base_dir: str, irony_dir: str, input_csv: str, output_csv: str) -> None:
    """M6: both models on one CSV; irony and sentiment from the specialist -> K2 + provenance (K3)."""
    tune(spark)
    base, irony = clf.load_model(base_dir), clf.load_model(irony_dir)
    df, key = lb.ensure_id(normalize_columns(rd.read_labelled_csv(spark, input_csv, schema=None)))
    sk.write_csv(clf.predict_hybrid(base, irony, stage(df, "to-predict"), key), output_csv)
    write_record(spark, {"mode": "hybrid", "base_model_dir": base_dir, "irony_model_dir": irony_dir, "labels": base.labels,
                         "base_thresholds": base.thresholds, "irony_thresholds": irony.thresholds}, f"{output_csv}_meta")


def hybrid_job(spark: SparkSession, base_csv: str, irony_csv: str, out_csv: str) -> None:
    """J2/J3 on two prediction files -> K2 + provenance."""
    tune(spark)
    base, key = lb.ensure_id(rd.read_labelled_csv(spark, base_csv, schema=None))
    irony, key2 = lb.ensure_id(rd.read_labelled_csv(spark, irony_csv, schema=None))
    if key != key2:
        raise ValueError("both prediction files need the id column, or neither")
    sk.write_csv(hybrid_merge(base, irony, key), out_csv)
    write_record(spark, {"hybrid_sources": {"irony": "irony_model", "sentiment": "irony_model",
                                            "other_labels": "base_model"},
                         "base_csv": base_csv, "irony_csv": irony_csv}, f"{out_csv}_meta")


def evaluate_job(spark: SparkSession, predictions_csv: str, test_ids_path: str, out: str,
                 labels=LABELS, config_path: str | None = None) -> DataFrame:
    """S2 + S7 (+ S6) -> J4 -> P10 -> A7, A8, A9, A4 -> K3. Returns the metrics row.

    With ``config_path`` (a run's ``label_config``) the labels must be those of the run, in its order."""
    tune(spark)
    if config_path is not None:
        own = [r["label"] for r in rd.read_label_config(spark, config_path).orderBy("pos").collect()]   # ten rows
        if own != list(labels):
            raise ValueError(f"labels of the run are {own}, not {list(labels)}")
    df = normalize_columns(rd.read_labelled_csv(spark, predictions_csv, schema=None))
    require_predictions(df, labels)
    df, key = lb.ensure_id(df)
    ids = rd.read_ids(spark, test_ids_path)
    test = lb.test_subset(df, ids, key).withColumns(
        {c: whole_number(c) for c in [*labels, *[f"{c}_ft_pred" for c in labels], "sentiment", "sent_pred"]})
    test = stage(test, "test_rows")
    rep = mt.multilabel_report(test, labels)
    sk.write_report(rep, f"{out}/test_report_multilabel")
    s = mt.sentiment_f1(test)
    si = mt.sentiment_f1_irony(test)
    f1 = rep.filter(F.col("label").isin("micro avg", "macro avg")).groupBy().pivot(
        "label", ["micro avg", "macro avg"]).agg(F.first("f1"))
    metrics = one_row({"ml_f1_micro": f1.select("micro avg"), "ml_f1_macro": f1.select("macro avg"),
                       "sent_macro_f1": s.select("sent_macro_f1"),
                       "sent_macro_f1_irony": si.select("sent_macro_f1_irony"),
                       "num_test_rows": s.select("n_rows")})
    sk.write_json_record(metrics, f"{out}/test_metrics_from_csv")
    sk.write_csv(lb.class_frequency(test, labels).select("label", F.col("freq").cast("bigint").alias("support")),
                 f"{out}/label_supports")
    return metrics
