"""Language identification, the classifier, and the driver contract."""

import pytest
from pyspark.sql import functions as F

from tenor.operators import classifier as clf
from tenor.operators import language as lg
from tenor.schemas import LABELS, PREDICTION_COLS

SF = "/root/testdata/sf0.001"


def test_language_identification(spark):
    train = spark.createDataFrame(
        [("1", "the cat and the dog are in the house with the man", "en"),
         ("2", "der hund und die katze sind in dem haus mit dem mann", "de"),
         ("3", "le chat et le chien sont dans la maison avec le monsieur", "fr")],
        "comment_id string, text string, lang string")
    prof = lg.train_profiles(train)
    test = spark.createDataFrame([("a", "the man and the house"), ("b", "die katze und der hund"),
                                  ("c", ""), ("d", "zzzz qqqq")], "comment_id string, text string")
    got = {r.comment_id: r.pred_lang for r in lg.identify(test, prof).collect()}
    assert got["a"] == "en" and got["b"] == "de" and got["c"] is None
    kept = {r.comment_id for r in lg.english_only(lg.identify(test, prof)).collect()}
    assert "a" in kept and "c" in kept and "b" not in kept       # unknown language fails open


def test_classifier_smoke(spark):
    from tenor.plans import views as V
    gold = V.gold(spark, SF)
    model, split, metrics, sent, tuned = clf.train_main(gold, max_iter=5)
    assert len(model.thresholds) == len(LABELS) and tuned.count() == len(LABELS)
    docs = V.comments(spark, SF).limit(30).withColumn("video_title", F.lit("t"))
    out = clf.predict(model, docs)
    assert set(PREDICTION_COLS) <= set(out.columns) and out.count() == 30
    r = out.select(*PREDICTION_COLS).collect()
    for row in r:
        assert 0.0 <= row.irony_ft_prob <= 1.0
        assert row.sent_neg_prob + row.sent_neu_prob + row.sent_pos_prob == pytest.approx(1.0)
        assert row.sent_pred in (-1, 0, 1)


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "avg_vader_compound" in df.columns
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60
    for key in ("yearly_summary", "window_fill", "multilabel_report", "token_windows"):
        assert key in o
