"""Labels, split, metrics, tuning, loss
against plain-Python computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenor.functions.numeric import THRESHOLD_GRID
from tenor.operators import labels as lb
from tenor.operators import metrics as mt
from tenor.schemas import LABELS, ContractError

L3 = ["a", "b", "c"]


def _prf(tp, fp, fn):
    p = tp / (tp + fp) if tp + fp else 0.0
    r = tp / (tp + fn) if tp + fn else 0.0
    f = 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0
    return p, r, f


def test_grid_has_the_linspace_doubles():
    assert len(THRESHOLD_GRID) == 19
    assert 0.39999999999999997 in THRESHOLD_GRID and 0.49999999999999994 in THRESHOLD_GRID


def test_contract_and_codes(spark):
    df = spark.createDataFrame([("1", -1), ("2", None)], "comment_id string, sentiment int")
    with pytest.raises(ContractError):
        lb.build_labels(df)
    full = spark.createDataFrame([("1", -1, *([0] * 10)), ("2", None, 1, *([0] * 9)), ("3", 1, *([0] * 10))],
                                 "comment_id string, sentiment int, " + ", ".join(f"{c} int" for c in LABELS))
    got = {r.comment_id: (r.sent_class, r.any_pos, r.stratum) for r in lb.build_labels(full).collect()}
    assert got == {"1": (0, 0, 0), "2": (1, 1, 4), "3": (2, 0, 2)}
    bad = spark.createDataFrame([("1", 5, *([0] * 10))],
                                "comment_id string, sentiment int, " + ", ".join(f"{c} int" for c in LABELS))
    with pytest.raises(Exception):
        lb.build_labels(bad).collect()


def test_renames_only_when_target_absent(spark):
    from tenor.schemas import normalize_columns
    df = spark.createDataFrame([(1, 2)], "`Cogni_dis_manual` int, `discrim_ manual` int")
    assert sorted(normalize_columns(df).columns) == ["cogni_dis_manual", "discrim_manual"]
    df2 = spark.createDataFrame([(1, 2)], "`Cogni_dis_manual` int, cogni_dis_manual int")
    assert sorted(normalize_columns(df2).columns) == ["Cogni_dis_manual", "cogni_dis_manual"]


def test_split_is_a_stratified_partition(spark):
    random.seed(1)
    rows = [(f"id{i}", random.randrange(6)) for i in range(500)]
    df = spark.createDataFrame(rows, "comment_id string, stratum int")
    out = lb.stratified_split(df).collect()
    assert len(out) == 500 and len({r.comment_id for r in out}) == 500
    for s in range(6):
        n = sum(1 for _, st in rows if st == s)
        got = [r.split for r in out if r.stratum == s]
        assert got.count("train") == (7 * n + 5) // 10
        assert got.count("train") + got.count("val") == (17 * n + 10) // 20
    again = {r.comment_id: r.split for r in lb.stratified_split(df).collect()}
    assert again == {r.comment_id: r.split for r in out}


def _random_preds(n=60, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        ys = [rnd.random() < 0.3 for _ in L3]
        ps = [rnd.random() < 0.3 for _ in L3]
        rows.append((f"r{i}", *[int(v) for v in ys], *[int(v) for v in ps]))
    rows.append(("none", 0, 0, 0, 0, 0, 0))
    return rows


def test_multilabel_report_matches_python(spark):
    rows = _random_preds()
    schema = "comment_id string, " + ", ".join(f"{c} int" for c in L3) + ", " + ", ".join(f"{c}_ft_pred int" for c in L3)
    df = spark.createDataFrame(rows, schema)
    got = {r.label: r for r in mt.multilabel_report(df, L3).collect()}
    per = []
    T = FP = FN = 0
    for j, c in enumerate(L3):
        y = [r[1 + j] for r in rows]
        p = [r[4 + j] for r in rows]
        tp = sum(a * b for a, b in zip(y, p))
        fp = sum((1 - a) * b for a, b in zip(y, p))
        fn = sum(a * (1 - b) for a, b in zip(y, p))
        T, FP, FN = T + tp, FP + fp, FN + fn
        per.append((_prf(tp, fp, fn), sum(y)))
        assert got[c].f1 == pytest.approx(per[-1][0][2]) and got[c].support == sum(y)
    assert got["micro avg"].f1 == pytest.approx(_prf(T, FP, FN)[2])
    assert got["macro avg"].f1 == pytest.approx(sum(x[0][2] for x in per) / 3)
    S = sum(x[1] for x in per)
    assert got["weighted avg"].recall == pytest.approx(sum(x[0][1] * x[1] for x in per) / S)
    sf = []
    for r in rows:
        i = sum(r[1 + j] * r[4 + j] for j in range(3))
        ny, npred = sum(r[1:4]), sum(r[4:7])
        sf.append(2 * i / (ny + npred) if ny + npred else 0.0)
    assert got["samples avg"].f1 == pytest.approx(sum(sf) / len(sf))


def test_sentiment_macro_over_union_of_classes(spark):
    rows = [(-1, -1), (-1, 0), (0, 0), (1, -1), (1, 1), (0, 1)]
    df = spark.createDataFrame(rows, "sentiment int, sent_pred int")
    got = mt.sentiment_f1(df).collect()[0]
    f = []
    for c in (-1, 0, 1):
        tp = sum(1 for y, p in rows if y == c and p == c)
        fp = sum(1 for y, p in rows if y != c and p == c)
        fn = sum(1 for y, p in rows if y == c and p != c)
        f.append(_prf(tp, fp, fn)[2])
    assert got.sent_macro_f1 == pytest.approx(sum(f) / 3) and got.n_rows == 6
    # a class absent from both sides does not count
    two = spark.createDataFrame([(0, 0), (1, 1), (1, 0)], "sentiment int, sent_pred int")
    assert mt.sentiment_f1(two).collect()[0].sent_macro_f1 == pytest.approx((2 / 3 + 2 / 3) / 2)


def test_irony_subset_empty_is_null(spark):
    df = spark.createDataFrame([(0, 1, 1)], "irony int, sentiment int, sent_pred int")
    r = mt.sentiment_f1_irony(df).collect()[0]
    assert r.sent_macro_f1_irony is None and r.n_irony_rows == 0


def test_tune_thresholds_matches_brute_force(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 3), 0, rnd.choice([0.05, 0.5, 0.95])) for _ in range(80)]
    df = spark.createDataFrame(rows, "a int, a_ft_prob double, b int, b_ft_prob double")
    got = {r.label: r.threshold for r in mt.tune_thresholds(df, ["a", "b"]).collect()}
    y = [r[0] for r in rows]
    p = [r[1] for r in rows]
    best_t, best_f = 0.5, 0.0
    for t in THRESHOLD_GRID:
        pred = [int(x >= t) for x in p]
        f = _prf(sum(a * b for a, b in zip(y, pred)), sum((1 - a) * b for a, b in zip(y, pred)),
                 sum(a * (1 - b) for a, b in zip(y, pred)))[2]
        if f > best_f:
            best_f, best_t = f, t
    assert got["a"] == best_t
    assert got["b"] == 0.5            # no positives: every F1 is 0


def test_multitask_loss_matches_numpy(spark):
    rnd = np.random.default_rng(0)
    n = 20
    x = rnd.normal(size=(n, 3))
    y = rnd.integers(0, 2, size=(n, 3))
    s = rnd.normal(size=(n, 3))
    cls = rnd.integers(0, 3, size=n)
    rows = [(*map(float, x[i]), *map(int, y[i]), *map(float, s[i]), int(cls[i])) for i in range(n)]
    schema = ", ".join([f"{c}_logit double" for c in ["a", "irony", "c"]] + [f"{c} int" for c in ["a", "irony", "c"]]
                       + ["s0 double", "s1 double", "s2 double", "sent_class int"])
    df = spark.createDataFrame(rows, schema)
    got = mt.multitask_loss(df, ["a", "irony", "c"]).collect()[0]
    bce = np.maximum(x, 0) - x * y + np.log1p(np.exp(-np.abs(x)))
    multi = bce.mean(axis=1).mean()
    lse = np.log(np.exp(s).sum(axis=1))
    ce = (lse - s[np.arange(n), cls]) * (1 + 0.5 * y[:, 1])
    assert got.multi_loss == pytest.approx(multi) and got.sent_loss == pytest.approx(ce.mean())
    assert got.loss == pytest.approx(0.7 * multi + ce.mean())
    assert math.isfinite(got.loss)


def test_class_frequency_and_test_subset(spark):
    df = spark.createDataFrame([("1", 1, 0), ("2", 1, 1), ("3", None, 0)], "comment_id string, a int, b int")
    got = {r.label: r.freq for r in lb.class_frequency(df, ["a", "b"]).collect()}
    assert got == {"a": 2.0, "b": 1.0}
    ids = spark.createDataFrame([("2",), ("3",), ("9",)], "x string")
    assert sorted(r.comment_id for r in lb.test_subset(df, ids).collect()) == ["2", "3"]
    assert df.select(F.lit(1)).count() == 3


def test_row_ids_when_no_id_column(spark):
    df = spark.createDataFrame([("x",), ("y",), ("z",)], "text string").repartition(1)
    out, key = lb.ensure_id(df)
    assert key == "_row_id" and [(r.text, r._row_id) for r in out.orderBy("_row_id").collect()] == [
        ("x", "0"), ("y", "1"), ("z", "2")]
    same, key2 = lb.ensure_id(spark.createDataFrame([(5,)], "comment_id int"))
    assert key2 == "comment_id" and same.collect()[0].comment_id == "5"


def test_report_zero_division_edges(spark):
    # a: no positives and no predictions; b: predictions only; c: positives only
    rows = [("1", 0, 0, 1, 0, 1, 0), ("2", 0, 0, 0, 1, 0, 0)]
    schema = "comment_id string, a int, b int, c int, a_ft_pred int, b_ft_pred int, c_ft_pred int"
    got = {r.label: r for r in mt.multilabel_report(spark.createDataFrame(rows, schema), L3).collect()}
    for lab in L3:
        assert (got[lab].precision, got[lab].recall, got[lab].f1) == (0.0, 0.0, 0.0)
    assert got["a"].support == 0 and got["c"].support == 1
    assert got["samples avg"].f1 == 0.0 and got["micro avg"].f1 == 0.0
