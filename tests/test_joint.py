"""Joint training of both heads: gradients, the loss A11 and whole runs against plain dense NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenor.functions.numeric import IRONY_SENT_EXTRA, LAMBDA_MULTI, LAMBDA_SENT
from tenor.operators import classifier as clf
from tenor.operators import joint as jt
from tenor.operators import metrics as mt
from tenor.plans import views as V
from tenor.schemas import LABELS

SHAPE = jt.Shape(features=40, rank=3, labels=4)


def table(seed=1, n=60):
    rng = np.random.default_rng(seed)
    return [(rng.integers(0, 40, rng.integers(0, 12)).tolist(), rng.integers(0, 2, 4).astype(float).tolist(), int(rng.integers(0, 3)), float(rng.integers(0, 2)), float(1 / rng.integers(1, 4))) for _ in range(n)]


def dense(rows, idf):
    x = np.zeros((len(rows), len(idf)))
    for i, r in enumerate(rows):
        for t in r[0]:
            x[i, t] += idf[t]
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return jt.LENGTH * x / np.where(norm > 0, norm, 1), *(np.array([r[k] for r in rows]) for k in (1, 2, 3, 4))


def plain_loss(theta, data, ridge):
    """A11 and its gradient, row by row of the formula, in dense matrices."""
    x, y, sent, irony, weight = data
    w, c, v, b = SHAPE.split(theta)
    h = np.tanh(x @ w + c)
    z = h @ v + b
    p = 1 / (1 + np.exp(-z[:, :4]))
    bce = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean(1)
    q = np.exp(z[:, 4:]) / np.exp(z[:, 4:]).sum(1, keepdims=True)
    ce = -np.log(q[np.arange(len(q)), sent]) * (1 + IRONY_SENT_EXTRA * irony)
    n = weight.sum()
    a11 = LAMBDA_MULTI * (weight * bce).sum() / n + LAMBDA_SENT * (weight * ce).sum() / n
    d = np.hstack([LAMBDA_MULTI * (p - y) / 4, LAMBDA_SENT * (q - np.eye(3)[sent]) * (1 + IRONY_SENT_EXTRA * irony)[:, None]]) * weight[:, None] / n
    back = (d @ v.T) * (1 - h * h)
    g = np.concatenate([(x.T @ back).ravel(), back.sum(0), (h.T @ d).ravel(), d.sum(0)])
    return a11 + 0.5 * ridge * theta @ theta, a11, g + ridge * theta


def test_gradient_by_differences():
    rows = table()
    data = dense(rows, np.linspace(0.1, 2, 40))
    theta = SHAPE.start(5)
    _, _, g = plain_loss(theta, data, 0.01)
    for k in np.random.default_rng(0).choice(len(theta), 25, replace=False):
        e = np.zeros_like(theta)
        e[k] = 1e-6
        assert (plain_loss(theta + e, data, 0.01)[0] - plain_loss(theta - e, data, 0.01)[0]) / 2e-6 == pytest.approx(g[k], abs=1e-7)


def test_tasks_sum_the_same_gradient(spark):
    rows, idf = table(), np.linspace(0.1, 2, 40)
    theta = SHAPE.start(3)
    want = plain_loss(theta, dense(rows, idf), 0.01)
    for parts in (1, 5):
        got = jt.evaluate(jt.vectorised(spark.createDataFrame(rows, jt.TERMS).repartition(parts), idf), theta, SHAPE, 0.01)
        assert got[0] == pytest.approx(want[0], abs=1e-12) and got[1] == pytest.approx(want[1], abs=1e-12)
        assert np.abs(got[2] - want[2]).max() < 1e-12
    with pytest.raises(ValueError, match="no rows"):
        jt.evaluate(spark.createDataFrame([], jt.TRAIN), theta, SHAPE, 0.01)


def test_training_equals_the_plain_run(spark):
    rows, idf = table(2), np.ones(40)
    train = jt.vectorised(spark.createDataFrame(rows, jt.TERMS).repartition(3), idf).cache()
    got, falls = jt.minimise(lambda t: jt.evaluate(train, t, SHAPE, 1e-4), SHAPE.start(1), 12)
    data = dense(rows, idf)
    want, plain_falls = jt.minimise(lambda t: plain_loss(t, data, 1e-4), SHAPE.start(1), 12)
    assert np.abs(got - want).max() < 1e-6 and np.allclose(falls, plain_falls, atol=1e-9)
    assert all(b < a for a, b in zip(falls, falls[1:])) and falls[-1] < 0.8 * falls[0]
    train.unpersist()


def test_long_rows_in_parts(monkeypatch):
    rows, idf = table(4), np.linspace(0.5, 1, 40)
    sparse = jt.sparse_rows([np.array(r[0], np.int64) for r in rows], idf)
    w, c, *_ = SHAPE.split(SHAPE.start(2))
    whole = jt.hidden(*sparse, w, c)
    monkeypatch.setattr(jt, "AT_ONCE", 7)
    assert np.allclose(jt.hidden(*sparse, w, c), whole) and np.allclose(whole, np.tanh(dense(rows, idf)[0] @ w + c))


def test_loss_of_the_trained_model_is_a11(spark):
    """The last A11 of training is what the A11 operator says about the model's logits on the training rows."""
    gold = V.gold(spark, "/root/testdata/sf0.001").limit(60)
    train = clf.stage(clf.build_labels(gold), "joint-test")
    model = clf.fit(train, max_iter=8, num_features=512, rank=4)
    assert len(model.history) > 3 and all(b < a for a, b in zip(model.history, model.history[1:]))
    w, c, v, b = model.shape.split(model.theta)
    seen = clf._windows(train, "comment_id", [*LABELS, "sent_class"], model.config).collect()
    h = jt.hidden(*jt.sparse_rows([np.array(r.terms) for r in seen], model.idf), w, c)
    rows = [(*[int(r[x]) for x in LABELS], int(r.sent_class), 1.0 / r.n_windows, *map(float, z)) for r, z in zip(seen, h @ v + b)]
    cols = ", ".join([*[f"{x} int" for x in LABELS], "sent_class int", "weight double", *[f"{x}_logit double" for x in LABELS], "s0 double", "s1 double", "s2 double"])
    logits = spark.createDataFrame(rows, cols)
    each = [(r.weight, mt.multitask_loss(spark.createDataFrame([r], cols)).first().loss) for r in logits.limit(12).collect()]
    ours = []
    for r in logits.limit(12).collect():
        z, s = np.array([r[f"{x}_logit"] for x in LABELS]), np.array([r.s0, r.s1, r.s2])
        y = np.array([r[x] for x in LABELS])
        bce = (np.maximum(z, 0) - z * y + np.log1p(np.exp(-abs(z)))).mean()
        ce = (np.log(np.exp(s).sum()) - s[r.sent_class]) * (1 + IRONY_SENT_EXTRA * r.irony)
        ours.append((r.weight, LAMBDA_MULTI * bce + LAMBDA_SENT * ce))
    assert np.allclose(each, ours)
    whole = sum(x.weight * (LAMBDA_MULTI * (np.maximum(z, 0) - z * y + np.log1p(np.exp(-abs(z)))).mean() + LAMBDA_SENT * (np.log(np.exp(s).sum()) - s[x.sent_class]) * (1 + IRONY_SENT_EXTRA * x.irony))
                for x in logits.collect() for z, s, y in [(np.array([x[f"{k}_logit"] for k in LABELS]), np.array([x.s0, x.s1, x.s2]), np.array([x[k] for k in LABELS]))]) / sum(r[len(LABELS) + 1] for r in rows)
    assert model.history[-1] == pytest.approx(whole, abs=1e-9)


def test_predictions_equal_the_plain_model_and_survive_saving(spark, tmp):
    gold = V.gold(spark, "/root/testdata/sf0.001").limit(80)
    model, split, scored, tuned = clf.train_held_out(gold, "specialist", max_iter=4, num_features=256, rank=3)
    clf.save_model(model, tmp + "/m")
    back = clf.load_model(tmp + "/m")
    assert np.array_equal(back.theta, model.theta) and np.array_equal(back.idf, model.idf) and back.thresholds == model.thresholds
    w, c, v, b = model.shape.split(model.theta)
    sums = {}
    for r in clf._windows(gold, "comment_id", [], model.config).collect():
        h = jt.hidden(*jt.sparse_rows([np.array(r.terms, np.int64)], model.idf), w, c)
        sums.setdefault(r.comment_id, []).append(jt.probabilities(h @ v + b, len(LABELS))[0])
    for r in clf.predict(back, gold.dropDuplicates(["comment_id"])).collect():
        if len(sums[r.comment_id]) != 1:
            continue
        want = np.mean(sums[r.comment_id], axis=0)
        assert np.allclose([*[r[f"{x}_ft_prob"] for x in LABELS], r.sent_neg_prob, r.sent_neu_prob, r.sent_pos_prob], want, atol=1e-9)
        assert [r[f"{x}_ft_pred"] for x in LABELS] == [int(p >= t) for p, t in zip(want, model.thresholds)]
    assert {r.split for r in scored.select("split").distinct().collect()} == {"val", "test"} and tuned.count() == len(LABELS)
    assert clf.at_thresholds(scored, LABELS, [0.0] * len(LABELS)).filter(F.col("irony_ft_pred") != 1).count() == 0


def test_rows_are_worked_on_in_bounded_pieces(monkeypatch):
    """Whatever a batch holds, some AT_ONCE numbers are worked on at once: sums and vectors are those of the whole."""
    rows, idf = table(6), np.linspace(0.5, 1, 40)
    sizes = np.array([len(r[0]) for r in rows])
    flat = np.concatenate([np.array(r[0], np.int64) for r in rows])
    whole, theta = jt.sparse_flat(flat, sizes, idf), SHAPE.start(2)
    rest = [np.array([r[k] for r in rows]) for k in (1, 2, 4, 3)]
    want = jt.row_sums(theta, SHAPE, whole, *rest, 0.5, 1.0, 1.0)
    monkeypatch.setattr(jt, "AT_ONCE", 9)
    parts, seen = [*jt.pieces(sizes)], []
    assert [a for a, _ in parts[1:]] == [b for _, b in parts[:-1]] and (parts[0][0], parts[-1][1]) == (0, len(rows)) and len(parts) > 10
    assert all(sizes[a:b].sum() <= 9 or b == a + 1 for a, b in parts) and [*jt.pieces(np.zeros(0, int))] == []
    for a, b in parts:
        feature, value, ends = jt.sparse_flat(flat[sizes[:a].sum():sizes[:b].sum()], sizes[a:b], idf)
        back, to = jt._numbers(jt._bytes(value, ends).slice(1), np.float64)   # as binaries and back, from within a column
        assert np.array_equal(back, value[ends[0]:]) and np.array_equal(to, ends[1:] - ends[0])
        seen.append((feature, value))
    assert all(np.array_equal(np.concatenate([x[k] for x in seen]), whole[k]) for k in (0, 1))
    got = jt.row_sums(theta, SHAPE, whole, *rest, 0.5, 1.0, 1.0)
    assert np.allclose(got[0], want[0], atol=1e-12) and np.allclose(got[1], want[1], atol=1e-12)
