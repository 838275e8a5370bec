"""Language profiles: packed trigrams, training counts and both ways of scoring against plain Python."""

import math
import random
from collections import Counter

import pytest

from tenor.operators import language as lg

TEXTS = [("1", "The quick brown fox  jumps", "en"), ("2", "der schnelle braune Fuchs", "de"), ("3", "ÜBER\tälter größer", "de"), ("4", "the THE the", "en"), ("5", "", "en"), ("6", None, "de"),
         ("7", "漢字 \U0001F600\U0001F600x", "ja"), ("8", " ", "en"), ("9", "ab", None), ("2", "the other one", "en"), (None, "le renard brun", "fr"), ("10", "a\x00b\x00", "zz"), ("11", "xyzzy qqq", None)]


def plain_grams(text):
    t = " " + " ".join((text or "").lower().split()) + " " if (text or "").split() or not text else "  "
    if text and not text.split():
        t = "   "[:3]
    return [t[i:i + 3] for i in range(len(t) - 2) if t[i + 1] != " "]


def plain_profile(rows):
    counts = {}
    for _, t, lang in rows:
        if lang is not None:
            counts.setdefault(lang, Counter()).update(plain_grams(t))
    return {k: c for k, c in counts.items() if c}


def plain_best(profile, text):
    grams, scores = plain_grams(text), {}
    for lang, c in profile.items():
        denom = sum(c.values()) + len(c) + 1.0
        met = [g for g in grams if g in c]
        if met:
            scores[lang] = sum(math.log(c[g] + 1.0) for g in met) - len(grams) * math.log(denom)
    top = [k for k, v in scores.items() if v == max(scores.values())]
    return top[0] if len(top) == 1 else None


def frame(spark, rows):
    return spark.createDataFrame(rows, "comment_id string, text string, lang string")


def test_profile_counts(spark):
    want = {(lang, g): c for lang, cs in plain_profile(TEXTS).items() for g, c in cs.items()}
    got = {(r.lang, r.gram): round(math.exp(r.delta)) - 1 for r in lg.train_profiles(frame(spark, TEXTS).repartition(3)).collect()}
    assert got == want


def test_counts_handed_on_and_texts_in_parts(monkeypatch):
    """With small bounds a task hands its counts on after every batch, and texts are cut anywhere: the sums are the same."""
    import pyarrow as pa

    texts = [f" {t.lower()} " for t in ("the quick brown fox", "x", "", "😀😀 the the")]
    batches = [pa.RecordBatch.from_arrays([pa.array(["a", "b", "a", "a"]), pa.array(texts)], names=["lang", "t"])] * 3
    sums = []
    for held, at_once in ((1 << 20, 1 << 20), (1, 4)):
        monkeypatch.setattr(lg, "HELD_GRAMS", held)
        monkeypatch.setattr(lg, "AT_ONCE", at_once)
        total = Counter()
        made = list(lg._count_grams(iter(batches)))
        for b in made:
            for lang, gram, c in zip(*[col.to_pylist() for col in b.columns]):
                total[lang, gram] += c
        sums.append((len(made), total))
    assert sums[0][1] == sums[1][1] and sums[0][0] < sums[1][0] and sums[0][1]["a", "the"] == 9


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_languages_by_lookup_and_by_join(spark, monkeypatch, limit):
    monkeypatch.setattr(lg, "LOOKUP_GRAMS", limit)
    profile = plain_profile(TEXTS)
    asked = TEXTS + [("20", "THE", None), ("21", "größe", None), ("22", "zzz qqq", None), ("23", "renard", None), ("24", "the fox " * 40000, None)]
    df = frame(spark, asked)
    got = lg.identify(df, lg.train_profiles(frame(spark, TEXTS)))
    assert got.columns == [*df.columns, "pred_lang"]
    assert sorted((str(r.comment_id), str(r.text), str(r.pred_lang)) for r in got.collect()) == sorted((str(k), str(t), str(plain_best(profile, t))) for k, t, _ in asked)
    assert lg.identify(df, lg.train_profiles(df.limit(0))).filter("pred_lang is not null").count() == 0


def test_equal_profiles_tie(spark):
    rows = [("1", "same words here", "a"), ("2", "same words here", "b"), ("3", "other things", "c")]
    got = {r.comment_id: r.pred_lang for r in lg.identify(frame(spark, rows), lg.train_profiles(frame(spark, rows))).collect()}
    assert got == {"1": None, "2": None, "3": "c"}


def test_both_ways_agree_on_random_texts(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(str(i), "".join(rnd.choice("abcdeéß 漢") for _ in range(rnd.randrange(60))), rnd.choice("xyz")) for i in range(300)]
    df = frame(spark, rows).repartition(4)
    profile = lg.stage(lg.train_profiles(df.limit(150)), "p")
    by_lookup = sorted((r.comment_id, str(r.pred_lang)) for r in lg.identify(df, profile).collect())
    monkeypatch.setattr(lg, "CELLS", 0)   # an alphabet too large for the direct table
    codes = [ord(a) << 42 | ord(b) << 21 | ord(c) for a, b, c in ["abc", "cde", " ab"]]
    order = lg.np.argsort(codes)
    asked = lg.pd.Series([" abcde ", " zab ", "  ", " 漢ab "])
    weights = lg.np.array([[1.0, 0.0], [0.0, 2.0], [0.5, 0.5]])[order]
    args = (lg.np.array(codes, lg.np.uint64)[order], weights, lg.np.array([-1.0, -1.0]), ["x", "y"])
    searched = lg._lookup(*args)(asked).tolist()
    monkeypatch.setattr(lg, "CELLS", 1 << 22)
    assert searched == lg._lookup(*args)(asked).tolist() == ["y", None, None, None]
    monkeypatch.setattr(lg, "LOOKUP_GRAMS", 0)
    assert by_lookup == sorted((r.comment_id, str(r.pred_lang)) for r in lg.identify(df, profile).collect())


def test_scoring_shuffles_and_joins_nothing(spark):
    df = frame(spark, TEXTS)
    plan = lg.identify(df, lg.train_profiles(df))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Generate" not in plan
