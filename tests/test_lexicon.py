"""Lexicon scores (J5, M1, M2), labels, caps, summary and sample."""

import math

import pytest
from pyspark.sql import functions as F

from tenor.functions.numeric import sentiment_label
from tenor.operators import lexicon as lx


@pytest.fixture(scope="module")
def lex(spark):
    v = spark.createDataFrame([("good", 2.0), ("bad", -2.0), ("great", 3.0)], "token string, valence double")
    p = spark.createDataFrame([("good", 0.7, 0.6, 1.0), ("bad", -0.7, 0.6, 1.0), ("very", 0.0, 0.0, 1.3)],
                              "token string, polarity double, subjectivity double, intensity double")
    return v, p


def _score(spark, lex, rows, rules=False):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(rows)], "comment_id string, text string")
    out = lx.score(df, lex[0], lex[1], rules=rules)
    return {r.comment_id: r for r in out.collect()}


def test_plain_sum_scores(spark, lex):
    got = _score(spark, lex, ["good good bad", "", None, "nothing here", "very good", "not very good"])
    s = 2.0
    assert got["0"].vader_compound == pytest.approx(s / math.sqrt(s * s + 15))
    # shares: pos (2+1)*2 = 6, neg |-2-1| = 3, neu 0 -> 6/9, 3/9
    assert got["0"].vader_pos == pytest.approx(6 / 9) and got["0"].vader_neg == pytest.approx(3 / 9)
    for k in ("1", "2"):
        assert (got[k].vader_compound, got[k].vader_pos, got[k].vader_neu, got[k].tb_polarity) == (0.0, 0.0, 0.0, 0.0)
    assert got["3"].vader_neu == 1.0 and got["3"].vader_compound == 0.0
    assert got["4"].tb_polarity == pytest.approx(0.7 * 1.3)
    assert got["4"].tb_subjectivity == pytest.approx(min(0.6 * 1.3, 1.0))
    assert got["5"].tb_polarity == pytest.approx(0.7 * 1.3 * -0.5)


def test_rules_negation_caps_but_punctuation(spark, lex):
    got = _score(spark, lex, ["good", "not good", "GOOD day", "good but bad", "good!!", "very good"], rules=True)
    base = got["0"].vader_compound
    assert got["1"].vader_compound < 0 < base                       # negation flips
    assert got["2"].vader_compound > base                           # caps emphasis (mixed case)
    assert got["3"].vader_compound < 0                              # after 'but' weighs 1.5x
    assert got["4"].vader_compound > base                           # '!' emphasis
    assert got["5"].vader_compound > base                           # booster
    for r in got.values():
        assert -1.0 <= r.vader_compound <= 1.0
        assert abs(r.vader_pos + r.vader_neg + r.vader_neu - 1.0) < 1e-9 or r.vader_neu == 0.0


def test_label_edges(spark):
    df = spark.createDataFrame([(0.05,), (-0.05,), (0.0499,), (0.0,)], "c double")
    got = [r.l for r in df.select(sentiment_label("c").alias("l")).collect()]
    assert got == ["positive", "negative", "neutral", "neutral"]


def test_cap_per_year_ties_nulls_last(spark):
    rows = []
    for y, n in ((2010, 2), (2011, 3), (2012, 4)):
        for i in range(n):
            rows.append((f"{y}-{i}", y, None if i == 0 else f"{y}-01-0{i}T00:00:00Z"))
    rows.append(("2012-x", 2012, "2012-01-01T00:00:00Z"))   # equal date, tie broken by id
    df = spark.createDataFrame(rows, "comment_id string, year int, published_at string")
    got = sorted((r.year, r.comment_id) for r in lx.cap_per_year(df, n=3).collect())
    assert got == [(2010, "2010-0"), (2010, "2010-1"),
                   (2011, "2011-0"), (2011, "2011-1"), (2011, "2011-2"),
                   (2012, "2012-1"), (2012, "2012-2"), (2012, "2012-x")]


def test_review_sample_sizes_and_determinism(spark):
    rows = [(f"c{i}", 2010 + i % 3) for i in range(50)]
    df = spark.createDataFrame(rows, "comment_id string, year int")
    a = sorted(r.comment_id for r in lx.review_sample(df, n=7).collect())
    b = sorted(r.comment_id for r in lx.review_sample(df, n=7).collect())
    assert a == b and len(a) == 21
    assert lx.review_sample(df, n=100).count() == 50


def test_summary_and_range(spark):
    rows = [("a", 2010, 0.5, True, False), ("b", 2010, -0.5, False, True), ("c", 2011, 0.0, False, False)]
    df = spark.createDataFrame(rows, "comment_id string, year int, vader_compound double, is_distrust boolean, "
                                     "is_trust boolean")
    for c in lx.SCORE_COLS:
        if c != "vader_compound":
            df = df.withColumn(c, F.lit(0.25))
    s = {r.year: r for r in lx.yearly_summary(lx.label_sentiment(df)).collect()}
    assert (s[2010]["count"], s[2010].pos_count, s[2010].neg_count, s[2010].neu_count) == (2, 1, 1, 0)
    assert (s[2010].distrust_count, s[2010].trust_count) == (1, 1)
    assert s[2011].neu_count == 1 and s[2010].avg_vader_compound == 0.0
    r = lx.year_range(df).collect()[0]
    assert (r.min_year, r.max_year, r.n_rows) == (2010, 2011, 3)
