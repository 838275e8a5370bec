"""Word windows, window means, prediction columns, hybrid merge, publication
(W8, A12, P14-P17, J2, J3, P19, A13)."""

import pytest
from pyspark.sql import functions as F

from tenor.operators import hybrid as hy
from tenor.operators import model as md
from tenor.operators import publish as pb
from tenor.schemas import ContractError


@pytest.mark.parametrize("n,k", [(0, 1), (1, 1), (318, 1), (319, 2), (476, 2), (477, 3)])
def test_window_counts_and_coverage(spark, n, k):
    text = " ".join(f"w{i}" for i in range(n))
    df = spark.createDataFrame([("c", text)], "comment_id string, text_proc string")
    rows = md.token_windows(df).orderBy("window_no").collect()
    assert len(rows) == k == md.expected_windows(n) and all(r.n_windows == k for r in rows)
    seen = set()
    for r in rows:
        assert len(r.tokens) <= 318
        assert r.tokens == [f"w{i}" for i in range(r.window_no * 158, min(n, r.window_no * 158 + 318))]
        seen.update(r.tokens)
    assert seen == {f"w{i}" for i in range(n)}
    assert md.token_windows(df, slide=False).count() == 1


def test_window_mean(spark):
    df = spark.createDataFrame([("a", 0.2), ("a", 0.4), ("b", 1.0)], "comment_id string, p double")
    got = {r.comment_id: (r.n_windows, r.p) for r in md.window_mean(df, ["p"]).collect()}
    assert got["a"][0] == 2 and got["a"][1] == pytest.approx(0.3) and got["b"] == (1, 1.0)


def test_prediction_columns(spark):
    df = spark.createDataFrame([("x", 0.3, 0.5, 1.0, 1.0, 0.0), ("y", 0.29, 0.7, 0.0, 2.0, 2.0)],
                               "comment_id string, a_p double, b_p double, s0 double, s1 double, s2 double")
    out = {r.comment_id: r for r in md.prediction_columns(df, ["a", "b"], [0.3, 0.5]).collect()}
    assert (out["x"].a_ft_pred, out["x"].b_ft_pred, out["y"].a_ft_pred) == (1, 1, 0)
    assert out["x"].sent_pred == -1          # tie between neg and neu: first wins
    assert out["y"].sent_pred == 0
    for r in out.values():
        assert r.sent_neg_prob + r.sent_neu_prob + r.sent_pos_prob == pytest.approx(1.0)
    assert "s0" in md.prediction_columns(df, ["a", "b"]).columns


def _preds(spark, rows):
    cols = ["irony_ft_prob", "irony_ft_pred", "sent_neg_prob", "sent_neu_prob", "sent_pos_prob", "sent_pred",
            "trust_ft_prob", "trust_ft_pred"]
    return spark.createDataFrame(rows, "comment_id string, text string, " + ", ".join(
        f"{c} {'int' if c.endswith('pred') else 'double'}" for c in cols))


def test_hybrid_merge_by_id(spark):
    base = _preds(spark, [("1", "t1", 0.1, 0, 0.2, 0.3, 0.5, 1, 0.9, 1), ("2", "t2", 0.2, 0, 0.3, 0.3, 0.4, 1, 0.1, 0)])
    spec = _preds(spark, [("2", "x", 0.8, 1, 0.6, 0.2, 0.2, -1, 0.0, 0), ("3", "x", 0.9, 1, 0.1, 0.1, 0.8, 1, 0.0, 0)])
    got = {r.comment_id: r for r in hy.hybrid_merge(base, spec, labels=["irony", "trust"]).collect()}
    assert set(got) == {"1", "2"}                                  # extra specialist row ignored
    assert (got["2"].irony_ft_pred, got["2"].sent_pred, got["2"].trust_ft_prob, got["2"].text) == (1, -1, 0.1, "t2")
    assert got["1"].irony_ft_prob is None and got["1"].trust_ft_pred == 1   # missing: base labels kept
    dup = spec.unionByName(spec.filter("comment_id = '2'"))
    with pytest.raises(Exception):
        hy.hybrid_merge(base, dup, labels=["irony", "trust"]).collect()
    joined = hy.pred_join(base, spec)
    assert joined.count() == 1 and "irony_ft_prob_base" in joined.columns and "irony_ft_prob_irony" in joined.columns
    with pytest.raises(ContractError):
        hy.check_label_lists(["a", "b"], ["b", "a"])


def test_publication_is_aggregate_only(spark):
    df = spark.createDataFrame([("1", 2010, 1, -1), ("2", 2010, 0, 1), ("3", 2011, 1, 0)],
                               "comment_id string, year int, a_ft_pred int, sent_pred int")
    pub = pb.public_view(df, ["a"])
    assert "comment_id" not in pub.columns
    got = {r.year: (r.n_comments, r.n_a) for r in pub.collect()}
    assert got == {2010: (2, 1), 2011: (1, 1)}
    rates = pb.yearly_rates(df, ["a"]).collect()
    assert [r.year for r in rates] == [2010, 2011] and rates[0].a_rate == 0.5 and rates[0].sent_neg_rate == 0.5
    with pytest.raises(pb.PublicationError):
        pb.assert_public(df)
    assert df.select(F.lit(1)).count() == 3


def _comments(spark):
    return spark.createDataFrame([("c1", "v1", 2011, "hello", 1), ("c2", "v1", 2011, "more", 0), ("c3", "v2", 2012, "text", 1)],
                                 "comment_id string, video_id string, year int, text string, irony_ft_pred int")


REFUSED = {
    "renamed": lambda d: d.select("year", F.col("comment_id").alias("n")),
    "derived": lambda d: d.groupBy("year", F.md5("comment_id").alias("h")).count(),
    "twice": lambda d: d.select("year", F.concat("video_id", F.lit("-")).alias("a")).select("year", F.upper("a").alias("b")),
    "minimum": lambda d: d.groupBy("year").agg(F.min("text").alias("m")),
    "collected": lambda d: d.groupBy("year").agg(F.collect_list("comment_id").alias("n")),
    "first by": lambda d: d.groupBy("year").agg(F.max_by("comment_id", "irony_ft_pred").alias("n")),
    "joined": lambda d: d.groupBy("year").count().join(d.select("year", F.col("video_id").alias("v")), "year"),
    "union": lambda d: d.select("year", F.lit("x").alias("k")).unionByName(d.select("year", F.col("text").alias("k"))),
    "window": lambda d: d.selectExpr("year", "first(text) OVER (PARTITION BY year ORDER BY irony_ft_pred) AS w"),
    "exploded": lambda d: d.select("year", F.explode(F.split("text", "l")).alias("part")),
    "subquery": lambda d: d.sparkSession.sql("SELECT year, (SELECT max(text) FROM {d}) AS s FROM {d}", d=d),
    "struct": lambda d: d.select("year", F.struct("comment_id", "year").alias("s")).select("year", F.col("s.comment_id").alias("i")),
    "python": lambda d: d.mapInPandas(lambda it: it, d.schema).select("year", F.col("irony_ft_pred").alias("n")),
}


@pytest.mark.parametrize("how", list(REFUSED))
def test_sensitive_columns_are_refused_by_lineage(spark, how):
    with pytest.raises(pb.PublicationError, match="show"):
        pb.assert_public(REFUSED[how](_comments(spark)))


def test_aggregates_of_sensitive_columns_are_public(spark):
    d = _comments(spark)
    ok = d.groupBy("year").agg(F.count("comment_id").alias("n"), F.countDistinct("video_id").alias("videos"), F.avg(F.length("text")).alias("mean_length"), F.count_if(F.col("text").contains("o")).alias("with_o"),
                               F.expr("count(*) FILTER (WHERE text LIKE '%e%')").alias("with_e"))
    assert pb.assert_public(ok) is ok
    staged = d.select("year", "irony_ft_pred").withColumn("n", F.lit(1)).groupBy("year").agg(F.sum("n").alias("n"))
    assert pb.assert_public(staged.unionByName(staged)).count() == 4
    from tenor.operators.lineage import sources
    assert {s.column for s in sources(ok)["mean_length"]} == {"text"} and all(s.aggregated for s in sources(ok)["mean_length"])


def test_small_cells(spark):
    d = spark.createDataFrame([(2010, 100, 5, 0, 97), (2011, 9, 9, 0, 1), (2012, 10, 10, 0, 9), (2013, 50, 10, 40, 41)], "year int, n long, a long, b long, c long")
    got = {r.year: (r.a, r.b, r.c) for r in pb.suppress_small_cells(d, "n", ["a", "b", "c"], least=10).collect()}
    assert got == {2010: (None, 0, None), 2012: (10, 0, None), 2013: (10, 40, None)}
