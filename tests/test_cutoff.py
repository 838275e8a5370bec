"""Cut-off selection against a plain sort: hot groups, equal and null orders, all kinds of numbers and texts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tenor.operators import cutoff as ct
from tenor.operators import lexicon as lx

SCHEMA = "g string, d string, v double, k long, id string"


def table(seed, n=2000):
    rnd = random.Random(seed)
    numbers = [0.0, -1.5, 2.0, math.inf, -math.inf, math.nan, None, 1e300, -1e-300]
    rows = []
    for i in range(n):
        g = rnd.choice(["hot"] * 20 + ["warm"] * 4 + ["a", "b", None])
        d = rnd.choice([None, "", "2010", f"2010-0{rnd.randrange(1, 9)}-1{rnd.randrange(9)}T0{rnd.randrange(9)}:00:00Z", "2010-05-05T00:00:00Z"])
        v = rnd.choice(numbers) if rnd.random() < 0.3 else rnd.gauss(0, 10 ** rnd.randrange(-3, 6))
        k = None if rnd.random() < 0.05 else rnd.choice([rnd.randrange(5), rnd.randrange(-2 ** 50, 2 ** 50)])
        rows.append((g, d, v, k, f"{rnd.choice(['', 'x', 'é'])}{i:05d}"))
    return rows


def number(x, descending):
    """Ascending sort key of a number: NaN is the largest; nulls last when descending, else first."""
    if x is None:
        return (3 if descending else 0, 0.0)
    if math.isnan(x):
        return (1 if descending else 2, 0.0)
    return (2, -x) if descending else (1, x)


ORDERS = {
    "date then id": ([ct.Key("d", nulls_last=True, steps=ct.DATE_STEPS), "id"], lambda r: ((r[1] is None, (r[1] or "").encode()), r[4].encode())),
    "number falling": ([ct.Key("v", descending=True), "id"], lambda r: (number(r[2], True), r[4].encode())),
    "number rising": (["v", "id"], lambda r: (number(r[2], False), r[4].encode())),
    "long, date, id": (["k", ct.Key("d"), "id"], lambda r: (number(r[3], False), (r[1] is not None, (r[1] or "").encode()), r[4].encode())),
}


@pytest.mark.parametrize("order,n,slack", [("date then id", 7, 0), ("number falling", 7, 3), ("number rising", 150, 20), ("long, date, id", 150, 20)])
def test_equals_a_plain_sort(spark, order, n, slack):
    rows = table(len(order) + n)
    keys, plain = ORDERS[order]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {}
    for r in ct.first_n_by_cutoff(df, ["g"], keys, n, rank_col="rn", slack=slack).collect():
        got.setdefault(r.g, {})[r.rn] = r.id
    for g in {r[0] for r in rows}:
        want = [r[4] for r in sorted((r for r in rows if r[0] == g), key=plain)[:n]]
        assert [got[g][i + 1] for i in range(len(want))] == want and len(got[g]) == len(want), g
    survivors = ct.within_cutoff(df, ["g"], keys, n, slack)
    assert survivors.columns == df.columns
    assert max(r["count"] for r in survivors.groupBy("g").count().collect()) <= n + slack


def test_rows_equal_in_the_whole_order(spark):
    """Thousands of equal rows at the boundary: exactly n are kept."""
    df = spark.range(5000).select(F.lit("g").alias("g"), F.when(F.col("id") < 10, "a").otherwise("b").alias("id"))
    got = ct.first_n_by_cutoff(df, ["g"], ["id"], 40).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {"a": 10, "b": 30}
    assert ct.first_n_by_cutoff(df.limit(0), ["g"], ["id"], 40).collect() == []
    numbers = df.select("g", F.lit(1).alias("one"), F.when(F.col("id") == "a", 1.0).otherwise(2.0).alias("v"))
    got = ct.first_n_by_cutoff(numbers, ["g"], ["one", "v", "one"], 40).groupBy("v").count().collect()
    assert {r["v"]: r["count"] for r in got} == {1.0: 10, 2.0: 30}


def test_several_group_columns_and_small_groups(spark):
    df = spark.range(2000).select((F.col("id") % 2).alias("y"), F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("t"), (F.col("id") * 7919 % 2003).alias("p"))
    got = sorted((r.y, -1 if r.t is None else r.t, r.p) for r in ct.first_n_by_cutoff(df, ["y", "t"], ["p"], 3, slack=1).collect())
    want = {}
    for r in df.collect():
        want.setdefault((r.y, -1 if r.t is None else r.t), []).append(r.p)
    assert got == sorted((y, t, p) for (y, t), ps in want.items() for p in sorted(ps)[:3])


def test_no_window_over_unfiltered_rows(spark):
    """Yearly cap and sample: below their windows stands the cut-off's filter, and the text crosses no exchange before it."""
    df = spark.createDataFrame([(f"{i:04d}", 2010 + (i % 7 == 0), None if i % 5 == 0 else f"2010-0{1 + i % 9}-01T00:00:00Z", "word " * 3) for i in range(2000)], "comment_id string, year int, published_at string, text string")
    for capped, want in ((lx.cap_per_year(df, 50), 100), (lx.review_sample(df, 50), 100)):
        plan = capped._jdf.queryExecution().optimizedPlan().toString()
        above, _, below = plan.partition("Window [")
        assert "__cut_h0" in below and "Filter" in below and "Window [" not in below
        assert capped.count() == want and "text" in capped.columns


def test_yearly_cap_with_a_hot_year_equal_and_null_dates(spark):
    rnd = random.Random(4)
    rows = [(f"c{rnd.randrange(10 ** 6)}-{i}", 2011 if rnd.random() < 0.9 else rnd.choice([2012, 2013]), rnd.choice([None, "2011-03-01T00:00:00Z", f"2011-03-0{rnd.randrange(1, 9)}T00:00:0{rnd.randrange(9)}Z"])) for i in range(4000)]
    df = spark.createDataFrame(rows, "comment_id string, year int, published_at string")
    got = sorted((r.year, r.comment_id) for r in lx.cap_per_year(df, 300).collect())
    want = [(y, r[0]) for y in (2011, 2012, 2013) for r in sorted((r for r in rows if r[1] == y), key=lambda r: (r[2] is None, r[2] or "", r[0]))[:300]]
    assert got == sorted(want)
    sample = sorted(r.comment_id for r in lx.review_sample(df, 200, seed=7).filter("year = 2011").collect())
    import hashlib
    hot = [r[0] for r in rows if r[1] == 2011]
    assert sample == sorted(sorted(hot, key=lambda i: (hashlib.md5(f"{i}:7".encode()).hexdigest(), i))[:200])
