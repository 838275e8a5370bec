"""The jobs end to end on tiny landed files: lexicon job outputs, train ->
predict -> merge -> evaluate."""

import json
import os

from pyspark.sql import functions as F

from tenor.plans import jobs
from tenor.plans import views as V
from tenor.schemas import LABELS
from tenor.sources import sinks as sk


def test_lexicon_job(spark, tmp):
    land = os.path.join(tmp, "land")
    os.makedirs(land)
    rows = {2010: ["good news", "123 !!", "bad lies", "I trust them"], 2011: ["great", None, "fake scam"]}
    for y, texts in rows.items():
        with open(os.path.join(land, f"comments_{y}.ndjson"), "w") as fh:
            for i, t in enumerate(texts):
                fh.write(json.dumps({"comment_id": f"{y}-{i}", "video_id": "v", "text": t,
                                     "published_at": f"{y}-01-0{i + 1}T00:00:00Z"}) + "\n")
    out = os.path.join(tmp, "out")
    summary = {int(r.year): r for r in jobs.lexicon_job(spark, os.path.join(land, "comments_*.ndjson"), out).collect()}
    assert int(summary[2010]["count"]) == 3 and int(summary[2011]["count"]) == 2
    assert int(summary[2010].distrust_count) == 1 and int(summary[2010].trust_count) == 1
    removed = spark.read.json(os.path.join(out, "removed_comments")).collect()
    assert sorted(r.comment_id for r in removed) == ["2010-1", "2011-1"]
    terms = spark.read.option("header", True).csv(os.path.join(out, "distrust_term_counts")).collect()
    assert len(terms) == 13 and {r.term: int(r["count"]) for r in terms}["lies"] == 1


def test_train_predict_merge_evaluate(spark, tmp):
    gold = V.gold(spark, "/root/testdata/sf0.001").drop("doc_id")
    src = os.path.join(tmp, "labelled")
    sk.write_csv(gold, src)
    model = jobs.train_job(spark, src, os.path.join(tmp, "run"), max_iter=5)
    assert len(model.thresholds) == len(LABELS)
    preds = os.path.join(tmp, "pred_base")
    jobs.predict_job(spark, os.path.join(tmp, "run", "model"), src, preds)
    jobs.hybrid_job(spark, preds, preds, os.path.join(tmp, "hybrid"))
    ids = os.path.join(tmp, "run", "split_ids", "split=test")
    m = jobs.evaluate_job(spark, os.path.join(tmp, "hybrid"), ids, os.path.join(tmp, "eval")).collect()[0]
    assert 0.0 <= m.ml_f1_micro <= 1.0 and m.num_test_rows > 0
    assert spark.read.text(os.path.join(tmp, "run", "label_config")).count() == 1
    assert gold.select(F.lit(1)).count() > 0


def pages_of(spark, vids, order):
    from tenor.schemas import SEARCH_PAGE, VIDEO_PAGE
    search = spark.createDataFrame(
        [(2015, "2015-01-01T00:00:00Z", "2015-01-21T00:00:00Z", "news", "viewCount", k,
          [{"id": {"videoId": v}} for v in ids]) for k, ids in enumerate(order)], SEARCH_PAGE)
    page = [{"id": v, "snippet": {"title": t, "description": d, "channelTitle": c, "publishedAt": p}} for v, t, d, c, p in vids]
    return search, spark.createDataFrame([(page,), (page[:2],)], VIDEO_PAGE)   # every lookup lands, some twice


def item(cid, pub, text):
    return {"snippet": {"topLevelComment": {"id": cid, "snippet": {"publishedAt": pub, "textDisplay": text}}}}


VIDS = [("v1", "News one", "", "chan", "2015-01-03T00:00:00Z"),
        ("v2", "Song lyrics", "", "chan", "2015-01-04T00:00:00Z"),     # music: excluded
        ("v3", "News three", None, "AVEVO", "2015-01-05T00:00:00Z"),   # vevo channel: excluded
        ("v4", "News four", "", "chan", "2015-01-06T00:00:00.000Z"), ("v5", "No date", "", "chan", "")]
BOUNDS = [(2015, "2015-01-01T00:00:00Z", "2015-01-21T00:00:00Z")]


def test_collect_to_lexicon(spark, tmp):
    """Landed pages -> comments -> the lexicon job reads what collection wrote."""
    from tenor.schemas import COMMENT_PAGE
    search, videos = pages_of(spark, VIDS, [["v5", "v4"], ["v1", "v2", "v3", "v4"]])
    comment_pages = spark.createDataFrame(
        [("v1", 0, [item("c1", "2015-02-01T00:00:00Z", "hello"), item("c2", "2016-01-01T00:00:00Z", "late"),
                    item("c3", "2015-02-02T00:00:00Z", "good good")]),
         ("v4", 0, [item("c1", "2015-02-01T00:00:00Z", "hello"), item("c4", None, "no date")]),
         ("v2", 0, [item("c5", "2015-02-01T00:00:00Z", "music")])], COMMENT_PAGE)
    out = os.path.join(tmp, "collect")
    s = jobs.collect_job(spark, search, videos, comment_pages, BOUNDS, ["news"], out).collect()
    assert [(r.year, r.videos, r.comments) for r in s] == [(2015, 2, 2)]
    got = spark.read.json(os.path.join(out, "comments")).collect()
    # The service answered v4 first, so it is credited with the shared comment.
    assert sorted((r.comment_id, r.video_id, r.video_title) for r in got) == [("c1", "v4", "News four"), ("c3", "v1", "News one")]
    for pattern in ("comments/*", "comments/*/*.json"):
        summary = jobs.lexicon_job(spark, os.path.join(out, pattern), os.path.join(tmp, "lex", pattern[9:].replace("*", "x"))).collect()
        assert [(r.year, r["count"], r.pos_count) for r in summary] == [(2015, 2, 1)]


def test_collect_nothing_and_current_year(spark, tmp):
    from tenor.schemas import COMMENT_PAGE
    search, videos = pages_of(spark, VIDS, [["v1"]])
    none = spark.createDataFrame([], COMMENT_PAGE)
    s = jobs.collect_job(spark, search, videos, none, BOUNDS, ["news"], os.path.join(tmp, "a")).collect()
    assert [(r.year, r.videos, r.comments) for r in s] == [(2015, 1, 0)]
    # The window ends after "now" of the current year, so its pages are not of this run.
    s = jobs.collect_job(spark, search, videos, none, [2015], ["news"], os.path.join(tmp, "b"), now_iso="2015-01-15T00:00:00Z")
    assert s.collect() == []


def test_window_bounds_are_times(spark, tmp):
    """A window at the year's first second is of the year, with fractions of a second or without."""
    from tenor.schemas import COMMENT_PAGE
    search, videos = pages_of(spark, VIDS, [["v1"]])
    search = search.withColumn("window_start", F.lit("2015-01-01T00:00:00.000Z")).withColumn("window_end", F.lit("2015-01-21T00:00:00.000Z"))
    s = jobs.collect_job(spark, search, videos, spark.createDataFrame([], COMMENT_PAGE), BOUNDS, ["news"], os.path.join(tmp, "a")).collect()
    assert [(r.year, r.videos) for r in s] == [(2015, 1)]


def test_collecting_a_year_keeps_the_others(spark, tmp):
    from tenor.schemas import COMMENT_PAGE
    search, videos = pages_of(spark, VIDS, [["v1", "v4"]])
    comments = spark.createDataFrame([("v1", 0, [item("c1", "2015-02-01T00:00:00Z", "hello")])], COMMENT_PAGE)
    out = os.path.join(tmp, "collect")
    jobs.collect_job(spark, search, videos, comments, BOUNDS, ["news"], out)
    jobs.collect_job(spark, search, videos, comments, [2014], ["news"], out, now_iso="2020-01-01T00:00:00Z")
    assert [(r.comment_id, r.year) for r in spark.read.json(os.path.join(out, "comments")).collect()] == [("c1", 2015)]
    # The year is collected again and holds nothing now: its file is empty, as a rewritten one would be.
    jobs.collect_job(spark, search, videos, comments.limit(0), BOUNDS, ["news"], out)
    assert spark.read.schema("comment_id string, year int").json(os.path.join(out, "comments")).count() == 0


def test_broken_line_fails(spark, tmp):
    import pytest
    from tenor.sources import readers as rd
    with open(os.path.join(tmp, "comments_2010.ndjson"), "w") as fh:
        fh.write('{"comment_id": "a", "text": "x"}\n{"comment_id": "b", "te\n')
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        rd.read_comments(spark, os.path.join(tmp, "comments_*.ndjson")).collect()


def test_rows_are_scored_by_row(spark):
    from tenor.operators import lexicon as lx
    rows = [("a", "good good"), ("a", "bad terrible"), (None, "good"), (None, "bad"), ("b", "good"), ("b", "good"), ("c", None), ("d", "great :) \U0001F600 :-(")]
    df = spark.createDataFrame(rows, "comment_id string, text string")
    alone = {}
    for k, (i, t) in enumerate(rows):
        one = spark.createDataFrame([(str(k), t)], "comment_id string, text string")
        alone[k] = lx.score(one, lx.seed_valence(spark), lx.seed_polarity(spark), rules=True, keep=[]).first().vader_compound
    want = sorted((str(i), str(t), round(alone[k], 9)) for k, (i, t) in enumerate(rows))
    got = lx.score(df, lx.seed_valence(spark), lx.seed_polarity(spark), rules=True).collect()
    assert sorted((str(r.comment_id), str(r.text), round(r.vader_compound, 9)) for r in got) == want
    narrow = lx.score(df, lx.seed_valence(spark), lx.seed_polarity(spark), rules=True, keep=[]).collect()
    assert sorted((str(r.comment_id), round(r.vader_compound, 9)) for r in narrow) == sorted((i, s) for i, _, s in want)
    assert alone[7] > alone[4]
    plan = lx.score(df, lx.seed_valence(spark), lx.seed_polarity(spark), rules=True, keep=[])._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION" not in plan


def test_predictions_by_row(spark):
    from tenor.operators import classifier as clf
    gold = V.gold(spark, "/root/testdata/sf0.001")
    model, *_ = clf.train_main(gold, max_iter=3)
    texts = [t.text for t in gold.select("text").limit(2).collect()]
    df = spark.createDataFrame([("x", texts[0], "t"), ("x", texts[1], "t"), (None, texts[0], "t")], "comment_id string, text string, video_title string")
    got = {(r.comment_id, r.text): r.irony_ft_prob for r in clf.predict(model, df).collect()}
    assert len(got) == 3 and got["x", texts[0]] == got[None, texts[0]] != got["x", texts[1]]


def test_row_numbers_follow_the_files(spark, tmp):
    import pytest
    from tenor.operators import labels as lb
    from tenor.operators.hybrid import hybrid_merge  # noqa: F401
    from tenor.sources import readers as rd
    for name, n in (("part-0.csv", 1), ("part-1.csv", 700)):
        with open(os.path.join(tmp, name), "w") as fh:
            fh.write("text,v\n" + "".join(f"{name}:{i},1.0\n" for i in range(n)))
    df, key = lb.ensure_id(rd.read_labelled_csv(spark, tmp, schema=None))
    got = {r.text: r[key] for r in df.collect()}
    assert got["part-0.csv:0"] == "0" and got["part-1.csv:0"] == "1" and got["part-1.csv:699"] == "700" and len(set(got.values())) == 701
    from tenor.functions.numeric import sentiment_to_class, whole_number
    assert {r[0] for r in df.select(whole_number("v")).collect()} == {1}
    with pytest.raises(Exception, match="whole number"):
        spark.createDataFrame([(0.5,)], "s double").select(sentiment_to_class("s")).collect()


def test_hybrid_predict_job(spark, tmp):
    gold = V.gold(spark, "/root/testdata/sf0.001").drop("doc_id", "comment_id")
    src = os.path.join(tmp, "no_ids")
    sk.write_csv(gold, src)
    for preset in ("base", "specialist"):
        jobs.train_job(spark, src, os.path.join(tmp, preset), preset=preset, max_iter=3)
    jobs.hybrid_predict_job(spark, os.path.join(tmp, "base", "model"), os.path.join(tmp, "specialist", "model"), src, os.path.join(tmp, "hy"))
    meta = json.loads(spark.read.text(os.path.join(tmp, "hy_meta")).first()[0])
    assert meta["mode"] == "hybrid" and len(meta["base_thresholds"]) == len(meta["irony_thresholds"]) == len(LABELS)
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(os.path.join(tmp, "hy")).count() == gold.count()
    m = jobs.evaluate_job(spark, os.path.join(tmp, "hy"), os.path.join(tmp, "base", "split_ids", "split=test"), os.path.join(tmp, "ev"),
                          config_path=os.path.join(tmp, "base", "label_config"))
    assert m.first().num_test_rows > 0
    cfg = json.loads(spark.read.text(os.path.join(tmp, "base", "label_config")).first()[0])
    assert {"base_model", "loss_weights", "timestamp"} <= set(cfg)
