"""Sources and sinks: round trips (S1, S2, S6, S7, U1, K1-K5) and page flattening."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tenor.sources import pages as pg
from tenor.sources import readers as rd
from tenor.sources import sinks as sk


def _ndjson(path, rows):
    with open(path, "w", encoding="utf-8") as fh:
        for r in rows:
            fh.write(json.dumps(r, ensure_ascii=False) + "\n")


def test_read_comments_year_from_file_and_dedup(spark, tmp):
    _ndjson(os.path.join(tmp, "comments_2010.ndjson"), [{"comment_id": "a", "text": "é ok"}])
    _ndjson(os.path.join(tmp, "comments_2011.ndjson"), [{"comment_id": "b", "text": "x"}, {"comment_id": "c"}])
    df = rd.read_comments(spark, [os.path.join(tmp, "comments_*.ndjson"), os.path.join(tmp, "comments_*.ndjson")])
    got = sorted((r.comment_id, r.year, r.text) for r in df.collect())
    assert got == [("a", 2010, "é ok"), ("b", 2011, "x"), ("c", 2011, None)]
    _ndjson(os.path.join(tmp, "comments_x.ndjson"), [{"comment_id": "d"}])
    with pytest.raises(Exception):
        rd.read_comments(spark, os.path.join(tmp, "comments_x.ndjson")).collect()


def test_csv_round_trip_keeps_text(spark, tmp):
    rows = [("1", "line one\nline two", "  padded  "), ("2", 'say "hi", ok', "back\\slash"), ("3", None, "")]
    df = spark.createDataFrame(rows, "comment_id string, text string, video_title string")
    out = os.path.join(tmp, "csv")
    sk.write_csv(df, out)
    back = rd.read_labelled_csv(spark, out, schema=df.schema)
    got = sorted((r.comment_id, r.text, r.video_title) for r in back.collect())
    assert got[0] == rows[0] and got[1] == rows[1]
    assert got[2][1] is None                 # '' and missing both read back as null, as read_csv does


def test_ndjson_sink_keeps_nulls_per_year(spark, tmp):
    df = spark.createDataFrame([("a", None, 2010), ("b", "ü", 2011)], "comment_id string, text string, year int")
    out = os.path.join(tmp, "nd")
    sk.write_ndjson_by_year(df, out)
    assert sorted(f for f in os.listdir(out) if f.startswith("year=")) == ["year=2010", "year=2011"]
    files = [f for f in os.listdir(os.path.join(out, "year=2010")) if f.endswith(".json")]
    line = open(os.path.join(out, "year=2010", files[0]), encoding="utf-8").read()
    assert '"text":null' in line


def _by_year(spark, out):
    return {y: sorted(r.comment_id for r in g) for y, g in
            {y: [r for r in spark.read.json(out).collect() if r.year == y] for y in (2011, 2012, 2013)}.items()}


def test_ndjson_sink_keeps_other_years(spark, tmp):
    """Reruns replace their own years only; years without rows are emptied if the run names them."""
    out = os.path.join(tmp, "years")
    rows = lambda year, *ids: spark.createDataFrame([(i, None, year) for i in ids], "comment_id string, text string, year int")
    sk.write_ndjson_by_year(rows(2011, "a", "b"), out)
    sk.write_ndjson_by_year(rows(2012, "c"), out)
    assert _by_year(spark, out) == {2011: ["a", "b"], 2012: ["c"], 2013: []}
    last = sk.write_ndjson_by_year(rows(2011, "d").union(rows(2013, "e")), out, years=[2011, 2013])
    assert _by_year(spark, out) == {2011: ["d"], 2012: ["c"], 2013: ["e"]}
    commits = {r.year: r for r in sk.year_commits(spark, out).collect()}
    assert {y for y, r in commits.items() if r.run == last} == {2011, 2013} and all(r.n_files and r.n_bytes for r in commits.values())
    sk.write_ndjson_by_year(rows(2011, "f"), out, years=[2011, 2013])
    assert _by_year(spark, out) == {2011: ["f"], 2012: ["c"], 2013: []} and sk.uncommitted_years(spark, out) == []
    assert {r.year: r.n_files > 0 for r in sk.year_commits(spark, out).collect()} == {2011: True, 2012: True, 2013: False}


def test_failed_year_leaves_the_old_one(spark, tmp):
    out = os.path.join(tmp, "years")
    good = spark.createDataFrame([("a", 2011), ("b", 2012)], "comment_id string, year int")
    sk.write_ndjson_by_year(good, out)
    before = [tuple(r) for r in sk.year_commits(spark, out).orderBy("year").collect()]
    bad = spark.range(100).select(F.when(F.col("id") < 99, F.col("id").cast("string")).otherwise(F.raise_error(F.lit("broken row"))).alias("comment_id"), F.lit(2011).alias("year"))
    with pytest.raises(Exception, match="broken row"):
        sk.write_ndjson_by_year(bad.repartition(4), out)
    assert _by_year(spark, out) == {2011: ["a"], 2012: ["b"], 2013: []}
    assert [tuple(r) for r in sk.year_commits(spark, out).orderBy("year").collect()] == before
    # A run that dies between its commit and its record is seen, and mended by a rerun.
    good.filter("year = 2012").withColumn("comment_id", F.lit("z")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").json(out)
    assert sk.uncommitted_years(spark, out) == ["2012"]
    sk.write_ndjson_by_year(good.filter("year = 2012"), out)
    assert sk.uncommitted_years(spark, out) == []


def test_label_config_and_ids(spark, tmp):
    cfg = {"label_names": ["a", "b"], "thresholds": [0.05, 0.2], "preprocessing": {"use_title_prefix": True,
                                                                                   "clean_like_old": True}}
    p = os.path.join(tmp, "label_config.json")
    open(p, "w").write(json.dumps(cfg, indent=2))
    got = [(r.pos, r.label, r.threshold) for r in rd.read_label_config(spark, p).orderBy("pos").collect()]
    assert got == [(0, "a", 0.05), (1, "b", 0.2)]
    cfg.pop("thresholds")
    open(p, "w").write(json.dumps(cfg, indent=2))
    assert [r.threshold for r in rd.read_label_config(spark, p).collect()] == [0.5, 0.5]
    assert rd.read_config_scalars(spark, p).collect()[0].max_length == 320
    ids = os.path.join(tmp, "test_ids.txt")
    open(ids, "w").write(" 1 \n\n2\n   \n")
    assert sorted(r.comment_id for r in rd.read_ids(spark, ids).collect()) == ["1", "2"]


def test_split_ids_and_report_and_record_sinks(spark, tmp):
    df = spark.createDataFrame([("1", "train"), ("2", "test")], "comment_id string, split string")
    sk.write_split_ids(df, os.path.join(tmp, "ids"))
    assert sorted(f for f in os.listdir(os.path.join(tmp, "ids")) if f.startswith("split=")) == ["split=test",
                                                                                              "split=train"]
    rep = spark.createDataFrame([(1, "b", 0.5), (0, "a", 1.0)], "row_no int, label string, f1 double")
    sk.write_report(rep, os.path.join(tmp, "rep"))
    back = spark.read.option("header", True).csv(os.path.join(tmp, "rep")).collect()
    assert [r.label for r in back] == ["a", "b"]
    sk.write_json_record(spark.createDataFrame([(0.5, None)], "ml_f1_micro double, x double"), os.path.join(tmp, "m"))
    files = [f for f in os.listdir(os.path.join(tmp, "m")) if f.endswith(".json")]
    assert len(files) == 1 and '"x":null' in open(os.path.join(tmp, "m", files[0])).read()


def test_page_flattening(spark):
    comment_item = "struct<snippet:struct<topLevelComment:struct<id:string,snippet:struct<publishedAt:string,textDisplay:string>>>>"
    pages = spark.createDataFrame(
        [("v1", 0, [{"snippet": {"topLevelComment": {"id": "c1", "snippet": {"publishedAt": None, "textDisplay": "a"}}}},
                    {"snippet": {"topLevelComment": {"id": "c2", "snippet": {"publishedAt": "2011-01-01T00:00:00Z",
                                                                             "textDisplay": "b"}}}}])],
        f"video_id string, page int, items array<{comment_item}>")
    got = [tuple(r) for r in pg.flatten_comment_pages(pages).orderBy("pos").collect()]
    assert got == [("v1", 0, 0, "c1", "", "a"), ("v1", 0, 1, "c2", "2011-01-01T00:00:00Z", "b")]
    vp = spark.createDataFrame([([{"id": "v1", "snippet": {"title": "T", "description": None, "channelTitle": "C",
                                                           "publishedAt": "2011"}}],)],
                               "items array<struct<id:string,snippet:struct<title:string,description:string,"
                               "channelTitle:string,publishedAt:string>>>")
    assert [tuple(r) for r in pg.flatten_video_pages(vp).collect()] == [("v1", "T", "", "C", "2011")]
    sp = spark.createDataFrame([("news", "date", 0, [{"id": {"videoId": "x"}}, {"id": {"videoId": "y"}}])],
                               "term string, ord string, page int, items array<struct<id:struct<videoId:string>>>")
    assert [r.video_id for r in pg.flatten_search_pages(sp).orderBy("pos").collect()] == ["x", "y"]
    assert sp.select(F.lit(1)).count() == 1


def test_overlapping_patterns_read_a_file_once(spark, tmp):
    _ndjson(os.path.join(tmp, "comments_2012.ndjson"), [{"comment_id": "z"}])
    df = rd.read_comments(spark, [os.path.join(tmp, "comments_*.ndjson"), os.path.join(tmp, "comments_2012.ndjson")])
    assert [(r.comment_id, r.year) for r in df.collect()] == [("z", 2012)]
    assert rd.read_comments(spark, os.path.join(tmp, "nothing_*.ndjson")).count() == 0
