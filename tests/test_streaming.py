"""The streaming ingest on landed files, driven to completion with the in-process memory sink."""

import json
import os

from tenor.streaming.ingest import comment_stream, yearly_counts


def test_stream_dedups_filters_and_counts(spark, tmp):
    land = os.path.join(tmp, "land")
    os.makedirs(land)
    rows = [{"comment_id": "a", "text": "I trust it", "published_at": "2010-03-01T00:00:00Z"},
            {"comment_id": "a", "text": "I trust it", "published_at": "2010-03-01T00:00:00Z"},
            {"comment_id": "b", "text": "123 !!", "published_at": "2010-03-02T00:00:00Z"},
            {"comment_id": "c", "text": "fake", "published_at": "2010-03-03T00:00:00Z"}]
    with open(os.path.join(land, "comments_2010.ndjson"), "w") as fh:
        fh.write("\n".join(json.dumps(r) for r in rows) + "\n")
    q = (yearly_counts(comment_stream(spark, land)).writeStream.outputMode("complete").format("memory")
         .queryName("tenor_counts").option("checkpointLocation", os.path.join(tmp, "ckpt")).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    r = spark.sql("SELECT * FROM tenor_counts").collect()
    assert [(x.year, x.comments, x.distrust_count, x.trust_count) for x in r] == [(2010, 2, 1, 1)]


def test_ingest_writes_per_year_files_once(spark, tmp):
    from tenor.streaming.ingest import start_ingest
    land = os.path.join(tmp, "land2")
    os.makedirs(land)
    rows = [{"comment_id": "a", "text": "hello", "published_at": "2011-03-01T00:00:00Z"},
            {"comment_id": "a", "text": "hello", "published_at": "2011-03-01T00:00:00Z"},
            {"comment_id": "b", "text": "!!", "published_at": "2011-03-02T00:00:00Z"}]
    with open(os.path.join(land, "comments_2011.ndjson"), "w") as fh:
        fh.write("\n".join(json.dumps(r) for r in rows) + "\n")
    out, ckpt = os.path.join(tmp, "out"), os.path.join(tmp, "ckpt2")
    start_ingest(spark, land, out, ckpt, available_now=True).awaitTermination(120)
    start_ingest(spark, land, out, ckpt, available_now=True).awaitTermination(120)   # rerun: nothing new
    got = spark.read.json(out).collect()
    assert [(r.comment_id, r.year, r.is_trust) for r in got] == [("a", 2011, False)]


def test_older_years_that_land_later_are_kept(spark, tmp):
    from tenor.streaming.ingest import start_ingest
    land, out, ckpt = (os.path.join(tmp, x) for x in ("land3", "out3", "ckpt3"))
    os.makedirs(land)
    for year in (2012, 2010, 2013):
        with open(os.path.join(land, f"comments_{year}.ndjson"), "w") as fh:
            fh.write(json.dumps({"comment_id": f"c{year}", "text": "hello", "published_at": f"{year}-03-01T00:00:00Z"}) + "\n")
        start_ingest(spark, land, out, ckpt, available_now=True).awaitTermination(120)
    assert sorted(r.year for r in spark.read.json(out).collect()) == [2010, 2012, 2013]
