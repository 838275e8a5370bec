"""Letters, cleaning, title prefix, keyword flags, term counts (P5, U5, P7, P8,
P9, P11, A2, P3) against plain-Python versions of the reference rules."""

import re

from pyspark.sql import functions as F

from tenor.functions.text import (DISTRUST_TERMS, TRUST_TERMS, clean_text, has_letter, is_music_video,
                                  with_title_prefix)
from tenor.operators import lexicon as lx
from tenor.operators import text as tx

LETTER_ROWS = ["", None, "123 !!", "___", "a1", "é", "½", "😀😀", "ok"]


def py_has_letter(t):
    return t is not None and re.search(r"[^\W\d_]", t) is not None


def py_clean(t):
    t = "" if t is None else t
    t = t.lower()
    t = re.sub(r"https?://\S+|www\.\S+", " ", t)
    t = re.sub(r"@\w+", " ", t)
    return re.sub(r"\s+", " ", t).strip()


def test_letters_split_is_a_partition(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(LETTER_ROWS)], "id int, text string")
    kept, removed = tx.split_letters(df)
    k = {r.id for r in kept.collect()}
    r = {r.id for r in removed.collect()}
    assert k | r == set(range(len(LETTER_ROWS))) and not (k & r)
    assert k == {i for i, t in enumerate(LETTER_ROWS) if py_has_letter(t)}


CLEAN_ROWS = ["HTTP://X.y z", "www.a b", "@Åsa hi", "a  b", None, "  Mixed   CASE\tand\nlines ",
              "see https://t.co/x?y=1, ok", "mail me@home.org now", " lead", "x\x1cy", "a\x85b"]


def test_clean_text_matches_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CLEAN_ROWS)], "id int, text string")
    got = {r.id: r.c for r in df.select("id", clean_text("text").alias("c")).collect()}
    assert got == {i: py_clean(t) for i, t in enumerate(CLEAN_ROWS)}


def test_title_prefix_only_for_non_blank_titles(spark):
    rows = [(0, "hi", "My Title"), (1, "hi", "   "), (2, "hi", None), (3, "hi", " Spaced ")]
    df = spark.createDataFrame(rows, "id int, text string, title string")
    got = {r.id: r.p for r in df.select("id", with_title_prefix("text", "title").alias("p")).collect()}
    assert got == {0: "[Video title: My Title] hi", 1: "hi", 2: "hi", 3: "[Video title:  Spaced ] hi"}


def test_flags_are_substring_matches(spark):
    rows = [(0, "I distrust them"), (1, "families"), (2, "Don't trust"), (3, "don’t trust"), (4, None),
            (5, "LIESliesx"), (6, "nothing here")]
    df = lx.add_flags(spark.createDataFrame(rows, "id int, text string"))
    got = {r.id: (r.is_distrust, r.is_trust, r.text_lower) for r in df.collect()}
    for i, t in rows:
        low = (t or "").lower()
        assert got[i] == (any(k in low for k in DISTRUST_TERMS), any(k in low for k in TRUST_TERMS), low)
    assert got[0][1] is True      # 'trust' inside 'distrust'
    assert got[1][0] is True      # 'lies' inside 'families'


def test_term_counts_non_overlapping_and_zero_kept(spark):
    rows = [("aaa",), ("aa aa",), ("",), (None,)]
    df = spark.createDataFrame(rows, "text_lower string")
    terms = ["aa", "lies", "a"]
    got = [(r.term_no, r.term, r["count"]) for r in tx.term_counts(df, terms).orderBy("term_no").collect()]
    expect = [(i, t, sum((x or "").count(t) for (x,) in rows)) for i, t in enumerate(terms)]
    assert got == expect


def test_music_filter(spark):
    rows = [("a", "Song (Official Music Video)", None, "x"), ("b", "news", "great REMIX", "y"),
            ("c", "news", "", "SomeVEVO"), ("d", "news", "talk", "chan")]
    df = spark.createDataFrame(rows, "video_id string, title string, description string, channel_title string")
    got = {r.video_id: r.m for r in df.select("video_id", is_music_video("title", "description", "channel_title")
                                               .alias("m")).collect()}
    assert got == {"a": True, "b": True, "c": True, "d": False}
    assert [r.video_id for r in tx.exclude_music(df).collect()] == ["d"]


def test_fill_defaults(spark):
    df = spark.createDataFrame([(None, None, None, None)], "text string, video_title string, irony int, sentiment int")
    r = tx.fill_defaults(df, labels=["irony"]).collect()[0]
    assert (r.text, r.video_title, r.irony, r.sentiment) == ("", "", 0, 0)


def test_has_letter_null_is_false(spark):
    df = spark.createDataFrame([(None,)], "text string")
    assert df.select(has_letter("text").alias("h")).collect()[0].h is False
    assert df.select(F.lit(1)).count() == 1
