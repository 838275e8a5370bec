"""Hashed windows (W8 for the classifier) on the bytes of Arrow batches, against Spark's own words, hash and windows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tenor.functions import text as tx
from tenor.operators import classifier as clf
from tenor.operators import joint as jt
from tenor.operators import model as md
from tenor.operators import terms as tm
from tenor.operators.text import add_text_proc

SPACES = [*map(chr, (0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)), "  ", " \n ",
          *map(chr, (0x7F, 0x80, 0x180E, 0x200B, 0xFEFF))]   # the last five are none
WORDS = ["a", "Abc", "straße", "ÉCOLE", "日本語", "\U0001F600", "https://x.y/z", "www.foo.bar", "WWW.x", "http:/no", "@user_1", "e@mail.com", "@",
         "x" * 300, "é" * 200, "don’t", "ΑΣ", "İstanbul", "1234", "12345678", "abcdefghijkl", "://", "y" * 256, "z" * 257, "q" * 1025]


def texts(seed=3):
    r = random.Random(seed)
    some = ["".join(r.choice(WORDS) + r.choice(SPACES) * r.randint(0, 2) for _ in range(r.randint(0, 60))) for _ in range(150)]
    long = [" ".join(r.choice(WORDS) for _ in range(n)) for n in (317, 318, 319, 476, 477, 634, 1000)]
    return ["", " ", None, "\u3000", "www.", "@a", "a", *some, *long]


def frame(spark):
    titles = [None, "", " ", "Titel  mit\tTab", "t"]
    return spark.createDataFrame([(None if k % 9 == 0 else str(k % 50), t, titles[k % 5], k) for k, t in enumerate(texts())],
                                 "comment_id string, text string, video_title string, row int")


def rows(df):
    return sorted(((r.row, r.window_no, r.n_windows, r.comment_id, r.terms) for r in df.collect()), key=lambda x: x[:2])


@pytest.mark.parametrize("preset", sorted(clf.PRESETS))
@pytest.mark.parametrize("features, slide, clean", [(1 << 14, True, True), (1000, False, False)])
def test_windows_of_numbers_are_those_of_words(spark, monkeypatch, preset, features, slide, clean):
    """Every kind of space, words of any length, empty and null texts, repeated and null keys; pieces of any size."""
    monkeypatch.setattr(tm, "AT_ONCE", 500)
    df = frame(spark)
    words = md.token_windows(add_text_proc(df, clean_like_old=clean), "comment_id", slide=slide, keep=["row"])
    want = rows(words.withColumn("terms", clf.hashed_terms("tokens", preset, features)))
    got = rows(clf._windows(df, "comment_id", ["row"], {"preset": preset, "num_features": features, "slide": slide, "clean_like_old": clean}))
    assert got == want and len(want) >= df.count()


def test_hash_is_sparks(spark):
    words = [w for w in {*WORDS, *(chr(c) * n for c in (65, 233, 8364, 128512) for n in range(1, 70))} if w.strip()]
    want = [r[0] for r in spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, w string").coalesce(1).orderBy("k").select(F.hash("w")).collect()]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    assert tm.hashes(data, np.append(0, ends[:-1]), ends).tolist() == want


def test_a_word_is_hashed_once(spark, monkeypatch):
    """Windows overlap by half; words don't: what is hashed follows the text, and neither words nor terms pass the JVM."""
    seen, plain = [], tm.hashes
    monkeypatch.setattr(tm, "hashes", lambda data, starts, ends: seen.append(len(starts)) or plain(data, starts, ends))
    [(_, _, per, _, terms)] = tm.window_terms(pa.array(["w " * 5000]), 318, 158, True, 64, False)
    assert seen == [5000] and per.tolist() == [31] and len(terms.flatten()) > 9000
    shape = jt.Shape(64, 2, len(clf.LABELS))
    model = clf.MultiTaskModel(np.ones(64), shape.start(1), shape, config={"preset": "specialist", "num_features": 64})
    plan = clf.predict(model, frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not any(x in plan for x in ("regexp_extract_all", "Generate", "ArrowEvalPython", "terms"))


def test_cleaning_skips_patterns_that_cannot_match(spark):
    """Guards before the patterns change nothing; without the collapse the words are the same."""
    df = frame(spark).filter("text is not null")
    old = F.lower("text")
    for pattern in (tx.URL, tx.HANDLE, f"{tx.SPACE}+"):
        old = F.regexp_replace(old, pattern, " ")
    r = df.agg(F.count_if(~tx.clean_text("text").eqNullSafe(F.trim(old))), F.count_if(~tx.words(tx.clean_text("text", collapse=False)).eqNullSafe(tx.words(F.trim(old))))).first()
    assert tuple(r) == (0, 0)


def test_vectors_kept_for_the_rounds_are_exact(spark):
    """Counts beyond 16 bits stand in parts; features beyond 16 bits keep 32. The sums are those of the values."""
    feature, counts, ends = np.array([3, 5, 9, 2]), np.array([7, 70_000, 131_070, 1]), np.array([0, 2, 3, 4, 4])
    f, c, e = jt._small(feature, counts, ends)
    assert f.tolist() == [3, 5, 5, 9, 9, 2] and c.tolist() == [7, 65535, 4465, 65535, 65535, 1] and e.tolist() == [0, 3, 5, 6, 6]
    for features in (40, 70_000):
        terms = [[features - 1] * 3 + [1, 2], [], [0, 7, 7]]
        idf = np.linspace(0.1, 2, features)
        df = spark.createDataFrame([(t, [1.0], 0, 0.0, 1.0) for t in terms], jt.TERMS).coalesce(1)
        batch = pa.RecordBatch.from_pandas(jt.vectorised(df, idf).toPandas(), preserve_index=False)
        (feature, value, ends), *_ = jt._read(batch, idf)
        want = jt.sparse_rows([np.array(t) for t in terms], idf)
        assert np.array_equal(feature, want[0]) and np.array_equal(value, want[1]) and np.array_equal(ends, want[2])
