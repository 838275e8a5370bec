"""Keyword lists as tables against plain substring search."""

import random

import pytest

from tenor.operators import keywords as kw

TERMS = [("a", "lie"), ("a", "aa"), ("b", "aa"), ("b", "x"), ("b", "don't trust"), ("a", "don’t"), ("c", "nowhere"), ("c", ""), ("c", None), ("a", "lie"), ("b", "é\n漢"), ("a", "aaa"), ("c", ".*")]
TEXTS = [("1", "they lie, lie and lie"), ("2", "aaaa aa"), ("2", "x don't trust don’t"), (None, "é\n漢\U0001F600x"), ("3", None), ("4", ""), ("5", "a b c"), ("2", "aaaa aa"), ("6", "l.*ie aaa" * 500)]


def plain(texts, terms):
    lists = {}
    for name, t in terms:
        if t:
            lists.setdefault(t, set()).add(name)
    counts = sorted((name, t, sum((x or "").count(t) for _, x in texts), sum(t in (x or "") for _, x in texts)) for t, names in lists.items() for name in names)
    by_list = []
    for k, x in set(texts):
        for name in {n for ns in lists.values() for n in ns}:
            held = [(x or "").count(t) for t, ns in lists.items() if name in ns and t in (x or "")]
            if held:
                by_list.append((str(k), name, len(held), sum(held)))
    return counts, sorted(by_list)


def run(spark, texts, terms):
    t = spark.createDataFrame(texts, "comment_id string, text_lower string")
    names = spark.createDataFrame(terms, "list string, term string")
    counts = sorted(tuple(r) for r in kw.keyword_counts(t, names).collect())
    return counts, sorted((str(r.comment_id), r.list, r.n_terms, r.n_hits) for r in kw.keyword_lists(t, names).collect())


@pytest.mark.parametrize("in_plan", [20_000, 0])
def test_edge_terms(spark, monkeypatch, in_plan):
    monkeypatch.setattr(kw, "ANCHORS_IN_PLAN", in_plan)
    assert run(spark, TEXTS, TERMS) == plain(TEXTS, TERMS)


def test_random_lists(spark):
    """Thousands of terms over few letters, so that they overlap and hold each other."""
    rnd = random.Random(8)
    word = lambda most: "".join(rnd.choice("abcd ") for _ in range(rnd.randrange(1, most)))
    terms = [(rnd.choice("xyz"), word(9)) for _ in range(3000)]
    texts = [(str(i), word(120)) for i in range(40)]
    assert run(spark, texts, terms) == plain(texts, terms)


def test_no_terms(spark):
    assert run(spark, TEXTS, [("a", "")]) == ([], [])


def test_text_is_not_shuffled(spark):
    t, names = spark.createDataFrame(TEXTS, "comment_id string, text_lower string"), spark.createDataFrame(TERMS, "list string, term string")
    plan = kw.found_terms(t, kw.term_anchors(names, t, "text_lower"), "text_lower", ["comment_id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_windows_are_looked_up_once(spark):
    """The lookup stands once in the plan: neither repeated by a filter of its own, nor done by a pattern per offset."""
    t, names = spark.createDataFrame(TEXTS, "comment_id string, text_lower string"), spark.createDataFrame(TERMS, "list string, term string")
    plan = kw.found_terms(t, kw.term_anchors(names, t, "text_lower"), "text_lower", ["comment_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan


@pytest.mark.parametrize("at_once", [1, 40, 1 << 17])
def test_windows_of_many_sizes(spark, monkeypatch, at_once):
    """Terms up to, at and beyond the bytes of a key, some that overlap themselves, in letters of one to four bytes."""
    monkeypatch.setattr(kw, "AT_ONCE", at_once)
    rnd = random.Random(3)
    word = lambda most: "".join(rnd.choice("aab é漢\U0001F600") for _ in range(rnd.randrange(1, most)))
    terms = [("x", "a" * n) for n in range(1, 10)] + [("y", "abaaba"), ("y", "abaabaa"), ("y", "漢漢"), ("y", "漢\U0001F600"), ("y", "\U0001F600" * 2)] + [("z", word(12)) for _ in range(60)]
    texts = [(str(i), word(90)) for i in range(30)] + [("s", "a" * 200), ("t", "abaabaaba" * 9), ("u", "漢" * 31), ("v", None), ("w", ""), ("w", "é")]
    assert run(spark, texts, terms) == plain(texts, terms)
