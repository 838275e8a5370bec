"""Window tree, window-fill sampling against a plain-Python walk of the
reference loop (D1 applied), comment dedup and caps (P1, P2, J6, W6, W7, U3,
U4, W2, W3, A5, A6, J1)."""

import random

import pytest

from tenor.operators import collect as co

DAY = 86400


def test_full_year_tree_has_511_windows():
    tree = co.window_tree([(2010, "2010-01-01T00:00:00Z", "2010-12-31T23:59:59Z")])
    assert len(tree) == 511 and max(r[1] for r in tree) == 8
    order = sorted(tree, key=lambda r: (r[3], r[1]))
    assert [r[:3] for r in order] == [r[:3] for r in tree]       # (start, level) order == walk order


def test_year_bounds_now_caps_current_year():
    assert co.year_bounds_py(2010, "2024-06-30T12:00:00Z") == ("2010-01-01T00:00:00Z", "2010-12-31T23:59:59Z")
    assert co.year_bounds_py(2024, "2024-06-30T12:00:00Z")[1] == "2024-06-30T12:00:00Z"


def py_walk(hits, eligible, start, end, terms, variant, target, page):
    """The reference's loop with distinct videos."""
    def search(s, e, term, order):
        hs = [h for h in hits if s <= h[1] <= e and h[3] == term]
        key = (lambda h: (-h[2], h[0])) if order == "viewCount" else (lambda h: (-h[1], h[0]))
        return [h[0] for h in sorted(hs, key=key)]

    def fetch(s, e):
        ids = []
        if variant == "general":
            for order in ("viewCount", "date"):
                res, i = search(s, e, terms[0], order), 0
                while len(ids) < target and i < len(res):
                    ids.extend(res[i:i + page])
                    i += page
                if len(ids) >= target:
                    break
            return ids
        for term in terms:
            for order in ("viewCount", "date"):
                ids.extend(search(s, e, term, order))
        return ids[:target]

    cands, seen, windows = [], set(), [(start, end)]
    while windows and len(cands) < target:
        s, e = windows.pop(0)
        valid = [v for v in fetch(s, e) if v not in seen and eligible[v]]
        before = len(cands)
        for v in valid:
            if len(cands) >= target:
                break
            if v in seen:
                continue
            seen.add(v)
            cands.append(v)
        if len(cands) < target and e - s >= 2 * DAY and len(cands) - before < target - before:
            mid = s + (e - s) // 2
            windows[0:0] = [(s, mid), (mid, e)]
    return cands


@pytest.mark.parametrize("variant,seed", [("general", 1), ("general", 2), ("early", 3), ("early", 4)])
def test_window_fill_equals_the_loop(spark, variant, seed):
    rnd = random.Random(seed)
    start_iso, end_iso = "2015-01-01T00:00:00Z", "2015-01-21T00:00:00Z"
    s0, e0 = co._epoch(start_iso), co._epoch(end_iso)
    terms = ["news", "report", "interview"]
    hits, eligible = [], {}
    for i in range(260):
        vid = f"v{rnd.randrange(200):03d}"
        ts = s0 + rnd.randrange(e0 - s0 + 1)
        if rnd.random() < 0.05:
            ts = s0 + (e0 - s0) // 2            # exactly on a midpoint: belongs to both halves
        hits.append((vid, ts, float(rnd.randrange(50)), rnd.choice(terms)))
        eligible[vid] = rnd.random() < 0.8
    # one video per (video, term, ts) row; keep the first of exact duplicates
    hits = list({(h[0], h[3]): h for h in hits}.values())
    target, page = 25, 5
    expect = py_walk(hits, eligible, s0, e0, terms, variant, target, page)

    hdf = spark.createDataFrame([(v, ts, vw, t, 2015) for v, ts, vw, t in hits],
                                "video_id string, ts_s long, views double, term string, year int")
    vdf = spark.createDataFrame(
        [(v, 2015, "music lyrics" if not ok else "t", "", "ch", "2015-01-02T00:00:00Z") for v, ok in eligible.items()],
        "video_id string, year int, title string, description string, channel_title string, published_at string")
    got = co.window_fill(hdf, vdf, [(2015, start_iso, end_iso)], terms, variant, target, page_size=page)
    got = [r.video_id for r in got.orderBy("video_rank").collect()]
    assert got == expect


@pytest.mark.parametrize("variant", ["general", "early"])
def test_leaves_of_several_depths(spark, variant):
    """A year whose first quarter is one second too short to be halved again; many hits on shared bounds and equal views."""
    rnd = random.Random(9)
    start_iso, end_iso = "2015-01-01T00:00:00Z", "2015-01-08T23:59:59Z"
    tree = co.window_tree([(2015, start_iso, end_iso)])
    halved = {(lv - 1, ix // 2) for _, lv, ix, *_ in tree if lv}
    assert len({lv for _, lv, ix, *_ in tree if (lv, ix) not in halved}) > 1
    bounds = sorted({b for r in tree for b in r[3:5]})
    hits = list({(h[0], h[3]): h for h in [(f"v{rnd.randrange(90):02d}", rnd.choice(bounds) if rnd.random() < 0.5 else rnd.randrange(bounds[0], bounds[-1] + 1), float(rnd.randrange(4)), rnd.choice(["news", "report"])) for _ in range(300)]}.values())
    eligible = {h[0]: rnd.random() < 0.7 for h in hits}
    hdf = spark.createDataFrame([(v, t, w, x, 2015) for v, t, w, x in hits] + [("out", bounds[0] - 1, 9.0, "news", 2015), ("out", bounds[-1] + 1, 9.0, "news", 2015)], "video_id string, ts_s long, views double, term string, year int")
    vdf = spark.createDataFrame([(v, 2015, "t" if ok else "lyrics", "", "ch", "2015-01-02T00:00:00Z") for v, ok in eligible.items()] + [("out", 2015, "t", "", "ch", "2015-01-02T00:00:00Z")],
                                "video_id string, year int, title string, description string, channel_title string, published_at string")
    for target in (6, 40):
        got = co.window_fill(hdf, vdf, [(2015, start_iso, end_iso)], ["news", "report"], variant, target, page_size=3)
        assert [r.video_id for r in got.orderBy("video_rank").collect()] == py_walk(hits, eligible, bounds[0], bounds[-1], ["news", "report"], variant, target, 3)
    lists = {}
    for r in co.window_lists(hdf, tree, ["news", "report"], 5).collect():
        lists.setdefault((r.level, r.idx, r.term_no, r.ord_no), {})[r["rank"]] = r.video_id
    for _, lv, ix, s, e, *_ in tree:
        for term_no, term in enumerate(["news", "report"]):
            for ord_no in (0, 1):
                own = sorted((h for h in hits if s <= h[1] <= e and h[3] == term), key=lambda h: (-h[2 - ord_no], h[0]))[:5]
                assert lists.get((lv, ix, term_no, ord_no), {}) == {k + 1: h[0] for k, h in enumerate(own)}


def test_plan_of_the_window_fill(spark):
    """Hits are copied for the two orders and at shared bounds only, before the leaf's filter; no union of two branches."""
    tree = co.window_tree([(2015, "2015-01-01T00:00:00Z", "2015-12-31T23:59:59Z")])
    hits = spark.createDataFrame([("v", 1420070400, 1.0, "news", 2015)], "video_id string, ts_s long, views double, term string, year int")
    plan = co.window_lists(hits, tree, ["news"], 3000)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    last = max(i for i, x in enumerate(lines) if "Window [" in x)
    below = [x for x in lines[last:] if "Generate" in x]
    assert len(below) == 2 and "Union" not in plan


def test_comment_text_is_shuffled_by_no_window(spark):
    """Dedup and caps run without the text; it comes by one join on a row number."""
    rows = [(2011, "A", p, i, f"c{p}-{i}", "2011-05-01T00:00:00Z", "text " * 5, "en") for p in range(30) for i in range(20)]
    comments = spark.createDataFrame(rows + rows[:50], "year int, video_id string, page int, pos int, comment_id string, published_at string, text string, lang string")
    sampled = spark.createDataFrame([(2011, "A", 1)], "year int, video_id string, video_rank int")
    got = co.collect_comments(comments, sampled, per_video=250, per_year=240)
    plan = got._jdf.queryExecution().optimizedPlan()
    windows = []

    def walk(node):
        if node.nodeName() == "Window" or node.nodeName() == "Aggregate":
            windows.append(node.output().mkString(","))
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    assert windows and not any("text#" in w for w in windows)
    assert sorted(r.comment_id for r in got.collect()) == sorted(r[4] for r in sorted(rows, key=lambda r: (r[2], r[3]))[:240])


def test_attach_windows_equals_range_join(spark):
    rnd = random.Random(5)
    tree = co.window_tree([(2012, "2012-01-01T00:00:00Z", "2012-12-31T23:59:59Z")])
    wins = spark.createDataFrame(tree, "year int, level int, idx int, start_s long, end_s long, "
                                       "window_start string, window_end string")
    pts = [tree[rnd.randrange(len(tree))][3 + rnd.randrange(2)] + rnd.choice([-1, 0, 1]) for _ in range(150)]
    hits = spark.createDataFrame([(f"v{i}", t, 2012) for i, t in enumerate(pts)], "video_id string, ts_s long, year int")
    got = sorted((r.video_id, r.level, r.idx) for r in co.attach_windows(hits, wins, 8).collect())
    expect = sorted((f"v{i}", w[1], w[2]) for i, t in enumerate(pts) for w in tree if w[3] <= t <= w[4])
    assert got == expect


def test_comment_dedup_and_caps(spark):
    rows = []
    for v, rank in (("A", 1), ("B", 2)):
        for page in range(2):
            for pos in range(30):
                cid = f"{v}{page}{pos}" if not (v == "B" and page == 0 and pos < 3) else f"A0{pos}"
                rows.append((2011, v, page, pos, cid, "2011-05-01T00:00:00Z", "x", "en" if pos != 7 else "de"))
    rows.append((2011, "A", 0, 99, "late", "2012-01-01T00:00:00Z", "x", "en"))       # other year: dropped
    schema = "year int, video_id string, page int, pos int, comment_id string, published_at string, text string, lang string"
    comments = spark.createDataFrame(rows, schema)
    sampled = spark.createDataFrame([(2011, "A", 1), (2011, "B", 2)], "year int, video_id string, video_rank int")
    got = co.collect_comments(comments, sampled, per_video=40, per_year=70).collect()
    per_video = {}
    for r in got:
        per_video[r.video_id] = per_video.get(r.video_id, 0) + 1
    assert per_video["A"] == 40 and len(got) == 70
    ids = [r.comment_id for r in got]
    assert len(ids) == len(set(ids)) and "late" not in ids
    assert not any(r.video_id == "B" and r.comment_id.startswith("A0") for r in got)   # first wins: under A
    assert "A07" not in ids                                                              # German dropped
    s = {r.year: r for r in co.ingest_summary(sampled, co.collect_comments(comments, sampled)).collect()}
    assert s[2011].videos == 2 and s[2011].warn_videos and s[2011].warn_comments


def test_attach_video_defaults(spark):
    c = spark.createDataFrame([("1", "A"), ("2", "Z")], "comment_id string, video_id string")
    v = spark.createDataFrame([("A", "T", "2011-01-01T00:00:00Z")], "video_id string, title string, published_at string")
    got = {r.comment_id: (r.video_title, r.video_published_at) for r in co.attach_video(c, v).collect()}
    assert got == {"1": ("T", "2011-01-01T00:00:00Z"), "2": ("", "")}


def test_year_filter_edges(spark):
    from tenor.functions.time import in_year
    rows = [("2010-12-31T23:59:59Z", 2010), ("2011-01-01T00:00:00Z", 2010), (None, 2010), ("", 2010),
            ("2011-01-01T00:00:00Z", 2011)]
    df = spark.createDataFrame(rows, "published_at string, year int")
    got = [r.ok for r in df.select(in_year("published_at", "year").alias("ok")).collect()]
    assert got == [True, False, False, False, True]


def test_year_bounds_columns(spark):
    from tenor.functions.time import year_bounds
    df = spark.createDataFrame([(2010,), (2024,)], "year int")
    s, e = year_bounds("year", "2024-06-30T12:00:00Z")
    got = [tuple(r) for r in df.select("year", s, e).orderBy("year").collect()]
    assert got == [(2010, "2010-01-01T00:00:00Z", "2010-12-31T23:59:59Z"),
                   (2024, "2024-01-01T00:00:00Z", "2024-06-30T12:00:00Z")]
