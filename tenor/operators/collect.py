"""Collection: year bounds and filters, time-window fill sampling, comment
dedup and caps, metadata join, ingest counters (P1, P2, P3, J1, J6, U2, U3,
U4, W2, W3, W6, W7, A5, A6).

The reference walks an API loop. Here the jobs start from landed pages (see
:mod:`tenor.sources.pages`) and the loop is a declarative plan:

window fill (W6) — the depth-first walk over halved windows visits windows in
``(start, level)`` order, appends each window's ranked raw hits that are new
and eligible, and stops at the target. So: build the window tree (small,
bounded, broadcast), put each hit into its leaf window, keep the leaf's first
results per (term, order) by cut-off selection, and rank upwards: a parent's
first n results are the first n of its children's first n. Then order everything
by ``(start, level, term_no, ord_no, rank)``, keep each video's first occurrence,
drop ineligible videos and keep the first ``target`` per year. Ranking limits apply
to raw hits, before the eligibility filter, as in the reference.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenor.functions.text import is_music_video
from tenor.functions.time import epoch_seconds, in_year, parse_iso
from tenor.operators.cutoff import Key, first_n_by_cutoff
from tenor.operators.ranking import first_n, first_per_key
from tenor.staging import stage

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for the same samples.
COMMENTS_PER_YEAR = 10_000
MAX_COMMENTS_PER_VIDEO = 40
VIDEO_SAMPLE_SIZE = 3_000          # general variant
VIDEO_SAMPLE_SIZE_EARLY = 4_000    # early-years variant
MIN_VIDEOS_REQUIRED = 2_500
MIN_COMMENTS_REQUIRED = 10_000
SEARCH_PAGE_SIZE = 50
MIN_SPLIT_SECONDS = 2 * 86_400     # a window is halved only if it spans >= 2 whole days
GENERAL_ORDERS = ["viewCount", "date"]
# ---------------------------------------------------------------------------
ISO = "%Y-%m-%dT%H:%M:%SZ"


def _epoch(iso: str) -> int:
    return int(datetime.strptime(iso, ISO).replace(tzinfo=timezone.utc).timestamp())


def _iso(s: int) -> str:
    return datetime.fromtimestamp(s, tz=timezone.utc).strftime(ISO)


def year_bounds_py(year: int, now_iso: str) -> tuple[str, str]:
    """P1 (driver-side, for the window tree): the year's bounds, capped at now."""
    now_year = int(now_iso[:4])
    return f"{year}-01-01T00:00:00Z", (f"{year}-12-31T23:59:59Z" if year < now_year else now_iso)


def window_tree(bounds) -> list[tuple]:
    """Halving windows of each (year, start_iso, end_iso): rows (year, level, idx,
    start_s, end_s, start_iso, end_iso) in visiting order. Midpoints are truncated
    to whole seconds; a window is split while it spans at least two whole days.
    Size is bounded (511 windows for a full year)."""
    out = []
    for year, start_iso, end_iso in bounds:
        stack = [(0, 0, _epoch(start_iso), _epoch(end_iso))]
        while stack:
            level, idx, s, e = stack.pop()
            out.append((int(year), level, idx, s, e, _iso(s), _iso(e)))
            if e - s >= MIN_SPLIT_SECONDS:
                mid = s + (e - s) // 2
                stack.append((level + 1, 2 * idx + 1, mid, e))
                stack.append((level + 1, 2 * idx, s, mid))
    return out


TREE_SCHEMA = "year int, level int, idx int, start_s long, end_s long, window_start string, window_end string"


def _leaf_cells(tree: list[tuple]) -> list[tuple]:
    """Rows (year, cell, origin, width, leaves): the year's span in equal cells no longer than its shortest leaf
    window, each with the few leaves that touch it. Bounded: some 400 cells for a full year."""
    out = []
    halved = {(y, level - 1, idx // 2) for y, level, idx, *_ in tree if level}
    for year in sorted({r[0] for r in tree}):
        leaves = [r for r in tree if r[0] == year and (year, r[1], r[2]) not in halved]
        leaves.sort(key=lambda r: r[3])
        origin, end = leaves[0][3], leaves[-1][4]
        width = max(1, min(r[4] - r[3] for r in leaves))
        for cell in range((end - origin) // width + 1):
            lo, hi = origin + cell * width, origin + (cell + 1) * width
            near = [(r[1], r[2], r[3], r[4], r[4] < end) for r in leaves if r[3] <= hi and r[4] >= lo]
            out.append((year, cell, origin, width, near))
    return out


def attach_leaves(hits: DataFrame, tree: list[tuple], ts: str = "ts_s") -> DataFrame:
    """Every hit with its leaf window: columns of ``hits`` + ``leaf_level, leaf_idx, at_end``.

    One probe of a small table by (year, cell). Windows are closed at both ends, so a hit on a bound that two leaves
    share enters the left one too, there with ``at_end`` true. Hits outside the tree drop out."""
    spark = hits.sparkSession
    near = "array<struct<level:int,idx:int,start_s:long,end_s:long,shared:boolean>>"
    cells = spark.createDataFrame(_leaf_cells(tree), f"year int, __cell int, __s0 long, __w long, __near {near}")
    roots = cells.filter("__cell = 0").select("year", "__s0", "__w")
    t = F.col(ts)
    at = F.floor((t - F.col("__s0")) / F.col("__w")).cast("int")
    probed = hits.join(F.broadcast(roots), "year").filter(t >= F.col("__s0")).withColumn("__cell", at).join(F.broadcast(cells.drop("__s0", "__w")), ["year", "__cell"])
    own = F.filter("__near", lambda w: (w["start_s"] <= t) & (t <= w["end_s"]))
    found = probed.select(*hits.columns, F.explode(own).alias("__leaf"))
    return found.select(*hits.columns, F.col("__leaf.level").alias("leaf_level"), F.col("__leaf.idx").alias("leaf_idx"),
                        (F.col("__leaf.shared") & (t == F.col("__leaf.end_s"))).alias("at_end"))


def _in_window(level) -> Column:
    """Whether a row of ``attach_leaves`` lies in its ancestor of that level as a hit of its own: a hit at a shared end
    counts for the windows that end there (below, the leaf to the right holds it)."""
    below = F.col("leaf_level") - level
    last = (F.col("leaf_idx") + 1) % F.pow(F.lit(2), F.greatest(below, F.lit(0))).cast("int") == 0   # the rightmost leaf of the window
    return (below >= 0) & (~F.col("at_end") | last)


def attach_windows(hits: DataFrame, windows: DataFrame, max_level: int, ts: str = "ts_s") -> DataFrame:
    """Every (hit, window) with window_start <= ts <= window_end (closed both ends): the leaf's ancestors."""
    tree = [tuple(r) for r in windows.select("year", "level", "idx", "start_s", "end_s", "window_start", "window_end").collect()]   # bounded: 511 a year
    each = attach_leaves(hits, tree, ts).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(max_level))))
    inside = each.filter(_in_window(F.col("level"))).withColumn("idx", F.expr("shiftright(leaf_idx, leaf_level - level)"))
    return inside.drop("leaf_level", "leaf_idx", "at_end").join(F.broadcast(windows), ["year", "level", "idx"])


def window_lists(hits: DataFrame, tree: list[tuple], terms, most: int, orders=GENERAL_ORDERS) -> DataFrame:
    """The first ``most`` hits of every (window, term, order), bottom-up: columns of ``hits`` +
    ``level, idx, term_no, ord_no, rank``.

    Both orders are rows of one table. Each leaf's list comes by cut-off selection, so what goes on is bounded by the
    tree: ``most`` hits per leaf, term and order, and as many at its end. Then each level, from the leaves up, ranks the
    rows that its children's lists hold: one window function a level, over one table."""
    score = F.lit(None).cast("double")
    for i, order in enumerate(orders):
        score = F.when(F.col("ord_no") == i, (F.col("views") if order == "viewCount" else F.col("ts_s")).cast("double")).otherwise(score)
    placed = (attach_leaves(hits, tree).withColumn("term_no", F.array_position(F.array(*[F.lit(t) for t in terms]), F.col("term")) - 1).filter("term_no >= 0")
              .withColumn("ord_no", F.explode(F.array(*[F.lit(i) for i in range(len(orders))]))).withColumn("score", score))
    search = ["year", "term_no", "ord_no"]
    rows = first_n_by_cutoff(placed, [*search, "leaf_level", "leaf_idx", "at_end"], [Key("score", descending=True), "video_id"], most)
    deepest = max((r[1] for r in tree), default=0)
    own, places = ~F.col("at_end"), []
    kept, rows = rows.columns, rows.withColumn("__own", F.lit(None).cast("long"))
    for level in range(deepest, -1, -1):
        # A hit that was not among the first of the window below is not among the first of this one.
        alive = _in_window(level) & (F.col("at_end") | (F.col("leaf_level") == level) | F.coalesce(F.col("__own") <= most, F.lit(False)))
        idx = F.expr(f"shiftright(leaf_idx, greatest(leaf_level - {level}, 0))")
        # The other rows stand apart, leaf by leaf, so that no window function meets them in one group.
        rows = rows.select("*", alive.alias("__alive"), F.when(alive, idx).otherwise(-1 - F.col("leaf_idx")).alias("__idx"))
        by = Window.partitionBy(*search, "__alive", "__idx").orderBy(F.col("score").desc(), "video_id")
        rows = rows.select("*", F.row_number().over(by).alias("__rank"), F.sum(F.when(own, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("__n"))
        place = F.when(F.col("__alive") & (F.col("__rank") <= most), F.struct(F.lit(level).alias("level"), F.col("__idx").alias("idx"), F.col("__rank").alias("rank")))
        rows = rows.select(*kept, *places, place.alias(f"__p{level}"), F.when(F.col("__alive"), F.col("__n")).alias("__own"))
        places.append(f"__p{level}")
    spots = F.filter(F.array(*places), lambda p: p.isNotNull())
    found = rows.withColumn("__p", F.explode(spots))
    return found.select(*hits.columns, "__p.level", "__p.idx", "term_no", "ord_no", "__p.rank")


def rank_candidates(hits: DataFrame, tree: list[tuple], terms, variant: str = "general", target: int = VIDEO_SAMPLE_SIZE,
                    orders=GENERAL_ORDERS, page_size: int = SEARCH_PAGE_SIZE) -> DataFrame:
    """W7 (+U2): ranked raw hits per window and search, with the window's start_s and window_start.

    Both variants rank each (window, term, order) search by views desc
    ("viewCount") or date desc ("date"), ties by video id. general: the first
    term only, whole pages until ``target`` is met; the second order is searched
    only if the first returned fewer than ``target`` hits, and only for the pages
    needed to reach it. early: every term and order, all pages, then the first
    ``target`` of the concatenation. A search has no other limit, so no rank past
    these bounds can matter. Output adds level, idx, term_no, ord_no, rank."""
    pages_target = -(-target // page_size) * page_size
    wkey = ["year", "level", "idx"]
    wins = hits.sparkSession.createDataFrame(tree, TREE_SCHEMA).select(*wkey, "start_s", "window_start")
    if variant == "general":
        # Pages of the first order stop once the target is met; the second order
        # runs only when short, for ceil((target - n1) / page) more pages.
        ranked = window_lists(hits, tree, list(terms)[:1], pages_target, orders)
        n1 = F.count(F.when(F.col("ord_no") == 0, 1)).over(Window.partitionBy(*wkey))
        ranked = ranked.withColumn("__n1", n1)
        need = F.ceil((F.lit(target) - F.col("__n1")) / F.lit(page_size)) * page_size
        ranked = ranked.filter((F.col("ord_no") == 0) | ((F.col("__n1") < target) & (F.col("rank") <= need))).drop("__n1")
    else:
        ranked = window_lists(hits, tree, terms, target, orders)
        ranked = first_n(ranked, wkey, ["term_no", "ord_no", "rank"], target, salt_cols=[])
    return ranked.join(F.broadcast(wins), wkey)


def one_per_video(videos: DataFrame, keys=("video_id",)) -> DataFrame:
    """One metadata row per video: a video is looked up more than once, and each answer lands."""
    return first_per_key(videos, list(keys), ["published_at"])


def video_eligible(videos: DataFrame, english=None) -> DataFrame:
    """P2 + P3 (+P4 when a language column is given): (video_id, eligible)."""
    ok = in_year("published_at", "year") & ~is_music_video("title", "description", "channel_title")
    if english is not None:
        ok = ok & (F.coalesce(F.col(english), F.lit("en")) == "en")
    once = one_per_video(videos, ("video_id", "year"))
    return once.select("video_id", "year", ok.alias("eligible"))


def window_fill(hits: DataFrame, videos: DataFrame, bounds, terms, variant: str = "general",
                target: int | None = None, english: str | None = None,
                page_size: int = SEARCH_PAGE_SIZE) -> DataFrame:
    """Sampled videos per year -> (year, video_rank, video_id, level, window_start).

    ``hits``: (video_id, ts_s, views, term, year); ``videos``: metadata with
    (video_id, year, title, description, channel_title, published_at)."""
    target = target or (VIDEO_SAMPLE_SIZE if variant == "general" else VIDEO_SAMPLE_SIZE_EARLY)
    ranked = rank_candidates(hits, window_tree(bounds), terms, variant, target, page_size=page_size)
    order = ["start_s", "level", "term_no", "ord_no", "rank"]
    return _fill(ranked, order, videos, target, english, bounded=True).select("year", "video_rank", "video_id", "level", "window_start")


def _fill(ranked: DataFrame, order: list[str], videos: DataFrame, target: int, english: str | None, bounded: bool) -> DataFrame:
    """The first occurrence of each video, then the first ``target`` eligible ones per year: by a window alone if the
    window lists bound the rows of a year, else by cut-off selection."""
    place = [c for c in ("level", "window_start") if c in ranked.columns and c not in order]
    first = first_per_key(ranked.select("year", "video_id", *order, *place), ["year", "video_id"], order)
    eligible = first.join(video_eligible(videos, english), ["year", "video_id"]).filter("eligible").drop("eligible")
    if bounded:
        return first_n(eligible, ["year"], [*order, "video_id"], target, rank_col="video_rank", salt_cols=[])
    return first_n_by_cutoff(stage(eligible, "eligible-videos"), ["year"], [*order, "video_id"], target, rank_col="video_rank")


def fill_landed(hits: DataFrame, videos: DataFrame, terms, variant: str = "general", target: int | None = None,
                english: str | None = None, orders=GENERAL_ORDERS) -> DataFrame:
    """W6 over landed search pages, in the order in which the service answered:
    (year, video_rank, video_id, window_start).

    ``hits``: :func:`tenor.sources.pages.flatten_search_pages` with its context.
    Windows come by start and, of equal starts, the longer first (a window before
    its halves); inside a window by term, order, page and position. The general
    variant uses the first term."""
    target = target or (VIDEO_SAMPLE_SIZE if variant == "general" else VIDEO_SAMPLE_SIZE_EARLY)
    place = lambda values, c: F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c)) - 1
    h = (hits.withColumn("term_no", place(terms, "term")).withColumn("ord_no", place(orders, "ord"))
             .withColumn("year", F.col("year").cast("int"))
             .withColumn("start_s", epoch_seconds(parse_iso("window_start")))
             .withColumn("longer", -epoch_seconds(parse_iso("window_end"))))
    h = h.filter((F.col("term_no") == 0) if variant == "general" else (F.col("term_no") >= 0)).filter("ord_no >= 0")
    order = ["start_s", "longer", "term_no", "ord_no", "page", "pos"]
    return _fill(h, order, videos, target, english, bounded=False).select("year", "video_rank", "video_id", "window_start")


def collect_comments(comments: DataFrame, sampled: DataFrame, english: str | None = "lang",
                     per_video: int | None = MAX_COMMENTS_PER_VIDEO,
                     per_year: int | None = COMMENTS_PER_YEAR) -> DataFrame:
    """Comment side of collection: semi-join to the sampled videos of the year,
    P2 on the comment date, U3 first-wins dedup by id over (video_rank, page,
    pos) — an id is claimed before the language check, as in the reference —
    then P4, W2 (per video), W3 (per year); a cap that is None is skipped.

    The comments of sampled videos are written once, with a number per row. Dedup
    and caps run on ids, places and that number, with cut-off selection; one join on
    the number brings the other columns. A comment that landed twice is one from the
    dedup on, so no step groups texts.

    ``comments``: (year, video_id, page, pos, comment_id, published_at, text[, lang]);
    ``sampled``: (year, video_id, video_rank)."""
    ranks = sampled.select("year", "video_id", "video_rank")
    mine = comments.filter(in_year("published_at", "year")).join(ranks, ["year", "video_id"])
    mine = stage(mine.withColumn("__row", F.monotonically_increasing_id()).select(*comments.columns, "video_rank", "__row"), "sampled-comments")
    order = ["video_rank", "page", "pos"]
    narrow = mine.select("year", "video_id", "comment_id", *order, "__row", *([english] if english is not None else []))
    c = first_per_key(narrow, ["year", "comment_id"], order)
    if english is not None:
        c = c.filter(F.coalesce(F.col(english), F.lit("en")) == "en")
    if per_video is not None or per_year is not None:
        c = stage(c, "claimed-comments")
    if per_video is not None:
        c = first_n_by_cutoff(c, ["year", "video_id"], [*order, "comment_id"], per_video)
    if per_year is not None:
        c = first_n_by_cutoff(c, ["year"], [*order, "comment_id"], per_year)
    return mine.join(c.select("__row"), "__row", "left_semi").drop("__row")


def attach_video(comments: DataFrame, videos: DataFrame) -> DataFrame:
    """Add video_title and video_published_at (default '').

    One metadata row per video; AQE's run-time broadcast or skew-join handling
    covers a video that holds a large share of the comments."""
    v = one_per_video(videos).select("video_id", F.col("title").alias("__t"), F.col("published_at").alias("__p"))
    return (comments.join(v, "video_id", "left")
                    .withColumn("video_title", F.coalesce(F.col("__t"), F.lit("")))
                    .withColumn("video_published_at", F.coalesce(F.col("__p"), F.lit("")))
                    .drop("__t", "__p"))


def ingest_summary(sampled: DataFrame, collected: DataFrame,
                   min_videos: int = MIN_VIDEOS_REQUIRED, min_comments: int = MIN_COMMENTS_REQUIRED) -> DataFrame:
    """A5: per year, sampled videos (with or without comments) and collected
    comments, with the two under-target warnings."""
    v = sampled.groupBy("year").agg(F.count(F.lit(1)).alias("videos"))
    c = collected.groupBy("year").agg(F.count(F.lit(1)).alias("comments"))
    s = v.join(c, "year", "full").fillna(0, ["videos", "comments"])
    return s.select("year", "videos", "comments", (F.col("videos") < min_videos).alias("warn_videos"),
                    (F.col("comments") < min_comments).alias("warn_comments"))


def comments_per_video(collected: DataFrame) -> DataFrame:
    """Comments per video and year."""
    return collected.groupBy("year", "video_id").agg(F.count(F.lit(1)).alias("n_comments"))


def videos_per_window(sampled: DataFrame) -> DataFrame:
    """New videos per window."""
    return sampled.groupBy("year", "level", "window_start").agg(F.count(F.lit(1)).alias("n_videos"))

