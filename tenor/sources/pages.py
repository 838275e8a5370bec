"""Landed API pages -> rows.

The collection jobs start from pages landed as JSON (one object per page, as
the API returned it, plus request context). Flattening is ``posexplode`` over
``items`` and struct field access; the position inside the page is kept so the
reference's page order (first wins, caps in page order) stays defined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten_comment_pages(pages: DataFrame) -> DataFrame:
    """S3: (video_id, page, items[]) -> one row per top-level comment:
    video_id, page, pos, comment_id, published_at ('' when missing), text."""
    e = pages.select("video_id", "page", F.posexplode("items").alias("pos", "item"))
    top = F.col("item.snippet.topLevelComment")
    return e.select("video_id", "page", "pos",
                    top.getField("id").alias("comment_id"),
                    F.coalesce(top.getField("snippet").getField("publishedAt"), F.lit("")).alias("published_at"),
                    top.getField("snippet").getField("textDisplay").alias("text"))


def flatten_video_pages(pages: DataFrame) -> DataFrame:
    """Video pages -> video_id, title, description ('' when missing),
    channel_title, published_at."""
    e = pages.select(F.explode("items").alias("item"))
    sn = F.col("item.snippet")
    return e.select(F.col("item.id").alias("video_id"), sn.getField("title").alias("title"),
                    F.coalesce(sn.getField("description"), F.lit("")).alias("description"),
                    sn.getField("channelTitle").alias("channel_title"),
                    sn.getField("publishedAt").alias("published_at"))


def flatten_search_pages(pages: DataFrame) -> DataFrame:
    """Search pages -> ordered video ids per (term, ord, window, page)."""
    ctx = [c for c in ("year", "window_start", "window_end", "term", "ord", "page") if c in pages.columns]
    e = pages.select(*ctx, F.posexplode("items").alias("pos", "item"))
    return e.select(*ctx, "pos", F.col("item.id.videoId").alias("video_id"))


def pack_pages(rows: DataFrame, page_key, order_col: str, item) -> DataFrame:
    """Group rows into pages (``page_key`` must bound a page's size, as an API page
    does) with items in ``order_col`` order. Used to land fixtures from tables."""
    keys = [F.col(k) if isinstance(k, str) else k for k in page_key]
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("__o"),
                                                                           item.alias("__i")))).alias("__a"))
    return packed.select(*[F.col(c) for c in packed.columns if c != "__a"],
                         F.transform("__a", lambda x: x["__i"]).alias("items"))
