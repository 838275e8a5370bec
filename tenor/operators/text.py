"""Row filters and text operators: P3, P5/U5, P7, P8, P9, P11, A2."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenor.functions.text import has_letter, is_music_video, occurrences, preprocess


def split_letters(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """P5 and its complement U5: (rows with a letter, rows without one; null text
    goes to the removed side). Both are outputs."""
    mask = has_letter(text)
    return df.filter(mask), df.filter(~mask)


def exclude_music(videos: DataFrame, title: str = "title", description: str = "description",
                  channel: str = "channel_title") -> DataFrame:
    """P3 as a filter: keep videos that are not music videos."""
    return videos.filter(~is_music_video(title, description, channel))


def add_text_proc(df: DataFrame, text: str = "text", title: str = "video_title",
                  use_title_prefix: bool = True, clean_like_old: bool = True,
                  out: str = "text_proc", collapse: bool = True) -> DataFrame:
    """P7 + P8: classifier input text (without ``collapse`` for its words only, see :func:`tenor.functions.text.clean_text`)."""
    title_col = F.col(title) if title in df.columns else F.lit(None).cast("string")
    return df.withColumn(out, preprocess(F.col(text), title_col, use_title_prefix, clean_like_old, collapse))


def fill_defaults(df: DataFrame, labels=(), text_cols=("text",), string_cols=("video_title",)) -> DataFrame:
    """Labels and sentiment -> 0, text -> '', title/date -> ''."""
    fills = {c: 0 for c in [*labels, "sentiment"] if c in df.columns}
    fills.update({c: "" for c in [*text_cols, *string_cols] if c in df.columns})
    return df.fillna(fills)


def term_counts(df: DataFrame, terms, column: str = "text_lower") -> DataFrame:
    """A2: per term, non-overlapping literal occurrences summed over all rows,
    zero-count terms kept, in term order -> (term_no, term, count).

    One pass: a single global aggregate with one sum per term (partial sums
    per partition, one tiny final merge), then the one row is unpivoted."""
    sums = df.agg(*[F.coalesce(F.sum(occurrences(column, t)), F.lit(0)).cast("bigint").alias(f"c{i}")
                    for i, t in enumerate(terms)])
    rows = F.array(*[F.struct(F.lit(i).alias("term_no"), F.lit(t).alias("term"), F.col(f"c{i}").alias("count"))
                     for i, t in enumerate(terms)])
    return sums.select(F.inline(rows))
