"""Gold labels: codes, strata, class frequencies, stratified split, test subset
(P6, P10, P13, P18, A3, A4, W5, J4, K4)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenor.functions.numeric import sentiment_to_class, whole_number
from tenor.schemas import LABELS, normalize_columns, require_labels
from tenor.staging import stage

SPLIT_SEED = 42
VAL_SIZE = 0.15
TEST_SIZE = 0.15
# Hash-prefix buckets of the exact split ranking (4 hex digits).
RANK_BUCKET_HEX = 4


def build_labels(df: DataFrame, labels=LABELS) -> DataFrame:
    """P6 + P10 + P9 + P13 + P18: canonical headers, contract check (raises before
    any job), null labels -> 0, sentiment -> class 0/1/2, any_pos and stratum."""
    df = normalize_columns(df)
    require_labels(df, labels)
    df = df.withColumns({c: F.coalesce(whole_number(c), F.lit(0)) for c in labels})
    any_pos = (F.greatest(*[F.col(c) for c in labels]) > 0).cast("int") if len(labels) > 1 \
        else (F.col(labels[0]) > 0).cast("int")
    return (df.withColumn("sent_class", sentiment_to_class("sentiment"))
              .withColumn("any_pos", any_pos)
              .withColumn("stratum", (F.col("any_pos") * 3 + F.col("sent_class")).cast("int")))


def class_frequency(df: DataFrame, labels=LABELS) -> DataFrame:
    """A3 (and A4 on the test split): (label_no, label, freq) with freq = sum as a double."""
    sums = df.agg(*[F.coalesce(F.sum(F.col(c)), F.lit(0)).cast("double").alias(f"f{i}")
                    for i, c in enumerate(labels)])
    rows = F.array(*[F.struct(F.lit(i).alias("label_no"), F.lit(c).alias("label"), F.col(f"f{i}").alias("freq"))
                     for i, c in enumerate(labels)])
    return sums.select(F.inline(rows))


def split_hash(key: str = "comment_id", seed: int = SPLIT_SEED):
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def exact_rank(df: DataFrame, part: str, key: str, h: str = "__h") -> DataFrame:
    """1-based rank of each row inside ``part`` ordered by (h, key), plus the part
    size ``__n``, without sorting a whole part in one task.

    Rows are counted per (part, hash-prefix bucket); prefix sums over that small
    table (at most parts x 16^4 rows) give each bucket's offset, and the rank
    inside a bucket is a window over a small group."""
    bucket = F.conv(F.substring(F.col(h), 1, RANK_BUCKET_HEX), 16, 10).cast("int")
    df = df.withColumn("__b", bucket)
    counts = df.groupBy(part, "__b").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(part).orderBy("__b")
    offsets = counts.select(
        part, "__b",
        (F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")).alias("__off"),
        F.sum("__c").over(Window.partitionBy(part)).alias("__n"))
    ranked = df.join(F.broadcast(offsets), [part, "__b"])
    inner = Window.partitionBy(part, "__b").orderBy(F.col(h), F.col(key))
    return (ranked.withColumn("__rank", F.col("__off") + F.row_number().over(inner))
                  .drop("__b", "__off"))


def stratified_split(df: DataFrame, key: str = "comment_id", seed: int = SPLIT_SEED,
                     strata: str = "stratum") -> DataFrame:
    """70/15/15 per stratum, seeded. Rank by md5(id:seed) inside the stratum;
    cut points (7n+5) div 10 and (17n+10) div 20 (rounded 70% and 85%)."""
    ranked = exact_rank(df.withColumn("__h", split_hash(key, seed)), strata, key)
    n, r = F.col("__n"), F.col("__rank")
    split = (F.when(r <= F.floor((n * 7 + 5) / 10), "train")
             .when(r <= F.floor((n * 17 + 10) / 20), "val").otherwise("test"))
    return ranked.withColumn("split", split).drop("__h", "__n", "__rank")


def test_subset(df: DataFrame, ids: DataFrame, key: str = "comment_id") -> DataFrame:
    """Rows whose id (as a string) is in ``ids``."""
    ids = ids.select(F.col(ids.columns[0]).cast("string").alias(key)).distinct()
    return df.withColumn(key, F.col(key).cast("string")).join(ids, key, "left_semi")


def split_ids(df: DataFrame, name: str, key: str = "comment_id") -> DataFrame:
    """K4 input: the ids of one split."""
    return df.filter(F.col("split") == name).select(F.col(key).cast("string").alias(key))


def ensure_id(df: DataFrame, key: str = "comment_id", fallback: str = "_row_id") -> tuple[DataFrame, str]:
    """D3: use ``key`` when present; otherwise number the rows 0..n-1 in file order
    as strings, the row index the reference falls back to.

    Several files count in the order of their paths, and a file's splits in their
    order, whatever tasks they are read in: a split's rows have consecutive
    ``monotonically_increasing_id`` values in reading order, and the rows of all
    splits before it are added (one number per split). A frame that was not read
    from files counts its partitions instead."""
    if key in df.columns:
        return df.withColumn(key, F.col(key).cast("string")), key
    if fallback in df.columns:  # numbered when it was written
        return df.withColumn(fallback, F.col(fallback).cast("string")), fallback
    own = df.columns
    try:
        df = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__split"))
    except AnalysisException:
        df = df.select("*", F.lit("").alias("__file"), F.spark_partition_id().cast("long").alias("__split"))
    placed = stage(df.withColumn("__at", F.monotonically_increasing_id()), "file-rows")
    splits = placed.groupBy("__file", "__split").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__file", "__split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("__file", "__split", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__off"))
    ids = placed.join(offsets, ["__file", "__split"]).withColumn(fallback, (F.col("__off") + F.col("__at")).cast("string"))
    return ids.select(*own, fallback), fallback
