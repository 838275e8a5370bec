"""Incremental ingest of landed comment files (Structured Streaming).

The batch jobs read a closed set of per-year NDJSON files. When files keep
landing, the same stateless steps run as a stream: the year from the file
name (S1), first-wins dedup of comment ids per year (U3), the letter filter
(P5), cleaning (P7) and the keyword flags (P11). Running per-year counts are the
streaming form of the ingest counters (A5).

Files of any year may land in any order, so there is no event-time cut: the
state holds one key per comment seen. The checkpoint location must be shared
storage so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenor.functions.text import clean_text
from tenor.operators.lexicon import add_flags
from tenor.schemas import COMMENT
from tenor.sources.readers import YEAR_FROM_FILE


def comment_stream(spark: SparkSession, landing_dir: str, max_files_per_trigger: int = 100) -> DataFrame:
    """Landed ``comments_YYYY.ndjson`` files -> deduplicated, filtered, flagged rows."""
    raw = (spark.readStream.schema(COMMENT).option("maxFilesPerTrigger", max_files_per_trigger)
           .option("mode", "FAILFAST").option("pathGlobFilter", "comments_*.ndjson").json(landing_dir))
    year = F.regexp_extract(F.col("_metadata.file_path"), YEAR_FROM_FILE, 1)
    no_year = F.raise_error(F.concat(F.lit("no year in file name: "), F.col("_metadata.file_path")))
    rows = raw.withColumn("year", F.when(year != "", year.cast("int")).otherwise(no_year))
    deduped = rows.dropDuplicates(["year", "comment_id"])
    kept = deduped.filter(F.coalesce(F.col("text").rlike(r"[\p{L}\p{Nl}\p{No}]"), F.lit(False)))
    return add_flags(kept.withColumn("text_clean", clean_text("text")))


def yearly_counts(stream: DataFrame) -> DataFrame:
    """Running comments and flag counts per year (update/complete output)."""
    return stream.groupBy("year").agg(F.count(F.lit(1)).alias("comments"),
                                      F.count_if("is_distrust").alias("distrust_count"),
                                      F.count_if("is_trust").alias("trust_count"))


def start_ingest(spark: SparkSession, landing_dir: str, out_dir: str, checkpoint: str,
                 available_now: bool = False):
    """Run the ingest into per-year NDJSON files (the streaming form of K1).

    The file sink with a checkpoint on shared storage is exactly-once: a
    restarted or retried batch does not duplicate rows. ``available_now``
    processes what has landed and stops (backfills, tests)."""
    rows = comment_stream(spark, landing_dir)
    w = (rows.writeStream.format("json").option("path", out_dir).option("checkpointLocation", checkpoint)
             .option("ignoreNullFields", False).partitionBy("year").outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
