"""Sources (S1, S2, S6, S7, U1). Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenor.schemas import COMMENT, LABEL_CONFIG, LABELLED

# ``comments_2015.ndjson``, or a file of the per-year sink (``year=2015/part-...``).
YEAR_FROM_FILE = r"(?:comments_|/year=)(\d{4})(?=\.ndjson|/[^/]*$)"


def expand_globs(spark: SparkSession, patterns) -> list[str]:
    """The union of the files matched by the patterns, duplicates removed,
    sorted. Only file names are listed (on the driver, through the Hadoop file
    system, as Spark's own file index does)."""
    patterns = [patterns] if isinstance(patterns, str) else list(patterns)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = set()
    for pat in patterns:
        path = jvm.org.apache.hadoop.fs.Path(pat)
        statuses = path.getFileSystem(conf).globStatus(path)
        todo = list(statuses or [])
        while todo:
            st = todo.pop()
            if st.isFile():
                found.add(st.getPath().toString())
            else:  # a folder stands for its files, but for markers and hidden ones
                fs = st.getPath().getFileSystem(conf)
                todo += [x for x in fs.listStatus(st.getPath()) if x.getPath().getName()[:1] not in ("_", ".")]
    return sorted(found)


def read_comments(spark: SparkSession, patterns, schema: T.StructType = COMMENT) -> DataFrame:
    """S1 + U1: NDJSON comment files over many glob patterns, one JSON object per
    line, ``year`` from the file name. A file matched by several patterns is read
    once; a folder, such as the per-year sink writes, stands for its files. A file
    without a four-digit year in its name, and a line that is no JSON, fail the job."""
    files = expand_globs(spark, patterns)
    if not files:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("year", T.IntegerType())]))
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(files)
    path = F.col("_metadata.file_path")
    year = F.regexp_extract(path, YEAR_FROM_FILE, 1)
    return df.withColumn("year", F.when(year != "", year.cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("no year in file name: "), path))))


def read_labelled_csv(spark: SparkSession, path, schema: T.StructType | None = LABELLED) -> DataFrame:
    """CSV with a header; quoted text may hold newlines and doubled quotes."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if schema is not None:
        r = r.schema(schema).option("enforceSchema", False)
    return r.csv(path)


def read_label_config(spark: SparkSession, path: str) -> DataFrame:
    """The run config -> (pos, label, threshold), small and broadcastable.
    Missing thresholds default to 0.5; a missing max_length to 320."""
    cfg = spark.read.schema(LABEL_CONFIG).option("multiLine", True).json(path)
    thr = F.coalesce(F.col("thresholds"), F.array_repeat(F.lit(0.5), F.size("label_names")))
    z = cfg.select(F.posexplode(F.arrays_zip(F.col("label_names").alias("label"), thr.alias("threshold"))))
    return z.select(F.col("pos"), F.col("col.label").alias("label"),
                    F.coalesce(F.col("col.threshold"), F.lit(0.5)).alias("threshold"))


def read_config_scalars(spark: SparkSession, path: str) -> DataFrame:
    """Scalar settings with defaults (max_length 320, preprocessing flags)."""
    cfg = spark.read.schema(LABEL_CONFIG).option("multiLine", True).json(path)
    return cfg.select(F.coalesce("max_length", F.lit(320)).alias("max_length"),
                      F.col("preprocessing.use_title_prefix").alias("use_title_prefix"),
                      F.col("preprocessing.clean_like_old").alias("clean_like_old"),
                      "base_model", "seed")


def read_ids(spark: SparkSession, path: str, name: str = "comment_id") -> DataFrame:
    """One id per line; whitespace stripped, blank lines dropped."""
    t = spark.read.text(path)
    return t.select(F.trim(F.col("value")).alias(name)).filter(F.length(name) > 0)
