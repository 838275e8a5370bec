"""Staging, sizing and Arrow helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenor.session import checkpoint_dir, ensure_checkpoint_dir


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only on a local master without it (tests)."""
    d = checkpoint_dir(spark)
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="tenor-llm-")).rstrip("/")


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tenor-llm/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_at = path
    return back


def drop_stage(staged: DataFrame) -> None:
    """Remove a table that ``stage`` returned, once what was made of it is written."""
    spark = staged.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(staged.staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_size(df: DataFrame, text: str | Column) -> tuple[int, int]:
    """(rows, bytes of text): two numbers that size the buckets of what follows."""
    text = F.col(text) if isinstance(text, str) else text
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()
    return r["n"], r["b"]


def fan_out(total: float, each: float) -> int:
    """Buckets such that one holds about ``each`` of ``total``."""
    return max(1, -int(-total // each))


def byte_views(column: pa.Array) -> Iterator[memoryview | None]:
    """Each text of a string array as a view of its UTF-8 bytes; None for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    valid = column.is_valid().to_pylist() if column.null_count else None
    for i in range(len(column)):
        yield view[offs[i]:offs[i + 1]] if valid is None or valid[i] else None


def free_name(df: DataFrame, want: str) -> str:
    """``want``, with underscores added until no column of ``df`` has that name (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while want.lower() in taken:
        want += "_"
    return want
