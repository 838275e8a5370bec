"""Staged tables: written once to the shared folder and read back, which cuts
lineage and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tenor.session import checkpoint_dir, ensure_checkpoint_dir


#: Bytes of a row group of a staged table.
ROW_GROUP = 16 << 20


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under ``spark.checkpoint.dir`` and read it back. Only a
    local master without that setting (tests) gets a folder of its own."""
    spark = df.sparkSession
    base = checkpoint_dir(spark)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir (a shared folder) to stage intermediate tables")
        base = ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="tenor-"))
    path = f"{base.rstrip('/')}/tenor-stage/{name}-{uuid.uuid4().hex}"
    # Row groups are what a scan can deal out: small ones give even tasks, however uneven the files are.
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_at = path
    return back


def release(*staged: DataFrame) -> None:
    """Remove staged tables, once everything made of them is written."""
    for df in staged:
        Store(df.sparkSession).remove(df.staged_at)


class Store:
    """Names, small records and removals in whatever file system a path belongs to. No data passes through it."""

    def __init__(self, spark: SparkSession):
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._io = spark._jvm.org.apache.commons.io.IOUtils
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._hadoop.Path(path)
        return p, p.getFileSystem(self._conf)

    def list(self, path: str) -> list[tuple[str, int, bool]]:
        """(path, bytes, is a folder) of what stands directly in a folder; nothing if there is none."""
        p, fs = self._at(path)
        return [(str(s.getPath().toString()), s.getLen(), s.isDirectory()) for s in fs.listStatus(p)] if fs.exists(p) else []

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        with_ = fs.open(p)
        try:
            return self._io.toString(with_, "UTF-8")
        finally:
            with_.close()

    def replace(self, path: str, text: str) -> None:
        """Writes a small record beside its place and renames it there, so that no half of one is ever read."""
        p, fs = self._at(path)
        draft, _ = self._at(f"{path}.draft")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if fs.exists(p):
            fs.delete(p, False)
        if not fs.rename(draft, p):
            raise OSError(f"{path} could not be written")

    def remove(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)
