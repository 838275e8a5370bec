"""Sinks (K1-K5). Writes are whole-job outputs to shared storage; Spark's
commit protocol makes a failed or retried task leave no partial file behind."""

from __future__ import annotations

import json
import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenor.schemas import YEAR_COMMIT
from tenor.staging import Store

#: The records stand beside the sink's folder, so that no pattern of its files meets them.
COMMITS = ".commits"
YEAR_FOLDER = re.compile(r"year=(-?\d+|__HIVE_DEFAULT_PARTITION__)$")


def write_ndjson_by_year(df: DataFrame, path: str, mode: str = "overwrite", years=None) -> str:
    """K1: one NDJSON file set per year; null fields are written (not dropped);
    non-ASCII text is kept as is. Returns the id of the run.

    Only the years that ``df`` holds are replaced (dynamic partition overwrite):
    the other years of the folder stay. ``years`` names years of this run that may
    hold nothing; those without rows are emptied. New files stand in a staging
    folder until the job commits, so a failed write leaves the old years as they were.

    After the commit a record per replaced year is written to the folder ``path.commits``
    (run, time, files and their bytes). A year whose files are not those of its
    record was cut off between the two steps: :func:`uncommitted_years`."""
    spark, run = df.sparkSession, uuid.uuid4().hex
    writer = df.write.mode(mode).option("ignoreNullFields", False).option("encoding", "UTF-8")
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    before = _files_by_year(spark, path)
    writer.partitionBy("year").json(path)
    now = _files_by_year(spark, path)
    store = Store(spark)
    for year in map(str, years or ()):
        if mode == "overwrite" and year in before and now.get(year) == before[year]:  # the run holds nothing of it
            store.remove(f"{path}/year={year}")
            now.pop(year)
    known = _records(spark, path)
    stated = {str(y) for y in years or ()}
    for year in sorted(set(now) | stated):
        files = now.get(year, {})
        if year in stated or known.get(year, {}).get("files") != files:
            record = {"year": year, "run": run, "written_at": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), "files": files}
            store.replace(f"{path.rstrip('/')}{COMMITS}/year-{year}.json", json.dumps(record))
    return run


def _files_by_year(spark: SparkSession, path: str) -> dict[str, dict[str, int]]:
    """{year: {file: bytes}} of what stands in the year folders (names only, no data is read)."""
    store, out = Store(spark), {}
    for folder, _, is_folder in store.list(path):
        m = YEAR_FOLDER.search(folder)
        if m and is_folder:
            out[m[1]] = {f.rsplit("/", 1)[1]: n for f, n, deeper in store.list(folder) if not deeper and not f.rsplit("/", 1)[1].startswith(("_", "."))}
    return out


def _records(spark: SparkSession, path: str) -> dict[str, dict]:
    store = Store(spark)
    found = [json.loads(store.read(f)) for f, _, _ in store.list(path.rstrip("/") + COMMITS) if f.endswith(".json")]
    return {r["year"]: r for r in found}


def year_commits(spark: SparkSession, path: str) -> DataFrame:
    """The commit records of a per-year sink: year, run, time, number of files and bytes."""
    rows = [(None if y.startswith("__") else int(y), r["run"], r["written_at"], len(r["files"]), sum(r["files"].values())) for y, r in _records(spark, path).items()]
    return spark.createDataFrame(rows, YEAR_COMMIT)


def uncommitted_years(spark: SparkSession, path: str) -> list[str]:
    """Years whose files differ from their commit record: a run died between its commit and its record, or files were
    changed by hand. Rerunning the year mends it."""
    now, known = _files_by_year(spark, path), _records(spark, path)
    return sorted(y for y in set(now) | set(known) if now.get(y, {}) != known.get(y, {}).get("files", None if y in now else {}))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2: header, no index, quotes doubled, whitespace kept."""
    (df.write.mode(mode).option("header", True).option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .csv(path))


def write_json_record(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K3: a small record (metrics, frequencies, config, provenance) as one JSON file."""
    df.coalesce(1).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_split_ids(df: DataFrame, path: str, key: str = "comment_id", mode: str = "overwrite") -> None:
    """K4: one text file set per split, one id per line."""
    df.select(F.col(key).cast("string").alias("value"), "split").write.mode(mode).partitionBy("split").text(path)


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K5: the per-label report (A7) as CSV."""
    write_csv(report.orderBy("row_no"), path, mode)
