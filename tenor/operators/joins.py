"""Small driver-side tables as relations whose size the planner knows.

Joins with tables from outside (lexicons, id lists, video metadata) carry no
hint: Spark's own threshold and AQE's run-time sizes decide about a broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return f"CAST({float(v)!r} AS DOUBLE)" if isinstance(v, float) else str(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def local_table(spark, rows, names) -> DataFrame:
    """A small driver-side table as an inline VALUES relation: Catalyst knows its
    exact size."""
    body = ", ".join("(" + ", ".join(_sql_literal(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")

