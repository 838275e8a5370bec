"""Skew-safe "first n rows per group" (caps, samples, first-wins dedup).

``row_number() over (partition by g order by k) <= n`` puts a whole group into
one task. A year (or a video, or a copied comment id) may hold a third of all
rows, so the ranking runs in two exact rounds:

1. rank inside ``(g, salt)`` where ``salt = pmod(xxhash64(tiebreak), buckets)``
   and keep the first n: the hot group is spread over ``buckets`` tasks, and
   Catalyst's WindowGroupLimit already prunes each map partition to n rows per
   ``(g, salt)`` before the shuffle;
2. rank the survivors (at most ``n * buckets`` per group) inside ``g``.

The first n of a union equal the first n of the union of each part's first n,
so the result is exact for any total order (the tiebreak columns must make the
order total).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SALT_BUCKETS = 32


def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def first_n(df: DataFrame, group_cols, order_cols, n: int, rank_col: str | None = None,
            salt_cols=None, buckets: int = DEFAULT_SALT_BUCKETS) -> DataFrame:
    """Keep the first ``n`` rows of each group under ``order_cols`` (a total order).

    ``salt_cols`` (default: the plain column names in ``order_cols``) feed the salt hash.
    With ``rank_col`` the final 1-based rank is kept as a column.
    """
    group = _cols(group_cols)
    order = _cols(order_cols)
    if salt_cols is None:
        salt_cols = [c for c in order_cols if isinstance(c, str)]
    rn = "__rn"
    if buckets > 1 and salt_cols:
        salt = F.pmod(F.xxhash64(*_cols(salt_cols)), F.lit(buckets))
        w1 = Window.partitionBy(*group, salt).orderBy(*order)
        df = df.withColumn(rn, F.row_number().over(w1)).filter(F.col(rn) <= n).drop(rn)
    w2 = Window.partitionBy(*group).orderBy(*order)
    out = df.withColumn(rn, F.row_number().over(w2)).filter(F.col(rn) <= n)
    if rank_col:
        return out.withColumnRenamed(rn, rank_col)
    return out.drop(rn)


def first_per_key(df: DataFrame, key_cols, order_cols) -> DataFrame:
    """First-wins deduplication: one row per key, the earliest under ``order_cols`` (column
    names; equal ones are settled by the other columns).

    A grouped minimum: copies meet in the map-side aggregate, so a hot key is
    reduced before the only shuffle."""
    first = [c for c in order_cols if c not in key_cols]
    rest = [c for c in df.columns if c not in key_cols and c not in first]
    least = df.groupBy(*key_cols).agg(F.min(F.struct(*first, *rest)).alias("__first"))
    return least.select(*key_cols, *[F.col(f"__first.{c}").alias(c) for c in [*first, *rest]]).select(*df.columns)
