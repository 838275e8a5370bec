"""Publication: year-level aggregates only.

The data policy forbids publishing ids, user names, urls or raw text. Every
published table is an aggregate grouped by year, built here, and checked: by its
column names, and by where its columns come from (:mod:`tenor.operators.lineage`),
so a renamed or derived id is refused too. Counts of very few comments can be
suppressed before they are published.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenor.operators.lineage import private_columns
from tenor.schemas import LABELS, SENSITIVE_COLUMNS


class PublicationError(ValueError):
    pass


def assert_public(df: DataFrame, allowed_keys=("year",), sensitive=SENSITIVE_COLUMNS) -> DataFrame:
    """No sensitive column survives, under its own name or another; the table must be grouped by ``allowed_keys``."""
    bad = [c for c in df.columns if c in sensitive]
    if bad:
        raise PublicationError(f"sensitive columns in a public table: {bad}")
    private = private_columns(df, sensitive)
    if private:
        raise PublicationError("columns of a public table show sensitive ones: " + "; ".join(f"{c} shows {', '.join(src)}" for c, src in private.items()))
    missing = [k for k in allowed_keys if k not in df.columns]
    if missing:
        raise PublicationError(f"public tables are grouped by {list(allowed_keys)}; missing {missing}")
    return df


def suppress_small_cells(df: DataFrame, total: str, counts, least: int = 10, allowed_keys=("year",)) -> DataFrame:
    """A table of counts without cells of few comments. Rows whose ``total`` is below ``least`` go; of the others every
    count between 1 and least - 1 becomes null, and so does one that leaves fewer than ``least`` others in its row (the
    total would tell them)."""
    few = lambda c: (F.col(c) > 0) & (F.col(c) < least) | (F.col(total) - F.col(c) > 0) & (F.col(total) - F.col(c) < least)
    out = df.filter(F.col(total) >= least).withColumns({c: F.when(~few(c), F.col(c)) for c in counts})
    return assert_public(out, allowed_keys)


def yearly_rates(df: DataFrame, labels=LABELS, pred_suffix: str = "_ft_pred") -> DataFrame:
    """Per year, the share of comments flagged by each indicator and the
    sentiment shares, full precision, sorted by year."""
    rates = [F.avg(F.col(f"{c}{pred_suffix}").cast("double")).alias(f"{c}_rate") for c in labels]
    sent = [F.avg((F.col("sent_pred") == v).cast("double")).alias(f"sent_{n}_rate")
            for n, v in (("neg", -1), ("neu", 0), ("pos", 1))]
    return df.groupBy("year").agg(F.count(F.lit(1)).alias("n_comments"), *rates, *sent).orderBy("year")


def public_view(df: DataFrame, labels=LABELS, pred_suffix: str = "_ft_pred") -> DataFrame:
    """Drop every sensitive column, aggregate per year (counts only), check."""
    safe = df.drop(*[c for c in SENSITIVE_COLUMNS if c in df.columns])
    out = safe.groupBy("year").agg(
        F.count(F.lit(1)).alias("n_comments"),
        *[F.sum(F.col(f"{c}{pred_suffix}").cast("bigint")).alias(f"n_{c}") for c in labels])
    return assert_public(out)
