"""Two-model merge (J2, J3) and hybrid inference (M6).

The reference assigns the specialist's columns by row position (D2). Here the
merge is an id join: base rows without a specialist row keep their base labels
and get null irony/sentiment columns; a duplicated specialist id raises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenor.schemas import LABELS, SENTIMENT_PROB_COLS, require_same_labels

SPECIALIST_LABEL = "irony"
SENTIMENT_COLS = SENTIMENT_PROB_COLS + ["sent_pred"]


def pred_join(base: DataFrame, other: DataFrame, key: str = "comment_id",
              suffixes=("_base", "_irony")) -> DataFrame:
    """Inner equi-join on the id as a string; columns present on both sides
    get the suffixes (as a pandas merge does)."""
    b = base.withColumn(key, F.col(key).cast("string"))
    o = other.withColumn(key, F.col(key).cast("string"))
    both = (set(b.columns) & set(o.columns)) - {key}
    b = b.select(key, *[F.col(c).alias(c + suffixes[0]) if c in both else F.col(c) for c in b.columns if c != key])
    o = o.select(key, *[F.col(c).alias(c + suffixes[1]) if c in both else F.col(c) for c in o.columns if c != key])
    return b.join(o, key, "inner")


def hybrid_merge(base: DataFrame, specialist: DataFrame, key: str = "comment_id", labels=LABELS,
                 specialist_label: str = SPECIALIST_LABEL, check_unique: bool = True) -> DataFrame:
    """All base columns; the specialist label's prob/pred and the four
    sentiment columns come from the specialist, the other labels from base."""
    take = [f"{specialist_label}_ft_prob", f"{specialist_label}_ft_pred", *SENTIMENT_COLS]
    spec = specialist.select(F.col(key).cast("string").alias(key), *[F.col(c).alias(f"__s_{c}") for c in take])
    out = base.withColumn(key, F.col(key).cast("string")).join(spec, key, "left")
    if check_unique:
        # The check lives inside the key column so column pruning cannot drop it.
        # The join output is hash-partitioned and sorted by key, so this window
        # adds no exchange.
        dup = F.count(F.col(f"__s_{take[0]}")).over(Window.partitionBy(key))
        out = out.withColumn(key, F.when(dup > 1, F.raise_error(
            F.concat(F.lit("duplicate specialist id: "), F.col(key)))).otherwise(F.col(key)))
    cols = [F.col(f"__s_{c}").alias(c) if c in take else F.col(c) for c in base.columns]
    return out.select(*cols)


def check_label_lists(labels_base, labels_specialist) -> None:
    """P10: both models must predict the same labels in the same order."""
    require_same_labels(labels_base, labels_specialist, "Label order mismatch between models")
