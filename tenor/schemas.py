"""Explicit schemas (nothing is inferred) and column contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for the same results.
# Label order of the two-headed classifier, as configured and evaluated.
LABELS = [
    "Spam_flag", "irony", "distrust", "trust", "hostility",
    "concept_misinfo", "believe_misinfo", "Accuse_misinfo",
    "cogni_dis_manual", "discrim_manual",
]
# Header variants renamed to the canonical names, only if the target is absent.
LABEL_RENAMES = {"Cogni_dis_manual": "cogni_dis_manual", "discrim_ manual": "discrim_manual"}
# Sentiment classes: gold -1/0/1 <-> class index 0/1/2 (neg, neu, pos).
SENTIMENT_PROB_COLS = ["sent_neg_prob", "sent_neu_prob", "sent_pos_prob"]
# Columns never published (data policy): ids, user names, urls, raw text.
SENSITIVE_COLUMNS = [
    "comment_id", "video_id", "channel_id", "channel_title", "author", "user_name",
    "url", "text", "text_lower", "text_proc", "video_title", "description",
]
# ---------------------------------------------------------------------------

S = T.StringType()
D = T.DoubleType()

COMMENT = T.StructType([
    T.StructField("comment_id", S), T.StructField("video_id", S),
    T.StructField("text", S), T.StructField("published_at", S),
    T.StructField("video_title", S), T.StructField("video_published_at", S),
])

#: Record of a committed year of a per-year sink.
YEAR_COMMIT = T.StructType([
    T.StructField("year", T.IntegerType()), T.StructField("run", S), T.StructField("written_at", S),
    T.StructField("n_files", T.IntegerType()), T.StructField("n_bytes", T.LongType()),
])

SEARCH_PAGE = T.StructType([
    T.StructField("year", T.IntegerType()), T.StructField("window_start", S),
    T.StructField("window_end", S), T.StructField("term", S), T.StructField("ord", S),
    T.StructField("page", T.IntegerType()),
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("id", T.StructType([T.StructField("videoId", S)])),
        T.StructField("statistics", T.StructType([T.StructField("viewCount", D)])),
        T.StructField("snippet", T.StructType([T.StructField("publishedAt", S)])),
    ]))),
])

VIDEO_PAGE = T.StructType([
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("id", S),
        T.StructField("snippet", T.StructType([
            T.StructField("title", S), T.StructField("description", S),
            T.StructField("channelTitle", S), T.StructField("publishedAt", S),
        ])),
    ]))),
])

COMMENT_PAGE = T.StructType([
    T.StructField("video_id", S), T.StructField("page", T.IntegerType()),
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("snippet", T.StructType([
            T.StructField("topLevelComment", T.StructType([
                T.StructField("id", S),
                T.StructField("snippet", T.StructType([
                    T.StructField("publishedAt", S), T.StructField("textDisplay", S),
                ])),
            ])),
        ])),
    ]))),
])

LABELLED = T.StructType(
    [T.StructField("comment_id", S), T.StructField("text", S), T.StructField("video_title", S),
     T.StructField("sentiment", T.IntegerType())]
    + [T.StructField(name, T.IntegerType()) for name in LABELS]
)

PREDICTION_COLS = (
    [c for name in LABELS for c in (f"{name}_ft_prob", f"{name}_ft_pred")]
    + SENTIMENT_PROB_COLS + ["sent_pred"]
)

LABEL_CONFIG = T.StructType([
    T.StructField("label_names", T.ArrayType(S)),
    T.StructField("thresholds", T.ArrayType(D)),
    T.StructField("base_model", S),
    T.StructField("max_length", T.IntegerType()),
    T.StructField("preprocessing", T.StructType([
        T.StructField("use_title_prefix", T.BooleanType()),
        T.StructField("clean_like_old", T.BooleanType()),
    ])),
    T.StructField("seed", T.IntegerType()),
    T.StructField("trained_on", S),
    T.StructField("loss_weights", T.StructType([
        T.StructField("lambda_sent", D), T.StructField("lambda_multi", D),
        T.StructField("irony_sent_extra", D),
    ])),
    T.StructField("model_type", S),
    T.StructField("timestamp", S),
])


class ContractError(ValueError):
    """A required column is missing or label orders disagree (checked before any job)."""


def require_columns(df: DataFrame, cols, what: str = "columns") -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ContractError(f"Missing expected {what}: {missing}")


def require_labels(df: DataFrame, labels=LABELS) -> None:
    require_columns(df, labels, "binary label columns")
    require_columns(df, ["sentiment"], "sentiment column")


def require_predictions(df: DataFrame, labels=LABELS) -> None:
    require_columns(df, [f"{c}_ft_pred" for c in labels], "prediction columns")
    require_columns(df, ["sentiment", "sent_pred"], "sentiment gold/prediction columns")


def require_same_labels(a, b, what: str = "label order") -> None:
    if list(a) != list(b):
        raise ContractError(f"{what} mismatch: {list(a)} != {list(b)}")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Canonical label headers; a rename happens only if the target is absent."""
    renames = {src: dst for src, dst in LABEL_RENAMES.items()
               if src in df.columns and dst not in df.columns}
    return df.withColumnsRenamed(renames) if renames else df
