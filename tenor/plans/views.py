"""Test-table mapping: the driver's tables are not comments, so each
registered query starts from a view built the same way in Spark and in SQL.

The Spark side is a DataFrame function; the SQL side is a CTE of the same
name. Expressions that are plain arithmetic/CASE are written once as SQL text
(valid in both engines) so that the two definitions cannot drift apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenor.functions.text import LETTER
from tenor.functions.time import iso, plus_seconds, year_start_ntz
from tenor.schemas import LABELS

# Multipliers of the two pseudo-model probability views (base, specialist).
BASE_MULT = 7919
IRONY_MULT = 104729
# Own values: any will do, as long as labels differ.
BASE_THRESHOLDS = [round(0.25 + 0.05 * j, 2) for j in range(10)]
IRONY_THRESHOLDS = [round(0.7 - 0.05 * j, 2) for j in range(10)]

# Gold labels: two come from the labels table, the rest by arithmetic on doc_id.
LABEL_EXPR = {
    "Spam_flag": "CAST(toxic AS INT)",
    "irony": "CAST(quality AS INT)",
    "distrust": "CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END",
    "trust": "CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END",
    "hostility": "CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END",
    "concept_misinfo": "CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END",
    "believe_misinfo": "CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END",
    "Accuse_misinfo": "CASE WHEN doc_id % 19 = 0 THEN 1 ELSE 0 END",
    "cogni_dis_manual": "CASE WHEN doc_id % 23 = 0 THEN 1 ELSE 0 END",
    "discrim_manual": "CASE WHEN doc_id % 29 = 0 THEN 1 ELSE 0 END",
}
SENTIMENT_EXPR = "CAST(doc_id % 3 - 1 AS INT)"
TITLE_RE = "<title>([^<]*)</title>"
HOST_RE = "://([^/]+)"


def prob_expr(mult: int, j: int, alias_id: str = "doc_id") -> str:
    return f"CAST(({alias_id} * {mult} + {13 * j}) % 1000 AS DOUBLE) / 1000"


def logit_expr(mult: int, j: int, alias_id: str = "doc_id") -> str:
    return f"CAST(({alias_id} * {mult} + {13 * j}) % 1000 - 500 AS DOUBLE) / 100"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ----------------------------------------------------------------------------
# Spark views


def comments(spark: SparkSession, sf_dir: str, with_removed: bool = False) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    year = (F.lit(2010) + F.col("doc_id") % 15).cast("int")
    rows = d.select(
        F.col("doc_id").cast("string").alias("comment_id"),
        F.col("doc_id"),
        F.col("source").alias("video_id"),
        year.alias("year"),
        iso(plus_seconds(year_start_ntz(year), (F.col("doc_id") * 7919) % 31536000)).alias("published_at"),
        F.col("text"),
        F.col("lang"),
        F.expr("CAST(doc_id div 100 AS INT)").alias("page"),
        F.expr("CAST(doc_id % 100 AS INT)").alias("pos"),
    )
    if not with_removed:
        return rows
    # Every document stays; one in ten comes again under a new id without its letters.
    bare = rows.filter(F.col("doc_id") % 10 == 0).withColumns({
        "comment_id": F.concat(F.lit("r"), F.col("comment_id")), "text": F.regexp_replace("text", LETTER, "")})
    return rows.unionByName(bare)


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    year = (F.lit(2010) + F.col("page_id") % 15).cast("int")
    return p.select(
        F.concat(F.lit("src"), F.col("page_id").cast("string")).alias("video_id"),
        F.regexp_extract("html", TITLE_RE, 1).alias("title"),
        F.col("url").alias("description"),
        F.regexp_extract("url", HOST_RE, 1).alias("channel_title"),
        year.alias("year"),
        iso(plus_seconds(year_start_ntz(year), (F.col("page_id") * 104729) % 31536000)).alias("published_at"),
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("video_id"))
    v = videos(spark, sf_dir).select("video_id", F.col("title").alias("video_title"))
    base = lab.join(docs, "doc_id").join(v, "video_id", "left")
    return base.select(
        F.col("doc_id").cast("string").alias("comment_id"), "doc_id", "text", "video_title",
        F.expr(SENTIMENT_EXPR).alias("sentiment"),
        *[F.expr(LABEL_EXPR[name]).alias(name) for name in LABELS],
    )


def model_outputs(df: DataFrame, mult: int) -> DataFrame:
    """Pseudo-model outputs per row: ten label probabilities/logits, three sentiment logits."""
    return df.select(
        "*",
        *[F.expr(prob_expr(mult, j)).alias(f"{name}_p") for j, name in enumerate(LABELS)],
        *[F.expr(logit_expr(mult, j)).alias(f"{name}_logit") for j, name in enumerate(LABELS)],
        *[F.expr(logit_expr(mult, 10 + k)).alias(f"s{k}") for k in range(3)],
    )


# ----------------------------------------------------------------------------
# SQL views (DuckDB), same names and columns

def _iso_sql(year_sql: str, secs_sql: str) -> str:
    return (f"strftime(make_timestamp(CAST({year_sql} AS BIGINT), 1, 1, 0, 0, 0) + "
            f"to_seconds({secs_sql}), '%Y-%m-%dT%H:%M:%SZ')")


SQL_VIEWS: dict[str, tuple[list[str], str]] = {
    "comments": ([], f"""
        SELECT CAST(doc_id AS VARCHAR) AS comment_id, doc_id, source AS video_id,
               CAST(2010 + doc_id % 15 AS INTEGER) AS year,
               {_iso_sql('2010 + doc_id % 15', '(doc_id * 7919) % 31536000')} AS published_at,
               text, lang, CAST(doc_id // 100 AS INTEGER) AS page, CAST(doc_id % 100 AS INTEGER) AS pos
        FROM documents"""),
    "raw_comments": (["comments"], f"""
        SELECT * FROM comments UNION ALL
        SELECT 'r' || comment_id, doc_id, video_id, year, published_at, regexp_replace(text, '{LETTER}', '', 'g'), lang, page, pos
        FROM comments WHERE doc_id % 10 = 0"""),
    "videos": ([], f"""
        SELECT 'src' || CAST(page_id AS VARCHAR) AS video_id,
               regexp_extract(html, '{TITLE_RE}', 1) AS title,
               url AS description,
               regexp_extract(url, '{HOST_RE}', 1) AS channel_title,
               CAST(2010 + page_id % 15 AS INTEGER) AS year,
               {_iso_sql('2010 + page_id % 15', '(page_id * 104729) % 31536000')} AS published_at
        FROM pages"""),
    "gold": (["videos"], """
        SELECT CAST(l.doc_id AS VARCHAR) AS comment_id, l.doc_id, d.text, v.title AS video_title,
               {sent} AS sentiment, {labels}
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id
        LEFT JOIN videos v ON v.video_id = d.source""".format(
        sent=SENTIMENT_EXPR.replace("doc_id", "l.doc_id"),
        labels=", ".join(f"{LABEL_EXPR[n].replace('doc_id', 'l.doc_id')} AS {n}" for n in LABELS))),
}


def _outputs_sql(name: str, src: str, mult: int) -> tuple[list[str], str]:
    cols = ", ".join(
        [f"{prob_expr(mult, j)} AS {n}_p" for j, n in enumerate(LABELS)]
        + [f"{logit_expr(mult, j)} AS {n}_logit" for j, n in enumerate(LABELS)]
        + [f"{logit_expr(mult, 10 + k)} AS s{k}" for k in range(3)])
    return [src], f"SELECT *, {cols} FROM {src}"


SQL_VIEWS["gold_base"] = _outputs_sql("gold_base", "gold", BASE_MULT)
SQL_VIEWS["gold_irony"] = _outputs_sql("gold_irony", "gold", IRONY_MULT)


def register_sql_view(name: str, deps: list[str], body: str) -> None:
    SQL_VIEWS[name] = (deps, body)


def with_views(*names: str) -> str:
    """``WITH`` clause holding the named views and their dependencies, in order."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in ordered:
            return
        for d in SQL_VIEWS[n][0]:
            visit(d)
        ordered.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({SQL_VIEWS[n][1]})" for n in ordered) + "\n"


# ----------------------------------------------------------------------------
# Prediction tables of the two pseudo-models (Spark), and their SQL twins.

def predictions(spark: SparkSession, sf_dir: str, which: str = "base") -> DataFrame:
    from tenor.operators.model import prediction_columns
    from tenor.schemas import PREDICTION_COLS
    mult, thr = (BASE_MULT, BASE_THRESHOLDS) if which == "base" else (IRONY_MULT, IRONY_THRESHOLDS)
    g = gold(spark, sf_dir)
    out = prediction_columns(model_outputs(g, mult), LABELS, thr)
    return out.select(*g.columns, *PREDICTION_COLS)


def _pred_sql(src: str, thresholds) -> str:
    cols = []
    for n, t in zip(LABELS, thresholds):
        cols += [f"{n}_p AS {n}_ft_prob", f"CAST({n}_p >= CAST({float(t)!r} AS DOUBLE) AS INTEGER) AS {n}_ft_pred"]
    return f"""
        SELECT comment_id, doc_id, text, video_title, sentiment, {', '.join(LABELS)}, {', '.join(cols)},
               e0 / (e0 + e1 + e2) AS sent_neg_prob, e1 / (e0 + e1 + e2) AS sent_neu_prob,
               e2 / (e0 + e1 + e2) AS sent_pos_prob
        FROM (SELECT *, exp(s0 - greatest(s0, s1, s2)) AS e0, exp(s1 - greatest(s0, s1, s2)) AS e1,
                        exp(s2 - greatest(s0, s1, s2)) AS e2 FROM {src})"""


_SENT_PRED = ("CASE WHEN sent_neg_prob >= sent_neu_prob AND sent_neg_prob >= sent_pos_prob THEN -1 "
              "WHEN sent_neu_prob >= sent_pos_prob THEN 0 ELSE 1 END")
SQL_VIEWS["pred_base0"] = (["gold_base"], _pred_sql("gold_base", BASE_THRESHOLDS))
SQL_VIEWS["pred_irony0"] = (["gold_irony"], _pred_sql("gold_irony", IRONY_THRESHOLDS))
SQL_VIEWS["pred_base"] = (["pred_base0"], f"SELECT *, {_SENT_PRED} AS sent_pred FROM pred_base0")
SQL_VIEWS["pred_irony"] = (["pred_irony0"], f"SELECT *, {_SENT_PRED} AS sent_pred FROM pred_irony0")
SQL_VIEWS["strata"] = (["gold"], f"""
        SELECT *, CAST(sentiment + 1 AS INTEGER) AS sent_class,
               CASE WHEN greatest({', '.join(LABELS)}) > 0 THEN 1 ELSE 0 END AS any_pos,
               CAST((CASE WHEN greatest({', '.join(LABELS)}) > 0 THEN 1 ELSE 0 END) * 3 + sentiment + 1 AS INTEGER)
                 AS stratum
        FROM gold""")
SQL_VIEWS["split"] = (["strata"], """
        SELECT comment_id, stratum,
               CASE WHEN rn <= (7 * n + 5) // 10 THEN 'train'
                    WHEN rn <= (17 * n + 10) // 20 THEN 'val' ELSE 'test' END AS split
        FROM (SELECT comment_id, stratum,
                     row_number() OVER (PARTITION BY stratum ORDER BY md5(comment_id || ':42'), comment_id) AS rn,
                     count(*) OVER (PARTITION BY stratum) AS n
              FROM strata)""")
_SPEC = ["irony_ft_prob", "irony_ft_pred", "sent_neg_prob", "sent_neu_prob", "sent_pos_prob", "sent_pred"]
SQL_VIEWS["hybrid"] = (["pred_base", "pred_irony"], """
        SELECT b.* REPLACE ({repl})
        FROM pred_base b LEFT JOIN pred_irony i ON i.comment_id = b.comment_id""".format(
    repl=", ".join(f"i.{c} AS {c}" for c in _SPEC)))
SQL_VIEWS["hybrid_test"] = (["hybrid", "split"], """
        SELECT h.* FROM hybrid h WHERE h.comment_id IN (SELECT comment_id FROM split WHERE split = 'test')""")


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tenor.operators.hybrid import hybrid_merge
    return hybrid_merge(predictions(spark, sf_dir, "base"), predictions(spark, sf_dir, "irony"))


def split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tenor.operators.labels import build_labels, stratified_split
    return stratified_split(build_labels(gold(spark, sf_dir)))


def hybrid_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tenor.operators.labels import split_ids, test_subset
    return test_subset(hybrid(spark, sf_dir), split_ids(split_table(spark, sf_dir), "test"))


# ----------------------------------------------------------------------------
# Collection inputs: landed comments (ids from the text, so exact copies of a
# text are one comment seen twice), sampled (year, video) pairs, search hits.

def landed_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = comments(spark, sf_dir)
    return c.select(F.substring(F.md5("text"), 1, 16).alias("comment_id"), "video_id", "year", "page", "pos",
                    "published_at", "text", "lang")


def sampled_pairs(landed: DataFrame) -> DataFrame:
    """Every (year, video) of the landed comments; the sample order of a video is
    the number in its id (``srcN`` -> N), so no ranking window is needed."""
    pairs = landed.select("year", "video_id").distinct()
    return pairs.withColumn("video_rank", F.expr("CAST(substring(video_id, 4) AS INT)"))


def event_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tenor.functions.time import epoch_seconds
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").cast("string").alias("video_id"),
                    epoch_seconds("ts").alias("ts_s"), F.col("value").alias("views"),
                    F.col("event_type").alias("term"), F.year("ts").cast("int").alias("year"))


def event_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").cast("string").alias("video_id"), F.year("ts").cast("int").alias("year"),
                    F.concat(F.lit("video "), F.col("event_id").cast("string")).alias("title"),
                    F.col("props").alias("description"),
                    F.concat(F.lit("channel "), F.col("user_id").cast("string")).alias("channel_title"),
                    F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"))


SQL_VIEWS["landed"] = (["comments"], """
        SELECT substr(md5(text), 1, 16) AS comment_id, video_id, year, page, pos, published_at, text, lang
        FROM comments""")
SQL_VIEWS["sampled"] = (["landed"], """
        SELECT year, video_id, CAST(substring(video_id, 4) AS INTEGER) AS video_rank
        FROM (SELECT DISTINCT year, video_id FROM landed)""")
SQL_VIEWS["hits"] = ([], """
        SELECT CAST(event_id AS VARCHAR) AS video_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s, value AS views,
               event_type AS term, CAST(year(ts) AS INTEGER) AS year
        FROM events""")
SQL_VIEWS["hit_videos"] = ([], """
        SELECT CAST(event_id AS VARCHAR) AS video_id, CAST(year(ts) AS INTEGER) AS year,
               'video ' || CAST(event_id AS VARCHAR) AS title, props AS description,
               'channel ' || CAST(user_id AS VARCHAR) AS channel_title,
               strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS published_at
        FROM events""")
