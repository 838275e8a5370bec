"""Registered queries (one per SURVEY §2 key) and their DuckDB oracles.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver's tables via the
views of :mod:`tenor.plans.views`; each oracle is SQL over the same tables.
Computed columns carry the same aliases on both sides and final doubles are
rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenor.functions.numeric import round6, sentiment_label
from tenor.functions.text import (DISTRUST_TERMS, HANDLE, NON_SPACE, SPACE, TRUST_TERMS, URL,
                                  clean_text, with_title_prefix)
from tenor.operators import keywords as kw
from tenor.operators import lexicon as lx
from tenor.operators import text as tx
from tenor.plans import sqlgen as sg
from tenor.plans import views as V
from tenor.sources import pages as pg
from tenor.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return run
    return deco


def r6(cols):
    return [round6(c).alias(c) for c in cols]


def r6_sql(cols, prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{c}, 6) AS {c}" for c in cols)


# Frequent strings of the driver's invented prose, used where the reference's
# own keyword lists never match that text (they are exercised in pytest).
FREQUENT_TERMS = ["the", "and", "tion", "der", "que", "ment", "ein"]

# ----------------------------------------------------------------------------
# Lexicon job: kept/removed, cap, scores, flags, labels, summary, terms, sample

def _kept_removed(spark, sf_dir):
    return tx.split_letters(V.comments(spark, sf_dir, with_removed=True))


# Caps small enough that rows are lost to them at every test size.
YEAR_CAP, SAMPLE_CAP, VIDEO_CAP, INGEST_CAP, FILL_TARGET = 12, 5, 4, 10, 150


def _capped(spark, sf_dir, n=lx.MAX_PER_YEAR):
    kept, _ = _kept_removed(spark, sf_dir)
    return lx.cap_per_year(kept, n)


LETTERS = sg.has_letter_sql("text")
SQL_KEPT = V.with_views("raw_comments") + ", kept AS (SELECT * FROM raw_comments WHERE {m})".format(m=LETTERS)
SQL_CAPPED = SQL_KEPT + """, capped AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY year ORDER BY published_at ASC NULLS LAST, comment_id) AS rn
    FROM kept) WHERE rn <= 10000)"""
SQL_CAPPED_SMALL = SQL_CAPPED.replace("rn <= 10000", f"rn <= {YEAR_CAP}")


@register("letters_kept", SQL_KEPT + " SELECT comment_id, year, published_at, text FROM kept")
def q_letters_kept(spark, sf_dir):
    kept, _ = _kept_removed(spark, sf_dir)
    return kept.select("comment_id", "year", "published_at", "text")


@register("letters_removed", V.with_views("raw_comments")
          + f" SELECT comment_id, year, published_at, text FROM raw_comments WHERE NOT {LETTERS}")
def q_letters_removed(spark, sf_dir):
    _, removed = _kept_removed(spark, sf_dir)
    return removed.select("comment_id", "year", "published_at", "text")


@register("year_cap", SQL_CAPPED_SMALL + " SELECT comment_id, year, published_at FROM capped")
def q_year_cap(spark, sf_dir):
    return _capped(spark, sf_dir, YEAR_CAP).select("comment_id", "year", "published_at")


FLAGS_SQL = (f"{sg.contains_any_sql('text_lower', DISTRUST_TERMS)} AS is_distrust, "
             f"{sg.contains_any_sql('text_lower', TRUST_TERMS)} AS is_trust")


# Keyword lists as data: a word and a pair of words of every benchmark item.
KEYWORD_SQL = """WITH kw AS (SELECT string_split(lower(text), ' ') AS w FROM benchmark WHERE text IS NOT NULL),
terms AS (SELECT DISTINCT * FROM (SELECT 'word' AS list, w[5] AS term FROM kw UNION ALL SELECT 'pair' AS list, w[2] || ' ' || w[3] AS term FROM kw) WHERE length(term) > 0),
low AS (SELECT doc_id, lower(COALESCE(text, '')) AS t FROM documents),
hits AS (SELECT doc_id, list, term, CAST((length(t) - length(replace(t, term, ''))) / length(term) AS BIGINT) AS n FROM low, terms WHERE contains(t, term))"""


def _keywords(spark, sf_dir):
    w = F.split(F.lower("text"), " ")
    pick = F.array(F.struct(F.lit("word").alias("list"), F.get(w, 4).alias("term")), F.struct(F.lit("pair").alias("list"), F.concat(F.get(w, 1), F.lit(" "), F.get(w, 2)).alias("term")))
    terms = V.table(spark, sf_dir, "benchmark").select(F.inline(pick)).filter(F.length("term") > 0)
    return V.table(spark, sf_dir, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t")), terms


@register("keyword_counts", KEYWORD_SQL + """ SELECT list, term, CAST(COALESCE(sum(n), 0) AS BIGINT) AS "count", count(n) AS n_texts
  FROM terms LEFT JOIN hits USING (list, term) GROUP BY list, term""")
def q_keyword_counts(spark, sf_dir):
    """A2 with lists as a table: one pass, whatever their length."""
    return kw.keyword_counts(*_keywords(spark, sf_dir), text="t")


@register("keyword_lists", KEYWORD_SQL + " SELECT doc_id, list, count(*) AS n_terms, CAST(sum(n) AS BIGINT) AS n_hits FROM hits GROUP BY doc_id, list")
def q_keyword_lists(spark, sf_dir):
    """P11 with lists as a table."""
    return kw.keyword_lists(*_keywords(spark, sf_dir), key="doc_id", text="t")


@register("trust_flags", V.with_views("comments")
          + f", low AS (SELECT comment_id, COALESCE(lower(text), '') AS text_lower FROM comments)"
          + f" SELECT comment_id, {FLAGS_SQL} FROM low")
def q_trust_flags(spark, sf_dir):
    return lx.add_flags(V.comments(spark, sf_dir)).select("comment_id", "is_distrust", "is_trust")


@register("keyword_flags_frequent", V.with_views("comments")
          + ", low AS (SELECT comment_id, COALESCE(lower(text), '') AS text_lower FROM comments)"
          + f" SELECT comment_id, {sg.contains_any_sql('text_lower', FREQUENT_TERMS[:3])} AS is_distrust,"
          + f" {sg.contains_any_sql('text_lower', FREQUENT_TERMS[3:])} AS is_trust FROM low")
def q_keyword_flags_frequent(spark, sf_dir):
    df = lx.add_flags(V.comments(spark, sf_dir), distrust=FREQUENT_TERMS[:3], trust=FREQUENT_TERMS[3:])
    return df.select("comment_id", "is_distrust", "is_trust")


def _scored_comments(spark, sf_dir, rules=False):
    return lx.score(V.comments(spark, sf_dir), lx.seed_valence(spark), lx.seed_polarity(spark), rules=rules,
                    keep=[])


VADER = ["vader_neg", "vader_neu", "vader_pos", "vader_compound"]
TB = ["tb_polarity", "tb_subjectivity"]
SQL_SCORED = V.with_views("comments") + "," + sg.score_ctes("scored", "comments")


@register("valence_scores", SQL_SCORED + f" SELECT comment_id, {r6_sql(VADER)} FROM scored")
def q_valence_scores(spark, sf_dir):
    return _scored_comments(spark, sf_dir).select("comment_id", *r6(VADER))


@register("polarity_scores", SQL_SCORED + f" SELECT comment_id, {r6_sql(TB)} FROM scored")
def q_polarity_scores(spark, sf_dir):
    return _scored_comments(spark, sf_dir).select("comment_id", *r6(TB))


@register("valence_rules", V.with_views("comments") + "," + sg.rules_ctes("rules", "comments")
          + f" SELECT comment_id, {r6_sql(VADER)} FROM rules")
def q_valence_rules(spark, sf_dir):
    """M1 with all rules (boosters, caps, negation, but, punctuation)."""
    return _scored_comments(spark, sf_dir, rules=True).select("comment_id", *r6(VADER))


SENT_LABEL_SQL = ("CASE WHEN vader_compound >= 0.05 THEN 'positive' "
                  "WHEN vader_compound <= -0.05 THEN 'negative' ELSE 'neutral' END")


@register("sent_label", SQL_SCORED
          + f" SELECT comment_id, round(vader_compound, 6) AS vader_compound, {SENT_LABEL_SQL} AS sent_label"
          + " FROM scored")
def q_sent_label(spark, sf_dir):
    df = _scored_comments(spark, sf_dir)
    return df.select("comment_id", round6("vader_compound").alias("vader_compound"),
                     sentiment_label("vader_compound").alias("sent_label"))


SUMMARY_COLS = [f"avg_{c}" for c in lx.SCORE_COLS]
SQL_FLAGGED = (SQL_CAPPED + "," + sg.score_ctes("scored", "capped")
               + f", flagged AS (SELECT *, {FLAGS_SQL} FROM (SELECT *, COALESCE(lower(text), '') AS text_lower"
               + " FROM scored))")
SQL_SUMMARY = (SQL_FLAGGED + f""", labelled AS (SELECT *, {SENT_LABEL_SQL} AS sent_label FROM flagged)
SELECT year, count(*) AS count,
  count(*) FILTER (WHERE sent_label = 'positive') AS pos_count,
  count(*) FILTER (WHERE sent_label = 'neutral') AS neu_count,
  count(*) FILTER (WHERE sent_label = 'negative') AS neg_count,
  count(*) FILTER (WHERE is_distrust) AS distrust_count,
  count(*) FILTER (WHERE is_trust) AS trust_count,
  {', '.join(f'round(avg({c}), 6) AS avg_{c}' for c in lx.SCORE_COLS)}
FROM labelled GROUP BY year""")


def lexicon_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: raw comments -> letter filter -> yearly cap -> scores + flags ->
    label -> per-year summary (the lexicon job end to end)."""
    capped = _capped(spark, sf_dir)
    scored = lx.analyze(capped, lx.seed_valence(spark), lx.seed_polarity(spark), keep=["year"])
    summary = lx.yearly_summary(lx.label_sentiment(scored))
    return summary.select("year", "count", "pos_count", "neu_count", "neg_count", "distrust_count",
                          "trust_count", *r6(SUMMARY_COLS))


register("yearly_summary", SQL_SUMMARY)(lexicon_summary)


def _term_sql(terms, list_name: str) -> str:
    parts = [f"SELECT {i} AS term_no, {sg.q(t)} AS term, "
             f"CAST(COALESCE(sum((length(text_lower) - length(replace(text_lower, {sg.q(t)}, ''))) "
             f"// {len(t)}), 0) AS BIGINT) AS count, {sg.q(list_name)} AS list FROM flagged"
             for i, t in enumerate(terms)]
    return " UNION ALL ".join(parts)


def _terms(df, terms, list_name):
    return tx.term_counts(df, terms).withColumn("list", F.lit(list_name))


@register("term_counts", SQL_FLAGGED + " " + _term_sql(DISTRUST_TERMS, "distrust")
          + " UNION ALL " + _term_sql(TRUST_TERMS, "trust"))
def q_term_counts(spark, sf_dir):
    # Both lists in one aggregate (one pass over the capped comments).
    df = lx.add_flags(_capped(spark, sf_dir))
    n = len(DISTRUST_TERMS)
    both = tx.term_counts(df, DISTRUST_TERMS + TRUST_TERMS)
    first = F.col("term_no") < n
    return both.select(F.when(first, F.col("term_no")).otherwise(F.col("term_no") - n).alias("term_no"),
                       "term", "count", F.when(first, "distrust").otherwise("trust").alias("list"))


@register("term_counts_frequent", SQL_FLAGGED + " " + _term_sql(FREQUENT_TERMS, "frequent"))
def q_term_counts_frequent(spark, sf_dir):
    return _terms(lx.add_flags(_capped(spark, sf_dir)), FREQUENT_TERMS, "frequent")


@register("review_sample", SQL_CAPPED + f""" SELECT comment_id, year FROM (
    SELECT comment_id, year, row_number() OVER (PARTITION BY year ORDER BY md5(comment_id || ':42'), comment_id) AS rn
    FROM capped) WHERE rn <= {SAMPLE_CAP}""")
def q_review_sample(spark, sf_dir):
    return lx.review_sample(_capped(spark, sf_dir), SAMPLE_CAP).select("comment_id", "year")


SQL_REMOVED = (V.with_views("raw_comments")
               + f", removed AS (SELECT * FROM raw_comments WHERE NOT {LETTERS}),"
               + sg.score_ctes("scored", "removed")
               + f", flagged AS (SELECT *, {FLAGS_SQL} FROM (SELECT *, COALESCE(lower(text), '') AS text_lower"
               + " FROM scored))")


@register("removed_scored", SQL_REMOVED
          + f" SELECT comment_id, year, {r6_sql(lx.SCORE_COLS)}, is_distrust, is_trust FROM flagged")
def q_removed_scored(spark, sf_dir):
    _, removed = _kept_removed(spark, sf_dir)
    df = lx.analyze(removed, lx.seed_valence(spark), lx.seed_polarity(spark), keep=["year"])
    return df.select("comment_id", "year", *r6(lx.SCORE_COLS), "is_distrust", "is_trust")


@register("year_range", SQL_CAPPED
          + " SELECT min(year) AS min_year, max(year) AS max_year, count(*) AS n_rows FROM capped")
def q_year_range(spark, sf_dir):
    return lx.year_range(_capped(spark, sf_dir))


CLEAN_SQL = (f"trim(regexp_replace(regexp_replace(regexp_replace(lower(COALESCE(text, '')), "
             f"{sg.q(URL)}, ' ', 'g'), {sg.q(HANDLE)}, ' ', 'g'), {sg.q(SPACE + '+')}, ' ', 'g'))")


@register("clean_text", V.with_views("comments") + f" SELECT comment_id, {CLEAN_SQL} AS text_clean FROM comments")
def q_clean_text(spark, sf_dir):
    return V.comments(spark, sf_dir).select("comment_id", clean_text("text").alias("text_clean"))


TITLE_PREFIX_SQL = (f"CASE WHEN COALESCE(regexp_matches(title, {sg.q(NON_SPACE)}), false) "
                    f"THEN '[Video title: ' || title || '] ' || {CLEAN_SQL} ELSE {CLEAN_SQL} END")


@register("title_prefix", V.with_views("comments", "videos")
          + f" SELECT c.comment_id, {TITLE_PREFIX_SQL} AS text_proc"
          + " FROM comments c LEFT JOIN videos v ON v.video_id = c.video_id")
def q_title_prefix(spark, sf_dir):
    c = V.comments(spark, sf_dir)
    v = V.videos(spark, sf_dir).select("video_id", "title")
    return c.join(v, "video_id", "left").select(
        "comment_id", with_title_prefix(clean_text("text"), F.col("title")).alias("text_proc"))


# ----------------------------------------------------------------------------
# Labels, metrics, hybrid merge, publication, windows

from tenor.functions.numeric import THRESHOLD_GRID, argmax, class_to_sentiment, sigmoid, softmax  # noqa: E402
from tenor.operators import hybrid as hy  # noqa: E402
from tenor.operators import labels as lb  # noqa: E402
from tenor.operators import metrics as mt  # noqa: E402
from tenor.operators import model as md  # noqa: E402
from tenor.operators import publish as pb  # noqa: E402
from tenor.schemas import LABELS, PREDICTION_COLS  # noqa: E402

PROB_COLS = [f"{c}_ft_prob" for c in LABELS] + ["sent_neg_prob", "sent_neu_prob", "sent_pos_prob"]


def _round_preds(df):
    return df.withColumns({c: round6(c) for c in PROB_COLS if c in df.columns})


def _pred_select_sql(prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{c}, 6) AS {c}" if c in PROB_COLS else f"{prefix}{c}" for c in PREDICTION_COLS)


@register("sent_codes", V.with_views("gold")
          + " SELECT comment_id, sentiment, CAST(sentiment + 1 AS INTEGER) AS sent_class,"
          + " CAST(sentiment + 1 - 1 AS INTEGER) AS sentiment_back FROM gold")
def q_sent_codes(spark, sf_dir):
    df = lb.build_labels(V.gold(spark, sf_dir))
    return df.select("comment_id", "sentiment", "sent_class", class_to_sentiment("sent_class").alias("sentiment_back"))


@register("sigmoid", V.with_views("gold_base") + " SELECT comment_id, "
          + ", ".join(f"round(1.0 / (1.0 + exp(-{c}_logit)), 6) AS {c}_sig" for c in LABELS) + " FROM gold_base")
def q_sigmoid(spark, sf_dir):
    df = V.model_outputs(V.gold(spark, sf_dir), V.BASE_MULT)
    return df.select("comment_id", *[round6(sigmoid(f"{c}_logit")).alias(f"{c}_sig") for c in LABELS])


@register("softmax_argmax", V.with_views("pred_base")
          + " SELECT comment_id, round(sent_neg_prob, 6) AS sent_neg_prob, round(sent_neu_prob, 6) AS sent_neu_prob,"
          + " round(sent_pos_prob, 6) AS sent_pos_prob, CAST(sent_pred + 1 AS INTEGER) AS sent_class, sent_pred"
          + " FROM pred_base")
def q_softmax_argmax(spark, sf_dir):
    df = V.model_outputs(V.gold(spark, sf_dir), V.BASE_MULT)
    probs = softmax(["s0", "s1", "s2"])
    df = df.select("comment_id", *[p.alias(n) for p, n in zip(probs, ["sent_neg_prob", "sent_neu_prob", "sent_pos_prob"])])
    df = df.withColumn("sent_class", argmax(["sent_neg_prob", "sent_neu_prob", "sent_pos_prob"]))
    return df.select("comment_id", *r6(["sent_neg_prob", "sent_neu_prob", "sent_pos_prob"]), "sent_class",
                     class_to_sentiment("sent_class").alias("sent_pred"))


@register("apply_thresholds", V.with_views("pred_irony")
          + " SELECT comment_id, " + ", ".join(f"{c}_ft_pred" for c in LABELS) + " FROM pred_irony")
def q_apply_thresholds(spark, sf_dir):
    return V.predictions(spark, sf_dir, "irony").select("comment_id", *[f"{c}_ft_pred" for c in LABELS])


@register("wide_predictions", V.with_views("pred_base")
          + f" SELECT comment_id, video_title, sentiment, {', '.join(LABELS)}, {_pred_select_sql()} FROM pred_base")
def q_wide_predictions(spark, sf_dir):
    df = _round_preds(V.predictions(spark, sf_dir, "base"))
    return df.select("comment_id", "video_title", "sentiment", *LABELS, *PREDICTION_COLS)


@register("strata", V.with_views("strata") + " SELECT comment_id, any_pos, sent_class, stratum FROM strata")
def q_strata(spark, sf_dir):
    return lb.build_labels(V.gold(spark, sf_dir)).select("comment_id", "any_pos", "sent_class", "stratum")


FILL_SQL = V.with_views("comments", "videos") + """ SELECT c.comment_id, COALESCE(c.text, '') AS text,
    COALESCE(v.title, '') AS video_title, COALESCE(CAST(l.toxic AS INTEGER), 0) AS Spam_flag,
    COALESCE(CAST(l.quality AS INTEGER), 0) AS irony,
    COALESCE(CASE WHEN l.doc_id IS NULL THEN NULL ELSE CAST(c.doc_id % 3 - 1 AS INTEGER) END, 0) AS sentiment
  FROM comments c LEFT JOIN labels l ON l.doc_id = c.doc_id LEFT JOIN videos v ON v.video_id = c.video_id"""


@register("fill_defaults", FILL_SQL)
def q_fill_defaults(spark, sf_dir):
    c = V.comments(spark, sf_dir)
    lab = V.table(spark, sf_dir, "labels")
    v = V.videos(spark, sf_dir).select("video_id", F.col("title").alias("video_title"))
    df = (c.join(lab, "doc_id", "left").join(v, "video_id", "left")
           .select("comment_id", "text", "video_title",
                   F.col("toxic").cast("int").alias("Spam_flag"), F.col("quality").cast("int").alias("irony"),
                   F.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(),
                          (F.col("doc_id") % 3 - 1).cast("int")).alias("sentiment")))
    return tx.fill_defaults(df, labels=["Spam_flag", "irony"])


def _freq_sql(src: str, col_name: str = "freq", cast: str = "DOUBLE") -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS label_no, {sg.q(c)} AS label, CAST(COALESCE(sum({c}), 0) AS {cast}) AS {col_name} FROM {src}"
        for i, c in enumerate(LABELS))


@register("class_freq", V.with_views("gold") + " " + _freq_sql("gold"))
def q_class_freq(spark, sf_dir):
    return lb.class_frequency(lb.build_labels(V.gold(spark, sf_dir)))


@register("stratified_split", V.with_views("split") + " SELECT comment_id, stratum, split FROM split")
def q_stratified_split(spark, sf_dir):
    return V.split_table(spark, sf_dir).select("comment_id", "stratum", "split")


@register("test_subset", V.with_views("hybrid_test")
          + " SELECT comment_id, irony_ft_pred, sent_pred FROM hybrid_test")
def q_test_subset(spark, sf_dir):
    return V.hybrid_test(spark, sf_dir).select("comment_id", "irony_ft_pred", "sent_pred")


@register("label_support", V.with_views("hybrid_test") + " " + _freq_sql("hybrid_test", "support", "BIGINT"))
def q_label_support(spark, sf_dir):
    return lb.class_frequency(V.hybrid_test(spark, sf_dir)).select(
        "label_no", "label", F.col("freq").cast("bigint").alias("support"))


def _report_sql(src: str) -> str:
    long = " UNION ALL ".join(
        f"SELECT comment_id, {i} AS label_no, {sg.q(c)} AS label, CAST({c} AS BIGINT) AS y,"
        f" CAST({c}_ft_pred AS BIGINT) AS p FROM {src}" for i, c in enumerate(LABELS))
    def ratio(n, d):
        return f"CASE WHEN {d} > 0 THEN CAST({n} AS DOUBLE) / ({d}) ELSE 0.0 END"
    k = len(LABELS)
    return f""", long AS ({long}),
per AS (SELECT label_no, label, sum(y * p) AS tp, sum((1 - y) * p) AS fp, sum(y * (1 - p)) AS fn, sum(y) AS s
        FROM long GROUP BY label_no, label),
lab AS (SELECT label_no, label, {ratio('tp', 'tp + fp')} AS pr, {ratio('tp', 'tp + fn')} AS rc,
               {ratio('2 * tp', '2 * tp + fp + fn')} AS f1, s FROM per),
tot AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(s) AS s FROM per),
smp AS (SELECT comment_id, sum(y * p) AS i, sum(y) AS ny, sum(p) AS np FROM long GROUP BY comment_id),
rows AS (
  SELECT label_no AS row_no, label, pr, rc, f1, s FROM lab
  UNION ALL SELECT {k}, 'micro avg', {ratio('tp', 'tp + fp')}, {ratio('tp', 'tp + fn')},
                   {ratio('2 * tp', '2 * tp + fp + fn')}, s FROM tot
  UNION ALL SELECT {k + 1}, 'macro avg', avg(pr), avg(rc), avg(f1), sum(s) FROM lab
  UNION ALL SELECT {k + 2}, 'weighted avg', {ratio('sum(pr * s)', 'sum(s)')}, {ratio('sum(rc * s)', 'sum(s)')},
                   {ratio('sum(f1 * s)', 'sum(s)')}, sum(s) FROM lab
  UNION ALL SELECT {k + 3}, 'samples avg', avg({ratio('i', 'np')}), avg({ratio('i', 'ny')}),
                   avg({ratio('2 * i', 'ny + np')}), sum(ny) FROM smp)
SELECT CAST(row_no AS INTEGER) AS row_no, label, round(pr, 6) AS precision, round(rc, 6) AS recall,
       round(f1, 6) AS f1, CAST(s AS BIGINT) AS support FROM rows"""


REPORT_COLS = ["precision", "recall", "f1"]


@register("multilabel_report", V.with_views("hybrid_test") + _report_sql("hybrid_test"))
def q_multilabel_report(spark, sf_dir):
    rep = mt.multilabel_report(V.hybrid_test(spark, sf_dir))
    return rep.select("row_no", "label", *r6(REPORT_COLS), "support")


def _macro_sql(src: str, where: str, suffix: str, n_name: str) -> str:
    def ratio(n, d):
        return f"CASE WHEN {d} > 0 THEN CAST({n} AS DOUBLE) / ({d}) ELSE 0.0 END"
    return f""", rowsx AS (SELECT CAST(sentiment AS INTEGER) AS y, CAST(sent_pred AS INTEGER) AS p FROM {src} {where}),
cls AS (SELECT y AS c FROM rowsx UNION SELECT p FROM rowsx),
pc AS (SELECT c, count(*) FILTER (WHERE y = c AND p = c) AS tp, count(*) FILTER (WHERE y <> c AND p = c) AS fp,
              count(*) FILTER (WHERE y = c AND p <> c) AS fn FROM cls, rowsx GROUP BY c)
SELECT round(avg({ratio('tp', 'tp + fp')}), 6) AS sent_macro_precision{suffix},
       round(avg({ratio('tp', 'tp + fn')}), 6) AS sent_macro_recall{suffix},
       round(avg({ratio('2 * tp', '2 * tp + fp + fn')}), 6) AS sent_macro_f1{suffix},
       CAST(COALESCE(sum(tp + fn), 0) AS BIGINT) AS {n_name} FROM pc"""


SENT_F1 = ["sent_macro_precision", "sent_macro_recall", "sent_macro_f1"]


@register("sentiment_f1", V.with_views("hybrid_test") + _macro_sql("hybrid_test", "", "", "n_rows"))
def q_sentiment_f1(spark, sf_dir):
    return mt.sentiment_f1(V.hybrid_test(spark, sf_dir)).select(*r6(SENT_F1), "n_rows")


@register("sentiment_f1_irony", V.with_views("hybrid_test")
          + _macro_sql("hybrid_test", "WHERE irony = 1", "_irony", "n_irony_rows"))
def q_sentiment_f1_irony(spark, sf_dir):
    cols = [f"{c}_irony" for c in SENT_F1]
    return mt.sentiment_f1_irony(V.hybrid_test(spark, sf_dir)).select(*r6(cols), "n_irony_rows")


GRID_SQL = ", ".join(f"(CAST({t!r} AS DOUBLE))" for t in THRESHOLD_GRID)
TUNE_SQL = V.with_views("pred_base", "split") + """, val AS (
  SELECT p.* FROM pred_base p WHERE p.comment_id IN (SELECT comment_id FROM split WHERE split = 'val')),
long AS ({long}),
grid AS (SELECT * FROM (VALUES {grid}) g(t)),
f AS (SELECT label_no, label, t,
             CASE WHEN sum(y) + sum(CASE WHEN prob >= t THEN 1 ELSE 0 END) > 0
                  THEN 2.0 * sum(CASE WHEN prob >= t THEN y ELSE 0 END)
                       / (sum(y) + sum(CASE WHEN prob >= t THEN 1 ELSE 0 END)) ELSE 0.0 END AS f1
      FROM long, grid GROUP BY label_no, label, t),
best AS (SELECT *, row_number() OVER (PARTITION BY label_no ORDER BY f1 DESC, t ASC) AS rn FROM f)
SELECT CAST(label_no AS INTEGER) AS label_no, label, CASE WHEN f1 > 0 THEN t ELSE 0.5 END AS threshold,
       round(f1, 6) AS best_f1 FROM best WHERE rn = 1""".format(
    long=" UNION ALL ".join(f"SELECT {i} AS label_no, {sg.q(c)} AS label, {c} AS y, {c}_ft_prob AS prob FROM val"
                            for i, c in enumerate(LABELS)),
    grid=GRID_SQL)


@register("tune_thresholds", TUNE_SQL)
def q_tune_thresholds(spark, sf_dir):
    preds = V.predictions(spark, sf_dir, "base")
    val = lb.test_subset(preds, lb.split_ids(V.split_table(spark, sf_dir), "val"))
    return mt.tune_thresholds(val).select(F.col("label_no").cast("int"), "label", "threshold", round6("best_f1").alias("best_f1"))


LOSS_SQL = V.with_views("gold_base") + """, r AS (
  SELECT ({bce}) / {k} AS bce,
         (greatest(s0, s1, s2) + ln(exp(s0 - greatest(s0, s1, s2)) + exp(s1 - greatest(s0, s1, s2))
            + exp(s2 - greatest(s0, s1, s2)))
          - CASE sentiment + 1 WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END) * (1.0 + 0.5 * irony) AS ce
  FROM gold_base)
SELECT round(avg(bce), 6) AS multi_loss, round(avg(ce), 6) AS sent_loss,
       round(0.7 * avg(bce) + 1.0 * avg(ce), 6) AS loss FROM r""".format(
    k=float(len(LABELS)),
    bce=" + ".join(f"(greatest({c}_logit, 0.0) - {c}_logit * {c} + ln(1 + exp(-abs({c}_logit))))" for c in LABELS))


@register("multitask_loss", LOSS_SQL)
def q_multitask_loss(spark, sf_dir):
    df = lb.build_labels(V.model_outputs(V.gold(spark, sf_dir), V.BASE_MULT))
    return mt.multitask_loss(df).select(*r6(["multi_loss", "sent_loss", "loss"]))


PJ_COLS = ["irony_ft_prob", "irony_ft_pred", "Spam_flag_ft_pred", "sent_pred", "sent_pos_prob"]


@register("pred_join", V.with_views("pred_base", "pred_irony") + " SELECT b.comment_id, "
          + ", ".join(f"{'round(' if c in PROB_COLS else ''}b.{c}{', 6)' if c in PROB_COLS else ''} AS {c}_base, "
                      f"{'round(' if c in PROB_COLS else ''}i.{c}{', 6)' if c in PROB_COLS else ''} AS {c}_irony"
                      for c in PJ_COLS)
          + " FROM pred_base b JOIN pred_irony i ON i.comment_id = b.comment_id")
def q_pred_join(spark, sf_dir):
    j = hy.pred_join(V.predictions(spark, sf_dir, "base"), V.predictions(spark, sf_dir, "irony"))
    cols = []
    for c in PJ_COLS:
        for s in ("_base", "_irony"):
            cols.append(round6(c + s).alias(c + s) if c in PROB_COLS else F.col(c + s))
    return j.select("comment_id", *cols)


@register("hybrid_merge", V.with_views("hybrid") + f" SELECT comment_id, {_pred_select_sql()} FROM hybrid")
def q_hybrid_merge(spark, sf_dir):
    return _round_preds(V.hybrid(spark, sf_dir)).select("comment_id", *PREDICTION_COLS)


def _with_year(spark, sf_dir, df):
    years = V.comments(spark, sf_dir).select("comment_id", "year")
    return df.join(years, "comment_id")


RATE_COLS = [f"{c}_rate" for c in LABELS] + ["sent_neg_rate", "sent_neu_rate", "sent_pos_rate"]
HY_YEAR = V.with_views("hybrid", "comments") + ", hy AS (SELECT h.*, c.year FROM hybrid h JOIN comments c USING (comment_id))"


@register("yearly_rates", HY_YEAR + " SELECT year, count(*) AS n_comments, "
          + ", ".join(f"round(avg(CAST({c}_ft_pred AS DOUBLE)), 6) AS {c}_rate" for c in LABELS)
          + ", round(avg(CASE WHEN sent_pred = -1 THEN 1.0 ELSE 0.0 END), 6) AS sent_neg_rate"
          + ", round(avg(CASE WHEN sent_pred = 0 THEN 1.0 ELSE 0.0 END), 6) AS sent_neu_rate"
          + ", round(avg(CASE WHEN sent_pred = 1 THEN 1.0 ELSE 0.0 END), 6) AS sent_pos_rate"
          + " FROM hy GROUP BY year ORDER BY year")
def q_yearly_rates(spark, sf_dir):
    rates = pb.yearly_rates(_with_year(spark, sf_dir, V.hybrid(spark, sf_dir)))
    return rates.select("year", "n_comments", *r6(RATE_COLS))


@register("public_view", HY_YEAR + " SELECT year, count(*) AS n_comments, "
          + ", ".join(f"CAST(sum({c}_ft_pred) AS BIGINT) AS n_{c}" for c in LABELS) + " FROM hy GROUP BY year")
def q_public_view(spark, sf_dir):
    return pb.public_view(_with_year(spark, sf_dir, V.hybrid(spark, sf_dir)))


SMALL_CELL = 30


def _suppressed_sql() -> str:
    """Counts that are small, or leave few others, become null."""
    few = lambda c: f"({c} > 0 AND {c} < {SMALL_CELL}) OR (n_comments - {c} > 0 AND n_comments - {c} < {SMALL_CELL})"
    return (HY_YEAR + ", cells AS (SELECT year, count(*) AS n_comments, " + ", ".join(f"CAST(sum({c}_ft_pred) AS BIGINT) AS n_{c}" for c in LABELS) + " FROM hy GROUP BY year)"
            " SELECT year, n_comments, " + ", ".join(f"CASE WHEN NOT ({few(f'n_{c}')}) THEN n_{c} END AS n_{c}" for c in LABELS) + f" FROM cells WHERE n_comments >= {SMALL_CELL}")


@register("public_view_suppressed", _suppressed_sql())
def q_public_view_suppressed(spark, sf_dir):
    """The public counts without cells of few comments."""
    view = pb.public_view(_with_year(spark, sf_dir, V.hybrid(spark, sf_dir)))
    return pb.suppress_small_cells(view, "n_comments", [f"n_{c}" for c in LABELS], SMALL_CELL)


def _windows_input(spark, sf_dir):
    c = V.comments(spark, sf_dir)
    v = V.videos(spark, sf_dir).select("video_id", F.col("title").alias("video_title"))
    return tx.add_text_proc(c.join(v, "video_id", "left"))


WIDTH, STEP = md.window_shape()
WIN_SQL = (V.with_views("comments", "videos")
           + f", tp AS (SELECT c.comment_id, c.doc_id, regexp_extract_all({TITLE_PREFIX_SQL}, {sg.q(NON_SPACE + '+')}) AS w"
           + " FROM comments c LEFT JOIN videos v ON v.video_id = c.video_id),"
           + f" tk AS (SELECT *, CAST(1 + ceil(greatest(len(w) - {WIDTH}, 0) / {STEP}.0) AS INTEGER) AS k FROM tp),"
           + " win AS (SELECT comment_id, doc_id, k AS n_windows,"
           + " CAST(generate_subscripts(wins, 1) - 1 AS INTEGER) AS window_no, unnest(wins) AS tokens"
           + f" FROM (SELECT *, list_transform(range(k), lambda i: list_slice(w, i * {STEP} + 1, i * {STEP} + {WIDTH}))"
           + " AS wins FROM tk))")


@register("token_windows", WIN_SQL + " SELECT comment_id, n_windows, window_no, CAST(len(tokens) AS INTEGER) AS n_tokens,"
          + " array_to_string(tokens, ' ') AS window_text FROM win")
def q_token_windows(spark, sf_dir):
    w = md.token_windows(_windows_input(spark, sf_dir))
    return w.select("comment_id", "n_windows", "window_no", F.size("tokens").alias("n_tokens"),
                    F.array_join("tokens", " ").alias("window_text"))


def _window_prob(j: int):
    return f"CAST((doc_id * {V.BASE_MULT} + {13 * j} + 101 * window_no) % 1000 AS DOUBLE) / 1000"


@register("window_mean", WIN_SQL + " SELECT comment_id, count(*) AS n_windows, "
          + ", ".join(f"round(avg({_window_prob(j)}), 6) AS {c}_ft_prob" for j, c in enumerate(LABELS))
          + " FROM win GROUP BY comment_id")
def q_window_mean(spark, sf_dir):
    w = md.token_windows(_windows_input(spark, sf_dir), keep=["doc_id"])
    w = w.select("comment_id", *[F.expr(_window_prob(j)).alias(f"{c}_ft_prob") for j, c in enumerate(LABELS)])
    m = md.window_mean(w, [f"{c}_ft_prob" for c in LABELS])
    return m.select("comment_id", "n_windows", *r6([f"{c}_ft_prob" for c in LABELS]))


# ----------------------------------------------------------------------------
# Collection: bounds, filters, window fill, dedup, caps, metadata, counters

from tenor.functions.text import MUSIC_CHANNEL_MARKERS, MUSIC_KEYWORDS, is_music_video  # noqa: E402
from tenor.functions.time import in_year, year_bounds  # noqa: E402
from tenor.operators import collect as co  # noqa: E402

NOW_ISO = "2024-06-30T12:00:00Z"   # "now" is an argument of the bounds, not the clock


@register("year_bounds", V.with_views("comments") + f""" SELECT year,
    printf('%04d-01-01T00:00:00Z', year) AS start_iso,
    CASE WHEN year < {NOW_ISO[:4]} THEN printf('%04d-12-31T23:59:59Z', year) ELSE '{NOW_ISO}' END AS end_iso
  FROM (SELECT DISTINCT year FROM comments)""")
def q_year_bounds(spark, sf_dir):
    years = V.comments(spark, sf_dir).select("year").distinct()
    s, e = year_bounds("year", NOW_ISO)
    return years.select("year", s.alias("start_iso"), e.alias("end_iso"))


@register("year_filter", V.with_views("comments", "videos")
          + " SELECT c.comment_id, c.video_id, v.year FROM comments c JOIN videos v ON v.video_id = c.video_id"
          + " WHERE COALESCE(starts_with(c.published_at, CAST(v.year AS VARCHAR)), false)")
def q_year_filter(spark, sf_dir):
    c = V.comments(spark, sf_dir).select("comment_id", "video_id", "published_at")
    v = V.videos(spark, sf_dir).select("video_id", "year")
    return c.join(v, "video_id").filter(in_year("published_at", "year")).select("comment_id", "video_id", "year")


# The reference's keywords never occur in the invented pages; the query uses words that do.
MUSIC_QUERY_WORDS = ["heon", "tion", "eaux"]
MUSIC_QUERY_SQL = "(" + sg.contains_any_sql("lower(COALESCE(title, ''))", MUSIC_QUERY_WORDS) + " OR " + sg.contains_any_sql(
    "lower(COALESCE(description, ''))", MUSIC_QUERY_WORDS) + " OR " + sg.contains_any_sql("lower(COALESCE(channel_title, ''))", MUSIC_CHANNEL_MARKERS) + ")"
MUSIC_SQL = ("(" + sg.contains_any_sql("lower(COALESCE(title, ''))", MUSIC_KEYWORDS)
             + " OR " + sg.contains_any_sql("lower(COALESCE(description, ''))", MUSIC_KEYWORDS)
             + " OR " + sg.contains_any_sql("lower(COALESCE(channel_title, ''))", MUSIC_CHANNEL_MARKERS) + ")")


@register("music_filter", V.with_views("videos") + f" SELECT video_id, {MUSIC_QUERY_SQL} AS is_music FROM videos")
def q_music_filter(spark, sf_dir):
    v = V.videos(spark, sf_dir)
    return v.select("video_id", is_music_video("title", "description", "channel_title", MUSIC_QUERY_WORDS).alias("is_music"))


@register("attach_video", V.with_views("comments", "videos")
          + " SELECT c.comment_id, COALESCE(v.title, '') AS video_title,"
          + " COALESCE(v.published_at, '') AS video_published_at"
          + " FROM comments c LEFT JOIN videos v ON v.video_id = c.video_id")
def q_attach_video(spark, sf_dir):
    c = V.comments(spark, sf_dir).select("comment_id", "video_id")
    return co.attach_video(c, V.videos(spark, sf_dir)).select("comment_id", "video_title", "video_published_at")


COLLECT_SQL = V.with_views("landed", "sampled") + """,
j AS (SELECT l.*, s.video_rank FROM landed l JOIN sampled s ON s.year = l.year AND s.video_id = l.video_id
      WHERE COALESCE(starts_with(l.published_at, CAST(l.year AS VARCHAR)), false)),
d AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY year, comment_id
      ORDER BY video_rank, page, pos) AS rn FROM j) WHERE rn = 1),
e AS (SELECT * FROM d WHERE COALESCE(lang, 'en') = 'en'),
pv AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY year, video_id
       ORDER BY video_rank, page, pos) AS rn FROM e) WHERE rn <= 40),
py AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY year
       ORDER BY video_rank, page, pos) AS rn FROM pv) WHERE rn <= 10000)"""
COLLECT_SMALL_SQL = COLLECT_SQL.replace("rn <= 40)", f"rn <= {VIDEO_CAP})").replace("rn <= 10000)", f"rn <= {INGEST_CAP})")


def _collected(spark, sf_dir, per_video=co.MAX_COMMENTS_PER_VIDEO, per_year=co.COMMENTS_PER_YEAR):
    landed = V.landed_comments(spark, sf_dir)
    return co.collect_comments(landed, V.sampled_pairs(landed), per_video=per_video, per_year=per_year)


@register("dedup_comments", V.with_views("landed", "sampled") + """,
j AS (SELECT l.*, s.video_rank FROM landed l JOIN sampled s ON s.year = l.year AND s.video_id = l.video_id)
SELECT year, comment_id, video_id, page, pos FROM (SELECT *, row_number() OVER (PARTITION BY year, comment_id
  ORDER BY video_rank, page, pos) AS rn FROM j) WHERE rn = 1""")
def q_dedup_comments(spark, sf_dir):
    from tenor.operators.ranking import first_per_key
    landed = V.landed_comments(spark, sf_dir)
    j = landed.join(V.sampled_pairs(landed), ["year", "video_id"])
    d = first_per_key(j.select("year", "comment_id", "video_rank", "page", "pos", "video_id"),
                      ["year", "comment_id"], ["video_rank", "page", "pos"])
    return d.select("year", "comment_id", "video_id", "page", "pos")


@register("video_cap", COLLECT_SMALL_SQL + " SELECT year, comment_id, video_id FROM pv")
def q_video_cap(spark, sf_dir):
    landed = V.landed_comments(spark, sf_dir)
    c = co.collect_comments(landed, V.sampled_pairs(landed), per_video=VIDEO_CAP, per_year=None)
    return c.select("year", "comment_id", "video_id")


@register("ingest_cap", COLLECT_SMALL_SQL + " SELECT year, comment_id, video_id, published_at FROM py")
def q_ingest_cap(spark, sf_dir):
    return _collected(spark, sf_dir, VIDEO_CAP, INGEST_CAP).select("year", "comment_id", "video_id", "published_at")


@register("ingest_summary", COLLECT_SQL + """, sv AS (SELECT year, count(*) AS videos FROM sampled GROUP BY year),
sc AS (SELECT year, count(*) AS comments FROM py GROUP BY year)
SELECT COALESCE(sv.year, sc.year) AS year, COALESCE(videos, 0) AS videos, COALESCE(comments, 0) AS comments,
       COALESCE(videos, 0) < 2500 AS warn_videos, COALESCE(comments, 0) < 10000 AS warn_comments
FROM sv FULL OUTER JOIN sc ON sc.year = sv.year""")
def q_ingest_summary(spark, sf_dir):
    landed = V.landed_comments(spark, sf_dir)
    sampled = V.sampled_pairs(landed)
    return co.ingest_summary(sampled, co.collect_comments(landed, sampled))


@register("comments_per_video", COLLECT_SQL
          + " SELECT year, video_id, count(*) AS n_comments FROM py GROUP BY year, video_id")
def q_comments_per_video(spark, sf_dir):
    return co.comments_per_video(_collected(spark, sf_dir))


# Window fill over the events table: a video is an event, its views the value,
# the search term the event type. The table spans one month, so the window tree
# spans that month (31 windows) instead of a whole year.
FILL_BOUNDS = [(2024, "2024-01-01T00:00:00Z", "2024-01-31T00:00:00Z")]
GENERAL_TERMS = ["view"]
EARLY_TERMS = ["view", "click", "purchase"]


def _wins_sql() -> str:
    rows = ", ".join(f"({y}, {lv}, {ix}, {s}, {e}, '{si}')" for y, lv, ix, s, e, si, _ in co.window_tree(FILL_BOUNDS))
    return f"SELECT * FROM (VALUES {rows}) w(year, level, idx, start_s, end_s, window_start)"


def _fill_sql(variant: str, target: int | None = None) -> str:
    terms = GENERAL_TERMS if variant == "general" else EARLY_TERMS
    target = target or (co.VIDEO_SAMPLE_SIZE if variant == "general" else co.VIDEO_SAMPLE_SIZE_EARLY)
    tl = "[" + ", ".join(sg.q(t) for t in terms) + "]"
    pages_target = -(-target // co.SEARCH_PAGE_SIZE) * co.SEARCH_PAGE_SIZE
    head = V.with_views("hits", "hit_videos") + f""", wins AS ({_wins_sql()}),
hw AS (SELECT h.*, w.level, w.idx, w.start_s, w.window_start, list_position({tl}, h.term) - 1 AS term_no
       FROM hits h JOIN wins w ON w.year = h.year AND h.ts_s BETWEEN w.start_s AND w.end_s),
hw2 AS (SELECT * FROM hw WHERE term_no IS NOT NULL AND term_no >= 0 {'AND term_no = 0' if variant == 'general' else ''}),
r AS (SELECT *, 0 AS ord_no, row_number() OVER (PARTITION BY year, level, idx, term_no ORDER BY views DESC, video_id) AS rank FROM hw2
      UNION ALL
      SELECT *, 1 AS ord_no, row_number() OVER (PARTITION BY year, level, idx, term_no ORDER BY ts_s DESC, video_id) AS rank FROM hw2),
r2 AS (SELECT * FROM r),"""
    if variant == "general":
        head += f"""
n1 AS (SELECT year, level, idx, count(*) AS n1 FROM r2 WHERE ord_no = 0 AND rank <= {pages_target} GROUP BY year, level, idx),
k AS (SELECT r2.* FROM r2 LEFT JOIN n1 ON n1.year = r2.year AND n1.level = r2.level AND n1.idx = r2.idx
      WHERE (ord_no = 0 AND rank <= {pages_target})
         OR (ord_no = 1 AND COALESCE(n1, 0) < {target}
             AND rank <= ceil(({target} - COALESCE(n1, 0)) / {float(co.SEARCH_PAGE_SIZE)}) * {co.SEARCH_PAGE_SIZE})),"""
    else:
        head += f"""
k AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY year, level, idx
      ORDER BY term_no, ord_no, rank) AS rn FROM r2) WHERE rn <= {target}),"""
    head += f"""
f AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY year, video_id
      ORDER BY start_s, level, term_no, ord_no, rank) AS rn FROM k) WHERE rn = 1),
el AS (SELECT video_id, year, COALESCE(starts_with(published_at, CAST(year AS VARCHAR)), false) AND NOT {MUSIC_SQL} AS eligible
       FROM hit_videos),
fe AS (SELECT f.* FROM f JOIN el ON el.video_id = f.video_id AND el.year = f.year WHERE el.eligible),
fin AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY start_s, level, term_no, ord_no, rank, video_id) AS video_rank FROM fe)"""
    return head


@register("window_fill", _fill_sql("general", FILL_TARGET)
          + " SELECT year, CAST(video_rank AS INTEGER) AS video_rank, video_id, level, window_start FROM fin"
          + f" WHERE video_rank <= {FILL_TARGET}")
def q_window_fill(spark, sf_dir):
    """A small target, so that the second order is searched in some windows and not in others."""
    return co.window_fill(V.event_hits(spark, sf_dir), V.event_videos(spark, sf_dir), FILL_BOUNDS, GENERAL_TERMS, target=FILL_TARGET)


@register("window_fill_early", _fill_sql("early")
          + " SELECT year, CAST(video_rank AS INTEGER) AS video_rank, video_id, level, window_start FROM fin"
          + f" WHERE video_rank <= {co.VIDEO_SAMPLE_SIZE_EARLY}")
def q_window_fill_early(spark, sf_dir):
    return co.window_fill(V.event_hits(spark, sf_dir), V.event_videos(spark, sf_dir), FILL_BOUNDS, EARLY_TERMS,
                          variant="early")


@register("candidate_rank", _fill_sql("early")
          + " SELECT year, level, idx, term_no, ord_no, CAST(rank AS INTEGER) AS rank, video_id FROM k")
def q_candidate_rank(spark, sf_dir):
    r = co.rank_candidates(V.event_hits(spark, sf_dir), co.window_tree(FILL_BOUNDS), EARLY_TERMS, "early", co.VIDEO_SAMPLE_SIZE_EARLY)
    return r.select("year", "level", "idx", F.col("term_no").cast("int"), "ord_no", "rank", "video_id")


LANDED_TERMS = ["purchase", "view", "click"]
LANDED_TARGET = 300


@register("landed_search_order", f"""WITH p AS (SELECT CAST(event_id % 700 AS VARCHAR) AS video_id, event_id // 50 AS page,
    event_id, list_position([{', '.join(sg.q(t) for t in LANDED_TERMS)}], event_type) AS term_no FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY term_no, page ORDER BY event_id) AS pos FROM p WHERE term_no IS NOT NULL),
f AS (SELECT video_id, min({{'t': term_no, 'p': page, 'o': pos}}) AS o FROM r GROUP BY video_id)
SELECT CAST(row_number() OVER (ORDER BY o, video_id) AS INTEGER) AS video_rank, video_id FROM f
ORDER BY o, video_id LIMIT {LANDED_TARGET}""")
def q_landed_search_order(spark, sf_dir):
    """W6 over landed pages: the service's own order of terms, pages and positions."""
    e = V.table(spark, sf_dir, "events").select(
        F.lit(2024).alias("year"), F.lit("2024-01-01T00:00:00Z").alias("window_start"), F.lit("2024-01-31T00:00:00Z").alias("window_end"),
        F.col("event_type").alias("term"), F.lit("date").alias("ord"), F.expr("CAST(event_id div 50 AS INT)").alias("page"), "event_id")
    item = F.struct(F.struct((F.col("event_id") % 700).cast("string").alias("videoId")).alias("id"))
    pages = pg.pack_pages(e, ["year", "window_start", "window_end", "term", "ord", "page"], "event_id", item)
    hits = pg.flatten_search_pages(pages)
    videos = hits.select("video_id", "year", F.lit("news").alias("title"), F.lit("").alias("description"), F.lit("c").alias("channel_title"),
                         F.lit("2024-01-02T00:00:00Z").alias("published_at"))
    return co.fill_landed(hits, videos, LANDED_TERMS, "early", LANDED_TARGET).select("video_rank", "video_id")


@register("window_yield", _fill_sql("general") + """ SELECT year, level, window_start, count(*) AS n_videos
  FROM fin WHERE video_rank <= 3000 GROUP BY year, level, window_start""")
def q_window_yield(spark, sf_dir):
    s = co.window_fill(V.event_hits(spark, sf_dir), V.event_videos(spark, sf_dir), FILL_BOUNDS, GENERAL_TERMS)
    return co.videos_per_window(s)


# ----------------------------------------------------------------------------
# Jobs: language identification, English filter, training, inference, hybrid

from tenor.operators import classifier as clf  # noqa: E402
from tenor.operators import language as lg  # noqa: E402


def _docs_with_titles(spark, sf_dir):
    c = V.comments(spark, sf_dir)
    v = V.videos(spark, sf_dir).select("video_id", F.col("title").alias("video_title"))
    return c.join(v, "video_id", "left")


def _identified(spark, sf_dir):
    """Every text is scored by profiles that were trained on the other half of the documents."""
    docs = V.comments(spark, sf_dir).select("comment_id", "doc_id", "year", "lang", "text")
    half = F.col("doc_id") % 2
    a, b = (lg.identify(docs.filter(half == k), lg.train_profiles(docs.filter(half != k))) for k in (0, 1))
    return a.unionByName(b)


LANG_SQL = V.with_views("comments") + f""",
pad AS (SELECT comment_id, doc_id % 2 AS half, lang, ' ' || regexp_replace(lower(COALESCE(text, '')), {sg.q(SPACE + '+')}, ' ', 'g') || ' ' AS t
        FROM comments),
g AS (SELECT comment_id, half, lang, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS gram
      FROM pad),
gw AS (SELECT * FROM g WHERE substr(gram, 2, 1) <> ' '),
cnt AS (SELECT half, lang, gram, count(*) AS c FROM gw WHERE lang IS NOT NULL GROUP BY half, lang, gram),
tot AS (SELECT half, lang, sum(c) AS total, count(*) AS v FROM cnt GROUP BY half, lang),
prof AS (SELECT t.half, t.lang, t.gram,
                ln(t.c + 1.0) - ln(tot.total + tot.v + 1.0) - (-ln(tot.total + tot.v + 1.0)) AS delta,
                -ln(tot.total + tot.v + 1.0) AS floor
         FROM cnt t JOIN tot ON tot.lang = t.lang AND tot.half = t.half),
nn AS (SELECT comment_id, greatest(length(t) - 2, 0)
              - (length(substr(t, 2, length(t) - 2)) - length(replace(substr(t, 2, length(t) - 2), ' ', ''))) AS n
       FROM pad),
ll AS (SELECT gw.comment_id, prof.lang, sum(prof.delta) + max(nn.n) * max(prof.floor) AS ll
       FROM gw JOIN prof ON prof.gram = gw.gram AND prof.half <> gw.half JOIN nn ON nn.comment_id = gw.comment_id
       GROUP BY gw.comment_id, prof.lang),
best AS (SELECT comment_id, max(ll) AS m FROM ll GROUP BY comment_id),
pick AS (SELECT ll.comment_id, CASE WHEN count(*) = 1 THEN min(ll.lang) END AS pred_lang
         FROM ll JOIN best ON best.comment_id = ll.comment_id AND ll.ll = best.m GROUP BY ll.comment_id)"""


@register("language_id", LANG_SQL + " SELECT c.comment_id, c.lang, p.pred_lang FROM comments c"
          " LEFT JOIN pick p ON p.comment_id = c.comment_id")
def q_language_id(spark, sf_dir):
    """M3: character trigram profiles, scored per text."""
    return _identified(spark, sf_dir).select("comment_id", "lang", "pred_lang")


@register("english_only", LANG_SQL + " SELECT c.comment_id, c.year, p.pred_lang FROM comments c"
          " LEFT JOIN pick p ON p.comment_id = c.comment_id WHERE COALESCE(p.pred_lang, 'en') = 'en'")
def q_english_only(spark, sf_dir):
    """P4 over M3's output: keep English, keep unknown (fails open)."""
    return lg.english_only(_identified(spark, sf_dir)).select("comment_id", "year", "pred_lang")


@register("train_multitask")
def q_train_multitask(spark, sf_dir):
    """M4: fit on the train split, tune thresholds on validation -> tuned thresholds; rows-only."""
    _, _, _, _, tuned = clf.train_main(V.gold(spark, sf_dir))
    return tuned.select(F.col("label_no").cast("int"), "label", "threshold", round6("best_f1").alias("best_f1"))


@register("test_metrics_default")
def q_test_metrics_default(spark, sf_dir):
    """M4 report: test-split micro/macro F1 at 0.5 and sentiment macro F1; rows-only."""
    _, _, metrics, sent, _ = clf.train_main(V.gold(spark, sf_dir))
    long = metrics.select(F.inline(F.array(
        F.struct(F.lit("ml_test_f1_micro_default").alias("metric"), F.col("ml_test_f1_micro_default").alias("value")),
        F.struct(F.lit("ml_test_f1_macro_default").alias("metric"), F.col("ml_test_f1_macro_default").alias("value")))))
    return long.unionByName(sent.select(F.lit("sent_test_macro_f1").alias("metric"),
                                        F.col("sent_test_macro_f1").alias("value")))


@register("predict_multitask")
def q_predict_multitask(spark, sf_dir):
    """M5: train on the labelled rows, predict every comment with sliding windows; rows-only."""
    model, *_ = clf.train_main(V.gold(spark, sf_dir))
    preds = clf.predict(model, _docs_with_titles(spark, sf_dir))
    return _round_preds(preds).select("comment_id", *PREDICTION_COLS)


@register("predict_invariants", "SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids, CAST(0 AS BIGINT) AS bad_probs,"
          " CAST(0 AS BIGINT) AS bad_sums, CAST(0 AS BIGINT) AS bad_preds, CAST(0 AS BIGINT) AS bad_sentiments FROM documents")
def q_predict_invariants(spark, sf_dir):
    """M5, stated invariants over real predictions: every row once, probabilities in range, the three
    sentiments summing to 1, each prediction equal to its probability cut at the model's threshold."""
    model, *_ = clf.train_main(V.gold(spark, sf_dir))
    p = clf.predict(model, _docs_with_titles(spark, sf_dir))
    probs = [f"{c}_ft_prob" for c in LABELS] + ["sent_neg_prob", "sent_neu_prob", "sent_pos_prob"]
    any_of = lambda cs: reduce(lambda a, b: a | b, cs)
    s = [F.col(c) for c in probs[-3:]]
    best = F.when((s[0] >= s[1]) & (s[0] >= s[2]), -1).when(s[1] >= s[2], 0).otherwise(1)
    return p.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("comment_id").alias("n_ids"),
                 F.count_if(any_of([~F.coalesce(F.col(c).between(0, 1), F.lit(False)) for c in probs])).alias("bad_probs"),
                 F.count_if(F.abs(s[0] + s[1] + s[2] - 1) > 1e-9).alias("bad_sums"),
                 F.count_if(any_of([F.col(f"{c}_ft_pred") != (F.col(f"{c}_ft_prob") >= t).cast("int") for c, t in zip(LABELS, model.thresholds)])).alias("bad_preds"),
                 F.count_if(F.col("sent_pred") != best).alias("bad_sentiments"))


@register("predict_hybrid")
def q_predict_hybrid(spark, sf_dir):
    """M6: base and specialist presets on the same input, merged by id; rows-only."""
    gold = V.gold(spark, sf_dir)
    base, *_ = clf.train_main(gold, preset="base")
    spec, *_ = clf.train_main(gold, preset="specialist")
    preds = clf.predict_hybrid(base, spec, _docs_with_titles(spark, sf_dir))
    return _round_preds(preds).select("comment_id", *PREDICTION_COLS)


@register("hybrid_invariants", "SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids, CAST(0 AS BIGINT) AS other_irony, CAST(0 AS BIGINT) AS other_sentiment,"
          " CAST(0 AS BIGINT) AS other_labels, CAST(0 AS BIGINT) AS specialist_like_base FROM documents")
def q_hybrid_invariants(spark, sf_dir):
    """M6, stated invariants: every row once; irony and sentiment are those that the specialist predicts alone, the other
    labels those of the base; and the two models do differ (else nothing would be told apart)."""
    from tenor.staging import stage
    gold = V.gold(spark, sf_dir)
    base, *_ = clf.train_held_out(gold, preset="base")
    spec, *_ = clf.train_held_out(gold, preset="specialist")
    docs = stage(_docs_with_titles(spark, sf_dir), "hybrid-docs")
    own = ["irony_ft_prob", "irony_ft_pred", "sent_neg_prob", "sent_neu_prob", "sent_pos_prob", "sent_pred"]
    rest = [c for c in PREDICTION_COLS if c not in own]
    h = clf.predict_hybrid(base, spec, docs).select("comment_id", *PREDICTION_COLS)
    alone = lambda m, cols, mark: clf.predict(m, docs).select("comment_id", *[F.col(c).alias(f"{mark}{c}") for c in cols])
    j = h.join(alone(spec, own, "s_"), "comment_id").join(alone(base, PREDICTION_COLS, "b_"), "comment_id")
    off = lambda cols, mark: reduce(lambda a, b: a | b, [~(F.abs(F.col(c) - F.col(f"{mark}{c}")) <= 1e-12) for c in cols])
    return j.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("comment_id").alias("n_ids"), F.count_if(off(own[:2], "s_")).alias("other_irony"),
                 F.count_if(off(own[2:], "s_")).alias("other_sentiment"), F.count_if(off(rest, "b_")).alias("other_labels"),
                 (F.count_if(off(["irony_ft_prob"], "b_")) == 0).cast("bigint").alias("specialist_like_base"))


# ----------------------------------------------------------------------------
# Landed pages -> rows. Pages are landed from the driver tables by Spark
# (a page holds at most 100 / 50 items, as an API page does), then flattened.



def _landed_comment_pages(spark, sf_dir):
    conv = V.table(spark, sf_dir, "conversations")
    pub = F.when(F.col("role") == "assistant", F.lit(None).cast("string")).otherwise(
        F.format_string("2020-01-01T00:00:%02dZ", (F.col("turn") % 60).cast("int")))
    item = F.struct(F.struct(F.struct(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.struct(pub.alias("publishedAt"), F.col("text").alias("textDisplay")).alias("snippet"),
    ).alias("topLevelComment")).alias("snippet"))
    rows = conv.withColumn("video_id", F.concat(F.lit("conv"), F.col("conv_id").cast("string"))) \
        .withColumn("page", F.expr("CAST(turn div 100 AS INT)"))
    return pg.pack_pages(rows, ["video_id", "page"], "turn", item)


@register("comment_pages", """SELECT 'conv' || CAST(conv_id AS VARCHAR) AS video_id, CAST(turn // 100 AS INTEGER) AS page,
  CAST(row_number() OVER (PARTITION BY conv_id, turn // 100 ORDER BY turn) - 1 AS INTEGER) AS pos,
  CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS comment_id,
  CASE WHEN role = 'assistant' THEN '' ELSE printf('2020-01-01T00:00:%02dZ', CAST(turn % 60 AS INTEGER)) END
    AS published_at, text
FROM conversations""")
def q_comment_pages(spark, sf_dir):
    return pg.flatten_comment_pages(_landed_comment_pages(spark, sf_dir))


@register("video_pages", V.with_views("videos")
          + " SELECT video_id, title, description, channel_title, published_at FROM videos")
def q_video_pages(spark, sf_dir):
    v = V.videos(spark, sf_dir).withColumn("__pid", F.expr("CAST(substring(video_id, 4) AS BIGINT)"))
    item = F.struct(F.col("video_id").alias("id"), F.struct(
        F.col("title").alias("title"), F.col("description").alias("description"),
        F.col("channel_title").alias("channelTitle"), F.col("published_at").alias("publishedAt")).alias("snippet"))
    landed = pg.pack_pages(v.withColumn("__page", F.expr("__pid div 50")), ["__page"], "__pid", item)
    return pg.flatten_video_pages(landed)


@register("search_pages", """SELECT event_type AS term, 'date' AS ord, CAST(event_id // 50 AS INTEGER) AS page,
  CAST(row_number() OVER (PARTITION BY event_type, event_id // 50 ORDER BY event_id) - 1 AS INTEGER) AS pos,
  CAST(event_id AS VARCHAR) AS video_id
FROM events""")
def q_search_pages(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("term"), F.lit("date").alias("ord"),
        F.expr("CAST(event_id div 50 AS INT)").alias("page"), "event_id")
    item = F.struct(F.struct(F.col("event_id").cast("string").alias("videoId")).alias("id"))
    landed = pg.pack_pages(e, ["term", "ord", "page"], "event_id", item)
    return pg.flatten_search_pages(landed)
