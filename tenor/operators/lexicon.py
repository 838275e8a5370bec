"""Lexicon scoring (J5, M1, M2, M7), labels and summaries (P12, A1, A14),
yearly caps and review samples (W1, W4).

The reference calls two per-row scoring libraries. Here the lexicons are
tables and scoring is a Spark job:

    comments --> tokens (posexplode of one array of structs that already
    carries the three previous tokens) --join lexicons--> per-token values
    --partial aggregate in the same task--> shuffle of key + sums --> scores

The text itself is never shuffled for scoring: its tokens are summed where it
is read. Look-back uses array positions, not a window, so a long text is never
sorted. Rows are told apart by key and text, so a repeated or null id pools
nothing; rows that repeat both add up evenly and are divided again.

Lexicon numbers are data (seed tables ship for tests and demos); numeric
equality with any particular library is not claimed.
"""

from __future__ import annotations

import csv
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenor.functions.numeric import sentiment_label
from tenor.functions.text import DISTRUST_TERMS, TRUST_TERMS, contains_any, tokens
from tenor.operators.cutoff import DATE_STEPS, Key, first_n_by_cutoff
from tenor.operators.joins import local_table

# ---------------------------------------------------------------------------
# Rule constants of the rule-based valence model (Hutto & Gilbert, 2014).
BOOST = 0.293             # booster word increment
CAPS_BOOST = 0.733        # ALL-CAPS emphasis increment
NEGATION_SCALAR = -0.74   # negated valence factor
BUT_BEFORE, BUT_AFTER = 0.5, 1.5
EXCLAIM_STEP, EXCLAIM_MAX = 0.292, 4
QUESTION_STEP, QUESTION_BIG = 0.18, 0.96
NORM_ALPHA = 15.0
DAMP = {2: 0.95, 3: 0.9}  # booster damping by distance
POLARITY_NEGATION = -0.5  # negated polarity factor of the polarity model
# Caps and seeds of the lexicon job.
MAX_PER_YEAR = 10_000
SAMPLE_PER_YEAR = 1_000
SAMPLE_SEED = 42
# ---------------------------------------------------------------------------

SCORE_COLS = ["vader_neg", "vader_neu", "vader_pos", "vader_compound", "tb_polarity", "tb_subjectivity"]


def _read_seed(name: str) -> list[dict]:
    with resources.files("tenor.data").joinpath(name).open(encoding="utf-8") as fh:
        return list(csv.DictReader(fh))


def seed_valence(spark: SparkSession) -> DataFrame:
    rows = [(r["token"], float(r["valence"])) for r in _read_seed("valence_seed.csv")]
    return local_table(spark, rows, ["token", "valence"])


def seed_polarity(spark: SparkSession) -> DataFrame:
    rows = [(r["token"], float(r["polarity"]), float(r["subjectivity"]), float(r["intensity"]))
            for r in _read_seed("polarity_seed.csv")]
    return local_table(spark, rows, ["token", "polarity", "subjectivity", "intensity"])


def seed_boosters() -> dict[str, float]:
    return {r["token"]: float(r["scalar"]) for r in _read_seed("boosters.csv")}


def seed_negations() -> list[str]:
    return [r["token"] for r in _read_seed("negations.csv")]


def _lookup(c: Column, d: dict[str, float]) -> Column:
    """Value of a small fixed word table (null when absent): one hash-set
    membership test per distinct value instead of a linear map scan."""
    by_value: dict[float, list[str]] = {}
    for k, v in d.items():
        by_value.setdefault(float(v), []).append(k)
    out = None
    for v, ks in by_value.items():
        out = (F.when(c.isin(*ks), F.lit(v)) if out is None else out.when(c.isin(*ks), F.lit(v)))
    return out if out is not None else F.lit(None).cast("double")


def token_rows(df: DataFrame, key: str, text: str = "text", lookback: int = 3, carry=()) -> DataFrame:
    """One row per token: key, *carry, pos (0-based), tok (case kept), token
    (lower), prev1..prevK (lower, null before the start). Empty texts keep one
    null row.

    The previous tokens are shifted copies of the token array (``slice`` +
    ``concat``) zipped with it, so the row is built in linear time and the
    tokenizer runs once per text."""
    carry = list(carry)
    toks = F.col("__toks")
    low = F.col("__low")
    n = F.size(low)
    shifted = [F.concat(F.array_repeat(F.lit(None).cast("string"), F.least(F.lit(k), n)),
                        F.slice(low, 1, F.greatest(n - k, F.lit(0)))).alias(f"prev{k}")
               for k in range(1, lookback + 1)]
    zipped = F.arrays_zip(toks.alias("tok"), low.alias("token"), *shifted)
    return (df.select(key, *carry, tokens(text).alias("__toks"))
              .select(key, *carry, "__toks", F.transform("__toks", lambda x: F.lower(x)).alias("__low"))
              .select(key, *carry, F.posexplode_outer(zipped).alias("pos", "t"))
              .select(key, *carry, "pos", "t.*"))


def _lex(lexicon: DataFrame, cols: list[str], prefix: str, on: str = "token") -> DataFrame:
    # The seed tables are local relations, so the planner knows their size and broadcasts them.
    return lexicon.select(F.col("token").alias(on), *[F.col(c).alias(f"{prefix}{c}") for c in cols])


def _is_upper(x: Column) -> Column:
    return (F.upper(x) == x) & (F.lower(x) != x)


def _doc_facts(text: str) -> list[Column]:
    """Per-text facts of the rule model, computed on the text row before exploding:
    mixed case, position of the first 'but', punctuation emphasis."""
    toks = tokens(text)
    lower_toks = F.transform(toks, lambda x: F.lower(x))
    txt = F.coalesce(F.col(text), F.lit(""))
    n_excl = F.length(txt) - F.length(F.replace(txt, F.lit("!"), F.lit("")))
    n_q = F.length(txt) - F.length(F.replace(txt, F.lit("?"), F.lit("")))
    q_amp = F.when(n_q > 3, F.lit(QUESTION_BIG)).when(n_q > 1, n_q * QUESTION_STEP).otherwise(F.lit(0.0))
    return [(F.exists(toks, _is_upper) & F.exists(toks, lambda x: ~_is_upper(x))).alias("__capdiff"),
            (F.array_position(lower_toks, "but") - 1).alias("__but"),
            (F.least(n_excl, F.lit(EXCLAIM_MAX)) * EXCLAIM_STEP + q_amp).alias("__amp")]


def score(df: DataFrame, valence_lex: DataFrame, polarity_lex: DataFrame, key: str = "comment_id",
          text: str = "text", rules: bool = False, boosters: dict | None = None,
          negations: list[str] | None = None, keep=None) -> DataFrame:
    """Six score columns (``SCORE_COLS``) per row; ``key`` may repeat or be null.

    ``keep=None``: every column of ``df`` is returned with the scores (joined
    back on key and text hash). ``keep=[cols]``: only key, those columns
    (narrow: ids, years, flags) and the scores; the narrow columns ride along as
    group keys, so there is no join back.

    ``rules=False``: valence is the plain lexicon sum (SQL-checkable);
    ``rules=True``: boosters, ALL-CAPS emphasis, negation in the three previous
    words, ``but`` clauses and ``!``/``?`` emphasis. Polarity/subjectivity:
    mean over matched words, scaled by a modifier word before it and flipped by
    a negation before that (both modes)."""
    boosters = boosters if boosters is not None else seed_boosters()
    negations = negations if negations is not None else seed_negations()
    join_back = keep is None
    keep = [] if keep is None else list(keep)
    facts = _doc_facts(text) if rules else []
    pre = df.select(F.struct(F.col(key), F.xxhash64(F.col(text))).alias("__k"), *keep, text, *facts)
    key, own = "__k", key
    fact_cols = ["__capdiff", "__but", "__amp"] if rules else []
    t = token_rows(pre, key, text, carry=[*keep, *fact_cols])
    t = (t.join(_lex(valence_lex, ["valence"], "", "token"), "token", "left")
          .join(_lex(polarity_lex, ["polarity", "subjectivity", "intensity"], "", "token"), "token", "left")
          .join(_lex(polarity_lex, ["intensity"], "m1_", "prev1"), "prev1", "left"))

    def is_neg(c: str) -> Column:
        # isin over literals is planned as a hash-set lookup (InSet).
        return F.coalesce(F.col(c).isin(*negations), F.lit(False))

    # Polarity model: modifier = a lexicon word whose intensity is not 1.
    mod1 = F.coalesce(F.col("m1_intensity"), F.lit(1.0))
    is_mod1 = mod1 != 1.0
    negated = is_neg("prev1") | (is_mod1 & is_neg("prev2"))
    scored = F.col("polarity").isNotNull() & (F.col("intensity") == 1.0)
    p = F.col("polarity") * mod1 * F.when(negated, F.lit(POLARITY_NEGATION)).otherwise(F.lit(1.0))
    s = F.least(F.col("subjectivity") * mod1, F.lit(1.0))
    t = t.withColumn("p", F.when(scored, p)).withColumn("s", F.when(scored, s))
    if rules:
        t = _valence_rules(t, valence_lex, boosters, negations)
    else:
        t = t.withColumn("v", F.when(F.col("tok").isNotNull(), F.coalesce(F.col("valence"), F.lit(0.0))))

    v = F.col("v")
    agg = t.groupBy(key, *keep).agg(
        F.sum(v).alias("__s"),
        F.sum(F.when(v > 0, v + 1.0).otherwise(0.0)).alias("__pos"),
        F.sum(F.when(v < 0, v - 1.0).otherwise(0.0)).alias("__neg"),
        F.count(F.when(v == 0, 1)).alias("__neu"),
        F.avg("p").alias("__p"), F.avg("s").alias("__subj"),
        F.count(F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, 1)).alias("__c"),  # rows with this key and text
        *([F.max("__amp").alias("__amp")] if rules else []),
    )
    agg = agg.withColumns({c: F.col(c) / F.col("__c") for c in ("__s", "__pos", "__neg", "__neu")})
    if rules:
        amp = F.col("__amp")
        ssum = (F.when(F.col("__s") > 0, F.col("__s") + amp)
                .when(F.col("__s") < 0, F.col("__s") - amp).otherwise(F.col("__s")))
        pos_sum = F.when(F.col("__pos") > -F.col("__neg"), F.col("__pos") + amp).otherwise(F.col("__pos"))
        neg_sum = F.when(F.col("__pos") < -F.col("__neg"), F.col("__neg") - amp).otherwise(F.col("__neg"))
    else:
        ssum, pos_sum, neg_sum = F.col("__s"), F.col("__pos"), F.col("__neg")
    agg = agg.select(key, *keep, ssum.alias("__s"), pos_sum.alias("__pos"), neg_sum.alias("__neg"),
                     "__neu", "__p", "__subj", "__c")
    total = F.col("__pos") - F.col("__neg") + F.col("__neu")
    share = lambda c: F.when(total > 0, F.abs(c) / total).otherwise(F.lit(0.0))
    s_ = F.coalesce(F.col("__s"), F.lit(0.0))
    compound = s_ / F.sqrt(s_ * s_ + F.lit(NORM_ALPHA))
    if rules:
        compound = F.least(F.greatest(compound, F.lit(-1.0)), F.lit(1.0))
    scores = agg.select(
        key, *keep, "__c",
        share(F.col("__neg")).alias("vader_neg"),
        share(F.col("__neu")).alias("vader_neu"),
        share(F.col("__pos")).alias("vader_pos"),
        compound.alias("vader_compound"),
        F.least(F.greatest(F.coalesce(F.col("__p"), F.lit(0.0)), F.lit(-1.0)), F.lit(1.0)).alias("tb_polarity"),
        F.least(F.greatest(F.coalesce(F.col("__subj"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("tb_subjectivity"),
    )
    if join_back:
        ident = F.struct(F.col(own), F.xxhash64(F.col(text)))
        return df.withColumn(key, ident).join(scores.drop("__c"), key, "left").drop(key)
    rows = scores.withColumn("__c", F.explode(F.array_repeat(F.lit(0), F.col("__c").cast("int"))))
    return rows.select(F.col(f"{key}.{own}").alias(own), *keep, *SCORE_COLS)


def _valence_rules(t: DataFrame, valence_lex: DataFrame, boosters: dict, negations: list[str]) -> DataFrame:
    """Per-token valence with the published rules (uses the carried text facts)."""
    for k in (1, 2, 3):
        t = t.join(_lex(valence_lex, ["valence"], f"l{k}_", f"prev{k}"), f"prev{k}", "left")
    capdiff = F.col("__capdiff")
    tok = F.col("tok")
    v = F.col("valence")
    # Each step is its own column so that no step's expression is inlined twice.
    t = t.withColumn("__v0", F.when(_is_upper(tok) & capdiff,
                                    F.when(v > 0, v + CAPS_BOOST).otherwise(v - CAPS_BOOST)).otherwise(v))
    for k in (1, 2, 3):
        prev, cur = F.col(f"prev{k}"), F.col(f"__v{k - 1}")
        eligible = prev.isNotNull() & F.col(f"l{k}_valence").isNull()
        b = F.coalesce(_lookup(prev, boosters), F.lit(0.0)) * DAMP.get(k, 1.0)
        negated = F.coalesce(prev.isin(*negations), F.lit(False)) | prev.endswith("n't")
        t = (t.withColumn("__b", F.when(cur < 0, -b).otherwise(b))
              .withColumn(f"__v{k}", F.when(eligible, F.when(negated, (cur + F.col("__b")) * NEGATION_SCALAR)
                                             .otherwise(cur + F.col("__b"))).otherwise(cur)))
    # Words outside the lexicon and booster words carry no valence of their own.
    t = t.withColumn("__v4", F.when(F.col("valence").isNull() | _lookup(F.col("token"), boosters).isNotNull(),
                                    F.lit(0.0)).otherwise(F.col("__v3")))
    v, but = F.col("__v4"), F.col("__but")
    v = (F.when(but < 0, v).when(F.col("pos") < but, v * BUT_BEFORE)
         .when(F.col("pos") > but, v * BUT_AFTER).otherwise(v))
    return t.withColumn("v", F.when(tok.isNotNull(), v))


def add_flags(df: DataFrame, text: str = "text", distrust=DISTRUST_TERMS, trust=TRUST_TERMS) -> DataFrame:
    """``text_lower`` (null -> '') and the two keyword-any flags."""
    low = F.coalesce(F.lower(F.col(text)), F.lit(""))
    return (df.withColumn("text_lower", low)
              .withColumn("is_distrust", contains_any("text_lower", distrust))
              .withColumn("is_trust", contains_any("text_lower", trust)))


def analyze(df: DataFrame, valence_lex: DataFrame, polarity_lex: DataFrame, key: str = "comment_id",
            text: str = "text", rules: bool = False, keep=None, **kw) -> DataFrame:
    """M1 + M2 + P9 + P11: scores, lowered text and flags (also used for removed rows, M7).

    With ``keep`` only key, ``keep``, the flags and the scores come back (see :func:`score`)."""
    if keep is None:
        return add_flags(score(df, valence_lex, polarity_lex, key, text, rules, **kw), text)
    flagged = add_flags(df, text)
    return score(flagged, valence_lex, polarity_lex, key, text, rules,
                 keep=[*keep, "is_distrust", "is_trust"], **kw)


def label_sentiment(df: DataFrame) -> DataFrame:
    """P12."""
    return df.withColumn("sent_label", sentiment_label("vader_compound"))


def yearly_summary(df: DataFrame) -> DataFrame:
    """A1: one row per year, counts and unrounded score means."""
    lab = F.col("sent_label")
    return df.groupBy("year").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(lab == "positive").alias("pos_count"),
        F.count_if(lab == "neutral").alias("neu_count"),
        F.count_if(lab == "negative").alias("neg_count"),
        F.count_if(F.col("is_distrust")).alias("distrust_count"),
        F.count_if(F.col("is_trust")).alias("trust_count"),
        *[F.avg(c).alias(f"avg_{c}") for c in SCORE_COLS],
    )


def year_range(df: DataFrame) -> DataFrame:
    """A14."""
    return df.agg(F.min("year").alias("min_year"), F.max("year").alias("max_year"),
                  F.count(F.lit(1)).alias("n_rows"))


def cap_per_year(df: DataFrame, n: int = MAX_PER_YEAR, key: str = "comment_id") -> DataFrame:
    """The earliest n per year by published_at (nulls last), ties by id; rows beyond the cut-off are filtered where they are read."""
    return first_n_by_cutoff(df, ["year"], [Key("published_at", nulls_last=True, steps=DATE_STEPS), key], n)


def review_sample(df: DataFrame, n: int = SAMPLE_PER_YEAR, seed: int = SAMPLE_SEED,
                  key: str = "comment_id") -> DataFrame:
    """min(n, rows) per year, pseudo-random but seeded: order by md5(id:seed)."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return first_n_by_cutoff(df.withColumn("__h", h), ["year"], ["__h", key], n).drop("__h")
