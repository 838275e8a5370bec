"""SQL text for the DuckDB oracles, generated from the same constants the Spark
operators use (term lists, lexicon rows, regex classes)."""

from __future__ import annotations

from tenor.functions.text import LETTER, TOKEN
from tenor.operators.lexicon import _read_seed, seed_negations


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def contains_any_sql(col: str, terms) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(t)})" for t in terms) + ")"


def has_letter_sql(col: str = "text") -> str:
    return f"COALESCE(regexp_matches({col}, {q(LETTER)}), false)"


def valence_values() -> str:
    rows = ", ".join(f"({q(r['token'])}, {dbl(r['valence'])})" for r in _read_seed("valence_seed.csv"))
    return f"SELECT * FROM (VALUES {rows}) t(token, valence)"


def polarity_values() -> str:
    rows = ", ".join(f"({q(r['token'])}, {dbl(r['polarity'])}, {dbl(r['subjectivity'])}, {dbl(r['intensity'])})"
                     for r in _read_seed("polarity_seed.csv"))
    return f"SELECT * FROM (VALUES {rows}) t(token, polarity, subjectivity, intensity)"


def negation_list() -> str:
    return "(" + ", ".join(q(w) for w in seed_negations()) + ")"


def score_ctes(name: str, src: str, key: str = "comment_id", text: str = "text") -> str:
    """CTEs ``{name}_*`` ending in ``{name}``: ``src`` plus the six score columns
    (plain-sum valence; polarity with modifier and negation)."""
    negs = negation_list()
    return f"""
{name}_vlex AS ({valence_values()}),
{name}_plex AS ({polarity_values()}),
{name}_arr AS (SELECT {key} AS k, regexp_extract_all(COALESCE({text}, ''), {q(TOKEN)}) AS toks FROM {src}),
{name}_u AS (SELECT k, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM {name}_arr),
{name}_tok AS (
  SELECT k, pos, tok, lower(tok) AS token,
         lag(lower(tok), 1) OVER (PARTITION BY k ORDER BY pos) AS prev1,
         lag(lower(tok), 2) OVER (PARTITION BY k ORDER BY pos) AS prev2
  FROM {name}_u),
{name}_tv AS (
  SELECT t.k, COALESCE(vl.valence, 0.0) AS v,
    CASE WHEN pl.polarity IS NOT NULL AND pl.intensity = 1.0 THEN
      pl.polarity * COALESCE(m.intensity, 1.0) *
      (CASE WHEN COALESCE(t.prev1 IN {negs}, false)
              OR (COALESCE(m.intensity, 1.0) <> 1.0 AND COALESCE(t.prev2 IN {negs}, false))
            THEN -0.5 ELSE 1.0 END) END AS p,
    CASE WHEN pl.polarity IS NOT NULL AND pl.intensity = 1.0 THEN
      least(pl.subjectivity * COALESCE(m.intensity, 1.0), 1.0) END AS s
  FROM {name}_tok t
  LEFT JOIN {name}_vlex vl ON vl.token = t.token
  LEFT JOIN {name}_plex pl ON pl.token = t.token
  LEFT JOIN {name}_plex m ON m.token = t.prev1),
{name}_agg AS (
  SELECT k, sum(v) AS s, sum(CASE WHEN v > 0 THEN v + 1.0 ELSE 0.0 END) AS pos_sum,
         sum(CASE WHEN v < 0 THEN v - 1.0 ELSE 0.0 END) AS neg_sum,
         count(CASE WHEN v = 0 THEN 1 END) AS neu, avg(p) AS p, avg(s) AS subj
  FROM {name}_tv GROUP BY k),
{name}_sc AS (
  SELECT k, COALESCE(s, 0.0) AS s, pos_sum, neg_sum, neu, pos_sum - neg_sum + neu AS total, p, subj
  FROM {name}_agg),
{name} AS (
  SELECT src.*,
    CASE WHEN sc.total > 0 THEN abs(sc.neg_sum) / sc.total ELSE 0.0 END AS vader_neg,
    CASE WHEN sc.total > 0 THEN abs(sc.neu) / sc.total ELSE 0.0 END AS vader_neu,
    CASE WHEN sc.total > 0 THEN abs(sc.pos_sum) / sc.total ELSE 0.0 END AS vader_pos,
    COALESCE(sc.s, 0.0) / sqrt(COALESCE(sc.s, 0.0) * COALESCE(sc.s, 0.0) + 15.0) AS vader_compound,
    least(greatest(COALESCE(sc.p, 0.0), -1.0), 1.0) AS tb_polarity,
    least(greatest(COALESCE(sc.subj, 0.0), 0.0), 1.0) AS tb_subjectivity
  FROM {src} src LEFT JOIN {name}_sc sc ON sc.k = src.{key})"""


def booster_values() -> str:
    from tenor.operators.lexicon import seed_boosters
    rows = ", ".join(f"({q(k)}, {dbl(v)})" for k, v in seed_boosters().items())
    return f"SELECT * FROM (VALUES {rows}) t(token, scalar)"


def rules_ctes(name: str, src: str, key: str = "comment_id", text: str = "text") -> str:
    """CTEs ending in ``{name}``: (key, vader_neg, vader_neu, vader_pos, vader_compound)
    of the rule-based valence model, mirroring ``lexicon.score(rules=True)``."""
    from tenor.operators import lexicon as L
    negs = negation_list()
    up = "(upper(tok) = tok AND lower(tok) <> tok)"
    steps = []
    prev = "v0"
    for k in (1, 2, 3):
        damp = L.DAMP.get(k, 1.0)
        b = f"(COALESCE(b{k}.scalar, 0.0) * {float(damp)!r})"
        bb = f"(CASE WHEN {prev} < 0 THEN -{b} ELSE {b} END)"
        negated = f"(COALESCE(t.prev{k} IN {negs}, false) OR ends_with(t.prev{k}, 'n''t'))"
        steps.append(f"""CASE WHEN t.prev{k} IS NOT NULL AND l{k}.valence IS NULL
                 THEN (CASE WHEN {negated} THEN ({prev} + {bb}) * {L.NEGATION_SCALAR!r} ELSE {prev} + {bb} END)
                 ELSE {prev} END""")
        prev = f"v{k}"
    joins = "\n".join(f"  LEFT JOIN {name}_vlex l{k} ON l{k}.token = t.prev{k}\n"
                      f"  LEFT JOIN {name}_boost b{k} ON b{k}.token = t.prev{k}" for k in (1, 2, 3))
    return f"""
{name}_vlex AS ({valence_values()}),
{name}_boost AS ({booster_values()}),
{name}_arr AS (SELECT {key} AS k, COALESCE({text}, '') AS txt,
                      regexp_extract_all(COALESCE({text}, ''), {q(TOKEN)}) AS toks FROM {src}),
{name}_u AS (SELECT k, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS pos FROM {name}_arr),
{name}_doc AS (
  SELECT a.k,
    COALESCE(bool_or({up.replace('tok', 'u.tok')}), false) AND COALESCE(bool_or(NOT {up.replace('tok', 'u.tok')}), false) AS capdiff,
    COALESCE(min(u.pos) FILTER (WHERE lower(u.tok) = 'but'), -1) AS but,
    least(length(a.txt) - length(replace(a.txt, '!', '')), {L.EXCLAIM_MAX}) * {L.EXCLAIM_STEP!r}
      + CASE WHEN length(a.txt) - length(replace(a.txt, '?', '')) > 3 THEN {L.QUESTION_BIG!r}
             WHEN length(a.txt) - length(replace(a.txt, '?', '')) > 1
               THEN (length(a.txt) - length(replace(a.txt, '?', ''))) * {L.QUESTION_STEP!r}
             ELSE 0.0 END AS amp
  FROM {name}_arr a LEFT JOIN {name}_u u ON u.k = a.k GROUP BY a.k, a.txt),
{name}_tok AS (
  SELECT k, pos, tok, lower(tok) AS token,
         lag(lower(tok), 1) OVER (PARTITION BY k ORDER BY pos) AS prev1,
         lag(lower(tok), 2) OVER (PARTITION BY k ORDER BY pos) AS prev2,
         lag(lower(tok), 3) OVER (PARTITION BY k ORDER BY pos) AS prev3
  FROM {name}_u),
{name}_t0 AS (
  SELECT t.*, d.capdiff, d.but, vl.valence, bt.scalar AS own_boost,
         l1.valence AS l1v, l2.valence AS l2v, l3.valence AS l3v,
         b1.scalar AS b1s, b2.scalar AS b2s, b3.scalar AS b3s
  FROM {name}_tok t JOIN {name}_doc d ON d.k = t.k
  LEFT JOIN {name}_vlex vl ON vl.token = t.token
  LEFT JOIN {name}_boost bt ON bt.token = t.token
{joins}),
{name}_t1 AS (SELECT *, CASE WHEN {up} AND capdiff THEN
                     (CASE WHEN valence > 0 THEN valence + {L.CAPS_BOOST!r} ELSE valence - {L.CAPS_BOOST!r} END)
                     ELSE valence END AS v0 FROM {name}_t0),
{name}_t2 AS (SELECT *, {steps[0].replace('b1.scalar', 'b1s').replace('l1.valence', 'l1v')} AS v1 FROM {name}_t1 t),
{name}_t3 AS (SELECT *, {steps[1].replace('b2.scalar', 'b2s').replace('l2.valence', 'l2v')} AS v2 FROM {name}_t2 t),
{name}_t4 AS (SELECT *, {steps[2].replace('b3.scalar', 'b3s').replace('l3.valence', 'l3v')} AS v3 FROM {name}_t3 t),
{name}_t5 AS (SELECT *, CASE WHEN valence IS NULL OR own_boost IS NOT NULL THEN 0.0 ELSE v3 END AS v4 FROM {name}_t4),
{name}_t6 AS (SELECT k, CASE WHEN but < 0 THEN v4 WHEN pos < but THEN v4 * {L.BUT_BEFORE!r}
                             WHEN pos > but THEN v4 * {L.BUT_AFTER!r} ELSE v4 END AS v FROM {name}_t5),
{name}_agg AS (
  SELECT t.k, sum(v) AS s, sum(CASE WHEN v > 0 THEN v + 1.0 ELSE 0.0 END) AS ps,
         sum(CASE WHEN v < 0 THEN v - 1.0 ELSE 0.0 END) AS ns, count(CASE WHEN v = 0 THEN 1 END) AS neu,
         max(d.amp) AS amp
  FROM {name}_t6 t JOIN {name}_doc d ON d.k = t.k GROUP BY t.k),
{name}_adj AS (
  SELECT k, CASE WHEN s > 0 THEN s + amp WHEN s < 0 THEN s - amp ELSE s END AS s,
         CASE WHEN ps > -ns THEN ps + amp ELSE ps END AS ps,
         CASE WHEN ps < -ns THEN ns - amp ELSE ns END AS ns, neu
  FROM {name}_agg),
{name} AS (
  SELECT src.{key},
    CASE WHEN a.ps - a.ns + a.neu > 0 THEN abs(a.ns) / (a.ps - a.ns + a.neu) ELSE 0.0 END AS vader_neg,
    CASE WHEN a.ps - a.ns + a.neu > 0 THEN abs(a.neu) / (a.ps - a.ns + a.neu) ELSE 0.0 END AS vader_neu,
    CASE WHEN a.ps - a.ns + a.neu > 0 THEN abs(a.ps) / (a.ps - a.ns + a.neu) ELSE 0.0 END AS vader_pos,
    least(greatest(COALESCE(a.s, 0.0) / sqrt(COALESCE(a.s, 0.0) * COALESCE(a.s, 0.0) + {L.NORM_ALPHA!r}), -1.0), 1.0)
      AS vader_compound
  FROM {src} src LEFT JOIN {name}_adj a ON a.k = src.{key})"""
