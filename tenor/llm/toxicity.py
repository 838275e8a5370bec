"""Toxicity scores: a Levenshtein automaton over a lexicon trie, and context windows.

The lexicon is learnt from labelled texts (words whose share of toxic texts is
far above their share of others). Its trie and the Levenshtein automata of its
terms run as one machine: a state is a set of (trie node, edits so far), made
deterministic as words reach it, so a word costs one table step per character
and most words die after a few. Each hit is then weighed in its window of
words: inside quotation marks or after a word of reporting it counts as
quotation, next to other hits as abuse. A logistic model over these sums, fitted
on the same labelled texts, gives the score.

Fitting reads at most about ``FIT_ROWS`` labelled texts, chosen by a hash of
the id; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenor.llm.common import stage

#: Bound of the labelled sample that lexicon and model are fitted on.
FIT_ROWS = 20_000
#: Toxic texts of the sample that a term must be in.
LEAST_TEXTS = 3
#: Words on either side of a hit that make its context.
WINDOW = 8
REPORTING = frozenset("said says wrote writes quoted quotes called reported cited".split())
_EDGE = " .,;:!?()[]{}<>\"'`*_~“”‘’«»"
_OPEN, _CLOSE = ("\"", "“", "«"), ("\"", "”", "»")
FEATURES = ("exact", "misspelled", "quoted", "window", "share", "words")


def edits_for(term: str) -> int:
    """Edits a term may be misspelt by."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """The trie of the terms, intersected with their Levenshtein automata; ``find`` gives (term, edits) or None."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.most, self.final = [0], [-1]
        for k, term in enumerate(terms):
            node, e = 0, edits_for(term)
            for c in term:
                self.most[node] = max(self.most[node], e)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                    self.final.append(-1)
                node = self.children[node][c]
            self.most[node] = max(self.most[node], e)
            self.final[node] = k
        self.letters = {c for kids in self.children for c in kids}
        self.states: list[dict[int, int]] = []
        self.number: dict[tuple, int] = {}
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.dead = self._state({})
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of a set of (node, edits), after letters of the terms that the word may lack."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            for kid in self.children[node].values():
                e = nodes[node] + 1
                if e <= self.most[kid] and e < nodes.get(kid, 99):
                    nodes[kid] = e
                    todo.append(kid)
        key = tuple(sorted(nodes.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(nodes)
            self.steps.append({})
            ends = [(e, self.final[n]) for n, e in nodes.items() if self.final[n] >= 0 and e <= edits_for(self.terms[self.final[n]])]
            self.accepts.append(min(ends) if ends else None)
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        to: dict[int, int] = {}
        for node, e in self.states[state].items():
            for letter, kid in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.most[kid] and cost < to.get(kid, 99):
                    to[kid] = cost
            if e + 1 <= self.most[node] and e + 1 < to.get(node, 99):
                to[node] = e + 1
        return self._state(to)

    def find(self, word: str) -> tuple[int, int] | None:
        state, steps, dead = self.start, self.steps, self.dead
        for c in word:
            if c not in self.letters:
                c = ""  # all other characters step alike
            to = steps[state].get(c)
            if to is None:
                to = steps[state][c] = self._step(state, c)
            if to == dead:
                return None
            state = to
        hit = self.accepts[state]
        return None if hit is None else (hit[1], hit[0])


@dataclass
class Model:
    terms: list[str]
    weights: np.ndarray
    coefficients: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray


def _chunks(texts: pa.Array) -> pa.ListArray:
    return pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))


def features(texts: pa.Array, automaton: LexiconAutomaton, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one row of ``FEATURES`` per text, number of hits per text)."""
    lists = _chunks(texts)
    per = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    found = [automaton.find(w.strip(_EDGE).lower()) if w else None for w in words]
    is_hit = np.array([f is not None for f in found], bool)
    which = coded.indices.to_numpy(zero_copy_only=False)
    places = np.flatnonzero(is_hit[which]) if len(words) else np.zeros(0, np.int64)
    begin = np.cumsum(per) - per
    doc = np.searchsorted(begin, places, side="right") - 1
    out = np.zeros((len(per), len(FEATURES)))
    hits = np.bincount(doc, minlength=len(per)) if len(places) else np.zeros(len(per), np.int64)
    edge = np.concatenate([[0], np.cumsum(hits)])
    for d in np.flatnonzero(hits).tolist():
        a, b = begin[d], begin[d] + per[d]
        at = places[edge[d]:edge[d + 1]]
        value = np.zeros(len(at))
        for k, p in enumerate(at.tolist()):
            term, edits = found[which[p]]
            context = [words[which[x]] for x in range(max(a, p - WINDOW), min(b, p + WINDOW + 1))]
            quoted = is_quoted(context, min(p - a, WINDOW))
            value[k] = weights[term] * (0.25 if quoted else 1.0) / (1 + edits)
            out[d, 2 if quoted else 1 if edits else 0] += weights[term]
        # The largest sum of values in a window of 2 * WINDOW words.
        run = np.cumsum(value)
        lo = np.searchsorted(at, at - 2 * WINDOW, side="right")
        out[d, 3] = (run - np.concatenate([[0], run])[lo]).max()
        out[d, 4] = value.sum() / per[d]
    out[:, :4] = np.log1p(out[:, :4])
    out[:, 4] = np.sqrt(out[:, 4])
    out[:, 5] = np.log1p(per)
    return out, hits


def is_quoted(context: list[str], at: int) -> bool:
    """Whether the word at ``at`` stands between quotation marks of the window, or after a word of reporting."""
    opened = next((i for i in range(at, -1, -1) if context[i][:1] in _OPEN or i < at and context[i][-1:] in _CLOSE), None)
    if opened is not None and context[opened][:1] in _OPEN and any(context[i].rstrip(".,;:!?")[-1:] in _CLOSE for i in range(max(at, opened), len(context))):
        return True
    return any(w.strip(_EDGE).lower() in REPORTING for w in context[max(0, at - 3):at])


def learn_lexicon(sample: DataFrame) -> tuple[list[str], np.ndarray]:
    """Terms and weights from ``body, toxic``: all words in at least ``LEAST_TEXTS`` toxic texts whose log-odds, less
    two standard errors, are above 1. Only those come back, out of the words of a sample of bounded size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in {c.strip(_EDGE).lower() for c in (text or "").split()} - {""}:
                    sums.setdefault(w, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x[0] for x in sums.values()], pa.int64()), pa.array([x[1] for x in sums.values()], pa.int64())], names=["w", "clean", "bad"])

    sizes = sample.agg(F.count(F.when(F.col("toxic") == 0, 1)).alias("clean"), F.count(F.when(F.col("toxic") == 1, 1)).alias("bad")).first()
    if not sizes["bad"] or not sizes["clean"]:
        return [], np.zeros(0)
    counts = sample.select("body", "toxic").mapInArrow(count, "w string, clean long, bad long").groupBy("w").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    odds = F.log((F.col("bad") + 0.5) / (sizes["bad"] - F.col("bad") + 0.5)) - F.log((F.col("clean") + 0.5) / (sizes["clean"] - F.col("clean") + 0.5))
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = (counts.filter((F.col("bad") >= LEAST_TEXTS) & (F.length("w") >= 3))
            .withColumn("weight", odds - 2 * error).filter("weight > 1").orderBy(F.col("weight").desc(), "w").collect())
    return [r["w"] for r in best], np.array([r["weight"] for r in best])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 25) -> np.ndarray:
    """Newton's method; the last coefficient is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(documents: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """Learn from the labelled documents where ``may_learn`` (over the id alone) holds.

    Labels that are null or neither 0 nor 1 are left out; an id with several labels counts as toxic if one says so.
    Without both kinds of label the model has no terms and scores 0.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    share = min(1.0, fit_rows / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))  # about fit_rows rows
    sample = documents.filter(may_learn).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).join(F.broadcast(known), "id").select("body", "toxic")
    sample = stage(sample, "toxicity-sample")
    terms, weights = learn_lexicon(sample)

    def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LexiconAutomaton(terms)
        for batch in batches:
            x, _ = features(batch.column(0), automaton, weights)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, k]) for k in range(len(FEATURES))] + [batch.column(1)], names=[*FEATURES, "toxic"])

    # About fit_rows rows of a few numbers each.
    rows = sample.mapInArrow(feature_rows, ", ".join([f"{f} double" for f in FEATURES] + ["toxic int"])).collect() if terms else []
    if not rows:
        return Model([], np.zeros(0), np.zeros(len(FEATURES) + 1), np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    data = np.array(rows, float)
    data = data[np.lexsort(data.T)]  # the sums of a fit don't depend on the order of tasks
    x, y = data[:, :-1], data[:, -1]
    mean, deviation = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    return Model(terms, weights, fit_logistic((x - mean) / deviation, y), mean, deviation)


def score(documents: DataFrame, model: Model, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """-> the columns of ``carry`` plus ``score double`` (0 to 1), ``hits int``, one row per document.

    A null or empty text is scored as a text of no words. Rows are judged one by one; an empty table gives no rows.
    """
    at = len(carry)
    schema = documents.select(*carry).schema
    held = [f"`c{i}` {f.dataType.simpleString()}" for i, f in enumerate(schema)]
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        automaton = LexiconAutomaton(m.terms)
        for batch in batches:
            if m.terms:
                x, hits = features(batch.column(at), automaton, m.weights)
                z = ((x - m.mean) / m.deviation) @ m.coefficients[:-1] + m.coefficients[-1]
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            else:
                p, hits = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(p, pa.float64()), pa.array(hits, pa.int32())], names=[*[f"c{i}" for i in range(at)], "score", "hits"])

    own = documents.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(text_col).alias("body"))
    done = own.mapInArrow(run, ", ".join([*held, "score double", "hits int"]))
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "score", "hits")

