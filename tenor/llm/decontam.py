"""Benchmark decontamination with a generalised suffix automaton over words.

The normalised words of the test items form one automaton. Training words are
streamed through it: the state holds the longest suffix of the words read that
occurs in some item, and its length. Where that length reaches the window (13
words, or all words of a shorter item), the words of the window are hit, and
the automaton's links give the items. Long matches therefore come out as whole
spans, which are cut or judged by length and coverage.

The automata are the only data that is broadcast. An automaton holds at most
``BLOCK_WORDS`` words; a larger set of items becomes several, and the documents
pass through one after the other without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenor.llm.common import byte_views, fan_out, free_name

#: Words an automaton holds at most; items longer than that are cut into overlapping parts.
BLOCK_WORDS = 200_000
#: A word is a run of 0-9, a-z (after lower-casing A-Z) and anything beyond ASCII; other bytes become blanks.
_KEEP = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: memoryview | bytes | None) -> list[bytes]:
    return [] if text is None else bytes(text).translate(_KEEP).split()


class SuffixAutomaton:
    """All runs of words of the items; ``step`` is one transition of the matching."""

    def __init__(self, items: list[tuple[str, list[bytes], int]], window: int):
        """``items``: (id, words, words of the whole item). Parts of a longer item come one by one."""
        self.ids: dict[bytes, int] = {}
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.window = window
        names: list[str] = []
        ends: list[tuple[int, int, int]] = []
        for name, ws, whole in items:
            state = 0
            need = min(window, whole)
            names.append(name)
            for i, w in enumerate(ws):
                state = self._add(state, self.ids.setdefault(w, len(self.ids)))
                if need and i + 1 >= need:
                    ends.append((state, need, len(names) - 1))
        self.shortest = min((need for _, need, _ in ends), default=0)
        # For each state, (length, items) of the windows that end there; a window is the suffix of that length.
        here: list[dict[int, set[int]]] = [{} for _ in self.go]
        for state, need, item in ends:
            while self.length[self.link[state]] >= need:
                state = self.link[state]
            here[state].setdefault(need, set()).add(item)
        self.names = names
        self.here = here
        # The nearest state on the way along the links, itself included, in which a window ends.
        self.near = [-1] * len(self.go)
        for s in sorted(range(1, len(self.go)), key=self.length.__getitem__):
            self.near[s] = s if here[s] else self.near[self.link[s]]

    def _clone(self, state: int, c: int, q: int) -> int:
        new = len(self.go)
        self.go.append(dict(self.go[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[state] + 1)
        self.link[q] = new
        while state >= 0 and self.go[state].get(c) == q:
            self.go[state][c] = new
            state = self.link[state]
        return new

    def _add(self, last: int, c: int) -> int:
        q = self.go[last].get(c)
        if q is not None:  # this run of words is known from an earlier item
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = len(self.go)
        self.go.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        state = last
        while state >= 0 and c not in self.go[state]:
            self.go[state][c] = new
            state = self.link[state]
        if state >= 0:
            q = self.go[state][c]
            self.link[new] = q if self.length[q] == self.length[state] + 1 else self._clone(state, c, q)
        return new

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (first word, end) covered by windows, merged, and the items with windows in them."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        if len(ws) < self.shortest or not self.shortest:
            return spans, set()
        get = self.ids.get
        ids = np.array([get(w, -1) for w in ws], np.int64)
        # Unknown words reset the automaton: only runs of known words as long as the shortest window are streamed.
        known = np.concatenate([[False], ids >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1]).reshape(-1, 2)
        go, link, length, near, here = self.go, self.link, self.length, self.near, self.here
        for a, b in edges[edges[:, 1] - edges[:, 0] >= self.shortest].tolist():
            state = n = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                to = go[state].get(c)
                while to is None and state:
                    state = link[state]
                    n = length[state]
                    to = go[state].get(c)
                if to is None:
                    continue
                state, n = to, n + 1
                if n < self.shortest:
                    continue
                at = near[state]
                long = 0
                while at > 0:
                    for need, items in here[at].items():
                        if need <= n:
                            long = max(long, need)
                            found |= items
                    at = near[link[at]]
                if long:
                    start = i + 1 - long
                    if spans and start <= spans[-1][1]:
                        spans[-1] = (min(start, spans[-1][0]), i + 1)
                    else:
                        spans.append((start, i + 1))
        merged: list[tuple[int, int]] = []
        for s, e in spans:
            while merged and s <= merged[-1][1]:
                s = min(s, merged.pop()[0])
            merged.append((s, e))
        return merged, {self.names[i] for i in found}


def _blocks(items: DataFrame, item_id: str, item_text: str, window: int) -> Iterator[list[tuple[str, list[bytes], int]]]:
    """The items in blocks of bounded size; at most one block is with the driver at a time."""
    own = items.filter(F.col(item_text).isNotNull()).select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(item_text).alias("text"))
    sized = own.withColumn("n", F.length(F.regexp_replace("text", "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "a")))
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n = fan_out(total, BLOCK_WORDS)
    for k in range(n):
        block: list[tuple[str, list[bytes], int]] = []
        held = 0
        for r in own.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).toLocalIterator():
            ws = words(r["text"].encode())
            for a in range(0, max(1, len(ws) - window + 1), BLOCK_WORDS):
                part = ws[a:a + BLOCK_WORDS + window - 1]
                if held and held + len(part) > BLOCK_WORDS:
                    yield block
                    block, held = [], 0
                block.append((r["id"], part, len(ws)))
                held += len(part)
        if block:
            yield block


def scan(documents: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13,
         carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """-> the columns of ``carry`` plus ``n_words int, spans array<struct<first,end>> (words), items array<string>``.

    A null text has no words, nor has an empty one; an item without words is in no document. Repeated items and
    documents each count for themselves; an item whose id is null has the id ''. With no items nothing is hit.
    Names in ``carry`` may be any of the columns of ``documents``; the others are not read. The three new columns come
    last, with underscores behind their names if ``carry`` has those.
    """
    spark = documents.sparkSession
    at = len(carry)
    schema = documents.select(*carry).schema
    held = ", ".join(f"`c{i}` {f.dataType.simpleString()}" for i, f in enumerate(schema))
    out = f"{held}, body string, n_words int, firsts array<int>, ends array<int>, items array<string>"
    df = documents.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(text_col).alias("body"),
                          F.lit(0).alias("n_words"), F.array().cast("array<int>").alias("firsts"), F.array().cast("array<int>").alias("ends"), F.array().cast("array<string>").alias("items"))
    blocks = list(_automata(spark, items, item_id, item_text, window))
    for b in blocks or [spark.sparkContext.broadcast(SuffixAutomaton([], window))]:
        def run(batches: Iterator[pa.RecordBatch], automaton=b) -> Iterator[pa.RecordBatch]:
            sam = automaton.value
            for batch in batches:
                n, firsts, ends, names = [], [], [], []
                for text, old_first, old_end, old_names in zip(byte_views(batch.column(at)), batch.column(at + 2).to_pylist(), batch.column(at + 3).to_pylist(), batch.column(at + 4).to_pylist()):
                    ws = words(text)
                    spans, found = sam.scan(ws)
                    if old_first:
                        spans = _union(spans + list(zip(old_first, old_end)))
                    n.append(len(ws))
                    firsts.append([s for s, _ in spans])
                    ends.append([e for _, e in spans])
                    names.append(sorted(found | set(old_names)))
                new = [pa.array(n, pa.int32()), pa.array(firsts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:at + 1], *new], names=batch.schema.names)

        df = df.mapInArrow(run, out)
    own = documents.select(*carry)
    made = {"n_words": F.col("n_words"), "spans": F.arrays_zip(F.col("firsts").alias("first"), F.col("ends").alias("end")), "items": F.col("items")}
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], *[c.alias(free_name(own, name)) for name, c in made.items()])


def _automata(spark, items, item_id, item_text, window):
    for block in _blocks(items, item_id, item_text, window):
        yield spark.sparkContext.broadcast(SuffixAutomaton(block, window))


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def n_hit(spans: str | Column = "spans") -> Column:
    return F.aggregate(F.col(spans) if isinstance(spans, str) else spans, F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["first"]))


def verdict(hits: Column, n_words: Column, one_in: int = 20) -> Column:
    """Contaminated: some word is hit, and at least one word in ``one_in``."""
    return (hits > 0) & (hits * one_in >= n_words)


def clean(documents: DataFrame, items: DataFrame, text_col: str = "text", window: int = 13, one_in: int = 20, max_span: int | None = None, **options) -> DataFrame:
    """The documents that are not contaminated, with their columns. With ``max_span``, spans of more words than that
    are also cut out of the texts that stay (without it such texts stay as they are)."""
    found = scan(documents, items, text_col=text_col, window=window, carry=tuple(documents.columns), **options)
    n_words, spans = found.columns[-3:-1]
    kept = found.filter(~verdict(n_hit(spans), F.col(n_words), one_in))
    if max_span is None:
        return kept.select(*documents.columns)

    @F.pandas_udf("string")
    def cut(texts, found_spans):
        import pandas as pd

        return pd.Series([_cut(t, [(s["first"], s["end"]) for s in sp if s["end"] - s["first"] > max_span]) for t, sp in zip(texts, found_spans)])

    return kept.withColumn(text_col, F.when(F.size(spans) > 0, cut(F.col(text_col), F.col(spans))).otherwise(F.col(text_col))).select(*documents.columns)


def _cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of ``spans`` and what stands between them."""
    import re

    if text is None or not spans:
        return text
    raw = text.encode()
    at = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
    out, last = [], 0
    for first, end in spans:
        out.append(raw[last:at[first][0]])
        last = at[end - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def items_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
