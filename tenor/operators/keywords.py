"""Keyword lists as tables (P11, A2): thousands of literal terms in one pass over the texts.

A test per term reads every text once per term. Here each term is known by an anchor, the rarest of its
windows of seven characters (all of it if it is shorter): a text can only hold a term whose anchor it holds. So a text's
windows are looked up among the anchors, the few that are met lead to their terms by a join with the table of
terms, and only those terms are tried on the text itself. Windows are looked up in Arrow batches, on the UTF-8 bytes of a
whole batch at once: a window is a number made of its bytes. Results are those of a plain substring search: case and
blanks count, occurrences do not overlap. Texts cross no shuffle; counts and flags are summed where the text is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenor.functions.text import occurrences_of
from tenor.staging import stage

WINDOW = 7
#: Anchors that stand in the plan as a table of numbers; of longer lists every window of a text is joined.
ANCHORS_IN_PLAN = 20_000
#: Texts from which the windows' frequencies are read. They only say which anchor is tried, not what is found.
RARITY_TEXTS = 2_000
#: Bytes of a window that stand in its number (the eighth holds how many there are), bytes looked at at once, and by how
#: many bits the first, coarse look is wider than the list.
KEY_BYTES, AT_ONCE, COARSE = 7, 1 << 17, 6


def window_key(window: str | Column) -> Column:
    """A window as a number: its first bytes and how many they are. Windows that begin alike may share it."""
    head = F.substring(F.encode(window, "UTF-8"), 1, KEY_BYTES)
    return F.conv(F.hex(head), 16, 10).cast("long").bitwiseOR(F.shiftleft(F.octet_length(head).cast("long"), 8 * KEY_BYTES))


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold some AT_ONCE bytes, one text at least."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + AT_ONCE, side="right")) - 1)
        yield a, b
        a = b


def held_keys(lengths: list[int], known: np.ndarray | None):
    """A column function: text as bytes -> the distinct keys of its windows of ``lengths`` bytes, of all or those ``known``,
    each with its occurrences that do not overlap."""
    coarse, spread, cut = None, np.uint64(0x9E3779B97F4A7C15), None
    if known is not None:
        known = np.unique(np.asarray(known, np.int64))
        bits = max(16, len(known).bit_length() + COARSE)
        coarse, cut = np.zeros(1 << bits, bool), np.uint64(64 - bits)
        coarse[(known.astype(np.uint64) * spread) >> cut] = True

    def held(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, key, occurrences) of the windows in some texts, sorted, each once."""
        found, windows = [], data.astype(np.uint64)
        for n in range(1, min(max(lengths, default=0), len(data)) + 1):
            if n > 1:
                windows = windows[:-1] << np.uint64(8) | data[n - 1:]
            if n not in lengths:
                continue
            keys = windows | np.uint64(n << 8 * KEY_BYTES)
            at = np.arange(len(keys)) if coarse is None else np.flatnonzero(coarse[(keys * spread) >> cut])
            key = keys[at].astype(np.int64)
            if coarse is not None:
                exact = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
                at, key = at[exact], key[exact]
            row = np.searchsorted(offsets, at, side="right") - 1
            whole = at + n <= offsets[row + 1]
            found.append((row[whole], key[whole], at[whole]))
        row, key, at = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
        order = np.lexsort((key, row))   # stable: places of a window stay in order
        row, key, at = row[order], key[order], at[order]
        same = (row[1:] == row[:-1]) & (key[1:] == key[:-1])
        first = np.flatnonzero(np.concatenate([[True], ~same])[:len(row)])
        n = np.diff(np.append(first, len(row)))
        overlapping = np.flatnonzero(same & (np.diff(at) < key[1:] >> 8 * KEY_BYTES)) + 1
        for g in np.unique(np.searchsorted(first, overlapping, side="right") - 1):   # windows like "aa" in "aaa": counted one by one
            size, end, n[g] = key[first[g]] >> 8 * KEY_BYTES, -1, 0
            for x in at[first[g]:first[g + 1] if g + 1 < len(first) else len(row)].tolist():
                if x >= end:
                    n[g], end = n[g] + 1, x + size
        return row[first], key[first], n

    def of(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        keys, counts, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [[0]]
        for a, b in _pieces(offsets):
            row, key, n = held(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            keys.append(key)
            counts.append(n)
            sizes.append(np.bincount(row, minlength=b - a))
        each = pa.StructArray.from_arrays([pa.array(np.concatenate(keys), pa.int64()), pa.array(np.concatenate(counts), pa.int64())], ["key", "n"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), each)

    return F.arrow_udf(of, "array<struct<key: long, n: long>>")


def with_keys(texts: DataFrame, text: str, windows: DataFrame) -> DataFrame:
    """A row per text and key of the windows (column ``w``) that it holds: columns ``__key, __n`` (its occurrences)."""
    keys = windows.select(window_key("w").alias("k")).distinct()
    lengths = sorted({r[0] >> 8 * KEY_BYTES for r in keys.select(F.col("k").bitwiseAND(F.lit(15 << 8 * KEY_BYTES)).alias("k")).distinct().collect()})   # 1 to KEY_BYTES
    few = [r["k"] for r in keys.limit(ANCHORS_IN_PLAN + 1).collect()]   # bounded by ANCHORS_IN_PLAN
    held = held_keys(lengths, np.array(few, np.int64) if len(few) <= ANCHORS_IN_PLAN else None)
    # Outer: an inner generator would get a filter that looks the windows up a second time.
    each = texts.select("*", F.explode_outer(held(F.col(text).cast("binary"))).alias("__held"))
    return each.select(*texts.columns, F.col("__held.key").alias("__key"), F.col("__held.n").alias("__n")).filter("__key IS NOT NULL")


def term_anchors(lists: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """``list, term`` -> ``term, anchor, lists`` (terms once, with the lists they stand in): staged, a row per term.

    Null and empty terms take no part."""
    terms = lists.filter(F.length("term") > 0).groupBy("term").agg(F.sort_array(F.collect_set("list")).alias("lists"))
    size = F.least(F.length("term"), F.lit(WINDOW))
    own = terms.select("term", F.explode(F.transform(F.sequence(F.lit(1), F.length("term") - size + 1), lambda i: F.substr("term", i, size))).alias("w"))
    own = stage(own.withColumn("__key", window_key("w")), "term-windows")
    seen = with_keys(texts.select(F.col(text).alias("t")).limit(RARITY_TEXTS), "t", own).groupBy("__key").agg(F.count(F.lit(1)).alias("n"))
    rarest = own.join(seen, "__key", "left").groupBy("term").agg(F.min_by("w", F.struct(F.coalesce("n", F.lit(0)), "w")).alias("anchor"))
    return stage(rarest.join(terms, "term").select("term", "anchor", "lists"), "term-anchors")


def found_terms(texts: DataFrame, anchors: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` + ``term, lists, n``: the terms that each text holds, with their non-overlapping occurrences.

    ``anchors``: of :func:`term_anchors`. A null text holds nothing."""
    met = with_keys(texts.select(*keep, F.col(text).alias("__text")), "__text", anchors.select(F.col("anchor").alias("w")))
    # Windows that are the whole term are counted already. The text is asked for the others: whether it holds them, and only then how often.
    counted = (F.col("term") == F.col("anchor")) & (F.octet_length("term") <= KEY_BYTES)
    tried = met.join(anchors.withColumn("__key", window_key("anchor")), "__key").filter(counted | F.contains("__text", "term"))
    return tried.select(*keep, "term", "lists", F.when(counted, F.col("__n")).otherwise(occurrences_of("__text", F.col("term"))).alias("n"))


def keyword_counts(texts: DataFrame, lists: DataFrame, text: str = "text_lower") -> DataFrame:
    """A2 for lists as data -> ``list, term, count, n_texts``: non-overlapping occurrences over all texts and the number of
    texts that hold the term; terms that occur nowhere are kept with 0."""
    anchors = term_anchors(lists, texts, text)
    sums = found_terms(texts, anchors, text, []).groupBy("term").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("n_texts"))
    zero = F.lit(0).cast("long")
    return (anchors.join(sums, "term", "left").select(F.explode("lists").alias("list"), "term", F.coalesce("count", zero).alias("count"), F.coalesce("n_texts", zero).alias("n_texts")))


def keyword_lists(texts: DataFrame, lists: DataFrame, key: str = "comment_id", text: str = "text_lower") -> DataFrame:
    """P11 for lists as data -> ``key, list, n_terms, n_hits``: a row per text and list of which it holds a term.

    Rows are told apart by key and text, so a repeated or null key mixes nothing; rows that repeat both give one row."""
    anchors = term_anchors(lists, texts, text)
    row = texts.select(F.col(key), F.col(text), F.xxhash64(text).alias("__hash"))
    found = found_terms(row, anchors, text, [key, "__hash"]).dropDuplicates([key, "__hash", "term"])
    each = found.withColumn("list", F.explode("lists"))
    return each.groupBy(key, "__hash", "list").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("n").alias("n_hits")).drop("__hash")
