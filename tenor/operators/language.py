"""Language identification (M3) and the English filter.

Character n-gram profiles (Cavnar & Trenkle, 1994; naive Bayes scoring):

* train: grams of lowercased, space-padded words -> counts per (lang, gram)
  -> add-one smoothed log probabilities of every gram seen.
* score: per (text, lang) the sum of ``log p - floor`` over the text's grams that
  the profile holds plus ``n_grams * floor`` is the log likelihood; the best language
  wins. Ties, empty texts and texts matching no profile gram give null, so the
  English filter fails open.

A trigram never becomes a row. Texts come in Arrow batches as code points, three
neighbours packed into one number; counting is a sort of a batch's numbers, scoring a
lookup in the profile's sorted numbers. Training shuffles a row per (lang, gram) and
task; scoring shuffles nothing and joins nothing. A profile of more than
``LOOKUP_GRAMS`` grams is joined instead of sent to the tasks, with the same results.

Deterministic: no sampling, no random seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenor.functions.text import SPACE, col
from tenor.staging import stage

GRAM = 3
#: Rows (language, gram) of a profile that every task may hold, as numbers and weights.
LOOKUP_GRAMS = 1_000_000
#: Characters looked up at once, and distinct grams that a training task counts before it hands them on.
AT_ONCE, HELD_GRAMS = 1 << 20, 1 << 20


def _padded(text) -> Column:
    """' ' + lowercased text with whitespace runs collapsed to one space + ' '."""
    t = F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), f"{SPACE}+", " ")
    return F.concat(F.lit(" "), t, F.lit(" "))


def gram_windows(text, n: int = GRAM) -> Column:
    """Every n-character window of the padded text, as n non-overlapping regex
    scans at offsets 0..n-1 (linear; no per-gram lambda)."""
    t = _padded(text)
    pat = "(?s)" + "." * n
    return F.concat(*[F.regexp_extract_all(F.substr(t, F.lit(k + 1)), F.lit(pat), 0) for k in range(n)])


def in_word(gram: Column, n: int = GRAM) -> Column:
    """A window belongs to a padded word unless a space is strictly inside it."""
    inner = F.substring(gram, 2, n - 2)
    return ~inner.contains(" ")


def n_grams(text, n: int = GRAM) -> Column:
    """Number of in-word windows: all windows minus those with an inner space
    (for trigrams: one per space that is not at either end)."""
    t = _padded(text)
    windows = F.greatest(F.length(t) - (n - 1), F.lit(0))
    if n != GRAM:
        raise ValueError("n_grams is written for trigrams")
    mid = F.substring(t, 2, F.greatest(F.length(t) - 2, F.lit(0)))
    inner_spaces = F.length(mid) - F.length(F.replace(mid, F.lit(" "), F.lit("")))
    return windows - inner_spaces


def gram_rows(df: DataFrame, cols, text: str, n: int = GRAM) -> DataFrame:
    """One row per in-word gram occurrence: cols + gram."""
    g = df.select(*cols, F.explode(gram_windows(text, n)).alias("gram"))
    return g.filter(in_word(F.col("gram"), n))


def packed_grams(texts: list[str | None], ids: np.ndarray | None = None, base: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The in-word trigrams of padded texts, as numbers to ``base`` of code points (or of their ``ids``), and the place of
    each one's text; some ``AT_ONCE`` at a time."""
    sizes = np.array([len(t or "") for t in texts], np.int64)
    points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    for a in range(0, max(len(points) - GRAM + 1, 0), AT_ONCE):
        p, o = points[a:a + AT_ONCE + GRAM - 1], owner[a:a + AT_ONCE + GRAM - 1]
        whole = (o[:-2] == o[2:]) & (p[1:-1] != ord(" "))
        x = (p if ids is None else ids[p]).astype(np.uint64)
        codes = (x[:-2] * np.uint64(base) + x[1:-1]) * np.uint64(base) + x[2:]
        yield codes[whole], o[:-2][whole]


def _unpacked(codes: np.ndarray) -> list[str]:
    mask = (1 << 21) - 1
    return [chr(c >> 42) + chr(c >> 21 & mask) + chr(c & mask) for c in codes.tolist()]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, padded text -> lang, gram, c: sums over a task's texts, handed on when they are many."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, (codes, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(_unpacked(codes), pa.string()), pa.array(counts, pa.int64())], names=["lang", "gram", "c"])

    for batch in batches:
        langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
        for lang in set(langs.tolist()):
            for codes, _ in packed_grams([t for t, x in zip(texts, langs) if x == lang]):
                new, c = np.unique(codes, return_counts=True)
                if lang in held:
                    both = np.concatenate([held[lang][0], new])
                    new, at = np.unique(both, return_inverse=True)
                    c = np.bincount(at, weights=np.concatenate([held[lang][1], c]), minlength=len(new)).astype(np.int64)
                held[lang] = new, c
        if sum(len(c) for c, _ in held.values()) > HELD_GRAMS:
            yield from rows()
            held = {}
    yield from rows()


def train_profiles(df: DataFrame, text: str = "text", lang: str = "lang", n: int = GRAM) -> DataFrame:
    """(lang, gram, delta, floor): delta = log p(gram|lang) - floor, floor = log of
    the smoothed probability of an unseen gram."""
    if n != GRAM:
        raise ValueError("profiles are written for trigrams")
    texts = df.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), _padded(text).alias("__t"))
    counts = texts.mapInArrow(_count_grams, "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    totals = counts.groupBy("lang").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("v"))
    prof = counts.join(totals, "lang")
    denom = F.col("total") + F.col("v") + F.lit(1.0)
    floor = -F.log(denom)
    return prof.select("lang", "gram", (F.log(F.col("c") + 1.0) - F.log(denom) - floor).alias("delta"),
                       floor.alias("floor"))


#: Cells of a direct lookup table (every trigram over the profile's alphabet); larger alphabets are searched.
CELLS = 1 << 22


def _lookup(codes: np.ndarray, weights: np.ndarray, floors: np.ndarray, langs: list[str]):
    """A function from padded texts to their languages: ``weights`` has a row per gram (sorted ``codes``), 0 where unseen."""
    mask = np.uint64((1 << 21) - 1)
    triple = [(codes >> np.uint64(42 - 21 * k)) & mask for k in range(GRAM)]
    alphabet = np.unique(np.concatenate([*triple, np.array([ord(" ")], np.uint64)]))
    base, direct = len(alphabet) + 1, (len(alphabet) + 1) ** GRAM <= CELLS

    def best(texts: pd.Series) -> pd.Series:
        n, sums = np.zeros(len(texts)), np.zeros((len(langs), len(texts)))
        if direct:   # characters outside the alphabet are 0, and no gram of the profile holds a 0
            ids = np.zeros(0x110000, np.uint32)
            ids[alphabet] = np.arange(1, base)
            x, y, z = (ids[t].astype(np.int64) for t in triple)
            table = np.full(base ** GRAM, -1, np.int32)
            table[(x * base + y) * base + z] = np.arange(len(codes))
        for grams, owner in (packed_grams(texts.tolist(), ids, base) if direct else packed_grams(texts.tolist())):
            n += np.bincount(owner, minlength=len(texts))
            if direct:
                at = table[grams.view(np.int64)]
                met = at >= 0
            else:
                at = np.minimum(np.searchsorted(codes, grams), len(codes) - 1)
                met = codes[at] == grams
            at, owner = at[met], owner[met]
            for i in range(len(langs)):
                sums[i] += np.bincount(owner, weights=weights[at, i], minlength=len(texts))
        # A language that matched nothing has no score (every weight of a seen gram is above 0).
        score = np.where(sums > 0, sums + floors[:, None] * n[None, :], -np.inf)
        top = score.max(axis=0)
        alone = (score == top[None, :]).sum(axis=0) == 1
        picked = score.argmax(axis=0)
        return pd.Series([langs[k] if ok and t > -np.inf else None for k, ok, t in zip(picked, alone, top)], dtype=object)
    return best


def identify(df: DataFrame, profiles: DataFrame, key: str = "comment_id", text: str = "text",
             n: int = GRAM, out: str = "pred_lang") -> DataFrame:
    """Add ``out``: the most likely language, or null (tie / nothing matched).

    Each text is scored where it is read. The language list and the floors are read
    from the profile; it goes to the tasks if it is small enough, see :func:`identify_by_join` for larger ones."""
    profiles = stage(profiles, "language-profiles")
    if n == GRAM and profiles.count() <= LOOKUP_GRAMS:
        rows = profiles.toArrow()   # bounded by LOOKUP_GRAMS
        langs = sorted(set(rows.column("lang").to_pylist()))
        if not langs:
            return df.withColumn(out, F.lit(None).cast("string"))
        place = {x: i for i, x in enumerate(langs)}
        owner = np.array([place[x] for x in rows.column("lang").to_pylist()])
        floors = np.zeros(len(langs))
        floors[owner] = rows.column("floor").to_numpy()
        codes, at = np.unique(np.array([ord(a) << 42 | ord(b) << 21 | ord(c) for a, b, c in rows.column("gram").to_pylist()], np.uint64), return_inverse=True)
        weights = np.zeros((len(codes), len(langs)))
        weights[at, owner] = rows.column("delta").to_numpy()
        return df.withColumn(out, F.pandas_udf(_lookup(codes, weights, floors, langs), "string")(_padded(text)))
    floors = {r["lang"]: r["floor"] for r in profiles.groupBy("lang").agg(F.first("floor").alias("floor")).collect()}
    langs = sorted(floors)
    if not langs:
        return df.withColumn(out, F.lit(None).cast("string"))
    wide = profiles.groupBy("gram").pivot("lang", langs).agg(F.first("delta"))
    wide = wide.select("gram", *[F.col(f"`{lang}`").alias(f"__d{i}") for i, lang in enumerate(langs)])
    return identify_by_join(df, wide, langs, floors, key, text, n, out)


def identify_by_join(df: DataFrame, wide: DataFrame, langs: list[str], floors: dict[str, float], key: str, text: str, n: int, out: str) -> DataFrame:
    """``identify`` for profiles that are too large for a task: ``wide`` has a row per gram with a delta per language.

    Every gram occurrence is one row through the join and the aggregate is per text
    only. Grams are summed where the text is read: the shuffle carries a key and
    sums. Texts are told apart by key and content, so a repeated or null key mixes
    nothing; equal texts get one score."""
    ident = F.struct(F.col(key), F.xxhash64(F.col(text)))
    g = gram_rows(df.select(ident.alias("__k"), n_grams(text, n).alias("__n"), F.col(text).alias("__t")), ["__k", "__n"], "__t", n)
    # Rows that repeat key and text add up evenly: the sums are divided by their number.
    sums = (g.join(wide, "gram", "left")
             .groupBy("__k", "__n")
             .agg((F.count(F.lit(1)) / F.col("__n")).alias("__c"),
                  *[F.sum(f"__d{i}").alias(f"__s{i}") for i in range(len(langs))]))
    # Log likelihood per language that matched at least one gram (null otherwise).
    ll = [F.col(f"__s{i}") / F.col("__c") + F.col("__n") * F.lit(floors[lang]) for i, lang in enumerate(langs)]
    best = F.greatest(*ll) if len(ll) > 1 else ll[0]
    at_top = sum((F.coalesce((x == best).cast("int"), F.lit(0)) for x in ll), F.lit(0))
    pick = F.lit(None).cast("string")
    for x, lang in reversed(list(zip(ll, langs))):
        pick = F.when(x == best, F.lit(lang)).otherwise(pick)
    res = sums.select("__k", F.when(at_top == 1, pick).alias(out))
    return df.withColumn("__k", ident).join(res, "__k", "left").drop("__k")


def english_only(df: DataFrame, lang: str = "pred_lang", english: str = "en") -> DataFrame:
    """Keep rows detected as English; an unknown language keeps the row (fails open)."""
    return df.filter(F.coalesce(F.col(lang), F.lit(english)) == english)
