"""License scans: exact set-similarity join of text blocks with license templates.

Only DataFrame functions. Words are taken from the text as it stands, with
ASCII case ignored. Blocks are runs of ``BLOCK`` words, one every ``STRIDE``,
so any stretch of ``BLOCK - STRIDE + 1`` words lies in one block. A block meets
a template of n different words when it holds at least o = ceil(0.8 n) of them.

Words that name the license of a template count several times, so that a
block without one of them falls below the template's least overlap: a word that
counts c times stands for c elements of the sets.

* Words are ordered by the number of documents that have them, rarest first,
  counted over all documents; words of no template cannot add to an overlap.
* Prefix filter: of a set with n words, one of the first n - o + 1 is shared.
* Length filter: a block needs o words of the templates at least.
* Positional filter: with the first shared word at places i and j, the overlap
  is at most 1 + min(n - i - 1, m - j - 1).

What passes is counted exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenor.llm.common import stage

BLOCK, STRIDE = 64, 32
CONTAINMENT = 0.8
#: (label, words): standing phrases that name a license.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: (label, words): sentences by which texts are put under a license.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "you should have received a copy of the gnu general public license along with this program"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    # And clauses of license bodies, of BLOCK - STRIDE + 1 words at most, so that one block holds them.
    ("mit", "under the terms of the mit license"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform"),
    ("gpl-3", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability"),
)
#: Words that name a license; a template is only met by a block with all of them that it has. "mit" is a common word of German, so it needs another beside it.
NAMING = {"mit": {"mit", "released", "terms"}, "apache-2": {"apache"}, "gpl-3": {"gnu", "3"}, "cc-by-nc": {"cc", "by", "nc"}, "cc-by": {"creative", "commons", "attribution"}, "mpl-2": {"mozilla"}}
#: A word is a run of 0-9, A-Z, a-z and anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_IN_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def phrase_pattern(words: str) -> str:
    """Matches the words one after the other, whatever separates them; Java's (?i) folds ASCII alone."""
    return f"(?i)(?<!{_IN_WORD}){_GAP.join(words.split())}(?!{_IN_WORD})"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def phrase_places(text: Column, words: str) -> Column:
    """struct(n, first, last): how often the phrase stands in the text, and its smallest and largest first word."""
    pattern = phrase_pattern(words)
    before = F.transform(F.split(text, pattern, -1), lambda p: n_words(p))
    n = F.size(before) - 1
    last = F.aggregate(F.slice(before, 1, n), F.lit(0).cast("long"), lambda a, x: a + x) + (n - 1) * len(words.split())
    places = F.struct(n.cast("long").alias("n"), before[0].alias("first"), last.cast("long").alias("last"))
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    return F.when(text.rlike(pattern), places).otherwise(nothing)


def template_sets(templates=TEMPLATES) -> list[tuple[int, str, list[str], int]]:
    """(number, label, different words, least overlap). The naming words of a template are listed as often as
    it takes that a block without one of them has less than the least overlap."""
    out = []
    for k, (label, words) in enumerate(templates):
        own = sorted(set(words.split()))
        spare = len(own) - math.ceil(CONTAINMENT * len(own) - 1e-9)
        own = sorted(own + [w for w in own if w in NAMING.get(label, ())] * spare)
        out.append((k, label, own, len(own) - spare))
    return out


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """-> ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks``, one row per document.

    ``blocks``: the (block, label, containment) found by the join. ``score`` is 1 where a phrase stands, else the
    largest containment of a template that was met (see ``template_sets``), else 0. A null or empty text has no words and no labels; rows
    that repeat an id each get their own result; an empty table gives no rows; other columns are not read.
    """
    sets = template_sets(templates)
    universe = sorted({w for _, _, own, _ in sets for w in own})
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.array(*[F.struct(F.lit(label).alias("label"), phrase_places(F.col("body"), words).alias("at")) for label, words in phrases])
    ascii_word = lambda w: F.lower(w).isin(universe) & w.rlike("^[0-9A-Za-z]+$")
    own = (documents.select(F.col(id_col).alias("doc_id"), text.alias("body"))
           .withColumn("words", F.regexp_extract_all("body", F.lit(WORD), F.lit(0)))
           .select("doc_id", F.monotonically_increasing_id().alias("row"), F.size("words").cast("long").alias("n_words"), found.alias("found"),
                   F.filter(F.transform("words", lambda w, i: F.when(ascii_word(w), F.struct(F.lower(w).alias("w"), i.alias("i")))), lambda x: x.isNotNull()).alias("hits")))
    own = stage(own, "license-words")

    counted = own.select(F.explode(F.array_distinct("hits.w")).alias("w")).groupBy("w").count()
    seen = {r["w"]: r["count"] for r in counted.collect()}  # one row for each word of the templates at most
    times = {w: max(ws.count(w) for _, _, ws, _ in sets) for w in universe}
    elements = [(w, c) for w in sorted(universe, key=lambda w: (seen.get(w, 0), w)) for c in range(times[w])]
    rank = {x: k for k, x in enumerate(elements)}
    ordered = [(k, label, sorted(rank[w, c] for w in set(ws) for c in range(ws.count(w))), o) for k, label, ws, o in sets]
    prefixes = [(ranks[i], k, i, len(ranks), o) for k, _, ranks, o in ordered for i in range(len(ranks) - o + 1)]
    spark = documents.sparkSession
    index = F.broadcast(spark.createDataFrame(prefixes, "w int, template int, i int, n int, o int"))
    ranks_of = F.create_map(*[x for w in universe for x in (F.lit(w), F.array(*[F.lit(rank[w, c]) for c in range(times[w])]))])
    rare = sorted({p[0] for p in prefixes})
    first = F.array_distinct(F.flatten(F.transform(F.filter("hits", lambda h: h["r"].isin(rare)), lambda h: F.array((h["i"] / STRIDE).cast("int"), (h["i"] / STRIDE).cast("int") - 1))))
    in_block = lambda h: (h["i"] >= F.col("block") * STRIDE) & (h["i"] < F.col("block") * STRIDE + BLOCK)
    blocks = (own.select("row", F.flatten(F.transform("hits", lambda h: F.transform(ranks_of[h["w"]], lambda r: F.struct(r.alias("r"), h["i"].alias("i"))))).alias("hits"))
              .select("row", "hits", F.explode(first).alias("block")).filter("block >= 0")
              .select("row", "block", F.array_sort(F.array_distinct(F.transform(F.filter("hits", in_block), lambda h: h["r"]))).alias("ranks")))
    m = F.size("ranks")
    pairs = (blocks.select("row", "block", "ranks", F.posexplode("ranks").alias("j", "w")).join(index, "w")
             .filter((m >= F.col("o")) & (F.col("j") <= m - F.col("o")) & (F.least(F.col("n") - F.col("i"), m - F.col("j")) >= F.col("o")))
             .dropDuplicates(["row", "block", "template"]))
    sets_by = F.element_at(F.array(*[F.array(*[F.lit(x) for x in ranks]) for _, _, ranks, _ in ordered]), F.col("template") + 1)
    labels_by = F.element_at(F.array(*[F.lit(label) for _, label, _, _ in ordered]), F.col("template") + 1)
    met = (pairs.withColumn("shared", F.size(F.array_intersect("ranks", sets_by))).filter("shared >= o")
           .groupBy("row").agg(F.collect_set(F.struct("block", labels_by.alias("label"), (F.col("shared") / F.col("n")).alias("containment"))).alias("blocks")))

    base = F.filter("found", lambda f: f["at"]["n"] > 0)
    base_labels = F.transform(base, lambda f: f["label"])
    more = F.coalesce(F.transform("blocks", lambda b: b["label"]), F.array().cast("array<string>"))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return (own.drop("hits").join(met, "row", "left")
            .select("doc_id", "n_words", F.aggregate("found", F.lit(0).cast("long"), lambda a, f: a + f["at"]["n"]).alias("n_base"),
                    F.array_min(F.transform(base, lambda f: f["at"]["first"])).alias("first_word"), F.array_max(F.transform(base, lambda f: f["at"]["last"])).alias("last_word"),
                    joined(base_labels).alias("base_labels"), joined(F.concat(base_labels, more)).alias("labels"),
                    F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))).alias("score"),
                    F.coalesce(F.array_sort("blocks"), F.array().cast("array<struct<block:int,label:string,containment:double>>")).alias("blocks")))
