"""Line dedup by hashes of runs of lines.

Lines that are not blank are hashed; every run of T = K + W - 1 consecutive
ones is a shingle with two hashes of its lines. Equal shingles are reduced to
their count and first place with map-side sums and then joined with all their
places, so a passage in a third of all documents adds one row per place; no
pairs of places are made. Of equal runs the first in the order of document and
line stays; the lines of the later ones go, and those of overlapping runs go
together. Shorter runs take part on request (``short_run_words``).

This is not winnowing: of the runs that share a selected gram only the first
could be extended without making pairs of places, and a run that repeats
another of them would be lost. So every run is kept, not the selected alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenor.llm.common import free_name, stage

K, W = 2, 2


def _row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Rows that repeat id and text are one document; a null id comes last."""
    return F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id")), F.xxhash64(text_col)


def repeated_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W, short_run_words: int | None = None) -> DataFrame:
    """-> ``doc, body, lines``: the document's key, its text's hash and the sorted line numbers (from 0, blank lines
    counted) that repeat an earlier run of ``k + w - 1`` lines. Documents without such lines have no row.

    With ``short_run_words``, a run of fewer lines counts too if it has that many words in all (parted by blanks), and
    so do all lines of a document that has fewer. Such a run repeats runs of as many lines only."""
    t = k + w - 1
    doc, body = _row_key(id_col, text_col)
    piece = F.transform(F.split(F.col(text_col), "\n"), lambda s, i: F.struct(F.xxhash64(F.trim(s)).alias("h"), F.xxhash64(F.lit(7), F.trim(s)).alias("g"), i.alias("i"), (F.length(F.trim(s)) == 0).alias("blank"), *([] if short_run_words is None else [F.regexp_count(s, F.lit(r"[^\x20\x09-\x0D]+")).alias("words")])))
    lines = documents.filter(F.col(text_col).isNotNull()).select(doc.alias("doc"), body.alias("body"), F.filter(piece, lambda x: ~x["blank"]).alias("line")).filter(F.size("line") >= (t if short_run_words is None else 1))
    at = lambda i: F.element_at("line", i + 1)
    # Each run of n lines: its two hashes and its line numbers.
    run = lambda s, n: F.struct(
        F.xxhash64(*[at(s + j)["h"] for j in range(n)]).alias("a"), F.xxhash64(*[at(s + j)["g"] for j in range(n)]).alias("b"),
        s.alias("s"), F.lit(n).alias("n"), F.transform(F.slice("line", s + 1, n), lambda x: x["i"]).alias("lines"))
    none = F.array().cast("array<int>")
    starts = lambda n: F.when(F.size("line") >= n, F.sequence(F.lit(0), F.size("line") - n)).otherwise(none)
    found = [F.transform(starts(t), lambda s: run(s, t))]
    for n in range(1, t) if short_run_words is not None else ():
        enough = lambda s: (F.size("line") == n) | (sum((at(s + j)["words"] for j in range(1, n)), at(s)["words"]) >= short_run_words)  # noqa: B023, E731
        found.append(F.transform(F.filter(starts(n), enough), lambda s: run(s, n)))  # noqa: B023
    runs = lines.select("doc", "body", F.explode(F.concat(*found)).alias("run")).select("doc", "body", "run.*")
    runs = stage(runs, "line-runs")
    first = runs.groupBy("n", "a", "b").agg(F.min(F.struct("doc", "body", "s")).alias("first"), F.max(F.struct("doc", "body", "s")).alias("last")).filter("first != last").drop("last")
    # A run that overlaps its own first occurrence is no copy.
    same = (F.col("doc") == F.col("first.doc")) & (F.col("body") == F.col("first.body"))
    later = runs.join(first, ["n", "a", "b"]).filter(~(same & (F.col("s") < F.col("first.s") + F.col("n"))))
    return later.select("doc", "body", F.explode("lines").alias("line")).groupBy("doc", "body").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def drop_repeated_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W,
                        short_run_words: int | None = None) -> DataFrame:
    """The documents with their columns, later copies of runs of ``k + w - 1`` lines removed from their texts, and two
    more: ``removed_lines array<int>`` and ``n_lines int`` (underscores are added to a name that is taken).

    Lines end at line feeds and are compared without outer blanks; blank lines take no part and stay. A null text
    stays null with 0 lines; an empty one stays; an empty table gives an empty table. Rows that repeat id and text are
    one document and get the same result; a null id comes after all others. ``short_run_words``: see ``repeated_lines``.
    """
    found = repeated_lines(documents, id_col, text_col, k, w, short_run_words)
    lines_col, n_col = free_name(documents, "removed_lines"), free_name(documents, "n_lines")
    doc, body = _row_key(id_col, text_col)
    keyed = documents.select(F.struct(*[F.col(c) for c in documents.columns]).alias("row"), doc.alias("doc"), body.alias("body"))
    joined = keyed.join(found, ["doc", "body"], "left").select("row", F.coalesce("lines", F.array().cast("array<int>")).alias("gone"))
    text = F.col("row")[text_col]
    kept = F.when(F.size("gone") == 0, text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda s, i: ~F.array_contains("gone", i)), "\n"))
    return joined.select(*[kept.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in documents.columns],
                         F.col("gone").alias(lines_col), F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).alias(n_col))
