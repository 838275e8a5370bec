"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed pseudo-random key (hex MD5 of its id and size). The
words of a source are summed per key prefix; the running sum over the prefixes
finds the one prefix in which the source's budget ends; only the documents of
that prefix are summed again by a longer one, until it holds at most one key.
A document is then taken when its key lies below its source's threshold. No
document is sorted: the windows run over at most 4096 sums per source, and a
larger budget only moves the threshold up, so samples are nested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenor.llm.common import free_name, stage

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the key per histogram level: 16 ** 3 sums per source.
DIGITS = 3
KEY_DIGITS = 32


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """``source, size`` -> ``source, source_size, target``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the sum of all sizes; no target is
    above ``max_repeats`` times its source's size, what is above goes to the others by weight. In the order of
    cap / weight the capped sources come first, so one pass over running sums finds the water level.
    """
    big = "decimal(38,0)"
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(int(w)) for w in weights])
    weighed = (by_source
               .withColumn("weight", F.element_at(table, (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1)).cast("long"))
               .withColumn("cap", F.col("source_size") * F.lit(max_repeats)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    summed = (weighed
              .withColumn("total", F.sum("source_size").over(every)).withColumn("total_weight", F.sum("weight").over(every))
              .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), zero))
              .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), zero)))
    capped = summed.withColumn("capped", F.col("cap").cast(big) * (F.col("total_weight") - F.col("weight_before"))
                               <= F.col("weight") * (F.col("total") - F.col("cap_before")).cast(big))
    level = (capped
             .withColumn("cap_sum", F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), zero))
             .withColumn("weight_sum", F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))).over(every), zero)))
    share = ((F.col("weight") * (F.col("total") - F.col("cap_sum"))).cast("double")
             / F.greatest(F.col("total_weight") - F.col("weight_sum"), F.lit(1)).cast("double"))
    return level.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source, size, key`` and ``source, budget`` -> ``source, below``: the documents of a source whose key is
    smaller than ``below`` are the longest run in key order whose sizes sum to at most the budget."""
    state = budgets.select("source", F.lit("").alias("prefix"), F.col("budget").alias("left"))
    done = None
    inside = sized.select("source", "size", "key")
    for level in range(1, -(-KEY_DIGITS // DIGITS) + 1):
        bins = (inside.withColumn("bin", F.substring("key", 1, level * DIGITS))
                .groupBy("source", "bin").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")))
        up_to = Window.partitionBy("source").orderBy("bin")
        s, b = state.alias("s"), bins.alias("b")
        run = (b.join(s, F.col("b.source").eqNullSafe(F.col("s.source")))
               .select("b.source", "b.bin", "b.words", "b.n", "s.left")
               .withColumn("sum", F.sum("words").over(up_to)))
        over = (run.filter(F.col("sum") > F.col("left"))
                .groupBy("source").agg(F.min(F.struct("bin", (F.col("left") - F.col("sum") + F.col("words")).alias("left"), "n")).alias("edge")))
        edges = stage(over.select("source", "edge.*"), f"mix-edge-{level}")
        last = level * DIGITS >= KEY_DIGITS
        final = edges.filter((F.col("n") <= 1) | F.lit(last)).select("source", F.col("bin").alias("below"))
        done = final if done is None else done.unionByName(final)
        more = edges.filter((F.col("n") > 1) & ~F.lit(last))
        if last or more.isEmpty():
            return done
        state = more.select("source", F.col("bin").alias("prefix"), "left")
        i, e = inside.alias("i"), state.alias("e")
        inside = i.join(e, F.col("i.source").eqNullSafe(F.col("e.source")) & F.col("i.key").startswith(F.col("e.prefix"))).select("i.source", "i.size", "i.key")
    return done


def mix(documents: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """-> ``id, source, size, source_size, target, copies, taken`` (and the columns of ``carry``), one row per document.

    ``copies`` = floor(target / source_size), plus one for the documents below the source's hash threshold;
    ``taken`` = copies * size. A null text has size 0. A null source is a source of its own. Documents without words
    take nothing away from a budget. Rows that repeat id and size share a key and are taken or left together.
    An empty table gives no rows. Other columns are not read, whatever their names.
    """
    sized = stage(documents.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *carry,
    ).withColumn("key", F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("size").cast("string")).cast("binary"))), "mix-sizes")
    targets = stage(source_targets(sized.select("source", "size"), weights, max_repeats), "mix-targets")
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("base", base).withColumn("budget", F.floor(F.col("target") - F.col("base") * F.col("source_size")).cast("long"))
    cut = thresholds(sized.filter("size > 0"), plan)
    p, c, d = plan.alias("p"), cut.alias("c"), sized.alias("d")
    # A source without an edge keeps every document within its budget.
    rule = (p.join(c, F.col("p.source").eqNullSafe(F.col("c.source")), "left")
            .select("p.source", "p.source_size", "p.target", "p.base", F.col("c.below").alias("below"), F.lit("~").alias("top")))
    r = rule.alias("r")
    more = (F.col("d.key") < F.coalesce(F.col("r.below"), F.col("r.top"))) & (F.col("r.base") < max_repeats) & (F.col("r.source_size") > 0)
    return (d.join(r, F.col("d.source").eqNullSafe(F.col("r.source")))
            .select(F.col("d.id").alias("id"), F.col("d.source").alias("source"), F.col("d.size").alias("size"), "r.source_size", "r.target",
                    (F.col("r.base") + F.when(more, 1).otherwise(0)).alias("copies"), *[F.col(f"d.{x}") for x in carry])
            .withColumn("taken", F.col("copies") * F.col("size")))


def repeat_documents(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: every document ``copies`` times, with the columns of ``documents``.

    Decisions are joined back on id and on the text's word count, so repeated ids with other texts get their own.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    chosen = mix(documents, **options).filter("copies > 0")
    c = chosen.select(F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("copies").alias("__copies")).dropDuplicates(["__id", "__source", "__size"])
    size = F.coalesce(F.regexp_count(documents[text_col], F.lit(WORD)), F.lit(0)).cast("long")
    joined = documents.join(c, documents[id_col].eqNullSafe(F.col("__id")) & documents[options.get("source_col", "source")].eqNullSafe(F.col("__source")) & (size == F.col("__size")))
    copy = free_name(documents, "copy")
    return joined.select(*[documents[x] for x in documents.columns], F.explode(F.sequence(F.lit(1), c["__copies"].cast("int"))).alias(copy)).drop(copy)

