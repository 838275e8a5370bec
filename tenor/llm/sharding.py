"""Sharding: a reproducible shuffle by a Feistel permutation of global row numbers.

Rows are numbered 0 to n - 1 in the order of (id, text) by one range shuffle of narrow rows: a row's number is its
partition's offset plus its place in the partition. A Feistel network on pairs of digits (number // b, number % b) with
a * b >= n permutes the numbers; what it puts at n or beyond walks on along its cycle until it is below n. The place
p that a row gets says its shard (p mod shards) and its slot (p div shards), so shards differ by one row at most,
anyone can compute where a row number goes, and ``row_number`` computes which row stands in a slot.

Everything is DataFrame functions. The texts are hashed where they are read and not shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenor.llm.common import free_name, stage

ROUNDS = 6
#: Prime that bounds the round function's numbers: products of two stay within 64 bits.
PRIME = 2 ** 31 - 1
#: Bits of ``monotonically_increasing_id`` that number the rows of a partition.
ROW_BITS = 33


def keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Three numbers below PRIME for every round, from the seed by a multiplicative generator."""
    x, out = (seed * 2 + 1) % (PRIME - 1) + 1, []
    for _ in range(rounds):
        drawn = []
        for _ in range(3):
            x = x * 48271 % PRIME
            drawn.append(x)
        out.append(tuple(drawn))
    return out


def sides(n: int) -> tuple[int, int]:
    """(a, b) with a * b >= n and fewer than a numbers to spare."""
    if n > PRIME * PRIME:
        raise ValueError("too many rows")
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _mix(x: Column, k: Column) -> Column:
    """A number below PRIME from one below PRIME: two multiplications with a fold between."""
    once = F.pmod(x * k["times"] + k["plus"], F.lit(PRIME))
    return F.transform(F.array(once), lambda y: F.pmod((y.bitwiseXOR(F.shiftright(y, 15)) + 1) * k["again"], F.lit(PRIME)))[0]


def _step(place: Column, a: int, b: int, seed: int, back: bool) -> Column:
    """The image (or preimage) of a number under the Feistel network on a * b numbers.

    One fold over the rounds' keys: a round adds a function of one side to the other and swaps them. Written out, the
    rounds would double in size when Spark moves a filter on the result below them.
    """
    long = lambda v: F.lit(v).cast("long")
    rounds = [F.struct(long(t).alias("times"), long(p).alias("plus"), long(g).alias("again"), long(b if i % 2 else a).alias("sizes")) for i, (t, p, g) in enumerate(keys(seed))]
    start = F.struct(F.call_function("div", place, long(b)).alias("to"), F.pmod(place, long(b)).alias("by"))
    if back:
        turn = lambda s, k: F.struct(F.pmod(s["by"] - _mix(s["to"], k), k["sizes"]).alias("to"), s["to"].alias("by"))
    else:
        turn = lambda s, k: F.struct(s["by"].alias("to"), F.pmod(s["to"] + _mix(s["by"], k), k["sizes"]).alias("by"))
    return F.aggregate(F.array(*(reversed(rounds) if back else rounds)), start, turn, lambda s: s["to"] * long(b) + s["by"])


def walk_ends(spark: SparkSession, n: int, seed: int, back: bool) -> DataFrame:
    """``outside, inside``: for every number from n to a * b - 1, the first one below n on its cycle. Fewer than a rows."""
    a, b = sides(n)
    going = spark.range(n, a * b).select(F.col("id").alias("outside"), F.col("id").alias("place"))
    done = going.select("outside", F.col("place").alias("inside")).limit(0)
    more = n < a * b
    while more:  # a cycle through numbers outside only would never be entered from below n: it drops out
        stepped = stage(going.withColumn("place", _step(F.col("place"), a, b, seed, back)), "shard-walk")
        done = done.unionByName(stepped.filter(F.col("place") < n).select("outside", F.col("place").alias("inside")))
        going = stepped.filter((F.col("place") >= n) & (F.col("place") != F.col("outside")))
        more = not going.isEmpty()
    return done


def permute(rows: DataFrame, number: str, n: int, seed: int = 0, back: bool = False, name: str = "place") -> DataFrame:
    """Adds ``name``, the permuted ``number`` (0 to n - 1): the same for the same n and seed, whatever the rows' order.
    ``back`` gives the inverse. The walks' ends are fewer than sqrt(n) + 1 pairs of numbers, which bounds their broadcast."""
    a, b = sides(n)
    moved = rows.withColumn("place", _step(F.col(number).cast("long"), a, b, seed, back))
    ends = walk_ends(rows.sparkSession, n, seed, back)
    if n < a * b:
        moved = moved.join(F.broadcast(ends), F.col("place") == F.col("outside"), "left").withColumn("place", F.coalesce("inside", "place")).drop("outside", "inside")
    return moved.withColumnRenamed("place", name) if name != "place" else moved


def number_rows(rows: DataFrame, *order: Column) -> tuple[DataFrame, int]:
    """(``rows`` with ``number``, the number of rows): numbers from 0 in the order given.

    Rows equal in ``order`` are told apart by their place in the input, so that copies of one row, however many, are
    dealt over several partitions too; they are alike, so who gets which number changes no result.
    """
    tie = F.monotonically_increasing_id()
    dealt = rows.withColumn("__tie", tie).repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    placed = stage(dealt.withColumn("__place", F.monotonically_increasing_id()), "shard-rows")
    part = F.shiftright("__place", ROW_BITS)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    # One row per partition of the shuffle above: a bounded table.
    offsets = sizes.withColumn("__offset", F.coalesce(F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("__rows")
    numbered = (placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
                .withColumn("number", F.col("__offset") + F.col("__place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))).drop("__part", "__offset", "__place"))
    return numbered, placed.count()


def shard(docs: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, carry: dict[str, str] | None = None) -> DataFrame:
    """-> ``id, size, text_crc32, digest, number, shard, slot``, one row per document, and the columns of ``carry``
    under the names it gives.

    ``shard`` is 0 to shards - 1 and ``slot`` counts from 0 without gaps in each; row counts of shards are at most one
    apart. ``size`` is the text's UTF-8 bytes and ``overhead``, ``digest`` its MD5. A null text counts as an empty one.
    A null id comes first. Rows that repeat id and text are rows of their own and get slots of their own; result rows
    do not depend on the order or partitions of the input. Fewer rows than shards leave the last shards empty; an empty
    table gives no rows. Other columns are not read, whatever their names; carried ones are numbered by, after the text.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    narrow = docs.select(F.col(id_col).alias("id"), (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.md5(body).alias("digest"), *[F.col(c).alias(name) for c, name in (carry or {}).items()])
    order = [F.col("id").asc_nulls_first(), F.col("digest"), *([F.xxhash64(*carry.values())] if carry else [])]
    numbered, n = number_rows(narrow, *order)
    place = permute(numbered, "number", n, seed)
    return place.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")).withColumn("slot", F.expr(f"place div {shards}L")).drop("place")


def row_number(slots: DataFrame, shards: int, n: int, seed: int = 0) -> DataFrame:
    """Adds ``number`` to ``shard, slot`` (and other columns): the number of the row that stands there among n rows."""
    name = free_name(slots, "__at")
    at = slots.withColumn(name, F.col("slot").cast("long") * shards + F.col("shard"))
    return permute(at, name, n, seed, back=True, name="number").drop(name)


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 0, rows_per_file: int = 1 << 20, **columns: str) -> None:
    """Writes the documents as Parquet under ``path/shard=k``, each file holding a run of slots in their order, with the
    column ``slot`` (underscores behind if the documents have one)."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    placed = shard(docs, shards, seed, carry=names, **columns)
    slot, part = free_name(docs, "slot"), free_name(docs, "shard")
    (placed.withColumn("__run", F.expr(f"slot div {rows_per_file}L")).repartition("shard", "__run").sortWithinPartitions("shard", "slot")
     .select(*[F.col(n).alias(c) for c, n in names.items()], F.col("slot").alias(slot), F.col("shard").alias(part))
     .write.partitionBy(part).parquet(path))
