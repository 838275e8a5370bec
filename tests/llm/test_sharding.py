import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import SF, edge_rows, rows

from pyspark.sql import functions as F

from tenor.llm import queries, sharding


def plain_place(x, n, seed, back=False):
    """The permutation of 0 .. n - 1 in plain integers, walking until below n."""
    a, b = sharding.sides(n)
    p = sharding.PRIME

    def mix(v, k):
        y = (v * k[0] + k[1]) % p
        return ((y ^ (y >> 15)) + 1) * k[2] % p

    def once(v):
        left, right = divmod(v, b)
        rounds = list(enumerate(sharding.keys(seed)))
        for i, k in reversed(rounds) if back else rounds:
            sign = -1 if back else 1
            if i % 2 == 0:
                left = (left + sign * (mix(right, k) % a)) % a
            else:
                right = (right + sign * (mix(left, k) % b)) % b
        return left * b + right

    x = once(x)
    while x >= n:
        x = once(x)
    return x


def plain(docs, shards, seed=0, overhead=16):
    """[(doc_id, size, crc32, shard, slot)] of [(doc_id, text)]."""
    raw = [(d, (t or "").encode()) for d, t in docs]
    raw.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1]).hexdigest()))
    out = []
    for i, (d, b) in enumerate(raw):
        at = plain_place(i, len(raw), seed)
        out.append((d, len(b) + overhead, zlib.crc32(b), at % shards, at // shards))
    return sorted(out, key=repr)


COLS = ("id", "size", "text_crc32", "shard", "slot")


def lawful(got, shards):
    slots = defaultdict(list)
    for r in got:
        slots[r[3]].append(r[4])
    counts = [len(slots[k]) for k in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_edge_rows(edge, wide, nothing):
    want = plain([(r[0], r[1]) for r in edge_rows()], 7)
    for df in (edge, wide, edge.repartition(5, F.rand(1)), edge.coalesce(1)):
        assert rows(sharding.shard(df, 7), *COLS) == want
    lawful(want, 7)
    assert rows(sharding.shard(edge, 1000), *COLS) == plain([(r[0], r[1]) for r in edge_rows()], 1000)
    assert sharding.shard(nothing, 7).collect() == [] and rows(sharding.shard(edge.limit(1), 1), "shard", "slot") == [(0, 0)]
    other = rows(sharding.shard(edge, 7, seed=5), *COLS)
    assert other == plain([(r[0], r[1]) for r in edge_rows()], 7, seed=5) != want


def test_documents(spark, documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = rows(queries.op12_sharding(spark, SF))
    assert [(d, s, c, k, i) for d, s, c, _, k, i, _ in got] == sorted(plain(docs, 40), key=repr)
    assert {(r[3], r[6]) for r in got} == {("rows", None)}
    lawful([(d, s, c, k, i) for d, s, c, _, k, i, _ in got], 40)


def test_copies_of_one_row(spark):
    """Most rows are one row many times, over several partitions: every copy gets a slot of its own."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("own")).otherwise(F.lit("same")).alias("text"))
    docs = [(r[0], r[1]) for r in df.collect()]
    want = plain(docs, 11)
    assert rows(sharding.shard(df.repartition(6), 11), *COLS) == want
    lawful(want, 11)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 24, 25, 26, 101, 997])
@pytest.mark.parametrize("seed", [0, 1, 12345])
def test_permutation_and_inverse(n, seed):
    there = [plain_place(i, n, seed) for i in range(n)]
    assert sorted(there) == list(range(n)) and [plain_place(p, n, seed, back=True) for p in there] == list(range(n))
    a, b = sharding.sides(n)
    assert n <= a * b < n + a


@pytest.mark.parametrize("n", [2, 26, 997])
def test_row_of_a_slot(spark, n):
    """Columns and plain integers agree, both ways."""
    numbers = spark.range(n).select(F.col("id").alias("number"))
    there = {r["number"]: r["place"] for r in sharding.permute(numbers, "number", n, seed=3).collect()}
    assert there == {i: plain_place(i, n, 3) for i in range(n)}
    slots = spark.createDataFrame([(p % 4, p // 4, i) for i, p in there.items()], "shard int, slot long, want long")
    assert sharding.row_number(slots, 4, n, seed=3).filter("number <> want").count() == 0


def test_large_numbers(spark):
    """Row numbers of very large tables: no overflow, and the inverse leads back."""
    n = 10 ** 13 + 7
    numbers = spark.createDataFrame([(0,), (1,), (n // 2,), (n - 1,)], "number long")
    a, b = sharding.sides(n)
    moved = numbers.withColumn("place", sharding._step(F.col("number"), a, b, 9, False))
    assert all(0 <= r["place"] < a * b for r in moved.collect())
    assert moved.withColumn("back", sharding._step(F.col("place"), a, b, 9, True)).filter("back <> number").count() == 0


def test_shuffle_spreads(spark):
    """Neighbours in number land in all shards alike."""
    n = 20000
    moved = sharding.permute(spark.range(n).select(F.col("id").alias("number")), "number", n).withColumn("shard", F.col("place") % 40)
    first = Counter(r["shard"] for r in moved.filter("number < 2000").collect())
    assert len(first) == 40 and 20 <= min(first.values()) and max(first.values()) <= 85


def test_written_shards(wide, spark, tmp):
    sharding.write_shards(wide, f"{tmp}/shards", 3, rows_per_file=4)
    back = spark.read.parquet(f"{tmp}/shards")
    assert back.columns == [*wide.columns, "slot", "shard"]
    assert rows(back, *wide.columns) == rows(wide, *wide.columns)
    lawful([(0, 0, 0, r["shard"], r["slot"]) for r in back.collect()], 3)


def test_plan_has_no_python_and_no_text_shuffle(documents):
    placed = sharding.shard(documents, 40)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "text#" not in plan
