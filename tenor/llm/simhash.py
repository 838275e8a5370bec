"""SimHash near-dedup by the generalised pigeonhole principle.

A document's fingerprint has the majority bits of the XXH64 values of its
4-word shingles. Two fingerprints that differ in at most t bits must, for any
split of the 64 bits into m parts with thresholds t1 + ... + tm = t - m + 1
(each at least -1, which skips a part), agree in some part up to its threshold.

* Correlated bits are put into one part, by the correlations over all fingerprints.
* m and the thresholds come from dynamic programming over estimated numbers of
  probes and candidates; how full the parts' buckets are is counted over all fingerprints.
* Every fingerprint is indexed under its value of each part, and probes the
  values within the part's threshold; what meets is verified on all 64 bits.
* Where very many rows meet under one value, they are cut into slices, and every
  two slices meet in a bucket of their own.

Documents are reduced to different fingerprints first, so copies cost nothing.
A task that joins buckets returns links that keep what it found connected (a
forest), not all pairs; connected components are then found by alternating
large-star and small-star steps over these links.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenor.llm.common import byte_views, fan_out, stage

BITS = 64
#: Rows of index and probes in one bucket join.
ROWS_PER_BUCKET = 400_000
#: Rows that meet under one value from which they are dealt to several buckets. There are about ``HEAVY_VALUES`` such
#: values at most (they are broadcast): with over ``ROWS_PER_VALUE * HEAVY_VALUES`` rows in all, it takes more to be one.
ROWS_PER_VALUE, HEAVY_VALUES = 200_000, 100_000
#: Pairs held at once when the rows of a value are compared.
PAIRS_AT_ONCE = 4_000_000
#: Cost of a probe row against a candidate pair: probes are shuffled, pairs only compared.
PROBE_COST = 40

# For each byte, its bits as eight 8-bit counters; 255 of them can be added up.
_LANES = np.array([sum((b >> k & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def majority(hashes: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Per document (``per`` hashes each, in order) the bits that over half of its hashes have."""
    out = np.zeros(len(per), np.uint64)
    some = np.flatnonzero(per)
    if not len(some):
        return out
    n = per[some]
    begin = np.cumsum(n) - n
    pieces = -(-n // 255)
    cut = np.repeat(begin, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    first = np.cumsum(pieces) - pieces
    octets = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    for k in range(8):
        lanes = np.add.reduceat(_LANES[octets[:, k]], cut)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        on = (2 * counts > n[:, None]) @ (1 << np.arange(8))
        out[some] |= on.astype(np.uint64) << np.uint64(8 * k)
    return out


def shingle_hashes(text: memoryview | bytes | None, shingle: int) -> list[int]:
    """XXH64 (seed 42) of every run of ``shingle`` words; of all words if there are fewer; none without words."""
    from xxhash import xxh64_intdigest

    words = [] if text is None else bytes(text).lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return []
    if len(words) <= shingle:
        return [xxh64_intdigest(b" ".join(words), 42)]
    line = b" ".join(words)
    ends = list(itertools.accumulate(map((1).__add__, map(len, words))))
    return [xxh64_intdigest(line[a:b - 1], 42) for a, b in zip([0, *ends], ends[shingle - 1:])]


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """-> ``id, body, fp``: the id, a hash of the text, and the fingerprint as a long. A null text and one without
    words have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            held: list[int] = []
            per: list[int] = []
            for text in byte_views(batch.column(2)):
                h = shingle_hashes(text, shingle)
                held += h
                per.append(len(h))
                if len(held) > 1_000_000:
                    done.append(majority(np.array(held, np.uint64), np.array(per, np.int64)))
                    held, per = [], []
            done.append(majority(np.array(held, np.uint64), np.array(per, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(done).view(np.int64))], names=["id", "body", "fp"])

    own = documents.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("body"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "id long, body long, fp long")


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """(number of fingerprints, 64 x 64 counts of bits that are set together) over all of them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS, BITS))
        for frame in frames:
            fp = frame["fp"].to_numpy(np.int64).view(np.uint64)
            bits = (fp[:, None] >> np.arange(BITS, dtype=np.uint64) & np.uint64(1)).astype(np.float32)
            total += bits.T @ bits
        i, j = np.triu_indices(BITS)
        yield pd.DataFrame({"i": i, "j": j, "n": total[i, j].astype(np.int64)})

    both = np.zeros((BITS, BITS))
    for r in fps.mapInPandas(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # 2080 rows
        both[r["i"], r["j"]] = both[r["j"], r["i"]] = r["n"]
    return fps.count(), both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of nearly equal size, each grown from the bit with the strongest correlations by
    the bit most correlated with it."""
    p = np.diag(both) / max(1, n)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(1, n) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free = set(range(BITS))
    groups = []
    for k in range(parts):
        room = (BITS + k) // parts
        left = sorted(free)
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        free.remove(group[0])
        while len(group) < room:
            b = max(sorted(free), key=lambda x: (corr[x, group].sum(), -x))
            group.append(b)
            free.remove(b)
        groups.append(sorted(group))
    return groups


def within(p: np.ndarray, most: int) -> np.ndarray:
    """Probability that two independent fingerprints differ in 0, 1, ..., ``most`` of the bits set with chance ``p``."""
    differ = 2 * p * (1 - p)
    at = np.zeros(most + 1)
    at[0] = 1
    for d in differ:
        at[1:] = at[1:] * (1 - d) + at[:-1] * d
        at[0] *= 1 - d
    return np.cumsum(at)


def probes(width: int, t: int) -> int:
    return 0 if t < 0 else sum(_choose(width, k) for k in range(t + 1))


def _choose(n: int, k: int) -> int:
    import math

    return math.comb(n, k)


def allocate(n: int, p: np.ndarray, groups: list[list[int]], distance: int, crowding: list[float]) -> tuple[float, list[int]]:
    """(cost, thresholds): the cheapest t_i >= -1 with sum ``distance - m + 1``. A part costs its probes and its
    candidates, estimated as n^2 / 2 times the chance of agreement within t_i times the part's ``crowding``."""
    want = distance - len(groups) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for g, c in zip(groups, crowding):
        near = within(p[g], max(distance, 0))
        new: dict[int, tuple[float, list[int]]] = {}
        for t in range(-1, min(distance, len(g)) + 1):
            cost = 0.0 if t < 0 else n * probes(len(g), t) * PROBE_COST + n * n / 2 * min(1.0, near[t] * c)
            for s, (before, ts) in best.items():
                if s + t not in new or before + cost < new[s + t][0]:
                    new[s + t] = before + cost, [*ts, t]
        best = new
    return best[want]


def crowding(fps: DataFrame, n: int, p: np.ndarray, groups: list[list[int]]) -> list[float]:
    """For each part, the pairs that share a bucket against those expected of independent bits."""
    value = F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(g)))).alias("value")) for k, g in enumerate(groups)])
    counts = fps.select(F.explode(value).alias("x")).select("x.*").groupBy("part", "value").count()
    pairs = {r["part"]: r["s"] for r in counts.groupBy("part").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("s")).collect()}
    return [max(1e-3, pairs.get(k, 0.0) / max(1.0, n + n * (n - 1.0) * within(p[g], 0)[0])) for k, g in enumerate(groups)]


def crowded_values(fps: DataFrame, used: list[tuple[list[int], int]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the values under which more than ``most`` rows can meet, in order, slices of each).

    A value's rows are those that have it and those that probe it, so a value with over ``most / 2`` fingerprints
    counts for every value it probes, and one with fewer only by itself. What comes back is bounded, as ``most`` is
    at least the number of all rows by ``HEAVY_VALUES``.
    """
    value = F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(g)))).alias("value")) for k, (g, _) in enumerate(used)])
    counts = fps.select(F.explode(value).alias("x")).select("x.*").groupBy("part", "value").count().filter(F.col("count") > most // 2).collect()
    load: dict[int, int] = {}
    for r in counts:
        around = (np.uint64(r["value"] % (1 << 64)) ^ _flips(*used[r["part"]]))
        for key in _mixed(around, r["part"]).tolist():
            load[key] = load.get(key, 0) + r["count"]
    heavy = sorted(k for k, n in load.items() if n > most // 2)
    return np.array(heavy, np.uint64), np.array([fan_out(2 * load[k], most) for k in heavy], np.int64)


def _flips(group: list[int], t: int) -> np.ndarray:
    """What turns a value into itself and into the values it probes."""
    return np.array([0, *[_mask(c) for k in range(1, t + 1) for c in itertools.combinations(group, k)]], np.uint64)


def _mixed(value: np.ndarray, part: int) -> np.ndarray:
    key = (value ^ (value >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (key ^ (key >> np.uint64(29))) + np.uint64(part)


def spread(key: np.ndarray, fp: np.ndarray, home: np.ndarray, heavy: np.ndarray, slices: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows, those of heavy keys once for each slice that theirs is to meet: under a new key for the two slices."""
    if not len(heavy):
        return key, fp, home
    place = np.minimum(np.searchsorted(heavy, key), len(heavy) - 1)
    times = np.where(heavy[place] == key, slices[place], 1)
    row = np.repeat(np.arange(len(key)), times)
    other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    n = times[row]
    own = ((_mixed(fp, 0) >> np.uint64(7))[row] % n.astype(np.uint64)).astype(np.int64)
    pair = (np.minimum(own, other) * n + np.maximum(own, other)).astype(np.uint64)
    return np.where(n > 1, _mixed(key[row] + pair * np.uint64(0xC2B2AE3D27D4EB4F), 0), key[row]), fp[row], home[row]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def plan(fps: DataFrame, distance: int) -> tuple[list[list[int]], list[int], int]:
    """(parts, thresholds, number of fingerprints). The number of parts comes from the model, the thresholds then
    from the counted crowding."""
    n, both = bit_moments(fps)
    p = np.diag(both) / max(1, n)
    options = [group_bits(n, both, m) for m in range(2, distance + 2)] or [[list(range(BITS))]]
    groups = min(options, key=lambda g: allocate(n, p, g, distance, [1.0] * len(g))[0])
    return groups, allocate(n, p, groups, distance, crowding(fps, n, p, groups))[1], n


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its component) that connect what the links a - b connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while True:
            short = new[new]
            if (short == new).all():
                break
            new = short
        if (new == root).all():
            break
        root = new
    leaf = root != np.arange(len(nodes))
    return nodes[leaf], nodes[root[leaf]]


def bucket_links(key: np.ndarray, fp: np.ndarray, home: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between index rows (``home``) and all rows with the same key, verified on all bits."""
    order = np.lexsort((~home, key))  # index rows first
    key, fp, home = key[order], fp[order], home[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(key)))
    mine = np.add.reduceat(home.astype(np.int64), edge) if len(edge) else size
    use = (mine > 0) & (size > 1)
    edge, size, mine = edge[use], size[use], mine[use]
    a = np.repeat(edge, mine) + np.arange(mine.sum()) - np.repeat(np.cumsum(mine) - mine, mine)  # every index row
    after = np.repeat(edge + size, mine) - a - 1  # what it is compared with: all rows behind it
    found_a, found_b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    run = np.cumsum(after)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(run, (run[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        n = after[at:to]
        x = np.repeat(a[at:to], n)
        y = x + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        near = (np.bitwise_count(fp[x] ^ fp[y]) <= distance) & (fp[x] != fp[y])
        found_a.append(fp[x[near]])
        found_b.append(fp[y[near]])
        if sum(map(len, found_a)) > PAIRS_AT_ONCE:
            fa, fb = forest(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b = [fa], [fb]
        at = to
    return forest(np.concatenate(found_a), np.concatenate(found_b))


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """``fp`` (each once) -> ``a, b``: links whose components are those of all pairs that differ in at most
    ``distance`` bits."""
    groups, thresholds, n = plan(fps, distance)
    used = [(g, t) for g, t in zip(groups, thresholds) if t >= 0]
    each = sum(1 + probes(len(g), t) for g, t in used)
    flips = [_flips(g, t) for g, t in used]
    masks = [np.uint64(_mask(g)) for g, _ in used]
    most = max(ROWS_PER_VALUE, n * each // HEAVY_VALUES)
    heavy, slices = crowded_values(fps, used, most)
    buckets = fan_out(n * each + most * int((slices * (slices - 1)).sum()), ROWS_PER_BUCKET)
    sent = fps.sparkSession.sparkContext.broadcast((heavy, slices))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows (bucket; keys, fingerprints, index or probe), packed per bucket. A row is an index row under its own
        value and a probe under the values around it."""
        for frame in frames:
            every = frame["fp"].to_numpy(np.int64).view(np.uint64)
            for some in np.array_split(every, fan_out(len(every) * each, 2_000_000)):
                keys, fps_, home = [], [], []
                for k, (mask, flip) in enumerate(zip(masks, flips)):
                    keys.append(_mixed(((some & mask)[:, None] ^ flip[None, :]).ravel(), k))
                    fps_.append(np.repeat(some, len(flip)))
                    home.append(np.tile(np.arange(len(flip)) == 0, len(some)))
                key, fp, own = spread(np.concatenate(keys), np.concatenate(fps_), np.concatenate(home), *sent.value)
                bucket = (key >> np.uint64(20)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                key, fp, own, bucket = key[order], fp[order], own[order], bucket[order]
                edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
                ends = [*edge[1:], len(bucket)] if len(bucket) else []
                yield pd.DataFrame({"bucket": bucket[edge].astype(np.int32) if len(bucket) else np.zeros(0, np.int32), "keys": [key[x:y].tobytes() for x, y in zip(edge, ends)],
                                    "fps": [fp[x:y].tobytes() for x, y in zip(edge, ends)], "own": [own[x:y].tobytes() for x, y in zip(edge, ends)]})

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        read = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in group[c]])
        a, b = bucket_links(read("keys", np.uint64), read("fps", np.uint64), read("own", bool), distance)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return fps.mapInPandas(deal, "bucket int, keys binary, fps binary, own binary").groupBy("bucket").applyInPandas(meet, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` -> ``node, root``: every node of a link with the least node of its component.

    Large-star: a node's larger neighbours move to its least neighbour; small-star: so do its smaller ones. Minima
    are grouped and joined back, so a node with very many links is no single group. Ends when nothing moves.
    """
    edges = stage(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links-0")
    round_ = 0
    while True:
        round_ += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        new = stage(small.filter("a != b").distinct(), f"links-{round_}")
        # Stars only, and the same as before: done.
        moved = new.join(edges, ["a", "b"], "left_anti")
        if moved.isEmpty() and new.count() == edges.count():
            break
        edges = new
    return new.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(new.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def classes(marked: DataFrame, distance: int = 4) -> DataFrame:
    """``id, body, fp`` -> ``fp, root, component_id, first_body``: for each fingerprint the smallest id of its
    component (null only if all are) and, of the rows with it, the least text hash."""
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("body").alias("body"))
    own = stage(marked.groupBy("fp").agg(F.min(order).alias("first")), "fingerprints-once")
    named = components(links(own.select("fp"), distance))
    rooted = own.join(named, own["fp"] == named["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rooted.select("fp", "root").join(least, "root").select("fp", "root", F.col("first.id").alias("component_id"), F.col("first.body").alias("first_body"))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """-> ``doc_id, body, fp, component_id, first_body``, one row per document; ``component_id`` is the smallest id
    that links of at most ``distance`` bits reach, itself included.

    Null texts and texts without words have fingerprint 0 and are linked like others. A null id comes after all
    others. Rows that repeat an id keep their own fingerprints. An empty table gives no rows; other columns are not read.
    """
    marked = stage(fingerprints(documents, id_col, text_col, shingle), "fingerprints")
    return marked.join(classes(marked, distance), "fp").select(F.col("id").alias("doc_id"), "body", "fp", "component_id", "first_body")


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with their columns, one of each component: the one with the smallest id (of rows that repeat it,
    the one with the least text hash)."""
    found = near_duplicates(documents, id_col, text_col, **options)
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("body") == F.col("first_body"))).select(F.col("doc_id").alias("__id"), F.col("body").alias("__body")).distinct()
    joined = documents.join(first, documents[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(documents[text_col]) == F.col("__body")))
    return joined.dropDuplicates(["__id", "__body"]).select(*[documents[c] for c in documents.columns])


def hex_digits(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
