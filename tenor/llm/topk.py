"""Exact top-k search by inner product with multi-resolution segment statistics.

Queries and candidates are packed into blocks of bounded size, and every
candidate block meets every query block once (the stated query set against all
rows). In a pair of blocks, vectors are cut into segments of length L with
mean m and deviation s. The distance over a segment is at least
L * ((m1 - m2)^2 + (s1 - s2)^2), so the inner product over it is at most
L * (m1 * m2 + s1 * s2). The sums of these bounds, from one segment to dim / 2
of them, drop candidates below the k-th best exact score seen; only survivors
get an exact integer product. Each pair returns k rows per query, and the k
best of these are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenor.llm.common import fan_out, stage

CANDIDATES_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 2048


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of sqrt(L) * [means, deviations] over ``segments`` runs of components; the last run may be shorter."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    lengths = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / lengths
    square = np.add.reduceat(x * x, edges[:-1], axis=1) / lengths
    return np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0))]) * np.sqrt(np.hstack([lengths, lengths]))


def _products(q: np.ndarray, x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Products of the pairs (rows, cols): by matrix when they are many, else pair by pair."""
    if len(rows) * 8 > len(q) * len(x):
        return (q @ x.T)[rows, cols]
    return np.concatenate([np.einsum("ij,ij->i", q[rows[i:i + 65536]], x[cols[i:i + 65536]]) for i in range(0, len(rows), 65536)] or [np.zeros(0)])


def block_top_k(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` best of ``x`` for every row of ``q`` (not itself), ties to the smaller id."""
    exact_in_float = max(1, q.shape[1]) * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) < 2 ** 52
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    fq, fx = q.astype(np.float64), x.astype(np.float64)
    out = []
    for a in range(0, len(q), 256):
        qi, part, whole = q_ids[a:a + 256], fq[a:a + 256], q[a:a + 256]
        rows = cols = None
        floor = np.full(len(qi), -np.inf)
        segments = 1
        while part.shape[1] and segments * 2 <= part.shape[1]:
            sq, sx = segment_statistics(part, segments), segment_statistics(fx, segments)
            if rows is None:
                bound = sq @ sx.T
                bound[qi[:, None] == ids[None, :]] = -np.inf
                if len(ids) > k:  # exact scores of the k most promising give the floor
                    best = np.argpartition(-bound, k, axis=1)[:, :k + 1]
                    near = np.einsum("ij,ikj->ik", part, fx[best])
                    near[qi[:, None] == ids[best]] = -np.inf
                    floor = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
                    floor -= 1e-9 * np.abs(floor) + 1e-6
                rows, cols = np.nonzero(bound > -np.inf)
                bound = bound[rows, cols]
            else:
                bound = _products(sq, sx, rows, cols)
            stays = bound + 1e-9 * np.abs(bound) + 1e-6 >= floor[rows]
            rows, cols = rows[stays], cols[stays]
            segments *= 4
        if rows is None:
            rows, cols = np.nonzero(qi[:, None] != ids[None, :])
        if exact_in_float:
            score = _products(part, fx, rows, cols).astype(np.int64)
        else:
            score = np.array([sum(int(m) * int(n) for m, n in zip(whole[r], x[c])) for r, c in zip(rows, cols)], dtype=np.int64)
        by = np.lexsort((cols, -score, rows))
        rows, cols, score = rows[by], cols[by], score[by]
        first = np.searchsorted(rows, np.arange(len(qi)))
        top = np.arange(len(rows)) - first[rows] < k
        out.append(pd.DataFrame({"query_id": qi[rows[top]], "vec_id": ids[cols[top]], "score": score[top]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")


def _pack(key: list[str]):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        m = np.array(group["v"].tolist(), dtype=np.int64)
        return pd.DataFrame({**{c: [group[c].iloc[0]] for c in key}, "ids": [group["id"].to_numpy(np.int64).tobytes()], "m": [m.tobytes()]})
    return pack


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """-> ``query_id, rank, vec_id, score``: for the rows where ``is_query`` holds, the ``k`` other rows with the
    largest product of floor(scale * component), ties to the smaller id.

    Rows whose id or vector is null, or whose vector holds a null or non-finite component, take no part. Rows that
    share an id are entries of their own: none is a candidate of another, and as queries they share one list of the
    ``k`` best pairs. Vectors of another length than the query's are no
    candidates; empty vectors score 0 with each other. An empty table gives no rows; other columns are not read.
    """
    x = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    entries = (vectors.filter(sound)
               .select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"), is_query.alias("q"))
               .withColumn("row", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))
    entries = stage(entries, "topk-entries")
    n = entries.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("q"), 1)).alias("q")).first()
    n_q, n_c = fan_out(n["q"], QUERIES_PER_BLOCK), fan_out(n["n"], CANDIDATES_PER_BLOCK)

    def packed(rows: DataFrame, blocks: int, name: str) -> DataFrame:
        named = rows.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
        return named.groupBy("dim", name).applyInPandas(_pack(["dim", name]), f"dim int, {name} int, ids binary, m binary")

    queries = packed(entries.filter("q"), n_q, "qb").withColumnsRenamed({"ids": "q_ids", "m": "q_m"})
    candidates = packed(entries, n_c, "cb").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                q_ids, ids = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
                yield block_top_k(q_ids, np.frombuffer(r.q_m, np.int64).reshape(len(q_ids), r.dim), ids, np.frombuffer(r.m, np.int64).reshape(len(ids), r.dim), k)

    pairs = candidates.join(queries, ["dim", "qb"]).repartition(n_q * n_c, "qb", "cb")
    found = pairs.mapInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
