"""Vector code compression: a codebook per part of the vector, learnt by exact Lloyd rounds with norm-of-sum bounds.

Every part of a vector keeps an upper bound on the distance to its own entry, a lower bound on the distance to all
others, and for each bound the round in which it was exact (its stamp). The driver keeps the codebooks of all rounds.
A bound of an older round is corrected by the true net displacement of the entries between that round's codebook and
the present one, the norm of the sum of their moves; the usual sum of the norms of single moves is never smaller. A part
whose corrected bounds stay apart keeps its entry without any distance. Else its own distance is computed and stamped
anew, and only if that is not enough all entries are rescanned, with ties to the lower index.

Distances are integers, so codes are exact; bounds are rounded outward. A round is one pass over the vectors: a task
returns its rows with their bounds and, as last rows, its sums per entry, which Spark adds. The driver holds codebooks
only (entries x dimension numbers a round).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenor.llm.common import drop_stage, free_name, stage

#: Of a bound's own size: covers the rounding of square roots and sums of floats.
SLACK = 1e-9


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to the rows of ``c``."""
    most = float(np.abs(x).max(initial=0)) + float(np.abs(c).max(initial=0))
    if most * most * max(1, x.shape[1]) < 2 ** 52:
        fx, fc = x.astype(np.float64), c.astype(np.float64)
        d = (fx * fx).sum(1)[:, None] + (fc * fc).sum(1)[None, :] - 2 * (fx @ fc.T)
        return d.astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def _outward(exact: np.ndarray, up: bool) -> np.ndarray:
    return np.nextafter(np.sqrt(exact.astype(np.float64)).astype(np.float32), np.float32(np.inf if up else -np.inf))


class Bounds:
    """What a block of vectors remembers: a row per vector, a column per part."""

    def __init__(self, rows: int, parts: int):
        self.code = np.zeros((rows, parts), np.uint8)
        self.upper, self.lower = np.zeros((rows, parts), np.float32), np.zeros((rows, parts), np.float32)
        self.upper_at, self.lower_at = np.zeros((rows, parts), np.uint8), np.zeros((rows, parts), np.uint8)

    FIELDS = ("code", "upper", "lower", "upper_at", "lower_at")

    @classmethod
    def read(cls, batch: pa.RecordBatch, parts: int) -> Bounds:
        b = cls(0, parts)
        for f in cls.FIELDS:
            raw = b"".join(batch.column(batch.schema.get_field_index(f)).to_pylist())
            setattr(b, f, np.frombuffer(raw, getattr(b, f).dtype).reshape(batch.num_rows, parts).copy())
        return b

    def columns(self) -> dict[str, list[bytes]]:
        return {f: [row.tobytes() for row in getattr(self, f)] for f in self.FIELDS}


def assign(x: np.ndarray, bounds: Bounds | None, history: list[np.ndarray]) -> tuple[Bounds, np.ndarray, int]:
    """Entries of every part of the rows of ``x`` in the last codebook of ``history`` (parts x entries x length each):
    (bounds with the codes, squared distances summed per row, number of parts that were rescanned)."""
    parts, entries, length = history[-1].shape
    now, first = len(history) - 1, bounds is None
    b = Bounds(len(x), parts) if first else bounds
    error, rescans = np.zeros(len(x), np.int64), 0
    for p in range(parts):
        xp, book = x[:, p * length:(p + 1) * length], history[-1][p]
        scan = np.arange(len(x))
        if not first:
            net = np.array([np.sqrt(((book - old[p]) ** 2).sum(1).astype(np.float64)) for old in history])
            own, at = b.code[:, p], b.lower_at[:, p]
            by_size = np.argsort(net, axis=1)
            largest, second = by_size[:, -1], by_size[:, -2] if entries > 1 else by_size[:, -1]
            lower = b.lower[:, p] - net[at, np.where(largest[at] == own, second[at], largest[at])]
            upper = b.upper[:, p] + net[b.upper_at[:, p], own]
            near = np.nonzero(~(upper + SLACK * (upper + np.abs(lower)) < lower))[0]
            exact = ((xp[near] - book[own[near]]) ** 2).sum(1)
            b.upper[near, p], b.upper_at[near, p] = _outward(exact, True), now
            scan = near[~(b.upper[near, p] * (1 + SLACK) + SLACK * np.abs(lower[near]) < lower[near])]
        if len(scan):
            d = _squared(xp[scan], book)
            best = d.argmin(1)
            rows = np.arange(len(scan))
            b.code[scan, p], b.upper[scan, p] = best, _outward(d[rows, best], True)
            if entries > 1:
                d[rows, best] = np.iinfo(np.int64).max
                b.lower[scan, p] = _outward(d.min(1), False)
            b.upper_at[scan, p] = b.lower_at[scan, p] = now
            rescans += len(scan)
        error += ((xp - book[b.code[:, p]]) ** 2).sum(1)
    return b, error, rescans


def _pass(history: list[np.ndarray], first: bool, carried: list[str], schema: pa.Schema):
    """A round over the rows of a task: rows with their codes and bounds, then the task's sums per part and entry."""
    parts, entries, length = history[-1].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, rescans = np.zeros((parts, entries, length), np.int64), np.zeros((parts, entries), np.int64), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column(batch.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False).reshape(n, parts * length).astype(np.int64)
            most = 2 * max(int(x.max(initial=0)), -int(x.min(initial=0)))
            if most * most * max(1, parts * length) >= 2 ** 62:
                raise ValueError("a component is too large: squared distances must fit 64 bits")
            b, error, scanned = assign(x, None if first else Bounds.read(batch, parts), history)
            rescans += scanned
            for p in range(parts):
                np.add.at(sums[p], b.code[:, p], x[:, p * length:(p + 1) * length])
                counts[p] += np.bincount(b.code[:, p], minlength=entries)
            made = b.columns() | {"error": error}
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else batch.column(batch.schema.get_field_index(f.name)) if f.name in ("v", *carried) else pa.nulls(n, f.type) for f in schema], schema=schema)
        p, e = np.nonzero(counts)
        last = {"part": p, "entry": e, "n": counts[p, e], "total": sums[p, e].tolist(), "rescans": np.where(np.arange(len(p)) == 0, rescans, 0)}
        yield pa.RecordBatch.from_arrays([pa.array(last[f.name], f.type) if f.name in last else pa.nulls(len(p), f.type) for f in schema], schema=schema)

    return run


def codebooks_digest(book: np.ndarray) -> str:
    """Hex SHA-256 of all components, by part, entry and position, as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
             carry: tuple[str, ...] = ()) -> tuple[DataFrame, np.ndarray, list[int]]:
    """-> (``id, code, error`` and the columns of ``carry``; the final codebooks, parts x entries x length; the number of
    parts rescanned in each pass). ``code`` has a byte per part, ``error`` is the sum of its squared distances.

    Components become floor(scale * x). A part's codebook starts as that part of the ``entries`` rows of smallest id
    (null ids last, then by vector; fewer rows: fewer entries). Each round assigns every part to the nearest entry, ties to the lower index, and
    moves each entry to the floor of its parts' mean; entries without parts stay. At last all parts are assigned again.

    Vectors that are null or hold a null or non-finite component take no part, nor do vectors of another length than the
    first's (smallest id, length divisible by ``parts``). Repeated rows and ids are rows of their own; a null id stays.
    Empty vectors have code 0 and error 0. An empty table gives no rows and codebooks without entries. Columns other than those named are
    not read; those of ``carry`` that are named like a result column get underscores behind. Components whose squared
    distances pass 64 bits raise an error.
    """
    if not 0 < entries <= 256 or parts < 1 or not 0 <= rounds <= 255:
        raise ValueError("entries must be 1 to 256, parts at least 1, rounds 0 to 255")
    x = F.col(vector_col)
    sound = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))) & (F.size(x) % parts == 0)
    ids, names = "id", {}
    for c in carry:
        name = c
        while name.lower() in {"id", "v", "part", "entry", "n", "total", "rescans", "error", *Bounds.FIELDS, *[m.lower() for m in names.values()]}:
            name += "_"
        names[c] = name
    whole = vectors.filter(sound).select(F.col(id_col).alias(ids), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"), *[F.col(c).alias(m) for c, m in names.items()])
    order = [F.col(ids).asc_nulls_last(), F.col("v")]
    head = whole.orderBy(*order).select("v").first()
    dim = len(head["v"]) if head else 0
    whole = whole.filter(F.size("v") == dim)
    seeds = [r["v"] for r in whole.orderBy(*order).select("v").limit(entries).collect()]
    length = dim // parts
    history = [np.array(seeds, np.int64).reshape(len(seeds), parts, length).transpose(1, 0, 2)]
    carried = [ids, *names.values()]
    if not seeds:
        empty = whole.select(*carried, F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
        return empty.filter(F.lit(False)).select(ids, "code", "error", *names.values()), history[-1], []
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema)
    made = f"{kinds}, {', '.join(f'{f} binary' for f in Bounds.FIELDS)}, error long, part int, entry int, n long, total array<long>, rescans long"
    state, before, rescans = whole, None, []
    for r in range(rounds + 1):
        arrow = _arrow_schema(vectors.sparkSession, made)
        done = stage(state.mapInArrow(_pass(history, r == 0, carried, arrow), made), f"veccodes-{r}")
        if before is not None:
            drop_stage(before)
        if r < rounds:
            added = (done.filter("part IS NOT NULL").groupBy("part", "entry")
                     .agg(F.sum("n").alias("n"), F.sum("rescans").alias("rescans"), F.array(*[F.sum(F.col("total")[i]) for i in range(length)]).cast("array<long>").alias("total"))).collect()
            book = history[-1].copy()
            for s in added:
                book[s["part"], s["entry"]] = [t // s["n"] for t in s["total"]]
            history.append(book)
            rescans.append(sum(s["rescans"] for s in added))
        else:
            rescans.append(done.agg(F.sum("rescans")).first()[0])
        state, before = done.filter("part IS NULL"), done
    return state.select(ids, "code", "error", *names.values()), history[-1], rescans


def _arrow_schema(spark, made: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], made).schema)


def with_group_error(coded: DataFrame, group: str, name: str = "group_error") -> DataFrame:
    """Adds the sum of ``error`` over the rows of equal ``group`` (nulls are one): summed first, then joined back."""
    name = free_name(coded, name)
    sums = coded.groupBy(F.col(group).alias("__group")).agg(F.sum("error").alias(name))
    return coded.join(sums, F.col(group).eqNullSafe(F.col("__group"))).drop("__group")
