"""The two-task model's numbers: one shared low-rank layer, two heads, one loss.

A window of words is a sparse vector x (hashed term counts times IDF, of fixed length). The shared layer is
``h = tanh(x W + c)`` with few columns, the heads are ``h V + b``: one logit per label, three for the
sentiment. Training minimises A11, the weighted sum of the labels' mean cross entropy and the sentiment's, in
which ironic rows weigh more, plus a small ridge. A step of the optimiser (L-BFGS with backtracking) needs the
loss and its gradient over all rows: every task sums its rows' gradient, cut into slices of numbers, and Spark
adds the slices, each in its own reducer. The driver holds the parameters (features x rank numbers) and the
optimiser's few vectors of that size, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenor.functions.numeric import IRONY_SENT_EXTRA, LAMBDA_MULTI, LAMBDA_SENT

NUM_FEATURES, RANK = 1 << 14, 16
#: Numbers per slice of a summed gradient, nonzero features multiplied at once, and pairs that L-BFGS remembers.
SLICE, AT_ONCE, PAIRS = 64, 1 << 16, 6
SENTIMENTS = 3
#: Length of a window's vector: with it the layer's weights move about as fast as the heads'.
LENGTH = 8.0


@dataclass
class Shape:
    features: int
    rank: int
    labels: int

    @property
    def sizes(self) -> list[tuple[int, ...]]:
        k = self.labels + SENTIMENTS
        return [(self.features, self.rank), (self.rank,), (self.rank, k), (k,)]

    def split(self, theta: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([int(np.prod(s)) for s in self.sizes])
        return [part.reshape(s) for part, s in zip(np.split(theta, ends[:-1]), self.sizes)]

    def start(self, seed: int) -> np.ndarray:
        """Small random weights, zero offsets."""
        rng = np.random.default_rng(seed)
        w, c, v, b = [rng.standard_normal(s) / np.sqrt(self.rank) if len(s) == 2 else np.zeros(s) for s in self.sizes]
        return np.concatenate([(w / LENGTH).ravel(), c, v.ravel(), b])


def pieces(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold some AT_ONCE numbers, one row at least."""
    ends, a, done = np.cumsum(sizes), 0, 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, done + AT_ONCE, side="right")))
        yield a, b
        a, done = b, ends[b - 1]


def counted_flat(flat: np.ndarray, sizes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, counts, ends, scales) of rows of hashed terms that stand one after the other: a row's vector is counts times
    IDF times its scale, and has length ``LENGTH`` (empty rows stay empty)."""
    n, many = len(idf), len(sizes)
    kind = np.int32 if many * n < 1 << 31 else np.int64   # half the bytes are sorted in half the time
    both = np.repeat(np.arange(many, dtype=kind) * kind(n), sizes) + flat.astype(kind, copy=False)
    both.sort()
    at = np.flatnonzero(np.append(True, both[1:] != both[:-1])[:len(both)])
    both, counts = both[at], np.diff(at, append=len(both))
    row = both // kind(n)
    feature = both - row * kind(n)
    value = counts * idf[feature]
    norm = np.sqrt(np.bincount(row, weights=value * value, minlength=many))
    return feature, counts, np.cumsum(np.bincount(row, minlength=many)), LENGTH / np.where(norm > 0, norm, 1.0)


def sparse_flat(flat: np.ndarray, sizes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, values, ends) of :func:`counted_flat`."""
    feature, counts, ends, scale = counted_flat(flat, sizes, idf)
    return feature, counts * idf[feature] * np.repeat(scale, np.diff(ends, prepend=0)), ends


def sparse_rows(terms: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`sparse_flat` of a list of rows."""
    sizes = np.array([len(t) for t in terms], np.int64)
    return sparse_flat(np.concatenate([np.asarray(t, np.int64) for t in terms]) if sizes.sum() else np.zeros(0, np.int64), sizes, idf)


def hidden(feature: np.ndarray, value: np.ndarray, ends: np.ndarray, w: np.ndarray, c: np.ndarray) -> np.ndarray:
    """tanh(x W + c) of sparse rows: the layer's rows are gathered for some rows at once, then each is one product."""
    sizes = np.diff(ends, prepend=0)
    out = np.zeros((len(ends), w.shape[1]))
    for a, b in pieces(sizes):
        lo = at = ends[a] - sizes[a]
        own, v = w.take(feature[lo:ends[b - 1]], axis=0), value[lo:ends[b - 1]]
        for i, to in enumerate(ends[a:b].tolist(), a):
            np.dot(v[at - lo:to - lo], own[at - lo:to - lo], out[i])
            at = to
    return np.tanh(out + c)


def probabilities(logits: np.ndarray, labels: int) -> np.ndarray:
    """Sigmoids of the labels' logits, softmax of the sentiment's."""
    s = logits[:, labels:] - logits[:, labels:].max(axis=1, keepdims=True)
    e = np.exp(s)
    return np.hstack([1 / (1 + np.exp(-np.clip(logits[:, :labels], -500, 500))), e / e.sum(axis=1, keepdims=True)])


def row_sums(theta: np.ndarray, shape: Shape, rows: tuple, y: np.ndarray, sent: np.ndarray, weight: np.ndarray, irony: np.ndarray, extra: float,
             lambda_multi: float, lambda_sent: float) -> tuple[np.ndarray, np.ndarray]:
    """Of some rows: the gradient of A11 summed (not averaged), and [labels' loss, sentiment's loss, weights]."""
    w, c, v, b = shape.split(theta)
    feature, value, ends = rows
    h = hidden(feature, value, ends, w, c)
    logits = h @ v + b
    p = probabilities(logits, shape.labels)
    z = logits[:, :shape.labels]
    bce = (np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))).mean(axis=1)
    s = logits[:, shape.labels:]
    top = s.max(axis=1)
    ce = top + np.log(np.exp(s - top[:, None]).sum(axis=1)) - s[np.arange(len(s)), sent]
    heavier = weight * (1 + extra * irony)
    d = np.hstack([lambda_multi * weight[:, None] * (p[:, :shape.labels] - y) / shape.labels, lambda_sent * heavier[:, None] * (p[:, shape.labels:] - np.eye(SENTIMENTS)[sent])])
    back = (d @ v.T) * (1 - h * h)
    gw, columns, sizes = np.zeros((shape.rank, shape.features)), np.ascontiguousarray(back.T), np.diff(ends, prepend=0)
    for a, b in pieces(sizes):   # sums over equal features
        lo, hi = ends[a] - sizes[a], ends[b - 1]
        own, v, many = feature[lo:hi].astype(np.intp), value[lo:hi], sizes[a:b]
        for j, column in enumerate(columns):
            gw[j] += np.bincount(own, weights=np.repeat(column[a:b], many) * v, minlength=shape.features)
    return np.concatenate([gw.T.ravel(), back.sum(0), (h.T @ d).ravel(), d.sum(0)]), np.array([(weight * bce).sum(), (heavier * ce).sum(), weight.sum()])


#: Windows as they are hashed, and as they are trained on: features (see :func:`_feature_type`) and their counts (uint16) as bytes.
TERMS = "terms array<int>, y array<double>, sent int, irony double, weight double"
TRAIN = "feature binary, counts binary, scale double, y array<double>, sent int, irony double, weight double"


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists of numbers -> (the numbers one after the other, how many each row has)."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), sizes


def _bytes(numbers: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Numbers of rows that stand one after the other -> a binary per row."""
    offsets = np.concatenate([[0], ends]).astype(np.int32) * np.int32(numbers.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(numbers))])


def _numbers(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """A column of binaries -> (their numbers one after the other, where each row ends)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data.view(dtype), (offsets[1:] - offsets[0]) // np.dtype(dtype).itemsize


def _feature_type(features: int):
    return np.uint16 if features <= 1 << 16 else np.int32


def _small(feature: np.ndarray, counts: np.ndarray, ends: np.ndarray, most: int = 0xFFFF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of at most ``most``: a larger one stands in several parts, whose sum it is."""
    if not len(counts) or counts.max() <= most:
        return feature, counts, ends
    times = -(-counts // most)
    last = np.cumsum(times)
    parts = np.full(last[-1], most)
    parts[last - 1] = counts - (times - 1) * most
    return np.repeat(feature, times), parts, np.append(0, last)[ends]


def vectorised(windows: DataFrame, idf: np.ndarray, partitions: int = 0) -> DataFrame:
    """``TERMS`` -> ``TRAIN``: every window as a sparse vector, once for all rounds, dealt out evenly to ``partitions`` if
    given. A task holds the numbers of some AT_ONCE terms at once, whatever its batches are. What is kept for the rounds
    are four bytes per feature of a window; ``idf``, by which they are the vectors, goes with the frame."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = _lists(batch.column(batch.schema.get_field_index("terms")))
            ends = np.cumsum(sizes)
            for a, b in pieces(sizes):
                feature, counts, to, scale = counted_flat(flat[ends[a] - sizes[a]:ends[b - 1]], sizes[a:b], idf)
                feature, counts, to = _small(feature, counts, to)
                rest = batch.select(["y", "sent", "irony", "weight"]).slice(a, b - a)
                yield pa.RecordBatch.from_arrays([_bytes(feature.astype(_feature_type(len(idf))), to), _bytes(counts.astype(np.uint16), to), pa.array(scale), *rest.columns],
                                                 names=["feature", "counts", "scale", *rest.schema.names])
    out = windows.mapInArrow(run, TRAIN)
    out = out.repartition(partitions) if partitions else out
    out.idf = idf
    return out


def _read(batch: pa.RecordBatch, idf: np.ndarray) -> tuple:
    col = dict(zip(batch.schema.names, batch.columns))
    feature, ends = _numbers(col["feature"], _feature_type(len(idf)))
    value = _numbers(col["counts"], np.uint16)[0] * idf[feature] * np.repeat(col["scale"].to_numpy(zero_copy_only=False), np.diff(ends, prepend=0))
    y = _lists(col["y"])[0].reshape(batch.num_rows, -1)
    return (feature, value, ends), y, *(col[c].to_numpy(zero_copy_only=False) for c in ("sent", "irony", "weight"))


def evaluate(train: DataFrame, theta: np.ndarray, shape: Shape, ridge: float, extra: float = IRONY_SENT_EXTRA, lambda_multi: float = LAMBDA_MULTI,
             lambda_sent: float = LAMBDA_SENT) -> tuple[float, float, np.ndarray]:
    """(A11 and ridge, A11, gradient) over all rows of ``train`` (made by :func:`vectorised`): one job."""
    idf = getattr(train, "idf", None)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros_like(theta), np.zeros(3)
        for batch in batches:
            if batch.num_rows:
                rows, y, sent, irony, weight = _read(batch, idf)
                g, s = row_sums(theta, shape, rows, y, sent, weight, irony, extra, lambda_multi, lambda_sent)
                total, sums = total + g, sums + s
        if sums[2]:
            flat = np.concatenate([sums, total])
            flat = np.pad(flat, (0, -len(flat) % SLICE)).reshape(-1, SLICE)
            at = np.nonzero(flat.any(axis=1))[0]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(flat[at].ravel()), SLICE).cast(pa.list_(pa.float64()))], names=["slice", "g"])

    added = train.mapInArrow(task, "slice int, g array<double>").groupBy("slice").agg(F.array(*[F.sum(F.col("g")[i]) for i in range(SLICE)]).alias("g"))
    flat = np.zeros((-(-(3 + len(theta)) // SLICE), SLICE))
    for batch in added.toArrow().to_batches():   # the parameters' size, never as Python numbers
        flat[batch.column(0).to_numpy()] = _lists(batch.column(1))[0].reshape(-1, SLICE)
    flat = flat.ravel()
    multi, sent, n = flat[:3]
    if not n:
        raise ValueError("no rows to train on")
    a11 = (lambda_multi * multi + lambda_sent * sent) / n
    return a11 + 0.5 * ridge * float(theta @ theta), a11, flat[3:3 + len(theta)] / n + ridge * theta


def minimise(loss, theta: np.ndarray, max_iter: int, tolerance: float = 1e-4) -> tuple[np.ndarray, list[float]]:
    """L-BFGS with backtracking: ``loss(theta)`` -> (value, A11, gradient). Returns the parameters and A11 after each
    round, the start's first; the value falls in every round."""
    value, a11, g = loss(theta)
    history, pairs = [a11], []
    for _ in range(max_iter):
        q, scale = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (y @ s)
            scale.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(scale)):
            q += (a - (y @ q) / (y @ s)) * s
        step = 1.0 if pairs else min(1.0, 1.0 / max(np.abs(g).sum(), 1e-12))
        slope = float(q @ g)
        for _ in range(30):
            moved = theta - step * q
            new, new_a11, new_g = loss(moved)
            if new <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            return theta, history
        s, y = moved - theta, new_g - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-PAIRS:]
        fell, theta, value, g = value - new, moved, new, new_g
        history.append(new_a11)
        if fell <= tolerance * max(1.0, abs(value)):
            break
    return theta, history


def scorer(theta: np.ndarray, shape: Shape, idf: np.ndarray):
    """A function of Arrow columns: hashed terms of windows -> probabilities of the labels and the three sentiments."""
    def of(terms: pa.Array) -> pa.Array:
        w, c, v, b = shape.split(theta)
        flat, sizes = _lists(terms)
        ends = np.cumsum(sizes)
        parts = [np.zeros((0, shape.labels + SENTIMENTS))]
        for lo, hi in pieces(sizes):
            h = hidden(*sparse_flat(flat[ends[lo] - sizes[lo]:ends[hi - 1]], sizes[lo:hi], idf), w, c)
            parts.append(probabilities(h @ v + b, shape.labels))
        p = np.concatenate(parts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
    return of


def scores(theta: np.ndarray, shape: Shape, idf: np.ndarray):
    """:func:`scorer` as a column function."""
    return F.arrow_udf(scorer(theta, shape, idf), "array<double>")
