"""Substring dedup with sharded suffix arrays and longest-previous-factor arrays.

A byte goes when some run of ``length`` bytes over it also starts in an earlier
document. The suffixes that can share such a run are first brought together:

1. Every window of ``length`` bytes has an anchor, the least hash of its
   ``gram``-byte substrings, so equal windows have equal anchors. A maximal run
   of windows with one anchor is a segment (about 1 anchor for every 16 bytes).
   Only hashes, documents and places are shuffled, packed, by anchor.
2. An anchor in one document only can't repeat. Of equal segments (anchor and
   content hash, with the bucket at least 86 bits) the one in the first document
   represents the others, which are covered from end to end; this takes copies out
   before any text moves. Segments of an anchor with several contents stay open.
3. The bytes of the open segments are dealt by anchor. Each shard sorts all
   windows of its segments (a suffix array up to ``length`` bytes), and its
   longest-previous-factor array is the larger of the common prefixes with the
   previous and the next suffix of a smaller document in suffix order, found by
   pointer jumping over nearest smaller positions. Windows with a previous factor
   of ``length`` bytes are covered.
4. The covered places return to their documents, which drop them.

An anchor with very many different contents (``HOT``) is dealt window by window
instead of as a whole, so no shard holds all of it. Texts are read in slices;
places, not texts, are what grows with the number of repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenor.llm.common import byte_views, fan_out, stage, text_size

U = np.uint64
_C1, _C2, _C3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
#: Bytes of text read at once.
SLICE = 1 << 20
#: Windows in a segment at most.
RUN = 4096
#: Contents of an anchor beyond which its windows are dealt one by one.
HOT = 4096
#: Segments that a task gathers before it packs them by bucket.
PACKED = 500_000
#: Bytes of text that a bucket of anchors, of documents, and a shard of open segments stands for.
TEXT_PER_BUCKET = 8 << 20
#: Stands for a null id in the order of documents: after all others.
LAST = np.iinfo(np.int64).max


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(29))) * _C2
    x = (x ^ (x >> U(32))) * _C3
    return x ^ (x >> U(29))


def _octets(b: np.ndarray) -> np.ndarray:
    """Little-endian 8-byte numbers at every place of ``b`` (7 fewer than bytes)."""
    x = b.astype(U)
    x = x[:-1] | x[1:] << U(8)
    x = x[:-2] | x[2:] << U(16)
    return x[:-4] | x[4:] << U(32)


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every substring of ``gram`` (8 at least) bytes."""
    n = len(b) - gram + 1
    x = _octets(b)
    h = np.zeros(n, U)
    for at in [*range(0, gram - 8, 8), gram - 8]:
        h = (h ^ (h >> U(31))) * _C1 + x[at:at + n] * _C2
    return _mix(h)


def least_of(h: np.ndarray, n: int) -> np.ndarray:
    """The minimum of every ``n`` consecutive values."""
    step = 1
    while step * 2 <= n:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[:len(h) - (n - step)], h[n - step:]) if n > step else h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(_C1), -1, 1 << 64)
    return np.multiply.accumulate(np.concatenate([[U(1)], np.full(n, _C1)])), np.multiply.accumulate(np.concatenate([[U(1)], np.full(n, U(inverse))]))


def segments(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int, powers) -> tuple[np.ndarray, ...]:
    """(anchor, content hash, first window, windows) of the segments of the documents at ``starts:ends`` of ``b``."""
    if len(b) < length:
        return np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    per_window = length - gram + 1
    h = gram_hashes(b, gram)
    m = least_of(h, per_window)
    inside = np.zeros(len(m) + 1, np.int64)
    some = ends - starts >= length
    np.add.at(inside, starts[some], 1)
    np.add.at(inside, ends[some] - length + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    edge = np.ones(len(m), bool)
    edge[1:] = (m[1:] != m[:-1]) | ~inside[:-1]
    first = np.flatnonzero(edge & inside)
    stop = np.flatnonzero(inside & np.concatenate([edge[1:] | ~inside[1:], [True]])) + 1
    n = stop - first
    if len(n) and n.max() > RUN:
        parts = -(-n // RUN)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, n = np.repeat(first, parts) + k * RUN, np.minimum(RUN, np.repeat(n, parts) - k * RUN)
    up, down = powers
    run = np.concatenate([[U(0)], np.cumsum(h * up[:len(h)])])
    content = _mix((run[first + n + per_window - 1] - run[first]) * down[first] + n.astype(U))
    return _mix(m[first]), content, first, n


def _slices(texts, limit: int, overlap: int) -> Iterator[tuple[list[tuple[int, int, memoryview]], int]]:
    """Groups of (row, offset in the text, bytes) of about ``limit`` bytes; a longer text comes in pieces that
    overlap by ``overlap`` bytes, so each window is in one piece."""
    group: list[tuple[int, int, memoryview]] = []
    held = 0
    for row, text in enumerate(texts):
        if text is None:
            continue
        for at in range(0, max(1, len(text) - overlap), limit):
            piece = text[at:at + limit + overlap]
            group.append((row, at, piece))
            held += len(piece)
            if held >= limit:
                yield group
                group, held = [], 0
    if group:
        yield group


def _press(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def _unpress(blob: bytes, n: int, kinds: list) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 0
    for kind in kinds:
        size = np.dtype(kind).itemsize * n
        out.append(np.frombuffer(raw[at:at + size], kind))
        at += size
    return out


def _delta(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _runs(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indexes of its entries in their order)."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    edge = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(bucket)]):
        yield int(sorted_[a]), order[a:b]


_PLACES = [np.int64, np.uint32, np.uint32, np.uint16]  # document, tag, first window (deltas within a blob), windows


def _places(doc, tag, first, n) -> list[np.ndarray]:
    return [_delta(doc.astype(np.int64)), tag.astype(np.uint32), first.astype(np.uint32), n.astype(np.uint16)]


def _doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(doc.astype(np.int64).view(U)) >> U(20)) % U(buckets)


def bounded_lpf(common: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Longest previous factor, as far as it reaches ``length``: for each suffix, in suffix order, the larger of its
    common prefixes with the nearest suffixes before and after it that have a smaller ``doc``.

    ``common[i]``: common prefix of suffixes i - 1 and i. A neighbour whose common prefix is below ``length`` ends the
    search on that side (the result is then below ``length``, given as 0). Neighbours are found by jumping along
    pointers: what lies between a suffix and its pointer has no smaller document.
    """

    def side(doc: np.ndarray, common: np.ndarray) -> np.ndarray:
        at = np.arange(len(doc)) - 1
        lcp = common.copy()
        todo = np.arange(len(doc))
        while len(todo):
            todo = todo[(lcp[todo] >= length) & (at[todo] >= 0)]
            todo = todo[doc[at[todo]] >= doc[todo]]
            via = at[todo]
            to, low = at[via].copy(), np.minimum(lcp[todo], lcp[via])
            at[todo], lcp[todo] = to, low
        lcp[(at < 0) | (lcp < length)] = 0
        return lcp

    before = side(doc, common)
    after = side(doc[::-1], np.concatenate([[0], common[:0:-1]]))[::-1]
    return np.maximum(before, after)


def covered_windows(data: np.ndarray, windows: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows (places in ``data``) have a previous factor of ``length`` bytes in a smaller ``doc``."""
    if not len(windows):
        return np.zeros(0, bool)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    x = _octets(padded).byteswap()  # big-endian numbers sort like bytes
    whole = length // 8
    keys = [x[windows + 8 * k] for k in range(whole)]
    if length % 8:
        keys.append(x[windows + 8 * whole] >> U(8 * (8 - length % 8)))
    order = np.lexsort((doc, *keys[::-1]))
    # Common prefix in bytes; partial words count their equal leading bytes.
    common = np.zeros(len(order), np.int64)
    equal = np.ones(len(order), bool)
    equal[0] = False
    for k, key in enumerate(keys):
        size = 8 if k < whole else length % 8
        key = key[order]
        differ = np.concatenate([[U(0)], key[1:] ^ key[:-1]])
        same = np.full(len(differ), size, np.int64)
        for byte in range(size):
            same = np.where((differ >> U(8 * byte)) > 0, size - 1 - byte, same)
        common += np.where(equal, same, 0)
        equal &= differ == 0
    out = np.zeros(len(order), bool)
    out[order] = bounded_lpf(common, doc[order], length) >= length
    return out


def repeated_places(keyed: DataFrame, by_bucket: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    """``doc long, tag int, text`` -> ``bucket, kind, n, blob``: packed places (first window, windows) covered by an
    earlier document, by bucket of documents. ``by_bucket``: :func:`texts_by_bucket` of it."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(2 * (SLICE + length))
        held: list[tuple[np.ndarray, ...]] = []

        def packed() -> pa.RecordBatch:
            anchor, content, doc, tag, place, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(doc, kind="stable")  # deltas of documents stay small
            anchor, content, doc, tag, place, n = (x[order] for x in (anchor, content, doc, tag, place, n))
            out = []
            for k, i in _runs((anchor >> U(40)) % U(buckets)):
                a, c = anchor[i], content[i]
                out.append((k, len(i), b"".join(x.tobytes() for x in (a.astype(np.uint32), c.astype(np.uint32), (c >> U(32)).astype(np.uint16))), _press(*_places(doc[i], tag[i], place[i], n[i]))))
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary()), pa.array([o[3] for o in out], pa.binary())], names=["bucket", "n", "hashes", "places"])

        for batch in batches:
            docs, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for group in _slices(byte_views(batch.column(2)), SLICE, length - 1):
                b = np.frombuffer(b"".join(g[2] for g in group), np.uint8)
                sizes = np.array([len(g[2]) for g in group], np.int64)
                ends = np.cumsum(sizes)
                anchor, content, first, n = segments(b, ends - sizes, ends, length, gram, powers)
                piece = np.searchsorted(ends, first, side="right")
                rows, at = np.array([g[0] for g in group], np.int64), np.array([g[1] for g in group], np.int64)
                held.append((anchor, content, docs[rows[piece]], tags[rows[piece]], first - (ends - sizes)[piece] + at[piece], n))
                if sum(len(h[0]) for h in held) > PACKED:  # a row for each bucket, so as many entries as memory allows
                    yield packed()
                    held = []
        if held:
            yield packed()

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        anchor, low, high, doc, tag, first, n = [], [], [], [], [], [], []
        for r in group.itertuples():
            k = r.n
            anchor.append(np.frombuffer(r.hashes[:4 * k], np.uint32))
            low.append(np.frombuffer(r.hashes[4 * k:8 * k], np.uint32))
            high.append(np.frombuffer(r.hashes[8 * k:], np.uint16))
            d, t, f, w = _unpress(r.places, k, _PLACES)
            doc.append(np.cumsum(d))
            tag.append(t)
            first.append(f)
            n.append(w)
        anchor, low, high, doc, tag, first, n = map(np.concatenate, (anchor, low, high, doc, tag, first, n))
        bucket_no = int(group["bucket"].iloc[0])
        order = np.argsort(anchor, kind="stable")
        anchor, doc = anchor[order], doc[order]
        edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        size = np.diff(np.append(edge, len(anchor)))
        shared = np.repeat(np.minimum.reduceat(doc, edge) != np.maximum.reduceat(doc, edge), size)
        order = order[shared]
        anchor, doc = anchor[shared], doc[shared]
        if not len(order):
            return pd.DataFrame([], columns=["bucket", "kind", "n", "origin", "blob"])
        content = high[order].astype(U) << U(32) | low[order]
        tag, first, n = tag[order], first[order], n[order]
        order = np.lexsort((first, doc, content, anchor))
        anchor, content, doc, tag, first, n = (x[order] for x in (anchor, content, doc, tag, first, n))
        new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        new = new_anchor | np.concatenate([[True], content[1:] != content[:-1]])
        of, heads = np.cumsum(new) - 1, np.flatnonzero(new)
        covered = doc > doc[heads][of]
        group_of, group_heads = np.cumsum(new_anchor) - 1, np.flatnonzero(new_anchor)
        contents = np.add.reduceat(new.astype(np.int64), group_heads)[group_of]
        open_ = ~covered & (contents > 1)
        out = []
        by_doc = np.lexsort((first, tag, doc))
        bucket = _doc_bucket(doc, buckets)
        for kind, chosen in ((0, covered), (1, open_)):
            i = by_doc[chosen[by_doc]]
            for k, j in _runs(bucket[i]):
                j = i[j]
                more = [anchor[j], (contents[j] > HOT)] if kind else []
                out.append((k, kind, len(j), bucket_no, _press(*_places(doc[j], tag[j], first[j], n[j]), *more)))
        return pd.DataFrame(out, columns=["bucket", "kind", "n", "origin", "blob"])

    packed = keyed.mapInArrow(anchors, "bucket int, n int, hashes binary, places binary")
    found = stage(packed.groupBy("bucket").applyInPandas(compare, "bucket int, kind int, n int, origin int, blob binary"), "repeat-places")

    def cut(key, texts: pa.Table, blobs: pa.Table) -> pa.Table:
        """The bytes of open segments, packed by shard: (shard; anchors, places, bytes)."""
        own = {(d, t): b for d, t, b in zip(texts["doc"].to_pylist(), texts["tag"].to_pylist(), texts["body"].to_pylist())}
        out: dict[int, list] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        parts = []
        for k, origin, blob in zip(blobs["n"].to_pylist(), blobs["origin"].to_pylist(), blobs["blob"].to_pylist()):
            d, t, f, w, a, hot = _unpress(blob, k, [*_PLACES, np.uint32, bool])
            parts.append((np.cumsum(d), t.view(np.int32), f.astype(np.int64), w.astype(np.int64), a.astype(U) | U(origin) << U(32), hot))
        if not parts:
            return _segment_table({})
        doc, tag, first, n, anchor, hot = map(np.concatenate, zip(*parts))
        order = np.lexsort((first, tag, doc))
        last, text = None, b""
        for i in order.tolist():
            if (now := (int(doc[i]), int(tag[i]))) != last:
                last, text = now, unpack(own[now])
            a, f, w = int(anchor[i]), int(first[i]), int(n[i])
            if hot[i]:
                for s in range(f, f + w):
                    piece = text[s:s + length]
                    key_ = int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little")
                    out.setdefault(key_ % buckets, []).append((key_, now, s, 1, piece))
            else:
                out.setdefault((a * 0x9E3779B97F4A7C15 >> 17) % buckets, []).append((a, now, f, w, text[f:f + w + length - 1]))
        return _segment_table(out)

    def _segment_table(out: dict[int, list]) -> pa.Table:
        rows = []
        for shard, items in out.items():
            numbers = [np.array([x[1][0] for x in items], np.int64), np.array([x[1][1] for x in items], np.int64).astype(np.uint32), np.array([x[2] for x in items], np.uint32), np.array([x[3] for x in items], np.uint16)]
            rows.append((shard, len(items), _press(*_places(*numbers)), zstandard.ZstdCompressor(level=1).compress(b"".join(x[4] for x in items))))
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "n": pa.array([r[1] for r in rows], pa.int32()), "places": pa.array([r[2] for r in rows], pa.binary()), "bytes": pa.array([r[3] for r in rows], pa.binary())})

    def factors(group: pd.DataFrame) -> pd.DataFrame:
        """Suffix array and longest previous factors of a shard."""
        parts, blobs = [], []
        for r in group.itertuples():
            d, t, f, w = _unpress(r.places, r.n, _PLACES)
            parts.append((np.cumsum(d), t, f.astype(np.int64), w.astype(np.int64)))
            blobs.append(zstandard.ZstdDecompressor().decompress(r.bytes))
        doc, tag, first, n = map(np.concatenate, zip(*parts))
        data = np.frombuffer(b"".join(blobs), np.uint8)
        begin = np.cumsum(n + length - 1) - (n + length - 1)
        of = np.repeat(np.arange(len(n)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = covered_windows(data, begin[of] + step, doc[of], length)
        # Covered windows next to each other in a segment become one place.
        edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        seg = np.unique(np.concatenate([a, (np.cumsum(n) - n)[1:]])) if len(a) else np.zeros(0, np.int64)
        seg = seg[hit[seg]] if len(seg) else seg
        stop = np.minimum(b[np.searchsorted(b, seg, side="right")], np.cumsum(n)[of[seg]]) if len(seg) else seg
        doc, tag, place, size_ = doc[of[seg]], tag[of[seg]], first[of[seg]] + step[seg], stop - seg
        out = []
        by_doc = np.lexsort((place, tag, doc))
        for k, j in _runs(_doc_bucket(doc, buckets)[by_doc]):
            j = by_doc[j]
            out.append((k, 0, len(j), _press(*_places(doc[j], tag[j], place[j], size_[j]))))
        return pd.DataFrame(out, columns=["bucket", "kind", "n", "blob"])

    opened = found.filter("kind = 1").select("bucket", "n", "origin", "blob")
    cuts = by_bucket.groupBy("bucket").cogroup(opened.groupBy("bucket")).applyInArrow(cut, "shard int, n int, places binary, bytes binary")
    later = cuts.groupBy("shard").applyInPandas(factors, "bucket int, kind int, n int, blob binary")
    return found.filter("kind = 0").select("bucket", "n", "blob").unionByName(later.select("bucket", "n", "blob"))


def texts_by_bucket(keyed: DataFrame, buckets: int) -> DataFrame:
    """``bucket, doc, tag, body`` with compressed texts, for the shuffle by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            bucket = _doc_bucket(batch.column(0).to_numpy(), buckets).astype(np.int32)
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                body = pa.array([press(t if t is not None else b"") for t in byte_views(part.column(2))], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(bucket[a:a + 500]), part.column(0), part.column(1), body], names=["bucket", "doc", "tag", "body"])

    return keyed.mapInArrow(run, "bucket int, doc long, tag int, body binary")


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, gram: int = 20, texts: bool = False) -> DataFrame:
    """-> ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, firsts, ends`` (and ``kept binary`` if ``texts``), one row
    per document; ``firsts`` and ``ends`` are the removed runs of bytes.

    Every byte goes that is covered by ``length`` bytes that also start in a document with a smaller id. Null texts are
    empty; texts shorter than ``length`` stay whole. Rows that repeat an id don't take from each other; a null id comes
    after all others. An empty table gives no rows; other columns are not read.
    """
    ids = documents.select(F.col(id_col).cast("long").alias("id"))
    # Rows with the same id are told apart by a hash of their text; without any, the tag is 0.
    repeated = not ids.groupBy("id").count().filter("count > 1").isEmpty()
    tag = F.shiftright(F.xxhash64(F.col(text_col)), 32).cast("int") if repeated else F.lit(0)
    keyed = documents.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST))).alias("doc"), tag.alias("tag"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    _, size = text_size(keyed, "text")
    buckets = fan_out(size, TEXT_PER_BUCKET)
    by_bucket = texts_by_bucket(keyed, buckets)  # one frame for both uses: Spark shuffles it once
    places = repeated_places(keyed, by_bucket, length, gram, buckets)

    def drop(key, texts_: pa.Table, blobs: pa.Table) -> pa.Table:
        parts = []
        for k, blob in zip(blobs["n"].to_pylist(), blobs["blob"].to_pylist()):
            d, t, f, w = _unpress(blob, k, _PLACES)
            parts.append((np.cumsum(d), t.view(np.int32), f.astype(np.int64), w.astype(np.int64)))
        doc, tag_, first, n = map(np.concatenate, zip(*parts)) if parts else [np.zeros(0, np.int64)] * 4
        order = np.lexsort((first, tag_, doc))
        doc, tag_, first, n = doc[order], tag_[order], first[order], n[order]
        unpack = zstandard.ZstdDecompressor().decompress
        rows: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "firsts", "ends", "kept")}
        for d, t, body in zip(texts_["doc"].to_pylist(), texts_["tag"].to_pylist(), texts_["body"].to_pylist()):
            text = unpack(body)
            a, b = np.searchsorted(doc, [d, d + 1]) if d < LAST else (np.searchsorted(doc, d), len(doc))
            mine = slice(a, b) if not repeated else np.arange(a, b)[tag_[a:b] == t]
            edge = np.zeros(len(text) + 1, np.int64)
            np.add.at(edge, first[mine], 1)
            np.add.at(edge, first[mine] + n[mine] + length - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            turn = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            for c, v in zip(rows, (None if d == LAST else d, len(text), int(gone.sum()), int((turn == 1).sum()), hashlib.sha256(kept).hexdigest(), np.flatnonzero(turn == 1), np.flatnonzero(turn == -1), kept if texts else None)):
                rows[c].append(v)
        kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "firsts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "kept": pa.binary()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in rows.items()})

    done = (by_bucket.groupBy("bucket").cogroup(places.groupBy("bucket"))
            .applyInArrow(drop, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, firsts array<long>, ends array<long>, kept binary"))
    return done if texts else done.drop("kept")
