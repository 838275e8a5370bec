"""Token ids as directly addressable codes in Parquet blocks.

Texts are encoded, and each block of documents stores the ids of its texts
back to back as directly addressable codes: level 0 holds the low
``WIDTHS[0]`` bits of every id and a bitmap that says which ids go on; level 1
holds the next bits of those ids only, and so on. A rank directory (the number
of set bits before each 512-bit block of the bitmap) leads from a position to
its place on the next level, so any id is read in constant time without
decoding what stands around it.

Blocks are rows of a Parquet table, written and committed by Spark, so they
live wherever Spark can write and a lost executor's blocks are written again.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenor.llm.common import fan_out, text_size

#: Bits of an id on each level, from the lowest; the last level takes what is left.
WIDTHS = (8, 8, 16)
RANK_BITS = 512
BLOCK_TOKENS = 1 << 20
#: Chunks whose ids a worker remembers.
CACHE = 600_000
TEXT_PER_RANGE = 24 << 20


def pack(ids: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
    """Per level: the chunks (1 or 2 bytes each), the continuation bitmap, and its rank directory."""
    out = []
    rest = ids.astype(np.uint32)
    for k, bits in enumerate(WIDTHS):
        chunk = (rest & np.uint32((1 << bits) - 1)).astype(np.uint8 if bits <= 8 else "<u2")
        rest = rest >> np.uint32(bits) if bits < 32 else np.zeros_like(rest)
        on = rest > 0 if k + 1 < len(WIDTHS) else np.zeros(len(rest), bool)
        bitmap = np.packbits(on, bitorder="little")
        per = np.add.reduceat(np.append(on, False).astype(np.uint32), np.arange(0, max(1, len(on)), RANK_BITS))
        ranks = np.concatenate([[0], np.cumsum(per)[:-1]]).astype("<u4")
        out.append((chunk.tobytes(), bitmap.tobytes(), ranks.tobytes()))
        rest = rest[on]
    return out


class Codes:
    """Reads what :func:`pack` wrote."""

    def __init__(self, levels: list[tuple[bytes, bytes, bytes]]):
        self.levels = [(np.frombuffer(c, np.uint8 if WIDTHS[k] <= 8 else "<u2"), np.frombuffer(b, np.uint8), np.frombuffer(r, "<u4")) for k, (c, b, r) in enumerate(levels)]

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        value = shift = 0
        for (chunk, bitmap, ranks), bits in zip(self.levels, WIDTHS):
            value |= int(chunk[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            a = i // RANK_BITS
            inside = bitmap[a * RANK_BITS // 8:(i >> 3) + 1].copy()
            inside[-1] &= (1 << (i & 7)) - 1
            i = int(ranks[a]) + int(np.bitwise_count(inside).sum())
            shift += bits
        return value

    def all(self) -> np.ndarray:
        out = np.zeros(len(self), np.uint32)
        at, shift = np.arange(len(self)), 0
        for (chunk, bitmap, _), bits in zip(self.levels, WIDTHS):
            out[at] |= chunk[:len(at)].astype(np.uint32) << np.uint32(shift)
            at = at[np.unpackbits(bitmap, count=len(at), bitorder="little").astype(bool)]
            shift += bits
        return out


class Encoder:
    """The tokenizer with a memory for chunks between blanks.

    Where the tokenizer's file says that white space only separates (it is dropped, and normalisation works within
    chunks), a text's ids are the ids of its chunks one after the other, and frequent chunks are encoded once.
    Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str, most: int | None = None):
        """``most``: chunks to remember (``CACHE`` if None)."""
        from tokenizers import Tokenizer

        self.most = most
        self.tok = Tokenizer.from_file(path)
        conf = json.loads(open(path, encoding="utf-8").read())
        kinds = [n.get("type") for n in (conf.get("normalizer") or {}).get("normalizers", [])]
        pre = (conf.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_chunk = (kinds == ["NFC", "Replace", "Lowercase"] and pre[0].get("type") == "Split" and pre[0].get("invert") is True
                         and pre[0].get("behavior") == "Removed" and r"[^\s" in pre[0].get("pattern", {}).get("Regex", "")
                         and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or set(t["content"]) & set(" \n") for t in conf.get("added_tokens", [])))
        self.special = [t["content"].lower() for t in conf.get("added_tokens", [])]
        self.dtype = np.uint16 if self.tok.get_vocab_size() <= 65536 else np.uint32
        suffix = conf["model"].get("end_of_word_suffix")
        #: Ids that end a run of letters: many such runs are encoded as one text and cut apart again.
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        if suffix:
            self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith(suffix)]] = True
        self._forget(np.zeros(0, np.int64))

    def _forget(self, stay: np.ndarray) -> None:
        """Keep the entries ``stay`` of the memory: a chunk's place in ``flat``, its number of ids, and its uses."""
        names = getattr(self, "names", [])
        if len(stay):
            self.flat, self.size = _gather(self.flat, self.begin[stay], self.size[stay])
        else:
            self.flat, self.size = np.zeros(0, self.dtype), np.zeros(0, np.int64)
        self.begin, self.uses = np.cumsum(self.size) - self.size, np.zeros(len(stay), np.int32)
        self.names, self.pending = [names[i] for i in stay.tolist()], []
        self.index = {n: i for i, n in enumerate(self.names)}

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, texts: list[str]) -> None:
        """Encode and remember; runs of letters, whose last id ends a word and no other does, go through together."""
        rest = texts
        if self.ends.any():
            letters, rest = [], []
            for t in texts:
                (letters if t.isalpha() and t.lower().isalpha() else rest).append(t)
            for a in range(0, len(letters), 2000):
                some = letters[a:a + 2000]
                ids = self._plain([" ".join(some)])[0]
                stop = np.flatnonzero(self.ends[ids]) + 1
                if len(stop) == len(some):
                    self._remember(some, ids, np.diff(stop, prepend=0))
                else:
                    rest += some
        for a in range(0, len(rest), 4096):
            each = self._plain(rest[a:a + 4096])
            self._remember(rest[a:a + 4096], np.concatenate(each), np.array([len(x) for x in each], np.int64))

    def _split(self, chunk: str) -> tuple[str, str]:
        """(body, tail) with ids(chunk) = ids(body) + ids(tail): in ASCII, 'Word.,' is 'word' followed by '.,'."""
        if not chunk.isascii():
            return chunk, ""
        low = chunk.lower()
        if "<" in low and any(s in low for s in self.special):
            return chunk, ""
        stem = low.rstrip(".,")
        return (stem, low[len(stem):]) if stem and stem[-1].isalnum() else (low, "")

    def _remember(self, names: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        self.index.update(zip(names, range(len(self.names), len(self.names) + len(names))))
        self.names += names
        self.pending.append((ids, size))

    def _settle(self) -> None:
        """Append what was remembered to the arrays."""
        if self.pending:
            size = np.concatenate([s for _, s in self.pending])
            at = len(self.flat) + np.cumsum(size) - size
            self.flat = np.concatenate([self.flat, *[i for i, _ in self.pending]])
            self.begin, self.size = np.concatenate([self.begin, at]), np.concatenate([self.size, size])
            self.uses = np.concatenate([self.uses, np.zeros(len(size), np.int32)])
            self.pending = []

    def _chunks(self, chunks: list[str]) -> np.ndarray:
        """The entries of the chunks, which are encoded first where they are new."""
        if len(self.names) > (CACHE if self.most is None else self.most):
            self._forget(np.flatnonzero(self.uses > 1))
        index = self.index
        new = [c for c in chunks if c not in index]
        stems, tails = [], []
        for c in new:
            stem, tail = self._split(c)
            stems.append(stem)
            tails.append(tail)
        self._encode([p for p in dict.fromkeys(stems + tails) if p not in index])
        self._settle()
        both = [(c, index[s], index[t]) for c, s, t in zip(new, stems, tails) if c not in index]
        if both:
            pair = np.array([x[1:] for x in both], np.int64)
            ids, size = _gather(self.flat, self.begin[pair.ravel()], self.size[pair.ravel()])
            self._remember([x[0] for x in both], ids, size.reshape(-1, 2).sum(axis=1))
            self._settle()
        which = np.fromiter(map(index.__getitem__, chunks), np.int64, len(chunks))
        self.uses[which] += 1
        return which

    def __call__(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(all ids back to back, ids per text), ``end`` after each text."""
        texts = pc.fill_null(texts, "")
        if not self.by_chunk:
            each = [x if end is None else np.append(x, x.dtype.type(end)) for x in self._plain(texts.to_pylist())]
            return np.concatenate([np.zeros(0, self.dtype), *each]), np.array([len(x) for x in each], np.int64)
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        entry = self._chunks(coded.dictionary.to_pylist())
        per = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        which = entry[coded.indices.to_numpy(zero_copy_only=False)] if len(entry) else np.zeros(0, np.int64)
        last = np.cumsum(per) - 1  # every text has a chunk
        ids, size = _gather(self.flat, self.begin[which], self.size[which], None if end is None else last)
        total = np.concatenate([[0], np.cumsum(size)])
        if end is not None:
            ids[total[last + 1] - 1] = end
        return ids, np.diff(total[last + 1], prepend=0)


def _gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, room: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(the stretches of ``flat`` one after the other, their sizes), with room for one more id after those at ``room``."""
    size = size.copy()
    if room is not None:
        size[room] += 1
    stop = np.cumsum(size)
    n = int(stop[-1]) if len(stop) else 0
    at = np.repeat((begin - (stop - size)).astype(np.int32 if max(n, len(flat)) < 1 << 30 else np.int64), size)
    at += np.arange(n, dtype=at.dtype)
    return flat.take(at, mode="clip") if len(flat) else np.zeros(n, flat.dtype), size


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, most: int | None = None) -> Encoder:
    if path not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].most = most
    return _ENCODERS[path]


_BLOCK = "part int, block int, doc_ids binary, sizes binary, nulls binary, " + ", ".join(f"chunk{k} binary, bitmap{k} binary, ranks{k} binary" for k in range(len(WIDTHS)))


def write_tokens(documents: DataFrame, to: str, tokenizer: str | None, end: int | None = 1, id_col: str = "doc_id", text_col: str = "text", remember: int | None = None) -> None:
    """Encode every whole text (null: empty) and write blocks in ascending order of id, null ids last.

    ``tokenizer``: a path that every executor has, or a function that gives it there. Rows that repeat an id follow
    each other in no fixed order unless their texts are equal. Other columns are not read. ``remember``: chunks whose
    ids a worker keeps (``CACHE`` if None), for executors with little memory.
    """
    _, size = text_size(documents, text_col)
    own = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    ranges = own.repartitionByRange(fan_out(size, TEXT_PER_RANGE), F.col("id").asc_nulls_last()).sortWithinPartitions(F.col("id").asc_nulls_last())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer() if callable(tokenizer) else tokenizer, remember)
        part, block = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        held_tokens = 0

        def flush() -> pa.RecordBatch:
            ids, sizes, docs, nulls = (np.concatenate(x) for x in zip(*held))
            row = [part, block, docs.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), np.packbits(nulls).tobytes(), *[x for level in pack(ids) for x in level]]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if isinstance(v, int) else pa.binary()) for v in row], names=[c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            for at in _slices(batch.column(1)):
                piece = batch.slice(*at)
                ids, sizes = encode(piece.column(1).cast(pa.large_string()), end)
                keys = piece.column(0)
                held.append((ids, sizes, pc.fill_null(keys, 0).to_numpy(zero_copy_only=False), pc.is_null(keys).to_numpy(zero_copy_only=False)))
                held_tokens += len(ids)
                if held_tokens >= BLOCK_TOKENS:
                    yield flush()
                    held, held_tokens, block = [], 0, block + 1
        if held:
            yield flush()

    ranges.mapInArrow(write, _BLOCK).write.option("compression", "zstd").mode("overwrite").parquet(to)


def _slices(texts: pa.Array, each: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """(offset, rows) of runs of about ``each`` bytes."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - size) // each
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(size) else np.zeros(0, int)
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(size)]):
        yield a, b - a


def read_block(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, Codes]:
    """(ids of documents, which of them are null, tokens per document, codes) of a row of the token table."""
    docs = np.frombuffer(row["doc_ids"], "<i8")
    nulls = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=len(docs)).astype(bool)
    return docs, nulls, np.frombuffer(row["sizes"], "<u4").astype(np.int64), Codes([(row[f"chunk{k}"], row[f"bitmap{k}"], row[f"ranks{k}"]) for k in range(len(WIDTHS))])


def read_tokens(spark: SparkSession, where: str) -> DataFrame:
    """-> ``doc_id, start, n_tokens, ids_crc32, part, block, at``: one row per document of the table at ``where``.

    ``start`` counts the ids of all documents before it, from the sizes of the blocks; ``at`` is its offset in its
    block. The running sum over blocks has one row per ``BLOCK_TOKENS`` ids.
    """
    table = spark.read.schema(_BLOCK).parquet(where)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                docs, nulls, sizes, codes = read_block(row)
                ids = codes.all().astype("<u4")
                edge = np.concatenate([[0], np.cumsum(sizes)])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(edge[:-1], edge[1:])]
                yield pd.DataFrame({"doc_id": pd.array(np.where(nulls, 0, docs), "Int64").copy(), "at": edge[:-1], "n_tokens": sizes, "ids_crc32": np.array(crc, np.int64),
                                    "part": np.int32(row["part"]), "block": np.int32(row["block"])}).assign(doc_id=lambda d: d["doc_id"].mask(nulls))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"part": frame["part"], "block": frame["block"], "n": [int(np.frombuffer(s, "<u4").sum(dtype=np.int64)) for s in frame["sizes"]]})

    before = Window.orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (table.select("part", "block", "sizes").mapInPandas(count, "part int, block int, n long")
              .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long")).drop("n"))
    docs = table.mapInPandas(read, "doc_id long, at long, n_tokens long, ids_crc32 long, part int, block int")
    return docs.join(starts, ["part", "block"]).withColumn("start", F.col("base") + F.col("at")).select("doc_id", "start", "n_tokens", "ids_crc32", "part", "block", "at")
