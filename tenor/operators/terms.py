"""Words of texts as numbers, on the bytes of Arrow batches.

The windows of a text overlap by half, so a word that is hashed window by window is hashed twice, and a row per window
carries its words as strings. Here the words of a whole batch are found on its UTF-8 bytes, every word (and every pair of
neighbours) is hashed once with Spark's own hash, and the windows are cut from those numbers. The spaces are those of
:data:`tenor.functions.text.SPACE`, the numbers those of ``pmod(hash(word), n)``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once, one text at least; words longer than LONG bytes are hashed one by one.
AT_ONCE, LONG, SEED = 1 << 18, 256, 42
#: Spaces beyond ASCII, of two and three bytes.
_SPACES = sorted(chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_CODES = {n: np.array([int.from_bytes(s, "big") for s in _SPACES if len(s) == n]) for n in (2, 3)}


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column of strings -> (their bytes one after the other, where they begin and the last ends); null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0]:at[-1]], at - at[0]


def _inside(data: np.ndarray) -> np.ndarray:
    """Per byte: is it part of a word?"""
    space = (data - np.uint8(0x09) < 5) | (data - np.uint8(0x1C) < 5)   # bytes below wrap round
    first = np.flatnonzero((data == 0xC2) | (data - np.uint8(0xE1) < 3))
    if len(first):   # 1 to 3 in a thousand bytes of most texts
        ahead = np.concatenate([data, np.zeros(2, np.uint8)])
        two = ahead[first].astype(np.int64) << 8 | ahead[first + 1]
        three = two << 8 | ahead[first + 2]
        for n, code in ((2, two), (3, three)):
            found = first[np.isin(code, _CODES[n])]
            for k in range(n):
                space[found + k] = True
    return ~space


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where the words begin, where they end, at which word each text begins, and the last ends)."""
    inside = _inside(data)
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    begin = at[:-1][at[:-1] < at[1:]]   # a word doesn't go on in the next text
    edge[begin] = inside[begin]
    starts = np.flatnonzero(edge)
    edge = inside.copy()
    edge[:-1] &= ~inside[1:]
    last = at[1:][at[:-1] < at[1:]] - 1
    edge[last] = inside[last]
    return starts, np.flatnonzero(edge) + 1, np.searchsorted(starts, at)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint32(by) | x >> np.uint32(32 - by)


def _mixed(block: np.ndarray) -> np.ndarray:
    return _turned(block * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)


def _added(h: np.ndarray, block: np.ndarray) -> np.ndarray:
    return _turned(h ^ _mixed(block), 13) * np.uint32(5) + np.uint32(0xE6546B64)


def _long(data: np.ndarray) -> int:
    """The running value of one long word: block after block."""
    whole, h = len(data) // 4 * 4, SEED
    blocks = np.concatenate([data[:whole].view("<u4"), data[whole:].view(np.int8).astype(np.int32).view(np.uint32)])
    for k in _mixed(blocks).tolist():
        h ^= k
        h = ((h << 13 | h >> 19) * 5 + 0xE6546B64) & 0xFFFFFFFF
    return h


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Spark's ``hash`` (Murmur3, 32 bits, seed 42) of pieces of ``data``: blocks of four bytes, then the rest byte by byte,
    each with its sign. The longest come first, so that every step works on the front of the arrays."""
    sizes = np.minimum(ends - starts, LONG + 1).astype(np.uint16)
    order = np.argsort(LONG + 1 - sizes, kind="stable")
    sizes, at, many = sizes[order], starts[order], len(sizes) - np.cumsum(np.bincount(sizes, minlength=LONG + 2))   # longer than that
    long = int(many[LONG])
    h = np.full(len(sizes), SEED, np.uint32)
    four = np.ndarray(len(data) + 1, "<u4", np.concatenate([data, np.zeros(4, np.uint8)]), 0, (1,)).copy()   # the block that begins at each byte
    for k in range(LONG // 4):
        if (m := int(many[4 * k + 3])) <= long:
            break
        h[long:m] = _added(h[long:m], four[at[long:m] + 4 * k])
    rest, place = sizes & 3, at + (sizes & ~np.uint16(3))
    own = np.flatnonzero(rest[long:]) + long
    for t in range(3):
        own = own if not t else own[rest[own] > t]
        h[own] = _added(h[own], data[place[own] + t].view(np.int8).astype(np.int32).view(np.uint32))
    for i in range(long):
        h[i] = _long(np.ascontiguousarray(data[starts[order[i]]:ends[order[i]]]))
    out = np.empty_like(h)
    out[order] = h
    out ^= (ends - starts).astype(np.uint32)
    out = (out ^ out >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    out = (out ^ out >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (out ^ out >> np.uint32(16)).view(np.int32)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with one space after each -> (bytes, where the words begin)."""
    sizes = ends - starts
    to = np.cumsum(sizes + 1) - (sizes + 1)
    out = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
    moved = np.arange(sizes.sum())
    out[moved + np.repeat(np.arange(len(sizes)), sizes)] = data[moved + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)]
    return out, to


def numbers(data: np.ndarray, at: np.ndarray, features: int, pairs: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """(the words' numbers, with ``pairs`` the number of each word with the next one, at which word each text begins and the
    last ends). What the last word of a text has with the next text's first is of no use."""
    starts, ends, first = words_of(data, at)
    below = lambda h: h & np.int32(features - 1) if features & (features - 1) == 0 else (h.astype(np.int64) % features).astype(np.int32)
    words = below(hashes(data, starts, ends))
    if not pairs:
        return words, None, first
    after = np.append(ends[1:], ends[-1:])
    if ((starts[1:] != ends[:-1] + 1) | (data[np.minimum(ends[:-1], len(data) - 1)] != 0x20))[np.isin(np.arange(1, len(starts)), first, invert=True)].any():
        data, starts, sizes = *_joined(data, starts, ends), ends - starts
        after = np.append((starts + sizes)[1:], (starts + sizes)[-1:])
    return words, below(hashes(data, starts, after)), first


def windows_of(first: np.ndarray, width: int, step: int, slide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """W8 by numbers of words: (windows per text, and per window: its text, its first word, how many words)."""
    sizes = np.diff(first)
    per = 1 + -(-np.maximum(sizes - width, 0) // step) if slide else np.ones(len(sizes), np.int64)
    text = np.repeat(np.arange(len(sizes)), per)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * step
    return per, text, first[:-1][text] + start, np.minimum(sizes[text] - start, width)


def cut(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges, one range after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def window_terms(column: pa.Array, width: int, step: int, slide: bool, features: int, pairs: bool):
    """Pieces of a column of texts: (texts from, to, windows per text, their texts, the windows' terms as lists). A window's
    terms are its words' numbers and, with ``pairs``, then those of its pairs of neighbours."""
    data, at = texts_of(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(at, at[a] + AT_ONCE, side="right")) - 1)
        words, both, first = numbers(data[at[a]:at[b]], at[a:b + 1] - at[a], features, pairs)
        per, text, start, size = windows_of(first, width, step, slide)
        if pairs:
            flat, size = np.concatenate([words, both]), np.column_stack([size, np.maximum(size - 1, 0)])
            flat, size = flat[cut(np.column_stack([start, len(words) + start]).ravel(), size.ravel())], size.sum(axis=1)
        else:
            flat = words[cut(start, size)]
        yield a, b, per, text, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat, pa.int32()))
        a = b
