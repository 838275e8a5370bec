"""Plain versions of the operators, straight from their definitions."""

import hashlib
import re
import zlib
from collections import defaultdict

import xxhash

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def order(doc_id):
    return (doc_id is None, doc_id or 0)


def repeats(docs, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of [(doc_id, text)]."""
    raw = [(d, (t or "").encode()) for d, t in docs]
    first = {}
    for d, b in raw:
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            if w not in first or order(d) < first[w]:
                first[w] = order(d)
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i:i + length]] < order(d):
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def repeated_lines(docs, t=3):
    """[(doc_id, text, kept)]; rows that repeat id and text are one document."""
    keys = sorted({(order(d), xx_signed(x), x) for d, x in docs if x is not None}, key=lambda k: k[:2])
    first, at = {}, {}
    for o, h, x in keys:
        own = [(i, s.strip(" ")) for i, s in enumerate(x.split("\n")) if s.strip(" ")]
        for s in range(len(own) - t + 1):
            run = tuple(own[s + j][1] for j in range(t))
            lines = [own[s + j][0] for j in range(t)]
            if run not in first:
                first[run] = (o, x, s)
            elif first[run][:2] != (o, x) or s >= first[run][2] + t:
                at.setdefault((o, x), set()).update(lines)
    return sorted(((d, None if x is None else "\n".join(s for i, s in enumerate(x.split("\n")) if i not in at.get((order(d), x), ()))) for d, x in docs), key=repr)


def xx_signed(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, distance=4):
    """Component of each index, by comparing all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def simhash(docs):
    fps = [fingerprint(t) for _, t in docs]
    comp = components(fps)
    least = {}
    for (d, _), c in zip(docs, comp):
        if c not in least or order(d) < order(least[c]):
            least[c] = d
    return sorted(((d, f"{f:016x}", least[c]) for (d, _), f, c in zip(docs, fps, comp)), key=repr)


def decontaminated(docs, items, n=13):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    windows = defaultdict(set)
    for name, text in items:
        ws = tuple(WORD.findall((text or "").translate(LOWER)))
        for s in range(max(1, len(ws) - n + 1) if ws else 0):
            windows[ws[s:s + n]].add("" if name is None else str(name))
    out = []
    sizes = {len(w) for w in windows}
    for d, text in docs:
        ws = tuple(WORD.findall((text or "").translate(LOWER)))
        hit, found = set(), set()
        for k in sizes:
            for s in range(len(ws) - k + 1):
                if ws[s:s + k] in windows:
                    hit.update(range(s, s + k))
                    found |= windows[ws[s:s + k]]
        out.append((d, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)))
    return sorted(out, key=repr)


def encoded(docs, path, end=1):
    """(doc_id, start, n_tokens, ids_crc32) and all ids, for ids that don't repeat."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    out, every = [], []
    for d, text in sorted(docs, key=lambda r: order(r[0])):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((d, len(every), len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        every += ids
    return sorted(out, key=repr), every


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
