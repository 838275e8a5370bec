import hashlib
import math

import numpy as np
import pytest
from conftest import SF, rows

from tenor.llm import queries, veccodes


def plain(table, parts=16, entries=64, rounds=2, scale=256):
    """[(vec_id, code, error, label_error, digest)] of [(vec_id, vector, label)], straight from the definition."""
    kept = [(i, [math.floor(scale * x) for x in v], g) for i, v, g in table if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * length:(p + 1) * length]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, p: min(range(len(books[p])), key=lambda k: (far(x, books[p][k]), k))
    for _ in range(rounds):
        codes = [[nearest(cut(v, p), p) for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), c in zip(kept, codes) if c[p] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    out, by_label = [], {}
    for i, v, g in kept:
        code = [nearest(cut(v, p), p) for p in range(parts)]
        error = sum(far(cut(v, p), books[p][c]) for p, c in enumerate(code))
        by_label[g] = by_label.get(g, 0) + error
        out.append((i, bytes(code).hex(), error, g))
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted(((i, c, e, by_label[g], digest) for i, c, e, g in out), key=repr)


def coded(df, **kw):
    done, book, scanned = veccodes.compress(df, carry=("label",), **kw)
    found = [(r["id"], bytes(r["code"]).hex(), r["error"], r["label_error"], veccodes.codebooks_digest(book)) for r in veccodes.with_group_error(done, "label", "label_error").collect()]
    return sorted(found, key=repr), scanned


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_vectors_of_the_tables(spark, tmp):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = plain([tuple(r) for r in table.select("vec_id", "embedding", "label").collect()])
    assert rows(queries.op11_vector_codes(spark, SF)) == want
    got, scanned = coded(table.repartition(7))
    assert got == want
    assert scanned[0] == 16 * len(want) and scanned[1] < scanned[0] and scanned[2] < scanned[0]


def test_edge_rows(spark):
    rng = np.random.default_rng(3)
    v = [[float(x) for x in rng.normal(0, 0.2, 8)] for _ in range(60)]
    table = [(i % 50, v[i], i % 3) for i in range(60)] + [(60, None, 1), (61, [0.1] * 7 + [None], 1), (62, [0.1] * 7 + [math.nan], 1), (63, [math.inf] * 8, 1), (None, v[3], None), (None, v[4], 2),
             (64, v[5], None), (-3, v[6], None), (-3, v[6], None)] + [(100 + i, [0.25] * 8, 9) for i in range(40)]
    df = spark.createDataFrame(table, SCHEMA)
    kw = {"parts": 4, "entries": 6, "rounds": 3}
    want = plain(table, **kw)
    assert coded(df, **kw)[0] == want
    from pyspark.sql import functions as F

    wide = df.select("*", *[F.lit(1).alias(c) for c in ("id", "v", "code", "error", "part", "upper", "n")])
    assert coded(wide, **kw)[0] == want
    done, _, _ = veccodes.compress(wide, **kw, carry=("code", "id", "label"))
    assert done.columns == ["id", "code", "error", "code_", "id_", "label"] and {r["code_"] for r in done.collect()} == {1}
    # other lengths take no part; fewer rows than entries; empty vectors; nothing at all
    assert coded(df.union(spark.createDataFrame([(500, [0.5] * 12, 1), (501, [0.5] * 9, 1)], SCHEMA)), **kw)[0] == want
    few = [(2, v[0], 1), (1, v[1], None)]
    assert coded(spark.createDataFrame(few, SCHEMA), **kw)[0] == plain(few, **kw)
    assert coded(spark.createDataFrame([(1, [], 1), (2, [], 1)], SCHEMA))[0] == plain([(1, [], 1), (2, [], 1)])
    for none in ([], [(1, None, 1)]):
        got, book, _ = veccodes.compress(spark.createDataFrame(none, SCHEMA), carry=("label",))
        assert got.collect() == [] and got.columns == ["id", "code", "error", "label"] and book.size == 0
    with pytest.raises(Exception, match="too large"):
        coded(spark.createDataFrame([(1, [3e30] * 8, 1)], SCHEMA), **kw)


@pytest.mark.parametrize("seed", range(12))
def test_bounds_against_full_scans(seed):
    """Many rounds over entries that move, also with ties: the bounds never change an assignment."""
    rng = np.random.default_rng(seed)
    parts, entries, length, n = 3, int(rng.integers(1, 9)), int(rng.integers(1, 5)), 300
    size = int(rng.choice([2, 6, 200, 50000, 2 ** 27]))
    x = rng.integers(-size, size + 1, (n, parts * length))
    history = [x[:entries].reshape(entries, parts, length).transpose(1, 0, 2).copy()]
    bounds, scanned = None, []
    for r in range(9):
        bounds, error, k = veccodes.assign(x, bounds, history)
        scanned.append(k)
        total = np.zeros(n, np.int64)
        book = history[-1].copy()
        for p in range(parts):
            xp = x[:, p * length:(p + 1) * length]
            d = ((xp[:, None, :] - history[-1][p][None]) ** 2).sum(2)
            assert (bounds.code[:, p] == d.argmin(1)).all()
            total += d.min(1)
            for e in range(entries):
                if (bounds.code[:, p] == e).any():
                    book[p, e] = xp[bounds.code[:, p] == e].sum(0) // (bounds.code[:, p] == e).sum()
        assert (error == total).all()
        history.append(book)
    assert entries == 1 or scanned[-1] < scanned[0]


def test_net_displacement_is_used():
    """An entry that moves away and back has no net displacement: nothing is rescanned, whatever the sum of its moves."""
    x = np.array([[0], [100]])
    there, away = np.array([[[0], [100]]]), np.array([[[49], [100]]])
    b, _, first = veccodes.assign(x, None, [there])
    b, _, _ = veccodes.assign(x, b, [there, away])
    b.upper_at[:], b.lower_at[:] = 0, 0
    b.upper[:], b.lower[:] = 1e-3, 99.9
    _, _, scanned = veccodes.assign(x, b, [there, away, there])
    assert first == 2 and scanned == 0
