import numpy as np
import pytest
from brute import components, fingerprint, order
from brute import simhash as plain
from conftest import edge_rows, rows

from tenor.llm import simhash


def got(df):
    return rows(simhash.near_duplicates(df).select("doc_id", simhash.hex_digits(), "component_id"))


def test_edge_rows(edge, wide):
    want = plain([(r[0], r[1]) for r in edge_rows()])
    assert got(edge) == want
    assert got(wide) == want


def test_documents(documents):
    want = plain([(r["doc_id"], r["text"]) for r in documents.collect()])
    assert got(documents) == want
    assert any(d != c for d, _, c in want)


def test_empty_table(nothing):
    assert got(nothing) == []


def test_keep_one(edge, wide):
    docs = [(r[0], r[1]) for r in edge_rows()]
    kept = simhash.keep_one(wide)
    assert kept.columns == wide.columns
    least: dict = {}
    for (d, _), c in zip(docs, components([fingerprint(t) for _, t in docs])):
        least[c] = min(least.get(c, d), d, key=order)
    want = sorted(least.values(), key=order)
    assert sorted((r["doc_id"] for r in kept.collect()), key=order) == want


@pytest.mark.parametrize("seed,n,most", [(1, 400, None), (2, 800, None), (3, 600, 20)])
def test_links_of_crowded_fingerprints(spark, monkeypatch, seed, n, most):
    """Fingerprints in tight groups, with skewed bits and chains: the same components as all pairs give, also where
    the rows of a value are cut into slices."""
    if most:
        monkeypatch.setattr(simhash, "ROWS_PER_VALUE", most)
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 20, dtype=np.uint64) & rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fps = set()
    for _ in range(n):
        fp = int(rng.choice(centres))
        for b in rng.integers(0, 64, rng.integers(0, 9)):
            fp ^= 1 << int(b)
        fps.add(fp)
    fps = sorted(fps)
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    named = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame, 4)).collect()}
    comp = components(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    groups = {}
    for f, c in zip(signed, comp):
        groups.setdefault(c, set()).add(f)
    mine = {}
    for f in signed:
        mine.setdefault(named.get(f, f), set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))


def test_slices_meet_each_other():
    rng = np.random.default_rng(5)
    key, fp = np.repeat(np.array([7, 9], np.uint64), 50), rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    k, f, h = simhash.spread(key, fp, np.ones(100, bool), np.array([9], np.uint64), np.array([4]))
    assert (k[:50] == 7).all() and len(k) == 50 + 50 * 4 and h.all()
    together = {(a, b) for x in set(k.tolist()) for a in f[k == x].tolist() for b in f[k == x].tolist()}
    hot = fp[50:].tolist()
    assert {(a, b) for a in hot for b in hot} <= together
    assert max((k == x).sum() for x in set(k[50:].tolist())) < 50


def test_thresholds_add_up():
    for distance in (0, 1, 3, 4, 6):
        for m in range(1, distance + 2):
            p = np.full(64, 0.5)
            p[:20] = 0.02
            groups = simhash.group_bits(1000, np.diag(p * 1000), m)
            assert sorted(b for g in groups for b in g) == list(range(64))
            _, t = simhash.allocate(100_000, p, groups, distance, [1.0] * m)
            assert sum(t) == distance - m + 1 and min(t) >= -1


def test_chain_of_links(spark):
    frame = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 100), (300, 300)], "a long, b long")
    named = {r["node"]: r["root"] for r in simhash.components(frame).collect()}
    assert named == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}
