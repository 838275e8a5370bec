import numpy as np
import pytest
from brute import repeats as plain
from conftest import edge_rows, rows

from tenor.llm import repeats

COLS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_edge_rows_against_all_windows(spark, edge, wide):
    want = plain([(r[0], r[1]) for r in edge_rows()])
    assert rows(repeats.remove_repeats(edge), *COLS) == want
    assert rows(repeats.remove_repeats(wide), *COLS) == want


def test_documents_against_all_windows(documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = rows(repeats.remove_repeats(documents), *COLS)
    assert got == plain(docs)
    assert sum(r[2] for r in got) > 0


def test_hot_anchors_and_slices(monkeypatch, edge):
    """Anchors dealt window by window, short runs and small slices give the same."""
    monkeypatch.setattr(repeats, "HOT", 1)
    monkeypatch.setattr(repeats, "SLICE", 1000)
    monkeypatch.setattr(repeats, "RUN", 7)
    monkeypatch.setattr(repeats, "TEXT_PER_BUCKET", 20_000)
    assert rows(repeats.remove_repeats(edge), *COLS) == plain([(r[0], r[1]) for r in edge_rows()])


def test_spans_and_kept_text(edge):
    for r in repeats.remove_repeats(edge.filter("doc_id in (0, 1, 3)"), texts=True).collect():
        assert len(r["firsts"]) == len(r["ends"]) == r["n_spans"]
        assert sum(b - a for a, b in zip(r["firsts"], r["ends"])) == r["n_removed"] == r["n_bytes"] - len(r["kept"])


def test_empty_table(nothing):
    assert repeats.remove_repeats(nothing).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_longest_previous_factor(seed):
    """Against the definition: the longest common prefix with any suffix of a smaller document."""
    rng = np.random.default_rng(seed)
    length, text = 6, bytes(rng.integers(97, 99, 80).tolist())
    at = np.arange(len(text) - length + 1)
    doc = rng.integers(0, 5, len(at))
    got = repeats.covered_windows(np.frombuffer(text, np.uint8), at, doc, length)
    want = [any(text[i:i + length] == text[j:j + length] and doc[j] < doc[i] for j in at) for i in at]
    assert got.tolist() == want
