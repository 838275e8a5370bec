"""Every stage of the pipeline on edge rows, clashing columns and empty tables."""

import pytest
from brute import components, decontaminated, encoded, fingerprint, order
from conftest import CLASHING, SF, edge_rows, rows
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tenor.llm import decontam, langid, mixing, queries

CLASH = [*CLASHING, "lang_pred", "n_words_", "fingerprint", "target", "taken", "source_size", "__copies", "start", "c0", "body_", "Score_", "firsts", "ends", "below", "base"]


@pytest.fixture(scope="module")
def clashing(edge):
    return edge.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])


@pytest.mark.parametrize("name,step", cp.STAGES[:-1])
def test_stage_keeps_columns_and_rows(spark, edge, clashing, nothing, name, step):
    """Extra columns change no decision and come through; an empty table gives an empty one."""
    plain = rows(step(spark, edge, SF), "doc_id", "text", "lang", "source", "n_chars")
    wide = step(spark, clashing, SF)
    assert wide.columns == clashing.columns
    assert rows(wide, "doc_id", "text", "lang", "source", "n_chars") == plain
    assert {tuple(r) for r in wide.select(*CLASH).distinct().collect()} <= {tuple(range(len(CLASH)))}
    given = [r[:2] for r in edge_rows()]
    assert all((r[0], r[1]) in given for r in plain)
    empty = step(spark, nothing, SF)
    assert empty.columns == nothing.columns and empty.collect() == []


def test_near_duplicates_of_edge_rows(spark, edge):
    given = [r[:2] for r in edge_rows()]
    least = {}
    for (d, _), c in zip(given, components([fingerprint(t) for _, t in given])):
        least[c] = min(least.get(c, (True, 0)), order(d))
    kept = sorted(r[0] for r in rows(cp.near_duplicates(spark, edge, SF), "doc_id") if r[0] is not None)
    assert kept == sorted(d for null, d in least.values() if not null)


def test_decontamination_of_edge_rows(spark, edge):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    given = [r[:2] for r in edge_rows()]
    verdicts = decontaminated(given, items)
    assert len(rows(cp.decontamination(spark, edge, SF))) == sum(not v[-1] for v in verdicts)


def test_language_and_mixture_of_edge_rows(spark, edge):
    kept = rows(cp.language(spark, edge, SF), "doc_id", "text")
    assert not [t for _, t in kept if t is None or not any(c.isalpha() for c in t)] and len(kept) > 3
    copies = {(r["id"], r["size"]): r["copies"] for r in mixing.mix(edge).collect()}
    mixed = rows(cp.mixture(spark, edge, SF), "doc_id", "text")
    want = sorted((r[:2] for r in edge_rows() for _ in range(copies[r[0], len((r[1] or "").split())])), key=repr)
    assert [m[0] for m in mixed] == [w[0] for w in want]


def test_tokens_of_edge_rows(spark, edge, clashing, nothing):
    want, _ = encoded([r[:2] for r in edge_rows()], queries.tokenizer_path(queries.WORD_BPE))
    for docs in (edge, clashing):
        got = rows(cp.token_files(spark, docs, SF))
        assert sorted(r[2:] for r in got) == sorted(r[2:] for r in want) and sum(r[2] for r in got) == sum(r[2] for r in want)
    assert cp.token_files(spark, nothing, SF).collect() == []


def test_names_of_new_columns(spark, clashing):
    items = spark.createDataFrame([(1, "w1x1")], "item_id long, text string")
    found = decontam.scan(clashing, items, carry=tuple(clashing.columns))
    assert found.columns == [*clashing.columns, "n_words__", "spans_", "items_"]
    model = queries.language_model(spark.read.parquet(f"{SF}/documents.parquet"))
    assert langid.identify(clashing, model, queries.tokenizer_path(queries.PIECES), carry=tuple(clashing.columns)).columns[-2:] == ["lang_pred_", "score__"]
