import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"
DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                          T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Columns whose names clash with what the operators use inside.
CLASHING = ["id", "body", "fp", "key", "size", "score", "n_words", "spans", "items", "row", "words", "doc", "tag", "bucket", "lines", "removed_lines", "component_id", "copies"]


def passage(k: int, n: int = 60) -> str:
    """``n`` words that no other ``k`` has."""
    return " ".join(f"w{k}x{(i * 7919 + k * 104729) % 99991}" for i in range(n))


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, repeated rows and ids, ties, a long text, shared passages."""
    p, q = passage(1), passage(2)
    lines = "\n".join(passage(k, 8) for k in range(20, 26))
    long = " ".join(passage(100 + k, 50) for k in range(400))
    rows = [
        (0, f"Alpha start. {p} end", "en", "a", 1), (1, f"beta {p} gamma {q}", "en", "a", 2), (2, f"{q} tail", "fr", "b", None),
        (3, f"Alpha start. {p} end", "en", "a", 1), (3, f"Alpha start. {p} end", "en", "a", 1), (4, None, None, None, None), (5, "", "de", "b", 0),
        (6, " \n\t ", None, "c", 3), (7, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 3, "en", "c", 9), (8, "a" * 130, "en", "c", 9),
        (9, long, "en", "a", 4), (10, f"é{long[:3000]} ünïcödé 漢字 {q[:200]}", "de", "b", 5), (11, "12345 678 !!!", "en", None, 6),
        (12, lines + "\nown line of this text", "en", "a", 7), (13, "first line here\n" + lines + "\n\nlast", "en", "a", 8), (14, lines + "\n" + lines, "fr", "b", 9),
        (15, "Released under the MIT License.", "en", "a", 1), (16, "cc by nc cc BY-NC x Apache License, Version 2 cc", "en", "b", 1), (-5, q, "en", "a", 2), (None, q, None, None, None), (None, None, None, None, None),
        (17, "same same same", "en", "z\U0001F600", 2), (18, "same same same", "en", "z￿", 2), (1, f"another text under a known id {q}", "en", "a", 2),
    ]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), DOCUMENTS)


@pytest.fixture(scope="session")
def wide(edge):
    """The same rows with columns of clashing names."""
    from pyspark.sql import functions as F

    return edge.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df, *cols) -> list[tuple]:
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)
