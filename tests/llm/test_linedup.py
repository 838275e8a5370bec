from brute import order, xx_signed
from brute import repeated_lines as plain
from conftest import edge_rows, passage, rows

from tenor.llm import linedup


def test_edge_rows(edge, wide):
    want = plain([(r[0], r[1]) for r in edge_rows()])
    assert rows(linedup.drop_repeated_lines(edge), "doc_id", "text") == want
    assert rows(linedup.drop_repeated_lines(wide), "doc_id", "text") == want
    assert any(r[1] == "first line here\n\nlast" for r in want)


def test_columns_stay(wide):
    out = linedup.drop_repeated_lines(wide)
    assert out.columns == [*wide.columns, "removed_lines_", "n_lines"]
    assert {r["removed_lines"] for r in out.collect()} == {15}


def test_documents(documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = rows(linedup.drop_repeated_lines(documents), "doc_id", "text")
    assert got == plain(docs) and got != sorted(docs, key=repr)


def test_empty_table(nothing):
    assert linedup.drop_repeated_lines(nothing).collect() == []


def plain_short(docs, words, t=3):
    """Like brute.repeated_lines, with runs of fewer lines of ``words`` words and whole documents of fewer lines."""
    keys = sorted({(order(d), xx_signed(x), x) for d, x in docs if x is not None}, key=lambda k: k[:2])
    first, at = {}, {}
    for o, _, x in keys:
        own = [(i, s.strip(" ")) for i, s in enumerate(x.split("\n")) if s.strip(" ")]
        for n in range(1, t + 1):
            for s in range(len(own) - n + 1):
                run = tuple(own[s + j][1] for j in range(n))
                if n < t and len(own) > n and sum(len(r.split()) for r in run) < words:
                    continue
                if run not in first:
                    first[run] = (o, x, s)
                elif first[run][:2] != (o, x) or s >= first[run][2] + n:
                    at.setdefault((o, x), set()).update(own[s + j][0] for j in range(n))
    return sorted(((d, None if x is None else "\n".join(s for i, s in enumerate(x.split("\n")) if i not in at.get((order(d), x), ()))) for d, x in docs), key=repr)


def test_short_runs(spark, documents):
    """Passages on one or two lines and copies of texts of one or two lines."""
    p, two = passage(1, 60), f"{passage(2, 30)}\n{passage(3, 30)}"
    docs = [(1, f"own a\n{p}\nown b\nown c"), (2, f"x\n  {p}\ny"), (3, f"u\n{two}\nv"), (4, f"k\n\n{two}\nl"), (5, "few words"), (6, "few words"), (7, "few words\nand\nmore"), (8, "\n "),
            (9, f"{p}\n{p}"), (10, two), (11, "one\ntwo"), (12, "one\n\ntwo"), (None, "few words"), (13, None), (13, None)]
    got = {d: x for d, x in rows(linedup.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), short_run_words=50), "doc_id", "text")}
    assert rows(linedup.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), short_run_words=50), "doc_id", "text") == plain_short(docs, 50)
    assert [got[d] for d in (2, 4, 6, 7, 9, 10, 12)] == ["x\ny", "k\n\nl", "", "few words\nand\nmore", "", "", ""]
    real = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert rows(linedup.drop_repeated_lines(documents, short_run_words=50), "doc_id", "text") == plain_short(real, 50) != plain(real)


def test_query_takes_short_runs(spark, documents):
    """The registered query leaves no later copy of a whole text and none of a line of 50 words."""
    import hashlib

    from conftest import SF

    from tenor.llm import queries

    real = [(r["doc_id"], r["text"]) for r in documents.collect()]
    kept = plain_short(real, 50)
    got = {r["doc_id"]: r["kept_sha256"] for r in queries.op2_line_dedup(spark, SF).collect()}
    assert got == {d: hashlib.sha256((x or "").encode()).hexdigest() for d, x in kept}
    long = [s.strip(" ") for _, x in kept for s in (x or "").split("\n") if len(s.split()) >= 50]
    assert len(long) == len(set(long)) and long
    whole = [x for _, x in kept if x and x.strip()]
    assert len(whole) == len(set(whole))


def test_later_place_of_a_gram(spark):
    """A run is met by its copy, though its first two lines stand earlier in another context."""
    docs = [(1, "a\nb\nx"), (2, "a\nb\nc"), (3, "0\na\nb\nc"), (4, "a\nb\ny")]
    got = rows(linedup.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "text")
    assert got == plain(docs) and (3, "0") in got
