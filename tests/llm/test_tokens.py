import numpy as np
import pyarrow as pa
import pytest
from brute import encoded
from conftest import edge_rows, rows

from tenor.llm import tokens
from tenor.llm.queries import WORD_BPE, tokenizer_path

PATH = tokenizer_path(WORD_BPE)
HARD = ["", " ", "Word., word.,x a.b,c 12,3. it's IT'S we'll.", "H̱ J̌ Á ́x ẞİΣ Σ.", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", "a b c\td\r\ne\x0bf\n\n\ng",
        "漢字kana ǅ ﬁ", "x" * 5000, "...,,, ,.a.,", "\x00\x01 \x7f", "é. É, é."]


def test_chunks_give_the_tokenizer_s_ids():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    ids, per = tokens.Encoder(PATH)(pa.array(HARD + [None]), None)
    want = [tok.encode(t, add_special_tokens=False).ids for t in HARD] + [[]]
    assert per.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_full_cache(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 3)
    e = tokens.Encoder(PATH)
    a = e(pa.array(HARD), 1)
    b = e(pa.array(HARD), 1)
    assert a[0].tolist() == b[0].tolist()


@pytest.mark.parametrize("top", [2, 300, 49408, 1 << 31])
def test_codes_round_trip_and_random_access(top):
    ids = np.random.default_rng(top).integers(0, top, 5000).astype(np.uint32)
    ids[:10] = [0, 1, 255, 256, 65535, 65536, 0, 2, 3, 4] if top > 65536 else ids[:10]
    codes = tokens.Codes(tokens.pack(ids))
    assert codes.all().tolist() == ids.tolist()
    for i in [0, 1, 7, 8, 511, 512, 513, 1023, 1024, 4999, *range(100, 140)]:
        assert codes[i] == ids[i]
    assert len(tokens.Codes(tokens.pack(ids[:0]))) == 0


def written(spark, df, tmp_path, **kw):
    tokens.write_tokens(df, str(tmp_path / "t"), PATH, **kw)
    return tokens.read_tokens(spark, str(tmp_path / "t"))


def test_documents(spark, documents, tmp_path):
    want, every = encoded([(r["doc_id"], r["text"]) for r in documents.collect()], PATH)
    got = written(spark, documents, tmp_path)
    assert rows(got, "doc_id", "start", "n_tokens", "ids_crc32") == want
    # Any token of the corpus by its block and offset, without decoding the rest.
    blocks = {(r["part"], r["block"]): tokens.read_block(r)[3] for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    for r in got.collect()[::37]:
        assert blocks[r["part"], r["block"]][r["at"]] == every[r["start"]]


def test_small_blocks_and_edge_rows(spark, edge, wide, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_TOKENS", 100)
    docs = [(r[0], r[1]) for r in edge_rows()]
    # Rows that repeat an id stand in any order: their sizes and sums are compared, starts as a whole.
    want, _ = encoded(docs, PATH)
    for k, df in enumerate((edge, wide)):
        got = written(spark, df, tmp_path / str(k))
        assert sorted((r[0] is None, r[0] or 0, r[2], r[3]) for r in rows(got, "doc_id", "start", "n_tokens", "ids_crc32")) == sorted((r[0] is None, r[0] or 0, r[2], r[3]) for r in want)
        spans = sorted((r["start"], r["n_tokens"]) for r in got.collect())
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0


def test_empty_table(spark, nothing, tmp_path):
    assert written(spark, nothing, tmp_path).collect() == []
