"""A corpus from documents: language, near duplicates, benchmark items, mix of sources, token files.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; ``run`` writes it as Parquet to the shared folder
and rereads it as the next one's documents. All but the last return the columns of documents, whatever further
columns those have and however they are named.

Every stage takes null ids, texts, languages and sources, empty and very long texts, repeated rows and empty tables:
what each makes of them stands with the stage. A stage's table is removed when the next one's is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tenor.llm import decontam, langid, mixing, simhash, tokens
from tenor.llm.common import drop_stage, shared_dir, stage
from tenor.llm.queries import END_ID, PIECES, WORD_BPE, language_model, prepare, table, tokenizer_path

#: Words and chunks that a worker remembers: the stages share their executors' memory.
WORDS, CHUNKS = 150_000, 300_000
#: A language is rejected where its posterior is below this, as are texts without letters.
LEAST_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows and is sure of.

    Null, empty and letterless texts go, and all documents if no language is given in any; rows are judged one by one,
    so repeated rows stay or go together, and of languages that tie the score is too low to stay."""
    prepare(spark)
    return langid.keep_known(docs, language_model(docs), tokenizer_path(PIECES), LEAST_LANGUAGE_SCORE, remember=WORDS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Texts without words, null ones too, are one group. A null id is larger than any; of rows that share the smallest
    id one stays."""
    return simhash.keep_one(docs, shingle=4, distance=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated; they stay as they are.

    Null and empty texts have no words and stay; repeated rows stay or go together; without items all stay."""
    return decontam.clean(docs, table(prepare(spark), sf_dir, "benchmark"), window=13)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    A null text has size 0, a null source is a source of its own; documents without words cost a source nothing.
    Rows that share id and size are taken or left together."""
    prepare(spark)
    return mixing.repeat_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns, from them, a row per document.

    A null text is encoded as an empty one, as its end id alone; rows that repeat are encoded each; a null id stands
    after all others."""
    where = f"{shared_dir(prepare(spark))}/tenor-llm/tokens-{uuid.uuid4().hex}"
    tokens.write_tokens(docs, where, lambda: tokenizer_path(WORD_BPE), END_ID, remember=CHUNKS)
    return tokens.read_tokens(spark, where).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language_id", language),
    ("simhash_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", mixture),
    ("token_output", token_files),
]

#: The stages hold a learnt model, XXH64 and a tokenizer: tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_stage(before)
        before = docs
    done = STAGES[-1][1](spark, docs, sf_dir)   # reads the token files, which are written by now
    drop_stage(before)
    return done
