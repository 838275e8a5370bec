"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get a probability in each language,
from their counts over all labelled training texts. A word's probability in a
language is the sum over all its segmentations into pieces of the product of
their probabilities, computed left to right by the forward algorithm, for many
words and all languages at once. A text's score is the sum over its words.

The model has one number per piece and language; it is all that is collected
or broadcast. Texts never leave their task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenor.llm.common import free_name

UNKNOWN = "und"
#: Characters a word is read in at once; the sums of a longer one are carried from part to part.
WORD_PART = 24
#: Words whose scores a worker remembers.
CACHE = 300_000
#: Added to each count, so that every piece is possible in every language.
SMOOTH = 0.1
#: Probability of a character that is no piece, relative to the rarest piece.
ODD_CHARACTER = 0.1


def letter_words(texts: pa.Array) -> pa.ListArray:
    """Runs of letters (and their marks), in lower case, one list per text; '' where there is none."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    return pc.split_pattern(pc.utf8_trim_whitespace(pc.replace_substring_regex(low, r"[^\p{L}\p{M}]+", " ")), " ")


_VOCABULARIES: dict[str, tuple] = {}


def vocabulary(path: str):
    """(the processor, piece -> id, all beginnings of pieces) of a sentencepiece file, read once per worker."""
    if path not in _VOCABULARIES:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        _VOCABULARIES[path] = sp, ids, {p[:k] for p in ids for k in range(1, len(p) + 1)}
    return _VOCABULARIES[path]


class Scorer:
    """Log probabilities of words in every language."""

    def __init__(self, path: str, table: np.ndarray, most: int = CACHE):
        """``table``: probabilities, one row per piece and a last one for an odd character; a column per language.
        ``most``: words to remember."""
        self.most = most
        sp, self.ids, self.beginnings = vocabulary(path)
        # Products of the rarest pieces leave the range of doubles once the counts are large enough. So each character
        # counts for the inverse square root of the least probability, which is taken out again at the end.
        self.per_character = -0.5 * np.log(table[-1]) if len(table) else np.zeros(0)
        lengths = np.array([len(sp.id_to_piece(i)) for i in range(len(sp))] + [1])
        self.longest = max(map(len, self.ids))
        self.table = table * np.exp(np.minimum(lengths, self.longest)[:, None] * self.per_character)
        self.known: dict[str, int] = {}
        self.logs, self.uses = np.zeros((0, table.shape[1])), np.zeros(0, np.int32)

    def forward(self, words: list[str]) -> np.ndarray:
        """Forward algorithm over words with their start mark: alpha[j] = sum over pieces s[i:j] of alpha[i] * p(piece).
        Of each part of a word, the sums that its pieces bring beyond its end are the beginning of the next part's."""
        marked = ["▁" + word for word in words]
        lengths = np.array([len(s) for s in marked])
        out = -lengths[:, None] * self.per_character
        live, begin = np.arange(len(marked)), np.ones((len(marked), 1, self.table.shape[1]))
        for a in range(0, int(lengths.max(initial=0)), WORD_PART):
            # A piece starts in this part and is at most ``longest`` characters long.
            left = lengths[live] - a
            alpha = self._part([marked[w][a:a + WORD_PART + self.longest - 1] for w in live.tolist()], begin)
            ends = left <= WORD_PART
            out[live[ends]] += np.log(alpha[ends, left[ends]])
            live, begin = live[~ends], alpha[~ends, WORD_PART:]
            if len(live):
                most = begin.max(axis=1, keepdims=True)
                begin = begin / most
                out[live] += np.log(most[:, 0])
        return out

    def _part(self, parts: list[str], begin: np.ndarray) -> np.ndarray:
        """The sums at every place, from those of ``begin`` and the pieces that start in the first ``WORD_PART``."""
        ids, beginnings, odd = self.ids, self.beginnings, len(self.table) - 1
        longest = max(map(len, parts))
        # An edge as one number: word, start (below 2^6) and piece (below 2^24), by end.
        ends: list[list[int]] = [[] for _ in range(longest + 1)]
        get = ids.get
        for w, s in enumerate(parts):
            n = len(s)
            for i in range(min(n, WORD_PART)):
                at = w << 30 | i << 24
                for j in range(i + 1, n + 1):
                    piece = s[i:j]
                    k = get(piece)
                    if k is not None:
                        ends[j].append(at | k)
                    elif j == i + 1:
                        ends[j].append(at | odd)
                        if piece not in beginnings:
                            break
                    elif piece not in beginnings:
                        break
        alpha = np.zeros((len(parts), max(longest + 1, begin.shape[1]), self.table.shape[1]))
        alpha[:, :begin.shape[1]] = begin
        for j in range(1, longest + 1):
            if ends[j]:
                edge = np.array(ends[j], np.int64)
                w = edge >> 30
                new = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))  # words come in order
                alpha[w[new], j] += np.add.reduceat(alpha[w, edge >> 24 & 63] * self.table[edge & 0xFFFFFF], new, axis=0)
        return alpha

    def words(self, words: list[str]) -> np.ndarray:
        """One row per word; those that were used only once are forgotten when there are too many."""
        if len(self.known) > self.most:
            names = list(self.known)
            stay = np.flatnonzero(self.uses > 1)
            self.known = {names[i]: k for k, i in enumerate(stay.tolist())}
            self.logs, self.uses = self.logs[stay], np.zeros(len(stay), np.int32)
        todo = [w for w in words if w not in self.known]
        todo.sort(key=len)
        found = [self.logs]
        for a in range(0, len(todo), 4096):
            some = todo[a:a + 4096]
            found.append(self.forward(some))
        self.known.update(zip(todo, range(len(self.known), len(self.known) + len(todo))))
        self.logs, self.uses = np.concatenate(found), np.concatenate([self.uses, np.zeros(len(todo), np.int32)])
        which = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        self.uses[which] += 1
        return self.logs[which]

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Per text and language, the sum over its words."""
        lists = letter_words(texts)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        logs = self.words(words)
        logs[[i for i, w in enumerate(words) if not w]] = 0
        per = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        which = coded.indices.to_numpy(zero_copy_only=False)
        return np.add.reduceat(logs[which], np.cumsum(per) - per, axis=0) if len(per) else np.zeros((0, self.table.shape[1]))


def train(labelled: DataFrame, text_col: str, lang_col: str, vocabulary_path: str) -> tuple[list[str], np.ndarray]:
    """(languages in code-point order, table of probabilities) from all rows with text and language.

    The counts are those of the vocabulary's own segmentation of each word, summed in the tasks and then by Spark:
    one row per language and piece comes back.
    """
    rows = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("body"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, ids, _ = vocabulary(vocabulary_path)
        n = len(sp)
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            lists = letter_words(batch.column(1))
            words = lists.flatten().dictionary_encode()
            per = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), per)
            pairs, times = np.unique(lang * len(words.dictionary) + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
            pieces = sp.encode(words.dictionary.to_pylist(), num_threads=1) if len(words.dictionary) else []
            size = np.array([len(p) for p in pieces], np.int64)
            flat = np.array([i for p in pieces for i in p], np.int64)
            begin = np.cumsum(size) - size
            w, l = pairs % max(1, len(pieces)), pairs // max(1, len(pieces))
            k = size[w] if len(pieces) else np.zeros(0, np.int64)
            at = np.repeat((begin[w] if len(pieces) else k) - (np.cumsum(k) - k), k) + np.arange(k.sum())
            sums = np.bincount(np.repeat(l, k) * n + flat[at], np.repeat(times, k), minlength=1)
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(some // n)), pa.array(some % n, pa.int32()), pa.array(sums[some].astype(np.int64))], names=["lang", "piece", "n"])

    sums = rows.mapInArrow(count, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    got = sums.collect()
    langs = sorted({r["lang"] for r in got})
    sp, ids, _ = vocabulary(vocabulary_path)
    table = np.full((len(sp), len(langs)), SMOOTH)
    for r in got:
        table[r["piece"], langs.index(r["lang"])] += r["n"]
    table[[i for i in range(len(sp)) if sp.id_to_piece(i) not in ids]] = 0
    table /= np.maximum(table.sum(axis=0), 1)
    least = np.where(table > 0, table, 1).min(axis=0) if langs else np.zeros(0)
    return langs, np.vstack([table, least * ODD_CHARACTER])


def identify(documents: DataFrame, model: tuple[list[str], np.ndarray], vocabulary_path: str, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), remember: int = CACHE) -> DataFrame:
    """-> the columns of ``carry`` plus ``lang_pred string, score double``: the most probable language (of equals the
    first by name) and its posterior with equal priors.

    A null text, one without any letter, and any text of a model without languages get ``und`` and 0. Rows are judged
    one by one, so repeated rows get equal results; an empty table gives no rows. ``remember``: words whose scores a
    worker keeps. The two new columns come last, with underscores behind their names if ``carry`` has those.
    """
    langs, table = model
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(table)
    at = len(carry)
    schema = documents.select(*carry).schema
    held = [f"`c{i}` {f.dataType.simpleString()}" for i, f in enumerate(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(vocabulary_path, sent.value, remember) if langs else None
        for batch in batches:
            texts = batch.column(at)
            lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if scorer is None or not len(texts):
                best, post = np.full(len(texts), -1), np.zeros(len(texts))
            else:
                logs = scorer.texts(texts)
                best = logs.argmax(axis=1)
                post = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                best[~lettered], post[~lettered] = -1, 0
            names = pa.array([langs[i] if i >= 0 else UNKNOWN for i in best.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], names, pa.array(post, pa.float64())], names=[*[f"c{i}" for i in range(at)], "lang_pred", "score"])

    own = documents.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(text_col).alias("body"))
    done = own.mapInArrow(run, ", ".join([*held, "lang_pred string", "score double"]))
    own = documents.select(*carry)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], *[F.col(c).alias(free_name(own, c)) for c in ("lang_pred", "score")])


def keep_known(documents: DataFrame, model: tuple[list[str], np.ndarray], vocabulary_path: str, least: float = 0.5, **options) -> DataFrame:
    """The documents whose language the model knows with a posterior of at least ``least``, with their columns."""
    found = identify(documents, model, vocabulary_path, carry=tuple(documents.columns), **options)
    pred, score = found.columns[-2:]
    return found.filter((F.col(pred) != UNKNOWN) & (F.col(score) >= least)).select(*documents.columns)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))
