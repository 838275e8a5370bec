"""The registered queries of the operators, with production parameters over whole tables, and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenor.llm import decontam, langid, licenses, linedup, mixing, repeats, sharding, simhash, tokens, topk, toxicity, turns, veccodes
from tenor.llm.common import shared_dir
from tenor.session import tune

#: Files of the public tokenizers; executors have them in the same package.
PIECES, WORD_BPE = "piece_bpe_32k.model", "word_bpe_49k.json"
END_ID = 1


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Whole texts and token blocks pass to Python: Arrow batches are bounded in rows and in bytes."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.remove_repeats(table(prepare(spark), sf_dir, "documents"), length=50)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Runs of one or two lines count as copies from so many words on.
SHORT_RUN_WORDS = 50


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linedup.drop_repeated_lines(table(prepare(spark), sf_dir, "documents").select("doc_id", "text"), short_run_words=SHORT_RUN_WORDS)
    return done.select("doc_id", "n_lines", F.size("removed_lines").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(prepare(spark), sf_dir, "documents")
    held_out = langid.fold("doc_id", 5) == 0
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(documents, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(prepare(spark), sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(prepare(spark), sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def language_model(documents: DataFrame) -> tuple:
    """Learnt from the text and language of the documents outside the held-out fold."""
    return langid.train(documents.filter(langid.fold("doc_id", 4) != 2), "text", "lang", tokenizer_path(PIECES))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(prepare(spark), sf_dir, "documents")
    found = langid.identify(documents, language_model(documents), tokenizer_path(PIECES))
    return found.select("doc_id", F.coalesce(langid.fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13)
    hits = decontam.n_hit()
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.sort_array("items"), ",").cast("binary"), 256).alias("items_sha256"), decontam.verdict(hits, F.col("n_words")).alias("contaminated"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(prepare(spark), sf_dir, "documents"), shingle=4, distance=4)
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = f"{shared_dir(prepare(spark))}/tenor-llm/tokens-{uuid.uuid4().hex}"
    tokens.write_tokens(table(spark, sf_dir, "documents"), where, lambda: tokenizer_path(WORD_BPE), END_ID)
    return tokens.read_tokens(spark, where).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(prepare(spark), sf_dir, "documents")).drop("blocks")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, book, _ = veccodes.compress(table(prepare(spark), sf_dir, "embeddings"), parts=16, entries=64, rounds=2, carry=("label",))
    done = veccodes.with_group_error(coded, "label", "label_error")
    return done.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(veccodes.codebooks_digest(book)).alias("codebooks_sha256"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(prepare(spark), sf_dir, "documents"), shards=40)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by the CRC-32 of ``conv_id:turn`` mod 20 (nulls: one space)."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    marked = conversations.select("conv_id", "turn", part("role").alias("role"), text.alias("text"), key.alias("key")).filter("key <> 0")
    return marked.select("conv_id", "turn", F.when(F.col("key") == 4, "user").otherwise(F.col("role")).alias("role"),
                         F.when(F.col("key") == 1, "").when(F.col("key") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                         F.explode(F.when(F.col("key") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(prepare(spark), sf_dir, "conversations")
    found, steps = turns.repair(damaged(conversations))
    every = conversations.select("conv_id").distinct()
    done = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv").join(turns.digests(steps), F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return done.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_line_dedup, op3_toxicity, op4_source_mixing, op5_exact_top_k, op6_language_id, op7_decontamination, op8_simhash_dedup, op9_token_output, op10_license_scan, op11_vector_codes, op12_sharding, op13_turn_repair)}

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_LINE_SQL = rf"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x, i: {{'s': trim(x), 'i': i - 1}}), lambda x: x.s <> '') AS ls FROM d),
r AS (SELECT doc_id, text, ls, n, unnest(range(0, len(ls) - n + 1)) AS s FROM l, (VALUES (1), (2), (3)) t(n) WHERE len(ls) >= n),
k0 AS (SELECT doc_id, text, n, s, len(ls) = n AS whole, array_to_string(list_transform(ls[s + 1:s + n], lambda x: x.s), chr(10)) AS run, list_transform(ls[s + 1:s + n], lambda x: x.i) AS lines FROM r),
k AS (SELECT * FROM k0 WHERE n = 3 OR whole OR len(regexp_extract_all(run, '[^\x20\x09-\x0D]+')) >= {SHORT_RUN_WORDS}),
f AS (SELECT n, run, min({{'n': doc_id IS NULL, 'd': doc_id, 't': text, 's': s}}) AS f FROM k GROUP BY n, run HAVING count(*) > 1),
g AS (SELECT DISTINCT k.doc_id, k.text, unnest(k.lines) AS line FROM k JOIN f USING (n, run)
      WHERE NOT (k.doc_id IS NOT DISTINCT FROM f.f.d AND k.text = f.f.t AND k.s < f.f.s + k.n)),
a AS (SELECT doc_id, text, list(line) AS gone FROM g GROUP BY ALL)
SELECT documents.doc_id, CAST(coalesce(len(string_split(documents.text, chr(10))), 0) AS INTEGER) AS n_lines, CAST(coalesce(len(gone), 0) AS INTEGER) AS n_removed,
  sha256(coalesce(CASE WHEN gone IS NULL THEN documents.text ELSE array_to_string(list_transform(list_filter(list_transform(string_split(documents.text, chr(10)), lambda x, i: {{'x': x, 'i': i - 1}}), lambda x: NOT list_contains(gone, x.i)), lambda x: x.x), chr(10)) END, '')) AS kept_sha256
FROM documents LEFT JOIN a ON documents.doc_id IS NOT DISTINCT FROM a.doc_id AND documents.text = a.text
"""

_MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
k AS (SELECT *, md5(concat_ws(':', CAST(doc_id AS VARCHAR), CAST(size AS VARCHAR))) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
b AS (SELECT *, sum(source_size) OVER () AS t, sum(weight) OVER () AS tw,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb,
  coalesce(sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb FROM w),
c AS (SELECT *, CAST(cap AS HUGEINT) * (tw - wb) <= CAST(weight AS HUGEINT) * (t - cb) AS capped FROM b),
e AS (SELECT *, coalesce(sum(cap) FILTER (capped) OVER (), 0) AS cs, coalesce(sum(weight) FILTER (capped) OVER (), 0) AS ws FROM c),
g AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(weight * (t - cs) AS DOUBLE) / CAST(greatest(tw - ws, 1) AS DOUBLE) END AS target FROM e),
h AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS base FROM g),
r AS (SELECT k.*, h.source_size, h.target, h.base, CAST(floor(h.target - h.base * h.source_size) AS BIGINT) AS budget,
  sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key RANGE UNBOUNDED PRECEDING) AS upto
  FROM k JOIN h ON k.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size, source_size, target, CAST(size * (base + CASE WHEN upto <= budget AND base < 3 AND source_size > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""

_TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_DECONTAM_SQL = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, len(x) AS n, array_to_string(x, ' ') AS x FROM (SELECT item, w[s + 1:s + least(13, len(w))] AS x FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 12, 1))) AS s FROM i WHERE len(w) > 0))),
d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
dw AS (SELECT doc_id, s, n, array_to_string(w[s + 1:s + n], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM iw) ns WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.s, dw.n, iw.item FROM dw JOIN iw ON dw.x = iw.x AND dw.n = iw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def _license_sql() -> str:
    """Every block and template compared plainly, without the join's filters."""
    sets = [(k, label, len(own), o, own) for k, label, own, o in licenses.template_sets()]
    t = ", ".join(f"({k}, '{label}', {n}, {o}, [{', '.join(repr(w) for w in own)}])" for k, label, n, o, own in sets)
    p = ", ".join(f"('{label}', {len(words.split())}, '{words}')" for label, words in licenses.PHRASES)
    return f"""
WITH t(k, label, n, o, own) AS (VALUES {t}), p(label, n, x) AS (VALUES {p}),
d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
pl AS (SELECT doc_id, p.label, s FROM (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS s FROM d WHERE len(w) >= 3) q JOIN p ON array_to_string(w[s + 1:s + p.n], ' ') = p.x),
b AS (SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels, list(label) AS ls FROM pl GROUP BY doc_id),
u AS (SELECT DISTINCT unnest(own) AS w FROM t),
x AS (SELECT DISTINCT doc_id, w, unnest([i // {licenses.STRIDE}, i // {licenses.STRIDE} - 1]) AS block FROM (SELECT doc_id, unnest(w) AS w, unnest(range(0, len(w))) AS i FROM d) JOIN u USING (w)),
o AS (SELECT doc_id, block, k, label, n, count(*) AS shared FROM x JOIN (SELECT k, label, n, o, unnest(own) AS w FROM t) y USING (w) WHERE block >= 0 GROUP BY doc_id, block, k, label, n, o HAVING count(*) >= o),
m AS (SELECT doc_id, max(shared / n) AS c, list(label) AS ls FROM o GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(b.ls, m.ls))), ','), '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(m.c, 0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Plain rounds: every part against every entry. Vectors have one length."""
    near = "SELECT part, x, vec_id, min({{'d': list_dot_product(x, x) - 2 * list_dot_product(x, e) + list_dot_product(e, e), 'entry': entry}}) AS best FROM p JOIN b{r} USING (part) GROUP BY part, x, vec_id"
    steps = "".join(f"""
a{r} AS ({near.format(r=r)}),
s{r} AS (SELECT part, entry, list(m ORDER BY pos) AS e FROM (SELECT part, best.entry AS entry, pos, floor(CAST(sum(c) AS DOUBLE) / count(*)) AS m
  FROM (SELECT part, best, unnest(x) AS c, unnest(range(0, len(x))) AS pos FROM a{r}) GROUP BY ALL) GROUP BY part, entry),
b{r + 1} AS (SELECT b{r}.part, b{r}.entry, coalesce(s{r}.e, b{r}.e) AS e FROM b{r} LEFT JOIN s{r} ON b{r}.part = s{r}.part AND b{r}.entry = s{r}.entry),""" for r in range(rounds))
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS x FROM (SELECT vec_id, v, unnest(range(0, {parts})) AS part FROM k)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < {entries}),
b0 AS (SELECT part, entry, x AS e FROM p JOIN f USING (vec_id)),{steps}
z AS ({near.format(r=rounds)}),
c AS (SELECT vec_id, string_agg(lpad(lower(hex(best.entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM z GROUP BY vec_id),
h AS (SELECT sha256(string_agg(CAST(CAST(m AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(e) AS m, unnest(range(0, len(e))) AS pos FROM b{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id) CROSS JOIN h
"""


#: CRC-32 by its polynomial: a table of 256 remainders, and {text} folded over it byte by byte.
_CRC_TABLE = """rem AS (SELECT i, i AS c, 0 AS k FROM range(0, 256) t(i) UNION ALL SELECT i, xor(c >> 1, 3988292384 * (c & 1)), k + 1 FROM rem WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM rem WHERE k = 8)"""
_CRC = ("xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT)),"
        " lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1])), 4294967295)")


def _sharding_sql(shards: int = 40, seed: int = 0) -> str:
    """The permutation round by round, walking by recursion."""
    def step(source: str) -> str:
        inner = f"SELECT k, p // b AS x, p % b AS y, a, b, n FROM {source} WHERE NOT done"
        for i, (times, plus, again) in enumerate(sharding.keys(seed)):
            once = f"SELECT *, (y * {times} + {plus}) % {sharding.PRIME} AS f FROM ({inner})"
            inner = f"SELECT k, y AS x, (x + ((xor(f, f >> 15) + 1) * {again}) % {sharding.PRIME}) % {'b' if i % 2 else 'a'} AS y, a, b, n FROM ({once})"
        return f"SELECT k, x * b + y AS p, a, b, n, x * b + y < n AS done FROM ({inner})"
    return f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(text)) - 1 AS k FROM d),
n AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM (SELECT count(*) AS n, CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1 AS a FROM d)),
w AS (SELECT k, k AS p, a, b, n, false AS done FROM o, n UNION ALL {step('w')}),
c AS (SELECT text, CAST({_CRC.format(text='text')} AS BIGINT) AS crc FROM (SELECT DISTINCT text FROM d), tab)
SELECT doc_id, CAST(strlen(text) + 16 AS BIGINT) AS size, crc AS text_crc32, 'rows' AS law, CAST(p % {shards} AS INTEGER) AS shard, CAST(p // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM o JOIN w USING (k) JOIN c USING (text) WHERE done
"""


def _turns_sql() -> str:
    """A walk over the grammar's states (nothing yet, after s, u, a), each with its cost and least audit as one string."""
    add = lambda s, n, e: f"CASE WHEN {s} = '~' THEN '~' ELSE lpad(CAST(CAST({s}[1:9] AS BIGINT) + {n} AS VARCHAR), 9, '0') || {s}[10:] || '{e}' END"
    stay = lambda s, to: f"CASE WHEN del THEN '~' WHEN c = '{to}' THEN {add(s, 'x', 'K')} ELSE {add(s, '2 + x', 'R')} END"
    inserted = f"""SELECT *, least(u1, {add('a1', 2, 'I')}) AS u2 FROM (SELECT *, least(a, {add('u1', 2, 'I')}) AS a1 FROM (SELECT *, least(u, {add('e', 2, 'I')}, {add('s', 2, 'I')}, {add('a', 2, 'I')}) AS u1 FROM"""
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    return rf"""
WITH RECURSIVE {_CRC_TABLE},
d0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format(text='k')} % 20 AS k FROM (SELECT *, {key} AS k FROM conversations), tab),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d0 WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again FROM d),
f AS (SELECT *, role[1:1] AS c, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN again > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault FROM o),
y AS (SELECT conv_id, i, c, fault IN (1, 2) AS del, CASE fault WHEN 3 THEN 1 ELSE 0 END AS x FROM f),
w AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS e, '~' AS s, '~' AS u, '~' AS a FROM y
  UNION ALL SELECT conv_id, i, {add('e', 3, 'D')}, least({add('s', 3, 'D')}, CASE WHEN NOT del AND c = 's' THEN {add('e', 'x', 'K')} ELSE '~' END),
    least({add('u2', 3, 'D')}, {stay('e', 'u')}, {stay('s', 'u')}, {stay('a1', 'u')}), least({add('a1', 3, 'D')}, {stay('u2', 'a')})
  FROM ({inserted} (SELECT w.*, y.c, y.del, y.x, y.i AS j FROM w JOIN y ON w.conv_id IS NOT DISTINCT FROM y.conv_id AND y.i = w.i + 1)))) t(conv_id, k, e, s, u, a, c, del, x, i, u1, a1, u2)),
n AS (SELECT conv_id, max(i) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM f) GROUP BY conv_id),
b AS (SELECT *, least(e, a1) AS best FROM ({inserted} (SELECT w.*, n.* EXCLUDE (conv_id, n) FROM w JOIN n ON w.conv_id IS NOT DISTINCT FROM n.conv_id AND w.i = n.n))))),
l AS (SELECT conv_id, best[10:] AS audit, unnest(range(1, len(best) - 8)) AS p FROM b),
q AS (SELECT conv_id, p, audit[p:p] AS edit, len(replace(audit[1:p], 'I', '')) AS i, len(replace(audit[1:p], 'D', '')) - 1 AS spot FROM l),
h AS (SELECT q.*, f.role, f.text, max(CASE WHEN spot = 0 AND edit = 'K' AND f.c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY q.conv_id) AS head FROM q LEFT JOIN f ON q.conv_id IS NOT DISTINCT FROM f.conv_id AND q.i = f.i),
r AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (spot - head) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS hash FROM h WHERE edit <> 'D' GROUP BY conv_id)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(best[1:9] AS BIGINT), 0) AS cost, coalesce(best[10:], '') AS audit, coalesce(hash, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) z LEFT JOIN b ON z.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN r ON z.conv_id IS NOT DISTINCT FROM r.conv_id
"""


#: XXH64, tokenizers, suffix order and learnt models are not in SQL: tests/llm compares those with brute force.
ORACLES = {"op2_line_dedup": _LINE_SQL, "op4_source_mixing": _MIX_SQL, "op5_exact_top_k": _TOPK_SQL, "op7_decontamination": _DECONTAM_SQL, "op10_license_scan": _license_sql(), "op11_vector_codes": _codes_sql(), "op12_sharding": _sharding_sql(), "op13_turn_repair": _turns_sql()}
