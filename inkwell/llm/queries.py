"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, chat, chunks, decontaminate, html, knn, licenses, pii, prefixes, simhash, tokenfiles, toxicity
from .common import checkpointed, table

RANKS = "byte_bpe_50k.tiktoken"
WORDS, WORDS_END = "word_bpe_49k.json", 2
#: A deployment passes its own key.
PII_KEY = "inkwell-demonstration-key"
TOXIC = 0.3


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = knn.quantised(table(spark, sf_dir, "embeddings"))
    return knn.top_k(rows, F.col("vec_id") % 20 == 0)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    ids = bpe.encode(table(spark, sf_dir, "documents"), path, pattern, packed=True, blanks_lead=True)
    return bpe.decode(ids, path, pattern).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)
    return found.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_replaced"), F.array_join("pii_kinds", ",").alias("kinds"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.perspectives(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda x: F.concat_ws("-", x["start"].cast("string"), x["stop"].cast("string")))
    return found.withColumn("mask", F.array_join(spans, ","))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
    )


def op10_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_passages(table(spark, sf_dir, "documents")).drop("text_key")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = checkpointed(prefixes.numbered(table(spark, sf_dir, "conversations")))
    return prefixes.trie(*prefixes.spliced(steps))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenfiles.shared_folder(spark, "token-files")
    tokenfiles.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(WORDS), WORDS_END, folds=True)
    return tokenfiles.read(spark, folder, "ids_crc32 long", tokenfiles.crc32)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""

def _escaped(column: str) -> str:
    return rf"regexp_replace(regexp_replace({column}, '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g')"


OP7_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(turn, 0) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS plain, {_escaped("coalesce(text, '')")} AS text
  FROM conversations
), c AS (
  SELECT conv_id, min(turn) AS first FROM t GROUP BY conv_id
), p AS (
  SELECT DISTINCT conv_id, role AS assistant FROM t WHERE role <> 'system'
), s AS (
  SELECT t.conv_id, p.assistant, (t.turn - c.first) // 256 AS segment, t.role = p.assistant AS own,
    '<|' || CASE WHEN t.role = p.assistant THEN 'assistant' WHEN t.role = 'system' THEN 'system' ELSE 'user name=' || {_escaped('t.role')} END || '|>' || chr(10) AS head,
    t.text || '<|end|>' || chr(10) AS body,
    row_number() OVER (PARTITION BY t.conv_id, p.assistant, (t.turn - c.first) // 256 ORDER BY t.turn, t.role, t.plain) AS n
  FROM t JOIN c ON t.conv_id IS NOT DISTINCT FROM c.conv_id JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, assistant, segment ORDER BY n) AS stop FROM s
)
SELECT conv_id, assistant, segment, 0 AS part, count(*) AS n_turns, string_agg(head || body, '' ORDER BY n) AS text,
  coalesce(string_agg(CAST(CAST(stop - length(body) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ',' ORDER BY n) FILTER (WHERE own), '') AS mask
FROM o GROUP BY conv_id, assistant, segment
"""


OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), first AS (
  SELECT text, min(doc_id) AS least FROM d GROUP BY text
), m AS (
  SELECT d.doc_id, d.part, (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 2 * length(d.text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN d.doc_id > first.least THEN 'E' ELSE '' END) AS fails
  FROM d JOIN first ON d.text = first.text
), l AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, fails
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, CAST(step AS INTEGER), 1) AS own, left(filter_order, CAST(step AS INTEGER) - 1) AS before FROM o, range(1, 6) t(step)
), r AS (
  SELECT part, filter_order, step, own, n, good, toxic, contains(fails, own) AS failing, length(translate(fails, before, '')) = length(fails) AS here, fails = own AS alone FROM c, s
), f AS (
  SELECT part, filter_order, step, own,
    CAST(coalesce(sum(n) FILTER (WHERE here AND NOT failing), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (WHERE here AND failing), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (WHERE failing AND NOT here), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (WHERE alone), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (WHERE here AND failing), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (WHERE here AND failing), 0) AS BIGINT) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM f
"""

#: CRC-32 of the decimal id, bit by bit: a byte is taken in, then eight shifts.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""

OP12_SQL = f"""
WITH t AS (
  SELECT conv_id, CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '') AS turn_text, turn, length(coalesce(text, '')) AS size
  FROM conversations WHERE conv_id IS NOT NULL
), g AS (
  SELECT conv_id, sha256(turn_text) AS digest, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(turn_text)) AS pos FROM t
), i AS (
  SELECT conv_id, {_CRC32} % 6 AS h FROM (SELECT DISTINCT conv_id FROM g)
), p AS (
  SELECT i.conv_id, 0 AS k, g.pos, digest, size FROM i JOIN g ON g.conv_id = i.conv_id - i.conv_id % 100 AND g.pos <= i.h
  UNION ALL SELECT i.conv_id, 1, g.pos, digest, size FROM i JOIN g ON g.conv_id = i.conv_id AND g.pos > i.h
), q AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS name, size FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY k, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), e AS (
  SELECT conv_id, depth, name, size FROM q UNION ALL SELECT conv_id, 0, '', 0 FROM i
), n AS (
  SELECT depth, name, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size FROM e GROUP BY depth, name
), c AS (
  SELECT depth - 1 AS depth, left(name, CAST(64 * (depth - 1) AS INTEGER)) AS name, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL
), m AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (depth, name)
), s AS (
  SELECT e.depth, e.name, count(*) FILTER (WHERE m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.size) AS saved_tokens
  FROM m JOIN e ON e.conv_id = m.conv_id AND e.depth <= m.depth GROUP BY e.depth, e.name
), l AS (
  SELECT depth, name, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ends FROM (SELECT conv_id, max(depth) AS depth, arg_max(name, depth) AS name FROM e GROUP BY conv_id) GROUP BY depth, name
)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(l.ends, '')) AS ends_sha256
FROM m JOIN s USING (depth, name) LEFT JOIN l USING (depth, name) LEFT JOIN n u ON u.depth = m.depth - 1 AND u.name = left(m.name, CAST(64 * (m.depth - 1) AS INTEGER))
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_topk, op2_html, op3_bpe, op4_pii, op5_simhash, op6_licenses, op7_chat, op8_decontaminate, op9_toxicity, op10_chunks, op11_filter_audit, op12_prefix_trie, op13_token_files)
    return {f.__name__: f for f in (*ops, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": OP1_SQL, "op7_chat": OP7_SQL, "op11_filter_audit": OP11_SQL, "op12_prefix_trie": OP12_SQL}
