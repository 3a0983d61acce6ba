"""The queries of this package and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import bpe, chat, embeddings, exact_dedup, langid, lexical, licenses, mixing, pages, sharding, simhash, spelling, tokencount
from .common import table


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return rows.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.label_duplicates(table(spark, sf_dir, "documents"))


#: A conversation of control strings, which the formatting must survive.
HOSTILE = r"\### Assistant: </turn> ok"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(chats.unionByName(own))).drop("n_tokens")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("order_key")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def op10_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_histogram_shards": op1_histogram_shards,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_source_mixing": op4_source_mixing,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_license_scan": op6_license_scan,
    "op7_language_id": op7_language_id,
    "op8_simhash": op8_simhash,
    "op9_main_text": op9_main_text,
    "op10_embedding_links": op10_embedding_links,
    "op11_lexical_search": op11_lexical_search,
    "op12_token_counts": op12_token_counts,
    "op13_spelling_variants": op13_spelling_variants,
    "pipeline": pipeline,
}

OP2_SQL = r"""
WITH normal AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
hashed AS (SELECT doc_id, sha256(t) AS text_sha256 FROM normal)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM hashed WINDOW w AS (PARTITION BY text_sha256)
"""

OP4_SQL = f"""
WITH sizes AS (SELECT source, sum(coalesce(strlen(text), 0) + 1)::BIGINT AS bytes FROM documents GROUP BY source),
weighted AS (SELECT source, bytes, pow(bytes::DOUBLE, {mixing.TEMPERATURE}) AS weight FROM sizes),
rated AS (SELECT source, weight / (SELECT sum(weight) FROM weighted) * (SELECT sum(bytes) FROM weighted) / bytes AS rate FROM weighted),
split AS (SELECT source, rate, greatest(1, ceil(rate / {mixing.MEAN_AT_MOST}))::INT AS draws FROM rated),
means AS (SELECT source, draws, rate / draws AS mean FROM split),
cdfs AS (
  SELECT source, draws, list_transform(range(0, ceil(mean + 12 * sqrt(mean) + 20)::INT + 1), lambda k:
    list_sum(list_transform(range(0, k + 1), lambda i: exp(i * ln(mean) - mean - lgamma(i + 1.0))))) AS cdf
  FROM means
),
counted AS (
  SELECT d.*, list_sum(list_transform(range(1, draws + 1), lambda j: len(list_filter(cdf, lambda c:
    c <= (('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, ''))) || ':' || j::VARCHAR), 1, 13))::BIGINT + 0.5) / {1 << 52})))) ::BIGINT AS n_copies
  FROM documents d JOIN cdfs ON d.source IS NOT DISTINCT FROM cdfs.source
)
SELECT * EXCLUDE (n_copies), unnest(range(1, n_copies + 1))::INT AS copy, n_copies FROM counted WHERE n_copies > 0
"""

OP3_SQL = r"""
WITH chats AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)
),
escaped AS (
  SELECT *, length(regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) + length('### : </turn>') + 1 AS chars
  FROM chats
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
),
corpus AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS occurrences FROM docs WHERE len(terms) > 0),
postings AS (SELECT place, doc_id, n, term, count(*) AS tf FROM (SELECT place, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, corpus GROUP BY term, docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
),
scored AS (
  SELECT item_id, place, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // occurrences))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term), corpus GROUP BY item_id, place, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS "rank", doc_id, score FROM scored WHERE score > 0 QUALIFY "rank" <= 10
"""

#: crc32 byte by byte with its table; near words by leaving out each letter: equal remains at one place are a replaced letter, a remain that is a word a deleted one.
OP13_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_concat([k], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS t FROM range(256) r(k)
),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS i, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')) AS run FROM documents
),
lowered AS (SELECT i, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM runs),
bytes AS (SELECT w, hex(encode(i || ':' || w)) AS x FROM lowered),
hashed AS (
  SELECT w, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(length(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM bytes, crc_table
),
slipped AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word FROM hashed),
words AS (SELECT word, count(*) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
remains AS (SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS r FROM (SELECT word, n, unnest(range(length(word)::INT)) AS k FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM remains a JOIN remains b ON a.k = b.k AND a.r = b.r AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM remains a JOIN words b ON a.r = b.word
  UNION SELECT b.word, a.word, a.n FROM remains a JOIN words b ON a.r = b.word
),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place FROM pairs),
near AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.other_n >= 10 * w.n THEN r.other END AS form, CASE WHEN r.other_n >= 10 * w.n THEN r.other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.place = 1),
chain AS (
  SELECT word, form AS at FROM near WHERE form IS NOT NULL
  UNION ALL SELECT c.word, n.form FROM chain c JOIN near n ON c.at = n.word WHERE n.form IS NOT NULL
),
ends AS (SELECT c.word, c.at AS root FROM chain c JOIN near n ON c.at = n.word WHERE n.form IS NULL)
SELECT n.word, n.form, coalesce(e.root, n.word) AS root, n.n::BIGINT AS n, n.n_near::BIGINT AS n_near, n.form_n::BIGINT AS form_n FROM near n LEFT JOIN ends e ON n.word = e.word
"""

ORACLE_SQL: dict[str, str] = {"op2_exact_dedup": OP2_SQL, "op3_chat_format": OP3_SQL, "op4_source_mixing": OP4_SQL, "op11_lexical_search": OP11_SQL, "op13_spelling_variants": OP13_SQL}
