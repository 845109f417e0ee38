"""One query for each operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webframe.session import cut, remove, table
from webframe.llm import chat, decontamination, divergence, language_id, pieces, quality, resampling, sharding, simhash, substring_dedup, superminhash, url_filter, warc


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.sha2(F.col("__kept"), 256).alias("kept_sha256"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)))
    model = language_id.train(docs.filter(~F.col("held_out")))
    return language_id.predict(docs, model, keep=("doc_id", "held_out"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    full = F.col("type") == "response"
    rows = warc.read(spark, folder).withColumn("digest", F.when(full, F.sha1("payload")).otherwise(F.col("digest")))
    rows = rows.withColumn("payload_length", F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length"))).drop("payload", "http_head")
    rows = cut(rows)  # without payloads; the archives have been read and can go
    remove(spark, folder)
    return warc.transactions(rows).select(
        F.col("response.capture_key").cast("long").alias("page_id"),
        F.col("response.payload_length").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to_key").cast("long").alias("refers_to"),
        F.col("request.uri").alias("url"),
        F.size("metadata").alias("n_metadata"),
    )


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(chat.turns_as_messages(table(spark, sf_dir, "conversations")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("host", "text_hash")


def tokenizer_model(name: str = "piece_bpe_32k.model") -> bytes:
    """The bytes of a public tokenizer's file, read on the driver: executors need no such path."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_model())


def op11_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "n_features", "weight", "score", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_simhash": op3_simhash,
    "op4_sharding": op4_sharding,
    "op5_url_filter": op5_url_filter,
    "op6_language_id": op6_language_id,
    "op7_warc": op7_warc,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_quality_rules": op9_quality_rules,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_superminhash": op11_superminhash,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_source_divergence": op13_source_divergence,
}
ORACLE_SQL: dict[str, str] = {
    "op7_warc": """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, url, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < newest THEN newest END AS refers_to, url, CAST(1 AS INTEGER) AS n_metadata
FROM m
""",
    "op8_chat_formatting": chat.ORACLE_SQL,
    "op13_source_divergence": divergence.ORACLE_SQL,
    "op9_quality_rules": f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
windows AS (
  SELECT doc_id, i, words[i:i + 4] AS g FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w WHERE len(words) >= 5)
),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
real AS (SELECT * FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM real GROUP BY doc_id),
norm AS (SELECT doc_id, source, text, trim(regexp_replace(lower(line), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS line FROM real),
hosts AS (SELECT source, count(DISTINCT text) AS n_host FROM d GROUP BY source),
often AS (
  SELECT source, line FROM (SELECT source, line, count(DISTINCT text) AS n FROM norm GROUP BY source, line) JOIN hosts USING (source)
  WHERE n >= {quality.MIN_DOCS} AND n > {quality.SHARE} * n_host
),
lost AS (SELECT doc_id, sum(length(line) - length(replace(line, ' ', '')) + 1) AS n FROM norm SEMI JOIN often USING (source, line) GROUP BY doc_id),
counts AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(least(coalesce(lost.n, 0), len(words)) AS BIGINT) AS n_boilerplate_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words)
    AND n_words - n_boilerplate_words >= {quality.KEEP} * n_words AS kept
FROM counts
""",
}
