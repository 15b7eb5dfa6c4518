"""The registered queries of this subpackage: each operator with production parameters over its
whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill.llm import bottomk, codec, ego, lm, packing, periodic, pii, quality, rules, substrings, toxicity, transducer, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return transducer.token_counts(table(spark, sf_dir, "documents"), path)


def op2_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego.link(table(spark, sf_dir, "embeddings"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.near_duplicates(table(spark, sf_dir, "documents"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return codec.digests(table(spark, sf_dir, "documents"), path)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, sf_dir, "documents"), path)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.fit(docs)).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans"
    )


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = lm.vocabulary(docs)
    return lm.score(docs, words, lm.train(docs, words))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_embedding_links, op3_minhash_dedup, op4_bpe_codec, op5_toxicity, op6_quality, op7_packing, op8_quality_rules, op9_pii, op10_lm_scores, op11_embedding_whitening, op12_substring_dedup, op13_periodic_runs)}
# CRC-32 of the id's digits, byte by byte and bit by bit.
CRC = """xor(4294967295, list_reduce(
    [4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))))"""

PERIODIC = f"""
WITH split AS (
    SELECT doc_id, {CRC} AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
marked AS (
    SELECT doc_id, w, len(w) AS n, h % 10 = 0 AS changed, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS k FROM split),
placed AS (
    SELECT doc_id, n, i, w[1 + if(changed AND i >= a, a + (i - a) % (1 + (n - a) // k), i)] AS word
    FROM (SELECT *, unnest(range(n)) AS i FROM marked)),
same AS (
    SELECT x.doc_id, x.i, y.i - x.i AS q FROM placed x JOIN placed y
    ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same),
stretches AS (
    SELECT doc_id, q, min(i) AS first, count(*) + q AS size FROM islands GROUP BY doc_id, q, island
    HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT * FROM stretches QUALIFY row_number() OVER (PARTITION BY doc_id, first, size ORDER BY q) = 1),
listed AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(first || ',' || size || ',' || q || chr(10), '' ORDER BY first, q) AS lines
    FROM runs GROUP BY doc_id),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size::DECIMAL(30, 0) * 1000000000 // q DESC, first, q) = 1),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM placed
    WHERE NOT EXISTS (FROM runs WHERE runs.doc_id = placed.doc_id AND i >= first + q AND i < first + size) GROUP BY doc_id)
SELECT m.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, first::BIGINT AS start, size::BIGINT AS length, q::BIGINT AS period,
    (1000 * size // q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM marked m LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""

SUBSTRINGS = """
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
    SELECT doc_id, i, array_to_string(w[i + 1 : i + 20], ' ') AS phrase
    FROM (SELECT *, unnest(range(greatest(len(w) - 19, 0))) AS i FROM split)),
late AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY doc_id, i) > 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM split),
judged AS (
    SELECT doc_id, i, word, max(late.i) OVER (PARTITION BY doc_id ORDER BY i ROWS 19 PRECEDING) IS NOT NULL AS removed
    FROM words LEFT JOIN late USING (doc_id, i))
SELECT doc_id, any_value(len(w))::BIGINT AS n_words, (count(*) FILTER (removed))::BIGINT AS n_removed,
    sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT removed), '')) AS kept_sha256
FROM split LEFT JOIN judged USING (doc_id) GROUP BY doc_id"""

ORACLES: dict[str, str] = {"op12_substring_dedup": SUBSTRINGS, "op13_periodic_runs": PERIODIC}
