"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from talkloom.llm import ann, bpe, linededup, neardup, packing, quality, rules, shards, token_counts, toxicity
from talkloom.sources.tables import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_multiprobe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document's pieces in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and its ids decoded; both as digests."""
    import public_tokenizers

    ranks, pattern = _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encode_and_decode(table(spark, sf_dir, "documents"), ranks, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count, and whether it exceeds 4096."""
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: 3-word shingles, similarity 0.85."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=3, threshold=0.85)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, learned outside the held-out fold."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log weight, sampling key, and whether it is in the sample."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.scores(docs, table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's boilerplate lines cut."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped_lines", "text")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document under the production policy."""
    return rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents")))


def op10_training_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token shards in the shared folder; the manifest of every document's spans."""
    manifest, _ = shards.write_shards(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))
    return manifest


QUERIES = {
    "op1_multiprobe_search": op1_multiprobe_search,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_token_counts": op4_token_counts,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_quality_resampling": op7_quality_resampling,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_training_shards": op10_training_shards,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op8_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS ls, count(*) OVER (PARTITION BY source, text) AS n_same FROM documents
), seen AS (
  SELECT source, unnest(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS line FROM lines
), totals AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
boilerplate AS (
  SELECT s.source, s.line FROM seen s JOIN totals t USING (source)
  GROUP BY s.source, s.line, t.n HAVING count(*) >= 3 AND count(*) > 0.01 * t.n
), gone AS (SELECT source, list(line) AS gone FROM boilerplate GROUP BY 1),
cut AS (
  SELECT l.doc_id, l.text, l.ls, l.n_same, list_filter(l.ls, lambda x: NOT list_contains(coalesce(g.gone, []), x)) AS kept
  FROM lines l LEFT JOIN gone g USING (source)
), judged AS (
  SELECT *, len(kept) < len(ls) AND (n_same = 1 OR len(list_filter(kept, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) > 0) AS applied FROM cut
)
SELECT doc_id, len(ls)::BIGINT AS n_lines,
  CASE WHEN applied THEN len(ls) - len(kept) ELSE 0 END::BIGINT AS n_dropped_lines,
  CASE WHEN applied THEN array_to_string(kept, chr(10)) ELSE text END AS text
FROM judged
"""

ORACLE_SQL["op9_quality_rules"] = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM base
), grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM words WHERE len(w) > 2)
), marked AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM marked, (VALUES (0), (1), (2)) v(k) WHERE marked.n > 1 GROUP BY 1
), m AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x: regexp_matches(x, '\p{L}')))::BIGINT AS n_letter_words,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{2022}]')))::BIGINT AS n_bullet_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipsis_lines
  FROM words w LEFT JOIN covered c USING (doc_id)
), f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 4 * n_words THEN 4 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 15 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 10 * n_letter_words < 6 * n_words THEN 64 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 10 * n_bullet_lines > 9 * n_lines THEN 128 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 10 * n_ellipsis_lines > 3 * n_lines THEN 256 ELSE 0 END)::INTEGER AS failed_bits
  FROM m
)
SELECT *, failed_bits & 3 <> 0 AS base_failed, failed_bits & 511 = 0 AS kept FROM f
"""

if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
