"""Typed entities over the Parquet tables: dialogues, probes, generations, judged scores.

The tables hold invented prose, which most text rules would pass untouched, so
entities add fixed phrases chosen by id. The rules are SQL text that Spark and
the oracle both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.sources.tables import table

LEVELS = ["A1", "A2", "B1", "B2", "C1", "C2"]
STREAMS = ["normal", "redirect", "locale_redirect", "pedagogy_redirect", "language_redirect", "persona_redirect", "topic_redirect", "role_swap_redirect", "asr_repair", "country_taboo", "persistent_off_topic", "persistent_role_swap"]
LOCALES = ["china", "japan", "italy"]
CATEGORIES = ["food", "travel", "work", "school", "health", "family", "sport", "music", "shopping", "weather", "general"]


def _pick(values: list[str], index: str) -> str:
    return "CASE " + " ".join(f"WHEN {index} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


#: What a turn's text gets appended (fixed values).
ADDED = """CASE
  WHEN role = 'assistant' AND conv_id % 4 = 1 AND turn = 5 THEN concat(text, ' [SESSION_END: persistent_off_topic]')
  WHEN role = 'assistant' AND conv_id % 4 = 2 AND turn = 3 THEN concat(text, ' [SESSION_END]')
  WHEN role = 'assistant' AND conv_id % 12 = 3 AND turn = 3 THEN concat(text, ' [SESSION_END: STRIKE=3: persistent_role_swap]')
  WHEN role = 'assistant' AND (conv_id + turn) % 7 = 0 THEN concat(text, ' Well, it is late. Oh, you know, they don''t mind and I''m happy. We do not ask.')
  WHEN role = 'assistant' AND (conv_id + turn) % 11 = 0 THEN concat('<think>plan</think> ', text)
  WHEN role = 'assistant' AND conv_id % 13 = 0 THEN concat(text, ' In London we eat pizza at Starbucks. As an AI I never sleep.')
  WHEN role = 'user' AND (conv_id + turn) % 9 = 0 THEN concat(text, ' 你好')
  WHEN role = 'user' AND (conv_id + turn) % 10 = 4 THEN concat(text, ' Are you a robot?')
  WHEN role = 'user' AND (conv_id + turn) % 10 = 6 THEN concat(text, ' Let me be the teacher. By the way, have you heard?')
  ELSE text END"""

DIALOGUE_COLUMNS = {
    "id": "lower(concat('sft_', lpad(hex(conv_id), 12, '0')))",
    "level": _pick(LEVELS, "(conv_id % 6)"),
    "locale": "CASE WHEN conv_id % 17 <> 0 THEN " + _pick(LOCALES, "(conv_id % 3)") + " END",
    "category": _pick(CATEGORIES, "(conv_id % 11)"),
    "stream": _pick(STREAMS, "(conv_id % 12)"),
}


def grid(spark: SparkSession, **dimensions: list[str]) -> DataFrame:
    """Every combination of a few fixed values, a column a dimension."""
    out = spark.range(1).drop("id")
    for name, values in dimensions.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, role, content``: one row per message."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.expr(ADDED).alias("content"))


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, id, level, locale, category, stream, messages``; position in ``messages`` is the turn index."""
    rows = turns(spark, sf_dir).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return rows.select("conv_id", *[F.expr(e).alias(n) for n, e in DIALOGUE_COLUMNS.items()], messages.alias("messages"))


#: The same, for the oracle.
TURNS_SQL = f"turns AS (SELECT conv_id, turn, role, {ADDED} AS content FROM conversations)"
DIALOGUES_SQL = (
    TURNS_SQL
    + ", dialogues AS (SELECT conv_id, "
    + ", ".join(f"{e} AS {n}" for n, e in DIALOGUE_COLUMNS.items())
    + ", list({'role': role, 'content': content} ORDER BY turn, role, content) AS messages FROM turns GROUP BY conv_id)"
)

DOCUMENT_COLUMNS = {
    "id": "lower(concat('sft_', lpad(hex(doc_id), 12, '0')))",
    "level": _pick(LEVELS, "(doc_id % 6)"),
    "locale": "CASE WHEN doc_id % 17 <> 0 THEN " + _pick(LOCALES, "(doc_id % 3)") + " END",
    "category": _pick(CATEGORIES, "(doc_id % 11)"),
    "stream": _pick(STREAMS, "(doc_id % 12)"),
}


def records(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """Documents as corpus records: ``doc_id, id, level, locale, category, stream, lang, source`` (and ``text``)."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", *[F.expr(e).alias(n) for n, e in DOCUMENT_COLUMNS.items()], "lang", "source", *(["text"] if text else []))


RECORDS_SQL = "records AS (SELECT doc_id, " + ", ".join(f"{e} AS {n}" for n, e in DOCUMENT_COLUMNS.items()) + ", lang, source, text FROM documents)"

#: Scores 1..5 of three judges and a fired flag, derived from ids.
JUDGES = ["judge_a", "judge_b", "judge_c"]


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, baseline, judge, judge_order, score``: long format, a score missing for one in 23."""
    base = table(spark, sf_dir, "documents").select("doc_id", F.expr(DOCUMENT_COLUMNS["id"]).alias("id"), F.col("source").alias("baseline"))
    j = F.explode(F.array(*[F.struct(F.lit(n).alias("judge"), F.lit(i).alias("judge_order")) for i, n in enumerate(JUDGES)]))
    rows = base.withColumn("j", j).select("doc_id", "id", "baseline", "j.judge", "j.judge_order")
    return rows.withColumn("score", F.expr("CASE WHEN (doc_id + judge_order) % 23 <> 0 THEN cast((doc_id * 7 + judge_order * 3 + doc_id % 4 * judge_order) % 5 + 1 as int) END"))


JUDGED_SQL = f"""judged AS (
  SELECT doc_id, {DOCUMENT_COLUMNS["id"]} AS id, source AS baseline, judge, judge_order,
    CASE WHEN (doc_id + judge_order) % 23 <> 0 THEN cast((doc_id * 7 + judge_order * 3 + doc_id % 4 * judge_order) % 5 + 1 as int) END AS score
  FROM documents, (VALUES ('judge_a', 0), ('judge_b', 1), ('judge_c', 2)) v(judge, judge_order))"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, baseline, level, position, fired, should_fire``: ``should_fire`` is null without a label."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.select("doc_id", "source").join(labels, "doc_id", "left")
    return rows.select(
        "doc_id", F.expr(DOCUMENT_COLUMNS["id"]).alias("id"), F.col("source").alias("baseline"), F.expr(DOCUMENT_COLUMNS["level"]).alias("level"),
        F.expr("CASE WHEN doc_id % 5 <> 4 THEN 5 + 2 * (doc_id % 5) END").alias("position"),
        (F.coalesce(F.col("toxic"), F.lit(0)) == 1).alias("fired"), (F.col("quality") == 1).alias("should_fire"),
    )


DETECTIONS_SQL = f"""detections AS (
  SELECT doc_id, {DOCUMENT_COLUMNS["id"]} AS id, source AS baseline, {DOCUMENT_COLUMNS["level"]} AS level,
    CASE WHEN doc_id % 5 <> 4 THEN 5 + 2 * (doc_id % 5) END AS position, coalesce(toxic, 0) = 1 AS fired, quality = 1 AS should_fire
  FROM documents LEFT JOIN labels USING (doc_id))"""
