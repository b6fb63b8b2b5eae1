"""Registered queries over replies, plans and views, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkloom.functions import text as T
from talkloom.operators import sampling as S
from talkloom.operators import turns as Q
from talkloom.plans import entities as E
from talkloom.plans.dialogue_queries import PAIRS, links
from talkloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


D, TURNS, REC = "WITH " + E.DIALOGUES_SQL, "WITH " + E.TURNS_SQL, "WITH " + E.RECORDS_SQL
JUD = "WITH " + E.JUDGED_SQL

#: Phrases of a broken persona and of a declined role, looked for in lower case.
BROKEN = [
    "i am an ai", "i'm an ai", "i am a chatbot", "i'm a chatbot", "as a language model", "as an ai language model", "i am a language model",
    "i'm a language model", "i don't have feelings", "as an ai,", "i am an artificial", "i'm artificial",
]
DECLINED = [
    "i'll stay", "i will stay", "let me stay", "let's keep", "i remain", "i'll remain", "i am the tutor", "i'm the tutor", "my role is", "you are the learner", "you're the learner",
    "you stay the learner", "as your tutor", "i'm here to help you", "let me ask you", "your turn",
]
#: What turns are made to say, by conversation.
_SAID = "CASE conv_id % 6 WHEN 0 THEN concat(content, ' As an AI, I am glad.') WHEN 1 THEN concat(content, ' I''m the tutor, your turn') WHEN 2 THEN concat('I don''t have feelings. My role is ', content) WHEN 3 THEN ' ' ELSE content END"


def _any(phrases: list[str], text: str) -> str:
    return "(" + " OR ".join("contains(lower({}), '{}')".format(text, p.replace("'", "''")) for p in phrases) + ")"


@query(TURNS + f", s AS (SELECT role, {_SAID} AS said FROM turns) SELECT role, count(*) AS n, round(avg({_any(BROKEN, 'said')}::INT), 6) AS broke, round(avg({_any(DECLINED, 'said')}::INT), 6) AS declined FROM s WHERE trim(said) <> '' GROUP BY 1")
def persona_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    def has(phrases: list[str]):
        out = F.lit(False)
        for p in phrases:
            out = out | F.lower("said").contains(p)
        return F.round(F.avg(out.cast("int")), 6)

    t = E.turns(spark, sf_dir).withColumn("said", F.expr(_SAID)).where(F.trim("said") != "")
    return t.groupBy("role").agg(F.count(F.lit(1)).alias("n"), has(BROKEN).alias("broke"), has(DECLINED).alias("declined"))


@query(TURNS + ", w AS (SELECT conv_id, turn, role, content, list_filter(regexp_extract_all(lower(content), '[a-z]+'), lambda x: length(x) >= 4) AS ws FROM turns), f AS (SELECT conv_id, ws AS topic FROM w WHERE turn = 1) SELECT w.conv_id, w.turn, NOT regexp_matches(w.content, '[\\x{4E00}-\\x{9FFF}]') AS in_english, list_has_any(w.ws, f.topic) AS anchored FROM w JOIN f USING (conv_id) WHERE w.turn > 1")
def topic_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.regexp_extract_all(F.lower("content"), F.lit("[a-z]+"), F.lit(0)), lambda x: F.length(x) >= 4)
    w = E.turns(spark, sf_dir).withColumn("ws", words)
    topic = w.where("turn = 1").select("conv_id", F.col("ws").alias("topic"))
    return w.where("turn > 1").join(topic, "conv_id").select("conv_id", "turn", (~F.col("content").rlike(r"[\x{4E00}-\x{9FFF}]")).alias("in_english"), F.arrays_overlap("ws", "topic").alias("anchored"))


_PROPS = "CASE WHEN event_id % 4 = 0 THEN concat('<think>plan</think>', props) WHEN event_id % 4 = 1 THEN concat(props, ',') ELSE props END"


@query(f"SELECT event_id, json_valid(p) AS valid, CASE WHEN json_valid(p) THEN json_extract_string(p, '$.ref') END AS ref FROM (SELECT event_id, regexp_replace({_PROPS}, '^<think>.*?</think>', '') AS p FROM events)")
def eval_json_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.regexp_replace(F.expr(_PROPS), r"^<think>.*?</think>", "")
    e = table(spark, sf_dir, "events").select("event_id", p.alias("p"))
    valid = F.try_parse_json("p").isNotNull() & F.trim("p").endswith("}")  # the parser stops at the first value's end
    return e.select("event_id", valid.alias("valid"), F.when(valid, F.get_json_object("p", "$.ref")).alias("ref"))


@query(JUD + ", a AS (SELECT id, score FROM judged WHERE judge = 'judge_a'), b AS (SELECT id, score AS other FROM judged WHERE judge = 'judge_b'), c AS (SELECT id, score AS third FROM judged WHERE judge = 'judge_c') SELECT id, CASE WHEN ('0x' || substr(sha256('ab:' || id), 1, 8))::BIGINT % 2 = 0 THEN score ELSE other END AS first, CASE WHEN ('0x' || substr(sha256('ab:' || id), 1, 8))::BIGINT % 2 = 0 THEN other ELSE score END AS second FROM a JOIN b USING (id) JOIN c USING (id) WHERE score <> other AND third IS NOT NULL")
def build_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkloom.functions import hashing as H

    j = E.judged(spark, sf_dir)
    a, b, c = (j.where(F.col("judge") == n).select("id", F.col("score").alias(k)) for n, k in (("judge_a", "x"), ("judge_b", "y"), ("judge_c", "z")))
    even = H.number(F.concat(F.lit("ab:"), "id")) % 2 == 0
    p = a.join(b, "id").join(c, "id").where("x <> y and z is not null")
    return p.select("id", F.when(even, F.col("x")).otherwise(F.col("y")).alias("first"), F.when(even, F.col("y")).otherwise(F.col("x")).alias("second"))


@query(TURNS + ", r AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN '<think>because</think>' || chr(10) || content ELSE content END AS content FROM turns WHERE role = 'assistant') SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN content ELSE regexp_replace(content, '^\\s*<think>.*?</think>\\s*', '') END AS shown FROM r")
def format_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reasoning kept or cut, by mode."""
    t = E.turns(spark, sf_dir).where("role = 'assistant'").withColumn("content", F.when(F.col("turn") % 4 == 1, F.concat(F.lit("<think>because</think>\n"), "content")).otherwise(F.col("content")))
    return t.select("conv_id", "turn", Q.evaluation_turn(F.col("content"), F.expr("CASE WHEN conv_id % 2 = 0 THEN 'keep' ELSE 'strip' END")).alias("shown"))


_CATS = "['food', 'travel', 'work', 'school']"


@query(REC + f", e AS (SELECT level, count(*) AS n FROM records GROUP BY 1), s AS (SELECT level, {_CATS}[(n + k) % 4 + 1] AS category, k FROM e, (SELECT unnest(range(37)) AS k)) SELECT level, category, count(*) AS n, ((count(*) + 4) // 5)::BIGINT AS n_batches FROM s GROUP BY 1, 2")
def category_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """37 further seeds a level go round the categories from where the existing ones stopped, in batches of one category and five seeds at most."""
    existing = E.records(spark, sf_dir).groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    return S.allocate(existing, "level", 37, ["food", "travel", "work", "school"], 5)


@query(PAIRS + " SELECT d.lang, d.source, count(*) AS n, count(*) FILTER (b IS NOT NULL) AS n_close FROM documents d LEFT JOIN (SELECT DISTINCT b FROM pairs) p ON p.b = d.doc_id GROUP BY 1, 2")
def dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    close = links(spark, sf_dir).select(F.col("b").alias("doc_id")).distinct().withColumn("close", F.lit(True))
    return docs.join(close, "doc_id", "left").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if("close").alias("n_close"))


@query(REC + ", t AS (SELECT category, count(*) AS n, min(doc_id) AS f FROM records WHERE category <> 'general' GROUP BY 1) SELECT category, n FROM t ORDER BY n DESC, f LIMIT 3")
def category_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = E.records(spark, sf_dir).where("category <> 'general'").groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("f"))
    return t.orderBy(F.desc("n"), "f").limit(3).select("category", "n")


@query(REC + " SELECT id, level FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY id) AS r FROM records) WHERE r <= 2")
def samples_per_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = E.records(spark, sf_dir)
    return r.withColumn("r", F.row_number().over(Window.partitionBy("level").orderBy("id"))).where("r <= 2").select("id", "level")


@query(REC + " SELECT id FROM records WHERE doc_id % 2 = 0 INTERSECT SELECT id FROM records WHERE doc_id % 3 = 0")
def paired_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = E.records(spark, sf_dir)
    return r.where("doc_id % 2 = 0").select("id").intersect(r.where("doc_id % 3 = 0").select("id"))
