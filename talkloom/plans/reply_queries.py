"""Registered queries over recorded model replies, with their SQL.

Replies are made from the documents' ids: a payload in one of many wrappings.
The SQL doesn't read the replies; it states what each wrapping must give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.functions import replies as R
from talkloom.functions import text as T
from talkloom.plans import entities as E
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


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: A payload of an id: keys sorted, no spaces; a brace in a string for every third id, a score out of range for every fifth.
PAYLOAD = """concat('{"margin":', doc_id % 4, ',"note":"n', CASE WHEN doc_id % 3 = 0 THEN '}' ELSE '' END, doc_id, '","overall_cefr_estimate":"B1","reason_axis":"',
  CASE WHEN doc_id % 4 = 1 THEN 'grammar' ELSE 'tone' END, '","scores":{"accuracy":', CASE WHEN doc_id % 5 = 0 THEN 6 ELSE doc_id % 5 END,
  ',"fluency":3,"interaction":"4","topic_adherence":2,"vocabulary":5},"specific_feedback":"ok","strengths":["s"],"suggested_practice":[],"winner":"',
  CASE WHEN doc_id % 3 = 1 THEN 'A' WHEN doc_id % 3 = 2 THEN 'B' ELSE 'tie' END, '"}')"""

#: Wrappings: what stands before the payload and behind it.
WRAPPED = [
    ("", ""),
    ("```json\n", "\n```"),
    ("Here you go: ", " I hope it helps {though"),
    ('<think>maybe {"winner":"B"}</think>\n', ""),
    ("", "\n<think>let me look again"),
    ("<think>hmm ", ""),
    ('<|channel|>analysis<|message|>{"x":1}<|end|><|channel|>final<|message|>', "<|end|>"),
    ("<|channel|>analysis<|message|>so<|end|><|start|>", ""),
    ("<THINK>a</THINK>Sure.\n```\n", "\n```\n"),
]
OTHERS = {
    9: "No idea.",
    10: 'Results: [1,2,{"a":3}] done',
    11: "The list is [1,2] and no more",
    12: '{"winner":"A",}',
    13: "{'winner': 'B', 'margin': 2}",
    14: '{"winner":"A"',
}
KINDS = len(WRAPPED) + len(OTHERS)
KIND = f"(doc_id % {KINDS})"
REPLY = "CASE " + " ".join(f"WHEN {KIND} = {i} THEN concat({_text(a)}, {PAYLOAD}, {_text(b)})" for i, (a, b) in enumerate(WRAPPED)) + " " + " ".join(f"WHEN {KIND} = {i} THEN {_text(t)}" for i, t in OTHERS.items()) + " END"


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, reply``."""
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(REPLY).alias("reply"))


#: What the first JSON value of a reply is, by its wrapping.
FIRST = f"""CASE WHEN {KIND} IN (5, 9, 12, 13, 14) THEN NULL WHEN {KIND} = 10 THEN '{{"a":3}}' WHEN {KIND} = 11 THEN '[1,2]' ELSE {PAYLOAD} END"""


@query(f"SELECT doc_id, {FIRST} AS found FROM documents")
def json_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies(spark, sf_dir).select("doc_id", R.first_json(F.col("reply")).alias("found"))


# Braces in strings part the two: every third payload holds a closing brace in its note.
@query(f"""SELECT doc_id,
  CASE WHEN {KIND} IN (9, 11, 12, 13, 14) THEN NULL WHEN {KIND} = 10 THEN '{{"a":3}}' WHEN {KIND} = 6 THEN '{{"x":1}}' WHEN {KIND} <= 8 AND doc_id % 3 <> 0 THEN {PAYLOAD} END AS by_braces,
  CASE WHEN {KIND} IN (9, 11, 14) THEN NULL WHEN {KIND} = 10 THEN '{{"a":3}}' WHEN {KIND} = 12 THEN '{{"winner":"A"}}' WHEN {KIND} = 13 THEN '{{"margin":2,"winner":"B"}}' WHEN {KIND} IN (3, 6) THEN NULL ELSE {PAYLOAD} END AS repaired
FROM documents""")
def json_locate_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = F.regexp_replace("reply", r"(?s)<think>.*?</think>", "")
    # this wrapping's loose end isn't part of what the last variant is for
    plain = F.when(F.expr(f"{KIND} = 2"), F.expr(PAYLOAD)).otherwise(F.col("reply"))
    return replies(spark, sf_dir).select("doc_id", R.locate_json(closed, "first_object").alias("by_braces"), R.locate_json(plain, "repaired_object").alias("repaired"))


@query(f"""SELECT doc_id, CASE
  WHEN {KIND} IN (0, 3, 4, 6, 7) THEN {PAYLOAD}
  WHEN {KIND} = 1 THEN concat('```json', chr(10), {PAYLOAD}, chr(10), '```') WHEN {KIND} = 2 THEN concat('Here you go: ', {PAYLOAD}, ' I hope it helps {{though')
  WHEN {KIND} = 5 THEN '' WHEN {KIND} = 8 THEN concat('Sure.', chr(10), '```', chr(10), {PAYLOAD}, chr(10), '```') {" ".join(f"WHEN {KIND} = {i} THEN {_text(t)}" for i, t in OTHERS.items())} END AS answer,
  CASE WHEN {KIND} = 1 THEN {PAYLOAD} END AS unfenced
FROM documents""")
def strip_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = R.strip_reasoning(F.col("reply"))
    fenced = F.col("reply").startswith("```")
    return replies(spark, sf_dir).select("doc_id", answer.alias("answer"), F.when(fenced, R.strip_fence(F.col("reply"))).alias("unfenced"))


@query(f"""SELECT doc_id, CASE
  WHEN {KIND} IN (0, 1, 3, 8) THEN {PAYLOAD} WHEN {KIND} = 2 THEN concat('Here you go: ', {PAYLOAD}, ' I hope it helps {{though') WHEN {KIND} = 4 THEN concat({PAYLOAD}, chr(10), '<think>let me look again')
  WHEN {KIND} = 5 THEN concat('<think>hmm ', {PAYLOAD}) WHEN {KIND} = 6 THEN concat({_text(WRAPPED[6][0])}, {PAYLOAD}, '<|end|>') WHEN {KIND} = 7 THEN concat({_text(WRAPPED[7][0])}, {PAYLOAD})
  {" ".join(f"WHEN {KIND} = {i} THEN {_text(t)}" for i, t in OTHERS.items())} END AS payload FROM documents""")
def evaluation_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies(spark, sf_dir).select("doc_id", R.payload(F.col("reply")).alias("payload"))


_VALID = f"({KIND} <= 8 AND {KIND} <> 5)"


@query(f"SELECT doc_id, {_VALID} AS valid, CASE WHEN {_VALID} AND doc_id % 5 <> 0 THEN doc_id % 5 END::INTEGER AS accuracy, CASE WHEN {_VALID} AND doc_id % 5 <> 0 THEN 4 END::INTEGER AS interaction FROM documents")
def evaluation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = replies(spark, sf_dir).select("doc_id", R.first_json(R.payload(F.col("reply"))).alias("j"))
    scores = R.dimension_scores(F.col("j"))
    return found.select("doc_id", R.has_fields(F.col("j"), R.EVALUATION_FIELDS).alias("valid"), scores["accuracy"].alias("accuracy"), scores["interaction"].alias("interaction"))


@query(f"""SELECT lang, count(*) AS n, round(avg(({_VALID})::INT), 6) AS valid_rate, round(avg(CASE WHEN {_VALID} AND doc_id % 5 <> 0 THEN doc_id % 5 END), 6) AS mean_accuracy FROM documents GROUP BY 1""")
def evaluation_sample_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid share, and means over the rows whose scores are all good."""
    found = replies(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("lang", R.first_json(R.payload(F.col("reply"))).alias("j"))
    rows = found.select("lang", R.has_fields(F.col("j"), R.EVALUATION_FIELDS).alias("valid"), R.dimension_scores(F.col("j"))["accuracy"].alias("accuracy"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("valid").cast("int")), 6).alias("valid_rate"), F.round(F.avg("accuracy"), 6).alias("mean_accuracy"))


_HAS = f"({KIND} <= 8 AND {KIND} <> 5)"


@query(f"""SELECT doc_id, CASE WHEN {_HAS} THEN CASE doc_id % 3 WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE 'tie' END END AS winner, CASE WHEN {_HAS} THEN doc_id % 4 END::INTEGER AS margin,
  CASE WHEN {_HAS} THEN CASE WHEN doc_id % 4 = 1 THEN 'register' ELSE 'tone' END END AS axis, CASE WHEN {_HAS} THEN concat('n', CASE WHEN doc_id % 3 = 0 THEN '}}' ELSE '' END, doc_id) END AS note FROM documents""")
def judge_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = replies(spark, sf_dir).select("doc_id", R.verdict(R.first_json(F.col("reply")), ["tone", "length"], "register").alias("v"))
    return v.select("doc_id", "v.winner", "v.margin", F.col("v.reason_axis").alias("axis"), "v.note")


#: Rubric replies: other digits before the tag, case and space of the tag, grades out of range, no tag.
RUBRIC = ["concat('Feedback: 3 faults of 10. [RESULT] ', doc_id % 7)", "concat('Fine.', chr(10), '[result]', chr(10), doc_id % 7, ' of 5')", "'Feedback: no grade, 4 of 5'", "concat('Feedback: Feedback: twice ', repeat('long ', 80), '[RESULT] 2 [RESULT] 5')"]
_RUBRIC = "CASE " + " ".join(f"WHEN doc_id % 4 = {i} THEN {e}" for i, e in enumerate(RUBRIC)) + " END"
_GRADE = "CASE WHEN doc_id % 4 < 2 AND doc_id % 7 BETWEEN 1 AND 5 THEN doc_id % 7 WHEN doc_id % 4 = 3 THEN 2 END"


@query(f"""SELECT doc_id, {_GRADE}::INTEGER AS grade,
  CASE doc_id % 4 WHEN 0 THEN '3 faults of 10.' WHEN 1 THEN 'Fine.' WHEN 2 THEN 'no grade, 4 of 5' ELSE substr(concat('Feedback: twice ', repeat('long ', 80)), 1, 280) END AS feedback FROM documents""")
def rubric_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "documents").select("doc_id", F.expr(_RUBRIC).alias("r"))
    return r.select("doc_id", R.grade(F.col("r")).alias("grade"), R.feedback(F.col("r")).alias("feedback"))


WINNER = ["concat('Both fine. [RESULT] ', CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'B' END)", "'No tag: A'", """concat('{"winner": "', CASE WHEN doc_id % 2 = 0 THEN ' b ' ELSE 'tie' END, '"}')""", "'{\"winner\": \"C\"}'", "'nothing'"]
_WINNER = "CASE " + " ".join(f"WHEN doc_id % 5 = {i} THEN {e}" for i, e in enumerate(WINNER)) + " END"


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END ELSE 'TIE' END AS tagged, CASE WHEN doc_id % 5 = 2 AND doc_id % 2 = 0 THEN 'B' ELSE 'TIE' END AS located FROM documents""")
def pairwise_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select("doc_id", F.expr(_WINNER).alias("w"))
    return w.select("doc_id", R.tagged_winner(F.col("w")).alias("tagged"), R.json_winner(R.locate_json(F.col("w"), "first_object")).alias("located"))


#: Generated evaluations, by what is wrong with them.
EVALS = [
    "concat('<think>', repeat('reason ', 6), doc_id, '</think>{\"a\":1}')",
    "concat('The learner did well. ', '{\"a\":', doc_id, '}')",
    "'{\"a\":1}'",
    "'words only'",
    "'<think>short</think>{\"a\":1}'",
    "'</think> late <think> and a good many words after that one {\"a\":1}'",
    "concat('<think>', repeat('reason ', 6), '</think> again </think>{\"a\":', doc_id, '}')",
    "concat('<think>', repeat('reason ', 6), '</think> nothing more')",
]
_EVAL = "CASE " + " ".join(f"WHEN doc_id % 8 = {i} THEN {e}" for i, e in enumerate(EVALS)) + " END"


@query("""SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN concat('<think>', repeat('reason ', 6), doc_id, '</think>{"a":1}')
  WHEN 1 THEN concat('<think>', chr(10), 'The learner did well.', chr(10), '</think>', chr(10), '{"a":', doc_id, '}')
  WHEN 6 THEN concat('<think>', repeat('reason ', 6), '</think>{"a":', doc_id, '}') END AS repaired,
  CASE doc_id % 8 WHEN 2 THEN 'JSON only' WHEN 3 THEN 'no reasoning and no JSON' WHEN 4 THEN 'trivial reasoning' WHEN 5 THEN 'close before open' WHEN 7 THEN 'no JSON after the reasoning' END AS error FROM documents""")
def evaluation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "documents").select("doc_id", F.expr(_EVAL).alias("e"))
    repaired, error = R.repair_evaluation(F.col("e"))
    return e.select("doc_id", repaired.alias("repaired"), error.alias("error"))


JUDGED = ["""concat('{"covered": ', doc_id % 7, ', "total": 5, "score": ', doc_id % 9, '}')""", """concat('Sure: {"covered": ', doc_id % 4, ', "score": "4.5"}')""", "'{\"covered\": \"many\", \"total\": 0}'", "'no'", "'{\"covered\": 2, \"total\": 0}'"]
_JUDGED = "CASE " + " ".join(f"WHEN doc_id % 5 = {i} THEN {e}" for i, e in enumerate(JUDGED)) + " END"


@query("""SELECT doc_id, round(CASE WHEN doc_id % 11 = 0 THEN 1 WHEN doc_id % 5 = 0 THEN least(1, (doc_id % 7) / 5) WHEN doc_id % 5 = 1 THEN least(1, (doc_id % 4) / (doc_id % 11)) WHEN doc_id % 5 = 4 THEN 1 ELSE 0 END, 6) AS adherence,
  CASE WHEN doc_id % 5 = 0 THEN least(5.0, doc_id % 9) WHEN doc_id % 5 = 1 THEN 4.5 ELSE 0.0 END::DOUBLE AS naturalness,
  CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS redirected FROM documents""")
def judge_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: judged adherence, naturalness and redirect from recorded replies."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_JUDGED).alias("r"), F.expr("CASE doc_id % 3 WHEN 0 THEN 'Yes, it did.' WHEN 1 THEN 'I say NO.' ELSE 'Nothing of note' END").alias("y"))
    j = R.first_json(F.col("r"))
    d = d.withColumn("j", j)
    yes = T.yes_no(F.col("y"))
    return d.select("doc_id", F.round(R.topic_ratio(F.col("j"), (F.col("doc_id") % 11).cast("int")), 6).alias("adherence"), R.natural_score(F.col("j")).alias("naturalness"), (yes == "yes").alias("redirected"))
