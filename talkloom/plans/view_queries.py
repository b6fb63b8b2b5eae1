"""Registered queries over cleaned records, training views and synthetic sets, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.operators import dedup as DD
from talkloom.operators import filters as FL
from talkloom.operators import turns as Q
from talkloom.operators import views as V
from talkloom.plans import entities as E
from talkloom.plans.dialogue_queries import _J, _joined
from talkloom.plans.text_queries import PIPED, _piped
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

#: Stored objects by id, with fields in any order, absent ones and unknown ones.
_OBJECT = """CASE doc_id % 4 WHEN 0 THEN concat('{"z":1,"level":"', level, '","id":', doc_id, '}') WHEN 1 THEN concat('{"id":"', id, '","tags":["a",{"b":2}],"junk":null}') WHEN 2 THEN '{}' ELSE concat('{"level":null,"id":', doc_id, '.5}') END"""


@query(REC + """ SELECT id, CASE doc_id % 4 WHEN 0 THEN concat('{"id":', doc_id, ',"level":"', level, '"}') WHEN 1 THEN concat('{"id":"', id, '","tags":["a",{"b":2}]}') WHEN 2 THEN '{}' ELSE concat('{"id":', doc_id, '.5,"level":null}') END AS kept FROM records""")
def keep_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed fields in the list's order; absent ones stay absent."""
    return E.records(spark, sf_dir).select("id", V.keep_fields(F.expr(_OBJECT), ["id", "level", "tags"]).alias("kept"))


@query(D + ", p AS (SELECT id, conv_id, level, CASE WHEN conv_id % 9 = 0 THEN NULL ELSE list_filter(messages, lambda m: NOT contains(m.content, '<think>')) END AS prompt, messages[1].content AS c FROM dialogues) SELECT id, level, len(prompt)::INT AS n_prompt, c AS chosen FROM p WHERE len(prompt) > 0 AND conv_id % 7 <> 0 AND conv_id % 5 <> 0 AND conv_id % 11 <> 0")
def clean_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: preference records that are whole on all sides."""
    d = E.dialogues(spark, sf_dir)
    prompt = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.when(~m["content"].contains("<think>"), m["content"]).alias("content")))
    side = lambda gone: F.struct(F.lit("assistant").alias("role"), F.when(~F.expr(gone), F.get("messages", F.lit(0))["content"]).alias("content"))
    pairs = d.select(
        F.when(F.expr("conv_id % 11 <> 0"), F.col("id")).alias("id"), F.struct("level").alias("metadata"), F.lit("s").alias("system_prompt"), F.when(F.expr("conv_id % 9 <> 0"), prompt).alias("prompt_messages"),
        side("conv_id % 7 = 0").alias("chosen"), side("conv_id % 5 = 0").alias("rejected"), F.lit(1).alias("extra"),
    )
    return V.clean_pairs(pairs).select("id", "metadata.level", F.size("prompt_messages").alias("n_prompt"), "chosen.content").withColumnRenamed("content", "chosen")


@query(D + ", t AS (SELECT id, unnest(CASE WHEN conv_id % 3 = 0 THEN [messages[len(messages)].content] ELSE list_transform(list_filter(messages, lambda m: m.role = 'assistant'), lambda m: m.content) END) AS text FROM dialogues) SELECT id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM t GROUP BY 1")
def side_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns of dialogues, the chosen side of pairs."""
    d = E.dialogues(spark, sf_dir)
    pair = F.expr("conv_id % 3 = 0")
    texts = V.side_texts(F.when(~pair, F.col("messages")), F.when(pair, F.get("messages", F.size("messages") - 1)))
    return d.select("id", F.explode(texts).alias("text")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


_BATCH = """CASE doc_id % 4 WHEN 0 THEN concat('[{"topic":"t', doc_id, '"}, 5, {"topic":"u"}]') WHEN 1 THEN concat('Here: {"items": [{"topic":"t', doc_id, '"}]}') WHEN 2 THEN 'nothing' ELSE '{"other": [{"topic":"x"}]}' END"""


@query("""SELECT doc_id, position::INT AS position, topic, ['food', 'travel'][position + 1] AS category FROM (
  SELECT doc_id, 0 AS position, 't' || doc_id AS topic FROM documents WHERE doc_id % 4 < 2 UNION ALL SELECT doc_id, 2, 'u' FROM documents WHERE doc_id % 4 = 0)""")
def stamped_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply's objects stamped by their place."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_BATCH).alias("reply"), F.array(F.lit("food"), F.lit("travel")).alias("wanted"))
    return V.stamped_batch(d, "reply", "wanted").select("doc_id", "position", F.get_json_object("item", "$.topic").alias("topic"), "category")


@query(REC + ", n AS (SELECT id, CASE WHEN locale IS NOT NULL AND doc_id % 5 <> 0 THEN 'Teach ' || level || ' in ' || locale || ', ' || locale || '.' END AS fresh, CASE WHEN doc_id % 7 = 0 THEN 'Teach ' || level || ' in ' || coalesce(locale, '') || ', ' || coalesce(locale, '') || '.' ELSE 'old' END AS prompt FROM records) SELECT id, coalesce(fresh, prompt) AS prompt, fresh IS NULL AS skipped, fresh IS NOT NULL AND fresh <> prompt AS changed FROM n")
def rerender_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts rendered anew; rows that lack a field keep theirs."""
    r = E.records(spark, sf_dir).withColumn("where", F.when(F.expr("doc_id % 5 <> 0"), F.col("locale")))
    old = F.when(F.expr("doc_id % 7 = 0"), F.concat(F.lit("Teach "), "level", F.lit(" in "), F.coalesce("locale", F.lit("")), F.lit(", "), F.coalesce("locale", F.lit("")), F.lit("."))).otherwise(F.lit("old"))
    return V.rerender(r.withColumn("prompt", old), "prompt", "Teach {level} in {locale}, {locale}.", {"level": F.col("level"), "locale": F.col("where")}).select("id", "prompt", "skipped", "changed")


@query(D + """, f AS (SELECT id, level, list_filter(messages, lambda m: m.role <> 'system') AS m, messages[len(messages)].content AS c FROM dialogues), g AS (SELECT *, list_position(list_transform(m, lambda x: x.role), 'user') AS u FROM f),
r AS (SELECT id, '<|im_start|>system' || chr(10) || level || '<|im_end|>' || chr(10) || array_to_string(list_transform(m, lambda x, i: '<|im_start|>' || x.role || chr(10) || CASE WHEN i = u AND NOT contains(x.content, '/no_think') THEN '/no_think ' ELSE '' END || x.content || '<|im_end|>' || chr(10)), '') || '<|im_start|>assistant' || chr(10) AS prompt, c AS chosen, 'No. ' || repeat('x', 900) AS rejected FROM g WHERE u > 0)
SELECT id, prompt, chosen FROM r WHERE length(prompt) + greatest(length(chosen), length(rejected)) <= 3072""")
def preference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered preference rows; the longer side counts in the length guard."""
    last = F.get("messages", F.size("messages") - 1)
    d = E.dialogues(spark, sf_dir).select("id", "level", F.col("messages").alias("prompt_messages"), last.alias("chosen"), F.struct(F.lit("assistant").alias("role"), F.concat(F.lit("No. "), F.repeat(F.lit("x"), F.lit(900))).alias("content")).alias("rejected"))
    return V.preference_rows(d, F.col("level"), 512).select("id", "prompt", "chosen")


#: White-space tokens of the chat text, the end marker of a turn being one; the last turn is cut open for every third dialogue.
_CHAT = "array_to_string(list_transform(messages, lambda m: '<|im_start|> ' || m.role || ' ' || m.content || ' <|im_end|> '), '')"


@query(D + f""", c AS (SELECT id, CASE WHEN conv_id % 3 = 0 THEN regexp_replace({_CHAT}, ' <\\|im_end\\|> $', '') ELSE {_CHAT} END AS t FROM dialogues), k AS (SELECT id, regexp_extract_all(t, '[^ \\t\\n\\r\\f\\v]+') AS k FROM c),
p AS (SELECT id, unnest(k) AS tok, unnest(range(len(k))) AS i, unnest(list_transform(k, lambda x, j: j > 2 AND k[j - 2] = '<|im_start|>' AND k[j - 1] = 'assistant')) AS opens FROM k),
s AS (SELECT *, max(CASE WHEN opens THEN i END) OVER w AS o, max(CASE WHEN tok = '<|im_end|>' THEN i END) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM p WINDOW w AS (PARTITION BY id ORDER BY i)),
m AS (SELECT id, count(*) AS n_tokens, count(*) FILTER (o IS NOT NULL AND (e IS NULL OR e < o)) AS n_trained, bool_or(opens) AS any_open FROM s GROUP BY 1)
SELECT id, n_tokens::INT AS n_tokens, n_trained::INT AS n_trained FROM m WHERE any_open AND n_tokens <= 200""")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3, V4: token spans of assistant turns; dialogues without any are errors, long ones are skipped."""
    chat = F.array_join(F.transform("messages", lambda m: F.concat(F.lit("<|im_start|> "), m["role"], F.lit(" "), m["content"], F.lit(" <|im_end|> "))), "")
    text = F.when(F.expr("conv_id % 3 = 0"), F.regexp_replace(chat, r" <\|im_end\|> $", "")).otherwise(chat)
    d = E.dialogues(spark, sf_dir).select("id", F.regexp_extract_all(text, F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0)).alias("tokens"))
    kept, _ = V.tokenised(d.withColumn("mask", V.span_mask(F.col("tokens"), ["<|im_start|>", "assistant"], "<|im_end|>")), "tokens", "mask", 200)
    return kept.select("id", F.size("tokens").alias("n_tokens"), F.aggregate("mask", F.lit(0), lambda s, x: s + x).alias("n_trained"))


@query(PIPED + """ SELECT count(*) AS n_samples, """ + ", ".join(f"round(avg((f <> {k})::INT), 6) AS {n}" for k, n in enumerate(["non_latin_script", "banned_terms", "mode_consistency", "naturalness"], 1)) + " FROM piped")
def filter_pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: pass rates per filter over sampled generations."""
    rates = V.filter_pass_rates(_piped(spark, sf_dir))
    return rates.select("n_samples", *[F.round(c, 6).alias(c) for c in rates.columns[1:]])


@query(D + f" SELECT id, {_J.format(x='list_slice(messages, 1, 4)')} AS dialogue FROM dialogues WHERE len(list_filter(messages, lambda m: m.role = 'user')) >= 2")
def simulated_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD7: a hold-out of two user turns simulated from recorded replies, the second of them the probe's."""
    from talkloom.operators import responders as RE

    d = E.dialogues(spark, sf_dir)
    d = d.where(F.size(F.filter("messages", lambda m: m["role"] == "user")) >= 2)
    said = lambda i: d.select("id", F.get("messages", F.lit(i))["role"].alias("r"), F.get("messages", F.lit(i))["content"].alias("text"))
    plain = d.select("id", F.lit("s").alias("system"), "messages")
    state = plain.select("id", F.slice("messages", 1, 4).alias("messages"))
    # what each side says next is looked up by how much has been said
    turn = lambda p: p.join(plain.select("id", F.col("messages").alias("all")), "id").select("id", F.get("all", F.size("messages"))["content"].alias("text")).where("text is not null")
    out = RE.simulate(plain.select("id", "system"), turn, turn, turn, user_turns=2, probe_at=1)
    roles = state.select("id", F.transform("messages", lambda m: m["role"]).alias("roles"))
    named = F.transform("messages", lambda m, i: F.struct(F.get("roles", i).alias("role"), m["content"].alias("content")))
    return out.join(roles, "id").select("id", _joined(named).alias("dialogue"))


@query()
def near_no_op_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a marker's removal is too small a change, by axis limit."""
    t = E.turns(spark, sf_dir).where("role = 'assistant'")
    axis = F.expr("CASE conv_id % 3 WHEN 0 THEN 'off_topic' WHEN 1 THEN 'accuracy_error' ELSE 'other' END")
    from talkloom.functions import text as T

    return t.select("conv_id", "turn", axis.alias("axis"), DD.near_no_op(T.strip_marker(F.col("content")), F.col("content"), axis).alias("no_op"))


_SETUP = "CASE WHEN doc_id % 3 = 0 THEN 'raw' ELSE 'trimmed' END"


@query(REC + f", p(condition, stream, origin) AS (VALUES ('a1', 'normal', 'raw'), ('a1', 'redirect', 'raw'), ('a2', 'normal', 'raw'), ('a2', 'redirect', 'trimmed')), r AS (SELECT *, {_SETUP} AS origin FROM records) SELECT condition, r.stream, count(*) AS n FROM r JOIN p ON p.stream = r.stream AND p.origin = r.origin GROUP BY 1, 2")
def condition_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of each ablation condition, by stream and origin."""
    plan = spark.createDataFrame([("a1", "normal", "raw"), ("a1", "redirect", "raw"), ("a2", "normal", "raw"), ("a2", "redirect", "trimmed")], "condition string, stream string, origin string")
    r = E.records(spark, sf_dir).withColumn("origin", F.expr(_SETUP))
    return r.join(plan, ["stream", "origin"]).groupBy("condition", "stream").agg(F.count(F.lit(1)).alias("n"))


@query(D + " SELECT id, len(list_filter(messages, lambda m: m.role <> 'system')) = 4 AS exact, len(list_filter(messages, lambda m: m.role = 'assistant' AND contains(m.content, '[SESSION_END'))) = 1 AND len(list_filter(messages, lambda m: m.role <> 'assistant' AND contains(m.content, '[SESSION_END'))) = 0 AS one_marker FROM dialogues")
def check_marker_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exactly so many messages, and the marker in exactly one tutor turn."""
    exact, one = FL.marker_structure(F.col("messages"), 4)
    return E.dialogues(spark, sf_dir).select("id", exact.alias("exact"), one.alias("one_marker"))


@query(TURNS + " SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN CASE WHEN contains(content, '/think') OR contains(content, '/no_think') THEN content ELSE '/no_think ' || content END ELSE content END AS content FROM turns WHERE role = 'user'")
def thinking_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directive before prompts of models that think, unless one is there."""
    t = E.turns(spark, sf_dir).where("role = 'user'")
    mode = F.expr("CASE WHEN conv_id % 2 = 0 THEN 'off' ELSE 'unsupported' END")
    return t.select("conv_id", "turn", Q.thinking_prefix(F.col("content"), mode).alias("content"))
