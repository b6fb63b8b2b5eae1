"""More registered queries over records and dialogues, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkloom.functions import hashing as H
from talkloom.functions import text as T
from talkloom.operators import curation as C
from talkloom.operators import dedup as DD
from talkloom.operators import filters as FL
from talkloom.operators import sampling as S
from talkloom.operators import turns as Q
from talkloom.plans import entities as E
from talkloom.plans.dialogue_queries import _AXIS, _HINT, _J, MARK, VIOLATED, _joined
from talkloom.plans.text_queries import TEXT
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
JUD, DET = "WITH " + E.JUDGED_SQL, "WITH " + E.DETECTIONS_SQL


@query(D + " SELECT id, len(list_filter(messages, lambda m: m.role <> 'system' AND NOT contains(m.content, '<think>')))::INT AS n_kept FROM dialogues")
def clean_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.transform("messages", lambda m: F.struct(F.when(m["role"] != "system", m["role"]).alias("role"), F.when(~m["content"].contains("<think>"), m["content"]).alias("content")))
    return E.dialogues(spark, sf_dir).select("id", F.size(C.clean_messages(blank)).alias("n_kept"))


@query(REC + " SELECT id, level, coalesce(locale, 'china') AS locale FROM records WHERE level IN ('A1', 'B2') AND coalesce(locale, 'china') IN ('china', 'italy')")
def filter_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = E.records(spark, sf_dir).withColumn("locale", F.coalesce("locale", F.lit("china")))
    return r.where(F.col("level").isin("A1", "B2") & F.col("locale").isin("china", "italy")).select("id", "level", "locale")


_VID = "CASE WHEN doc_id % 3 = 0 THEN concat(id, '_v', cast(doc_id % 4 as varchar(9))) WHEN doc_id % 7 = 0 THEN 'no seed' ELSE id END"


@query(REC + f" SELECT doc_id, nullif(regexp_extract(v, '([0-9a-f]{{12}})(?:_v\\d+)?$', 1), '') AS seed, coalesce(nullif(regexp_extract(v, '_(v\\d+)$', 1), ''), 'v0') AS variant FROM (SELECT doc_id, {_VID} AS v FROM records)")
def seed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = E.records(spark, sf_dir).withColumn("v", F.expr(_VID.replace("varchar(9)", "string")))
    return r.select("doc_id", C.seed_id(F.col("v")).alias("seed"), C.variant(F.col("v")).alias("variant"))


#: System prompts by id, with and without the two tells.
_PROMPT = "CASE doc_id % 5 WHEN 0 THEN concat('Be kind. ', '{a}') WHEN 1 THEN concat('{g}', '. Go on.') WHEN 2 THEN concat('{a}', ' {g}') WHEN 3 THEN '' ELSE category END".format(a=C.AXIS_TELL, g=C.GENERIC_TELL)


@query(REC + " SELECT id, ['axis_specific', 'generic', 'MIXED (BUG?)', 'missing', 'neither (BUG?)'][doc_id % 5 + 1] AS label FROM records")
def classify_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.records(spark, sf_dir).select("id", C.classify_prompt(F.expr(_PROMPT)).alias("label"))


@query(REC + " SELECT id, 'Hello.' || CASE WHEN doc_id % 4 > 0 THEN ' My name is ' || source || '.' ELSE '' END || CASE WHEN category <> 'general' THEN ' I want to practice English about ' || category || '.' ELSE '' END AS starter FROM records")
def starter_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, topic = F.expr("CASE WHEN doc_id % 4 > 0 THEN source ELSE '' END"), F.when(F.col("category") != "general", F.col("category"))
    return E.records(spark, sf_dir).select("id", C.starter_turn(name, topic).alias("starter"))


#: Dialogues of five messages by kind: what the second user turn and the tutor's answer are.
_L1 = [
    ("speaks_l1", "I would like to buy two apples, please.", "Of course, here you are.", "no_l1_turn"),
    ("speaks_l1", "I would like to buy two apples, please.", 'You could say in English: "I would like to buy two apples please!"', "english_echo"),
    ("speaks_l1", "I would like to buy two apples, please.", 'In English we would say "May I have some fruit?"', None),
    ("speaks_l1", "我想买两个苹果", 'Let me say it in English: "I would like to buy two apples, please."', None),
    (None, "I would like to buy two apples, please.", 'You could say in English: "I would like to buy two apples, please."', None),
    ("speaks_l1", "Two apples, yes", 'In English, "Two apples"', None),
    ("speaks_l1", "I would like to buy two apples, please.", "In English: ‘I would like to buy two apples, pleases.’", "english_echo"),
]
_SPOKEN = [0]  # kinds without a turn in another script


@query("WITH k AS (SELECT DISTINCT conv_id, conv_id % 7 AS k FROM conversations) SELECT conv_id, k NOT IN (0, 1, 6) AS passed, CASE WHEN k = 4 THEN NULL WHEN k IN (0, 1, 6) THEN 0.0 ELSE 1.0 END::DOUBLE AS score, CASE k WHEN 0 THEN 'no_l1_turn' WHEN 1 THEN 'english_echo' WHEN 6 THEN 'english_echo' END AS reason FROM k")
def filter_l1_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [(k, trigger, [("user", "Hello there" if k in _SPOKEN else "你好"), ("assistant", "Hello!"), ("user", second), ("assistant", answer)]) for k, (trigger, second, answer, _) in enumerate(_L1)]
    made = spark.createDataFrame(kinds, "k int, trigger string, messages array<struct<role: string, content: string>>")
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("k", (F.col("conv_id") % 7).cast("int"))
    return ids.join(made, "k").select("conv_id", FL.l1_sanity(F.col("messages"), F.col("trigger")).alias("r")).select("conv_id", "r.passed", "r.score", "r.reason")


#: The lowest level of a document that holds the word, as a band list gives each word's lowest listed band.
_WORDS = "SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word, list_position(['A1', 'A2', 'B1', 'B2', 'C1', 'C2'], level) - 1 AS band FROM records"
_STOP = "[" + ", ".join(f"'{w}'" for w in DD.STOPWORDS) + "]"
BANDS = D + ", " + E.RECORDS_SQL + f""", bands AS (SELECT word, min(band) AS band FROM ({_WORDS}) GROUP BY 1), texts AS (SELECT id, level, array_to_string(list_transform(list_filter(messages, lambda m: m.role = 'assistant'), lambda m: m.content), chr(10)) AS t FROM dialogues),
w AS (SELECT id, level, unnest(regexp_extract_all(lower(t), '[A-Za-z][A-Za-z''\\-]*')) AS word FROM texts), j AS (SELECT id, word, band > list_position(['A1', 'A2', 'B1', 'B2', 'C1', 'C2'], level) - 1 AS above FROM w JOIN bands USING (word) WHERE NOT list_contains({_STOP}, word)),
k AS (SELECT id, count(*) AS n_known, count(*) FILTER (above) AS n_above FROM j GROUP BY 1), o AS (SELECT id, list(word ORDER BY r) AS offenders FROM (SELECT id, word, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, word) AS r FROM j WHERE above GROUP BY 1, 2) WHERE r <= 10 GROUP BY 1),
r AS (SELECT a.id, a.level, coalesce(n_known, 0) AS n_known, coalesce(n_above, 0) AS n_above, offenders FROM texts a LEFT JOIN k USING (id) LEFT JOIN o USING (id)), q AS (SELECT *, CASE WHEN level = 'C2' OR n_known = 0 THEN 0 ELSE n_above / n_known END AS ratio FROM r)"""


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(x) for x in E.LEVELS]), F.col("level")) - 1
    words = E.records(spark, sf_dir, text=True).select(rank.cast("int").alias("band"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("word"))
    return words.groupBy("word").agg(F.min("band").alias("band"), F.count(F.lit(1)).alias("n_documents"))


@query(BANDS + " SELECT id, n_known, n_above, round(ratio, 6) AS ratio, level = 'C2' OR n_known < 30 OR ratio <= 0.05 AS passed, CASE WHEN level <> 'C2' THEN offenders END AS offenders FROM q")
def filter_cefr_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8, J-11, O3: shares of words above the level, stop-words and unknown words left out, with the ten most frequent offenders."""
    d = E.dialogues(spark, sf_dir)
    bands = _bands(spark, sf_dir).where(~F.col("word").isin(DD.STOPWORDS)).select("word", "band")
    m = C.above_band(d, bands, "id", T.assistant_text(F.col("messages")), offenders=10)
    return m.select("id", "n_known", "n_above", F.round("ratio", 6).alias("ratio"), C.vocabulary_filter(m).alias("passed"), F.when(F.col("level") != "C2", F.col("offenders")).alias("offenders"))


@query(BANDS.replace("lower(t)", "t").replace(f" WHERE NOT list_contains({_STOP}, word)", "") + " SELECT id, n_known, n_above, round(ratio, 6) AS ratio FROM q")
def level_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: the share above the level with words looked up as they are written, no minimum and no stop-words."""
    m = C.above_band(E.dialogues(spark, sf_dir), _bands(spark, sf_dir).select("word", "band"), "id", T.assistant_text(F.col("messages")), lower=False)
    return m.select("id", "n_known", "n_above", F.round("ratio", 6).alias("ratio"))


@query(REC + f", w AS (SELECT DISTINCT doc_id, word, band FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word, list_position(['A1', 'A2', 'B1', 'B2', 'C1', 'C2'], level) - 1 AS band FROM records)) SELECT word, min(band)::INT AS band, count(*) AS n_documents FROM w GROUP BY 1")
def vocab_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word's lowest band, and how many documents hold it."""
    return _bands(spark, sf_dir)


#: Names put into dialogues, what the cache holds of them, and what a judge says of the others.
_TOLD = "concat('We met Anna Bell in Rome. ', CASE conv_id % 4 WHEN 0 THEN 'The Old Town and WeChat and Wechat.' WHEN 1 THEN 'Paris and Rome are English-only.' WHEN 2 THEN 'Nothing else' ELSE 'Paris' END)"
_CACHE = [("rome", "china", "out"), ("rome", "italy", "in"), ("anna bell", "", "in"), ("paris", "italy", "ambiguous"), ("wechat", "china", "in")]


@query("""WITH c AS (SELECT DISTINCT conv_id, conv_id % 4 AS k, CASE WHEN conv_id % 17 = 0 OR conv_id % 3 = 0 THEN 'china' WHEN conv_id % 3 = 1 THEN 'japan' ELSE 'italy' END AS loc FROM conversations),
e AS (SELECT conv_id, loc, unnest(list_concat(['Anna Bell', 'Rome'], CASE k WHEN 0 THEN ['WeChat'] WHEN 1 THEN ['Paris'] WHEN 2 THEN ['Nothing'] ELSE ['Paris'] END)) AS entity FROM c),
v AS (SELECT conv_id, CASE entity WHEN 'Rome' THEN CASE loc WHEN 'china' THEN 'out' WHEN 'italy' THEN 'in' ELSE 'ambiguous' END WHEN 'Anna Bell' THEN CASE WHEN loc = 'china' THEN 'in' ELSE 'ambiguous' END WHEN 'Paris' THEN 'ambiguous' WHEN 'WeChat' THEN CASE WHEN loc = 'china' THEN 'in' ELSE 'ambiguous' END ELSE 'ambiguous' END AS verdict FROM e),
g AS (SELECT conv_id, count(*) AS n, count(*) FILTER (verdict = 'in') AS i, count(*) FILTER (verdict = 'ambiguous') AS a, count(*) FILTER (verdict = 'out') AS n_out FROM v GROUP BY 1)
SELECT conv_id, n, n_out, round((i + 0.7 * a) / n, 6) AS score, (i + 0.7 * a) / n >= 0.5 AND n_out = 0 AS passed FROM g""")
def locale_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6, J-12: entities of the tutor's turns, each with its cached verdict (rows without a locale are the default one's), the others ambiguous."""
    from talkloom.operators import extraction as X
    from talkloom.sources import jsonl

    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    loc = F.expr("CASE WHEN conv_id % 17 = 0 OR conv_id % 3 = 0 THEN 'china' WHEN conv_id % 3 = 1 THEN 'japan' ELSE 'italy' END")
    found = X.locale_entities(F.array(F.expr(_TOLD)), ["english"], [], F.array().cast("array<string>"))
    entities = ids.select("conv_id", loc.alias("locale"), F.explode(found).alias("entity"))
    cache = spark.createDataFrame(_CACHE, "entity string, locale string, verdict string")
    verdicts = jsonl.lookup_verdicts(entities.select("entity", "locale").distinct(), cache).where("verdict is not null")
    return C.locale_scores(entities, verdicts, "conv_id").select("conv_id", "n", "n_out", F.round("score", 6).alias("score"), "passed")


@query(JUD + " SELECT id, coalesce(NOT (('0x' || substr(sha256(id), 1, 8))::BIGINT / 4294967295 < 0.3) OR score IS NULL OR score >= 3, true) AS passed FROM judged WHERE judge = 'judge_a'")
def judge_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = E.judged(spark, sf_dir).where("judge = 'judge_a'")
    return j.select("id", (~H.keep(F.col("id"), 0.3) | F.coalesce(F.col("score") >= 3, F.lit(True))).alias("passed"))


_GOOD, _BAD = C.SCAFFOLD.replace("'", "''"), C.DIRECT_ANSWER.replace("'", "''")


@query(D + f""", t AS (SELECT stream, conv_id, unnest(messages) AS m FROM dialogues), g AS (SELECT stream, count(*) AS n_turns, avg(regexp_matches(m.content, '(?i){_GOOD}')::INT) AS good, avg(regexp_matches(m.content, '(?im){_BAD}')::INT) AS bad FROM t WHERE m.role = 'assistant' AND trim(m.content) <> '' GROUP BY 1),
p AS (SELECT stream, count(*) AS n_raw, count(*) FILTER (conv_id % 5 <> 0) AS n_passed FROM dialogues GROUP BY 1)
SELECT stream, n_raw, n_passed, round(n_passed / n_raw, 6) AS pass_rate, round(coalesce(good, 0), 6) AS positive_rate, round(coalesce(bad, 0), 6) AS negative_rate, n_passed / n_raw >= 0.6 AND coalesce(good, 0) >= 0.5 AND coalesce(bad, 0) <= 0.1 AS ok FROM p LEFT JOIN g USING (stream)""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per stream the share of raw rows that passed, and how often tutor turns show the good and the bad pattern."""
    d = E.dialogues(spark, sf_dir).withColumn("passed", F.col("conv_id") % 5 != 0)
    return C.quality_gate(d, "stream").select("stream", "n_raw", "n_passed", *[F.round(c, 6).alias(c) for c in ("pass_rate", "positive_rate", "negative_rate")], "ok")


@query(D + f", a AS (SELECT stream, len(list_filter(messages, lambda m: regexp_matches(m.content, '{T.DIALECTS['typed']}'))) AS typed, len(list_filter(messages, lambda m: contains(m.content, '[SESSION_END]'))) AS generic FROM dialogues) SELECT stream, count(*) AS n, sum(typed)::BIGINT AS n_typed, sum(generic)::BIGINT AS n_generic, CASE WHEN sum(typed) > 0 AND sum(generic) > 0 THEN 'mixed' WHEN sum(typed) > 0 THEN 'typed' WHEN sum(generic) > 0 THEN 'generic' ELSE 'none' END AS verdict FROM a GROUP BY 1")
def marker_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.dialogues(spark, sf_dir)
    per = d.select("stream", F.size(F.filter("messages", lambda m: m["content"].rlike(T.DIALECTS["typed"]))).alias("t"), F.size(F.filter("messages", lambda m: m["content"].contains("[SESSION_END]"))).alias("g"))
    g = per.groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("n_typed"), F.sum("g").alias("n_generic"))
    t, s = F.col("n_typed") > 0, F.col("n_generic") > 0
    return g.withColumn("verdict", F.when(t & s, "mixed").when(t, "typed").when(s, "generic").otherwise("none"))


#: A recorded second draft of each reply.
_SECOND = "CASE WHEN (conv_id + turn) % 2 = 0 THEN concat('<think>again</think> ', turn) ELSE concat('Second draft ', turn) END"


@query(TURNS + f" SELECT conv_id, turn, CASE WHEN NOT contains(content, '<think>') THEN content WHEN (conv_id + turn) % 2 = 1 THEN {_SECOND} ELSE '{C.FALLBACK}' END AS reply, CASE WHEN NOT contains(content, '<think>') THEN 1 WHEN (conv_id + turn) % 2 = 1 THEN 2 ELSE 3 END AS draft FROM turns WHERE role = 'assistant'")
def guarded_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first draft if it passes, else the recorded second one, else the canned reply."""
    t = E.turns(spark, sf_dir).where("role = 'assistant'")
    reply, draft = C.guarded([F.col("content"), F.expr(_SECOND)], lambda c: ~c.rlike("(?i)</?think"))
    return t.select("conv_id", "turn", reply.alias("reply"), draft.alias("draft"))


@query(D + ", a AS (SELECT id, unnest(list_transform(messages, lambda m, i: {'i': i - 1, 'r': m.role, 'n': len(regexp_extract_all(m.content, '[^ \\t\\n\\r\\f\\v]+'))})) AS x FROM dialogues) SELECT id, arg_min(x.i, -x.n * 100000 + ((('0x' || substr(sha256(id), 1, 8))::BIGINT + x.i) & 65535))::INT AS turn FROM a WHERE x.r = 'assistant' GROUP BY 1")
def pick_turn_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assistant turn of most words, ties by the id's hash."""
    tie = lambda i: (H.number(F.col("id")) + i).bitwiseAND(0xFFFF)
    at = F.filter(F.transform("messages", lambda m, i: F.struct((-T.word_count(m["content"])).alias("n"), tie(i).alias("t"), i.alias("i"), m["role"].alias("r"))), lambda x: x["r"] == "assistant")
    return E.dialogues(spark, sf_dir).select("id", F.array_min(at)["i"].alias("turn")).where("turn is not null")


_AXES = ["register", "accuracy", "locale", "length"]


_PLAIN = r"regexp_replace(content, '[^\x00-\x7F]', 'x', 'g')"


def _applicable() -> F.Column:
    """Over texts whose other characters are x, as word boundaries differ between engines there."""
    return C.applicable_axes(F.regexp_replace("content", r"[^\x00-\x7F]", "x"), _AXES)


@query(TURNS + f", a AS (SELECT conv_id, turn, content, len(list_filter(regexp_extract_all({_PLAIN}, '\\b[A-Z][a-zA-Z]{{2,}}\\b'), lambda x: NOT list_contains({sorted(C.NAME_OPENERS)}, lower(x)))) > 0 AS named FROM turns WHERE role = 'assistant') SELECT conv_id, turn, list_filter(['register', CASE WHEN len(regexp_extract_all(content, '[^ \\t\\n\\r\\f\\v]+')) >= 8 THEN 'accuracy' END, CASE WHEN named THEN 'locale' END, 'length'], lambda a: a IS NOT NULL) AS applicable FROM a")
def applicable_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.turns(spark, sf_dir).where("role = 'assistant'").select("conv_id", "turn", _applicable().alias("applicable"))


_SEEN = SQL["applicable_axes"].removeprefix("WITH ")
_AX = "['register', 'accuracy', 'locale', 'length']"


@query(f"""WITH RECURSIVE seen AS (WITH {_SEEN}), r AS (SELECT turn::VARCHAR AS level, printf('%06d-%02d', conv_id, turn) AS id, applicable, row_number() OVER (PARTITION BY turn ORDER BY conv_id) AS k FROM seen),
walk AS (SELECT DISTINCT level, 0::BIGINT AS k, NULL::VARCHAR AS id, NULL::VARCHAR AS axis, [0, 0, 0, 0] AS c FROM r
  UNION ALL SELECT level, k, id, {_AX}[p], list_transform(c, lambda x, i: CASE WHEN i = p THEN x + 1 ELSE x END)
  FROM (SELECT r.level, r.k, r.id, w.c, list_sort(list_transform(list_filter([1, 2, 3, 4], lambda i: list_contains(r.applicable, {_AX}[i])), lambda i: {{'n': w.c[i], 'i': i}}))[1].i AS p FROM walk w JOIN r ON r.level = w.level AND r.k = w.k + 1))
SELECT level, id, axis FROM walk WHERE k > 0""")
def assign_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = E.turns(spark, sf_dir).where("role = 'assistant'").select(F.col("turn").cast("string").alias("level"), F.format_string("%06d-%02d", "conv_id", "turn").alias("id"), _applicable().alias("applicable"))
    return C.assign_axes(t, "level", "id", _AXES)


_GAZ = {"food": ["pizza", "hot-dog"], "brands": ["starbucks"], "places": ["london", "new york"]}


def _gaz_sql(terms: list[str]) -> str:
    return C.gazetteer_pattern(terms)


@query(TURNS + ", h AS (SELECT conv_id, turn, " + ", ".join(f"len(regexp_extract_all(content, '{_gaz_sql(t)}')) AS {c}" for c, t in _GAZ.items()) + " FROM turns WHERE role = 'assistant') SELECT count(*) AS n, count(*) FILTER (food + brands + places > 0) AS n_leaking, round(avg((food + brands + places > 0)::INT), 6) AS leakage_rate, sum(food)::BIGINT AS food, sum(brands)::BIGINT AS brands, sum(places)::BIGINT AS places FROM h")
def leakage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = E.turns(spark, sf_dir).where("role = 'assistant'").select(*[F.regexp_count("content", F.lit(C.gazetteer_pattern(v))).alias(k) for k, v in _GAZ.items()])
    leaks = F.col("food") + F.col("brands") + F.col("places") > 0
    return t.agg(F.count(F.lit(1)).alias("n"), F.count_if(leaks).alias("n_leaking"), F.round(F.avg(leaks.cast("int")), 6).alias("leakage_rate"), *[F.sum(k).alias(k) for k in _GAZ])


@query(DET + ", g AS (SELECT 'violations' AS kind, (doc_id % 4)::BIGINT AS value, fired FROM detections UNION ALL SELECT 'turn', position::BIGINT, fired FROM detections) SELECT kind, value, count(*) AS n, count(*) FILTER (fired) AS n_fired, round(avg(fired::INT), 4) AS rate, row_number() OVER (PARTITION BY kind ORDER BY value NULLS LAST)::INT AS place FROM g GROUP BY 1, 2")
def premature_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by violation count and by turn, each in order with the missing value last."""
    d = E.detections(spark, sf_dir)
    pairs = F.array(F.struct(F.lit("violations").alias("kind"), (F.col("doc_id") % 4).cast("long").alias("value")), F.struct(F.lit("turn").alias("kind"), F.col("position").cast("long").alias("value")))
    g = d.select("fired", F.inline(pairs)).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"), F.count_if("fired").alias("n_fired"), F.round(F.avg(F.col("fired").cast("int")), 4).alias("rate"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.col("value").asc_nulls_last())))


@query(JUD + " SELECT baseline, count(*) FILTER (score IS NOT NULL) AS n_valid, count(*) FILTER (score IS NULL) AS n_errors, round(count(*) FILTER (score >= 4) / nullif(count(score), 0), 6) AS rate, round(sum(score) / nullif(count(score), 0), 6) AS pooled FROM judged GROUP BY 1")
def withholding_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("score")
    return E.judged(spark, sf_dir).groupBy("baseline").agg(F.count(s).alias("n_valid"), F.count_if(s.isNull()).alias("n_errors"), F.round(F.try_divide(F.count_if(s >= 4), F.count(s)), 6).alias("rate"), F.round(F.try_divide(F.sum(s), F.count(s)), 6).alias("pooled"))


@query(TEXT + ", n AS (SELECT level, len(regexp_extract_all(t, '[^ \\t\\n\\r\\f\\v]+')) AS w FROM assistant) SELECT level, min(w)::INT AS shortest, list_sort(list(w))[count(*)::INT // 2 + 1]::INT AS median, max(w)::INT AS longest, count(*) FILTER (w > 60) AS n_over FROM n GROUP BY 1")
def length_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = E.dialogues(spark, sf_dir).select("level", T.word_count(T.assistant_text(F.col("messages"))).alias("w"))
    # a histogram of lengths, cumulated: the upper median is the first length beyond half the rows
    h = n.groupBy("level", "w").agg(F.count(F.lit(1)).alias("c"))
    level = Window.partitionBy("level")
    h = h.withColumn("upto", F.sum("c").over(level.orderBy("w"))).withColumn("half", F.floor(F.sum("c").over(level) / 2))
    over = F.coalesce(F.sum(F.when(F.col("w") > 60, F.col("c"))), F.lit(0))
    return h.groupBy("level").agg(F.min("w").alias("shortest"), F.min(F.when(F.col("upto") > F.col("half"), F.col("w"))).alias("median"), F.max("w").alias("longest"), over.alias("n_over"))


@query(REC + ", r AS (SELECT *, CASE WHEN doc_id % 5 <> 4 THEN 5 + 2 * (doc_id % 5) END AS position FROM records), g(stream, level) AS (SELECT * FROM (SELECT unnest(" + str(E.STREAMS) + ")), (SELECT unnest(" + str(E.LEVELS) + "))) SELECT 'axis' AS section, g.stream || '|' || g.level AS cell, count(r.id) AS n FROM g LEFT JOIN r ON r.stream = g.stream AND r.level = g.level GROUP BY g.stream, g.level UNION ALL SELECT 'position', position::VARCHAR, count(*) FROM r WHERE position IS NOT NULL GROUP BY position UNION ALL SELECT 'violations', (doc_id % 4) || '|' || position, count(*) FROM r WHERE position IS NOT NULL GROUP BY doc_id % 4, position")
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by axis and level (zero-filled), by position, and by violations and turn."""
    r = E.records(spark, sf_dir).withColumn("position", F.expr("CASE WHEN doc_id % 5 <> 4 THEN 5 + 2 * (doc_id % 5) END"))
    grid = spark.createDataFrame([(f"{a}|{b}",) for a in E.STREAMS for b in E.LEVELS], "cell string")
    axis = grid.join(r.groupBy(F.concat_ws("|", "stream", "level").alias("cell")).agg(F.count(F.lit(1)).alias("n")), "cell", "left").na.fill(0, ["n"]).select(F.lit("axis").alias("section"), "cell", "n")
    at = r.where("position is not null")
    position = at.groupBy(F.col("position").cast("string").alias("cell")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("position").alias("section"), "cell", "n")
    both = at.groupBy(F.concat_ws("|", (F.col("doc_id") % 4).cast("string"), F.col("position").cast("string")).alias("cell")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("violations").alias("section"), "cell", "n")
    return axis.unionByName(position).unionByName(both)


@query(D + ", u AS (SELECT id, messages, list_filter(list_transform(messages, lambda m, i: CASE WHEN m.role = 'user' THEN i END), lambda i: i IS NOT NULL)[2] AS k FROM dialogues), n AS (SELECT id, messages[k + 1].content AS reply FROM u WHERE messages[k + 1].role = 'assistant'), w AS (SELECT *, len(regexp_extract_all(reply, '[^ \\t\\n\\r\\f\\v]+')) AS w FROM n) SELECT id, w >= 8 AND NOT regexp_matches(reply, '" + C.gazetteer_pattern(["pizza"]) + "') AND (contains(lower(reply), 'the') OR w <= 60) AS success FROM w")
def redirect_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: the reply behind the second user turn."""
    d = E.dialogues(spark, sf_dir).select("id", Q.reply_after_user(F.col("messages"), 1).alias("reply")).where("reply is not null")
    return d.select("id", C.redirect_success(F.col("reply"), C.gazetteer_pattern(["pizza"]), ["The"]).alias("success"))


@query(DET + ", g AS (SELECT baseline, avg(fired::INT) AS fire_rate, avg(should_fire::INT) AS expected_rate, count(*)::DOUBLE AS n_examples FROM detections GROUP BY 1) SELECT baseline || '.' || m AS path, round(v, 6) AS value FROM (SELECT baseline, 'fire_rate' AS m, fire_rate AS v FROM g UNION ALL SELECT baseline, 'expected_rate', expected_rate FROM g UNION ALL SELECT baseline, 'n_examples', n_examples FROM g)")
def metric_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = E.detections(spark, sf_dir).groupBy("baseline").agg(F.avg(F.col("fired").cast("int")).alias("fire_rate"), F.avg(F.col("should_fire").cast("int")).alias("expected_rate"), F.count(F.lit(1)).alias("n_examples"))
    return C.metric_paths(g, "baseline", ["fire_rate", "expected_rate", "n_examples"]).withColumn("value", F.round("value", 6))


@query(REC + ", l AS (SELECT id, CASE WHEN doc_id % 3 = 0 THEN 'own' WHEN doc_id % 3 = 1 THEN '' END AS c, doc_id FROM records), p AS (SELECT id, category AS c FROM records WHERE doc_id % 2 = 0) SELECT l.id, coalesce(nullif(l.c, ''), p.c, '') AS context FROM l LEFT JOIN p USING (id)")
def probe_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = E.records(spark, sf_dir)
    generations = r.select("id", F.expr("CASE WHEN doc_id % 3 = 0 THEN 'own' WHEN doc_id % 3 = 1 THEN '' END").alias("c"))
    probes = r.where("doc_id % 2 = 0").select("id", F.col("category").alias("p"))
    return generations.join(probes, "id", "left").select("id", F.coalesce(F.nullif("c", F.lit("")), "p", F.lit("")).alias("context"))


@query(D + ", c AS (SELECT id, level, coalesce(locale, 'china') AS locale, messages FROM dialogues WHERE len(messages) >= 4 AND messages[1].role = 'user') SELECT level, locale, min(id) AS donor FROM c GROUP BY 1, 2")
def leadin_donor(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.dialogues(spark, sf_dir).withColumn("locale", F.coalesce("locale", F.lit("china")))
    return d.where((F.size("messages") >= 4) & (F.get("messages", F.lit(0))["role"] == "user")).groupBy("level", "locale").agg(F.min("id").alias("donor"))


@query(REC + ", s AS (SELECT level, stream, min(id) AS m FROM records GROUP BY 1, 2), o AS (SELECT a.level, a.stream, list(b.m ORDER BY b.m) AS others FROM s a JOIN s b ON a.level = b.level AND a.stream <> b.stream GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY level, stream ORDER BY id) - 1 AS k FROM records) SELECT r.id, others[(k % len(others))::INT + 1] AS distractor FROM r JOIN o USING (level, stream)")
def distractor_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    r = E.records(spark, sf_dir)
    firsts = r.groupBy("level", "stream").agg(F.min("id").alias("m"))  # one row per level and stream
    others = firsts.alias("a").join(firsts.alias("b"), (F.col("a.level") == F.col("b.level")) & (F.col("a.stream") != F.col("b.stream"))).groupBy("a.level", "a.stream").agg(F.sort_array(F.collect_list("b.m")).alias("others"))
    k = F.row_number().over(Window.partitionBy("level", "stream").orderBy("id")) - 1
    return r.withColumn("k", k).join(others, ["level", "stream"]).select("id", F.get("others", (F.col("k") % F.size("others")).cast("int")).alias("distractor"))


_WIN = "CASE WHEN score IS NULL THEN 'garbled' WHEN score > 3 THEN 'a' WHEN score < 3 THEN 'b' ELSE 'tie' END"


@query(JUD + f", v AS (SELECT id, {_WIN} AS winner, score % 4 AS margin, ('0x' || substr(sha256('ab:' || id), 1, 8))::BIGINT % 2 = 0 AS f FROM judged WHERE judge = 'judge_b'), o AS (SELECT id, margin, CASE WHEN winner = 'tie' THEN 'tie' WHEN winner = 'garbled' AND NOT f THEN 'teacher_win' WHEN winner = 'garbled' THEN 'invalid' WHEN (winner = 'a') = f THEN 'teacher_win' ELSE 'policy_win' END AS outcome FROM (SELECT id, margin, f, winner FROM v WHERE winner <> 'garbled')) SELECT id, outcome, outcome = 'teacher_win' AND coalesce(margin, 0) >= 2 AS is_pair FROM o")
def judged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = E.judged(spark, sf_dir).where("judge = 'judge_b'").select("id", F.expr(_WIN).alias("winner"), (F.col("score") % 4).alias("margin")).where("winner <> 'garbled'")
    return C.judged_pairs(v).select("id", "outcome", "is_pair")


_A4 = "['register', 'accuracy', 'locale', 'length']"


#: Recorded rewrites by axis: the text again, a text of its own, or none that parses.
_REWRITE = "CASE WHEN (doc_id + p) % 3 = 0 THEN substr(text, 1, 80) WHEN (doc_id + p) % 7 = 5 THEN NULL ELSE concat('0123 ', axis, ' 456789 #', doc_id) END"


@query(REC + f", c AS (SELECT id, a AS axis, (list_position({_A4}, a) - 1 - doc_id % 4 + 4) % 4 AS d, (doc_id + list_position({_A4}, a) - 1) % 3 <> 0 AND (doc_id + list_position({_A4}, a) - 1) % 7 <> 5 AS valid FROM records, (SELECT unnest({_A4}) AS a) WHERE length(text) > 0) SELECT id, arg_min(axis, d) AS axis, min(d)::INT AS n_skipped FROM c WHERE valid AND d < 3 GROUP BY 1")
def register_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three axes from the assigned one on, the first whose rewrite parses and changes the text."""
    axes = F.array(*[F.lit(a) for a in _AXES])
    r = E.records(spark, sf_dir, text=True).where("length(text) > 0").select("id", "doc_id", "text", F.posexplode(axes).alias("p", "axis"), F.get(axes, (F.col("doc_id") % 4).cast("int")).alias("assigned"))
    r = r.withColumn("rewrite", F.expr(_REWRITE))
    changed = F.col("rewrite").isNotNull() & ~DD.near_no_op(F.col("rewrite"), F.substring("text", 1, 80), F.col("axis"))
    return C.first_valid_axis(r.withColumn("valid", changed), "id", _AXES)


@query(D + ", p AS (SELECT id, level, messages, list_filter(messages, lambda m: m.role = 'user') AS u FROM dialogues WHERE ('0x' || substr(sha256(substr(id, 5)), 1, 8))::BIGINT % 100 < 20) SELECT 'cold_' || id AS id, level, u[1].content AS opening FROM p WHERE len(u) > 0")
def probe_cold_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.dialogues(spark, sf_dir).where(H.in_pool(C.seed_id(F.col("id")), 20))
    first = F.get(T.contents(F.col("messages"), "user"), F.lit(0))
    return d.select(F.concat(F.lit("cold_"), "id").alias("id"), "level", first.alias("opening")).where("opening is not null")


@query(VIOLATED + f", c AS (SELECT id, turn, row_number() OVER (PARTITION BY stream, level ORDER BY id) AS r FROM found JOIN dialogues USING (id) WHERE reason IN ('metadata', 'metadata_corrected') AND turn >= 1) SELECT id, turn, {_J.format(x='list_slice(messages, 1, turn + 1)')} AS context FROM c JOIN dialogues USING (id) WHERE r <= 10")
def probe_redirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6: dialogues cut after a violation that metadata names or that was found in its place, ten a stream and level."""
    turn, reason = Q.violation_turn(F.col("messages"), F.expr(_AXIS), F.expr(_HINT).cast("int"))
    d = E.dialogues(spark, sf_dir).withColumn("turn", turn).withColumn("reason", reason).where(F.col("reason").isin("metadata", "metadata_corrected") & (F.col("turn") >= 1))
    return S.cap_per_cell(d, ["stream", "level"], ["id"], 10).select("id", "turn", _joined(Q.prefix(F.col("messages"), F.col("turn") + 1)).alias("context"))


@query(MARK + f" SELECT id, {_J.format(x='messages')} AS dialogue, s IS NOT NULL AS restored FROM located")
def untrim(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.dialogues(spark, sf_dir)
    trimmed = d.select("id", Q.trim_after_marker(F.col("messages")).alias("messages"))
    raw = d.where(Q.marker_index(F.col("messages")).isNotNull()).select("id", F.col("messages").alias("raw"))
    return trimmed.join(raw, "id", "left").select("id", _joined(F.coalesce("raw", "messages")).alias("dialogue"), F.col("raw").isNotNull().alias("restored"))


@query(D + f" SELECT id, {_J.format(x='messages')} AS dialogue FROM dialogues WHERE stream NOT LIKE 'persistent%' UNION ALL SELECT 'a7_' || id, {_J.format(x='list_slice(messages, 1, 2)')} FROM dialogues WHERE stream LIKE 'persistent%'")
def assemble_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.dialogues(spark, sf_dir)
    persistent = F.col("stream").startswith("persistent")
    base = d.where(~persistent).select("id", _joined(F.col("messages")).alias("dialogue"))
    return base.unionByName(d.where(persistent).select(F.concat(F.lit("a7_"), "id").alias("id"), _joined(F.slice("messages", 1, 2)).alias("dialogue")))


_ONCE = "'the '"


@query(TURNS + f" SELECT conv_id, turn, CASE WHEN contains(content, {_ONCE}) THEN substr(content, 1, strpos(content, {_ONCE}) - 1) || 'THE ' || substr(content, strpos(content, {_ONCE}) + 4) ELSE content END AS swapped, contains(content, {_ONCE}) AS changed FROM turns")
def swap_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q22: one block of a prompt for another, the first occurrence only."""
    swapped, changed = Q.swap_once(F.col("content"), "the ", "THE ")
    return E.turns(spark, sf_dir).select("conv_id", "turn", swapped.alias("swapped"), changed.alias("changed"))


@query(REC + f", c AS (SELECT level, coalesce(locale, 'china') AS locale, category, count(*) AS n FROM records WHERE category <> 'general' GROUP BY 1, 2, 3), g AS (SELECT a.level, l.locale, b.category FROM (SELECT unnest({E.LEVELS}) AS level) a, (SELECT unnest({E.LOCALES}) AS locale) l, (SELECT unnest({E.CATEGORIES[:10]}) AS category) b) SELECT g.level, g.locale, g.category, greatest(0, 9 - coalesce(n, 0))::BIGINT AS deficit FROM g LEFT JOIN c USING (level, locale, category) WHERE coalesce(n, 0) < 9 ORDER BY deficit DESC, level, locale, category LIMIT 10")
def worst_deficits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten cells of level, locale and category with the largest shortfalls."""
    counts = E.records(spark, sf_dir).where("category <> 'general'").groupBy("level", F.coalesce("locale", F.lit("china")).alias("locale"), "category", F.lit("sft").alias("pool")).agg(F.count(F.lit(1)).alias("n"))
    grid = E.grid(spark, level=E.LEVELS, locale=E.LOCALES, category=E.CATEGORIES[:10])
    d = S.coverage_deficits(counts, grid, ["level", "locale", "category"], ["sft"], 9, 9)
    return d.where("raw_deficit > 0").orderBy(F.desc("raw_deficit"), "level", "locale", "category").limit(10).select("level", "locale", "category", F.col("raw_deficit").alias("deficit"))


@query(REC + " SELECT level, n.n FROM (SELECT unnest(['A1', 'A2', 'B1', 'B2', 'C1', 'C2', 'D1']) AS level) l LEFT JOIN (SELECT level, count(*) AS n FROM records GROUP BY 1) n USING (level)")
def passed_per_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = spark.createDataFrame([(x,) for x in [*E.LEVELS, "D1"]], "level string")
    return levels.join(E.records(spark, sf_dir).groupBy("level").agg(F.count(F.lit(1)).alias("n")), "level", "left")


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, json_valid(props) AS valid FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.page").alias("page"), F.try_parse_json("props").isNotNull().alias("valid"))
