"""Registered queries over probes, names and marker pairs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkloom.functions import hashing as H
from talkloom.functions import text as T
from talkloom.operators import curation as C
from talkloom.operators import extraction as X
from talkloom.operators import probes as P
from talkloom.operators import scoring as SC
from talkloom.operators import turns as Q
from talkloom.plans import entities as E
from talkloom.plans.dialogue_queries import _J, MARK, _joined
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


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


#: Word boundaries differ between engines outside ASCII, so names are looked for in texts whose other characters are x.
def _ascii(c: str):
    return F.regexp_replace(c, r"[^\x00-\x7F]", "x")


_PLAIN = r"regexp_replace({x}, '[^\x00-\x7F]', 'x', 'g')"
#: Names put into documents by id (fixed values of the entity).
NAMED = """concat(CASE doc_id % 6 WHEN 0 THEN 'The Old Bridge in Lin Mei. ' WHEN 1 THEN 'Today Maria-Jose O''Hara met us. ' WHEN 2 THEN 'In Naqsh-e Jahan Square they speak French. ' WHEN 3 THEN 'Absolutely! WeChat is English-only. ' ELSE '' END, {text})"""
_NAMED_SQL = "named AS (SELECT doc_id, source, " + NAMED.format(text=_PLAIN.format(x="coalesce(text, '')")) + " AS t FROM documents)"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "x").alias("text"))
    return d.select("doc_id", "source", F.expr(NAMED.format(text="text")).alias("t"))


_STOP, _CITY = _list(X.SENTENCE_OPENERS), _list(X.CITY_STOPWORDS)
_NOUNS = "list_filter(regexp_extract_all(t, '\\b([A-Z][a-zA-Z''\\-]{1,}(?:[\\s\\-][A-Z][a-zA-Z''\\-]+){0,3})\\b', 1), lambda x: length(x) >= 3 AND NOT list_contains(" + _STOP + ", lower(regexp_extract(x, '^\\S+'))))"


@query("WITH " + _NAMED_SQL + f", n AS (SELECT doc_id, unnest({_NOUNS}) AS name FROM named) SELECT name, regexp_matches(name, '\\s') AS place, count(*) AS n FROM n GROUP BY 1, 2")
def name_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each person or place is named."""
    n = _named(spark, sf_dir).select(F.explode(X.proper_nouns(F.col("t"))).alias("name"))
    return n.groupBy("name", (~X.is_person(F.col("name"))).alias("place")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + _NAMED_SQL + f", c AS (SELECT doc_id, list_filter(regexp_extract_all(t, '\\b([A-Z][a-zA-Z''\\-]+(?:\\s[A-Z][a-zA-Z''\\-]+){{0,3}})\\b', 1), lambda x: NOT list_contains({_CITY}, lower(regexp_extract(x, '^\\S+'))))[1] AS city FROM named) SELECT doc_id, city FROM c")
def city_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("doc_id", X.city_guess(F.col("t")).alias("city"))


LANGUAGES, OPENERS = ["english", "french", "mandarin"], ["absolutely", "precision", "great"]
KNOWN = {"china": ["wechat", "lin mei"], "italy": ["naqsh-e jahan square"]}
_LOC = "CASE doc_id % 3 WHEN 0 THEN 'china' WHEN 1 THEN 'italy' ELSE 'japan' END"
_KNOWN_SQL = "CASE doc_id % 3 " + " ".join(f"WHEN {i} THEN {_list(KNOWN[k])}" for i, k in enumerate(KNOWN)) + " ELSE [] END"


@query("WITH " + _NAMED_SQL + f""", e AS (SELECT doc_id, name, i FROM (SELECT doc_id, unnest({_NOUNS}) AS name, unnest(range(len({_NOUNS}))) AS i FROM named)
  WHERE NOT list_contains({_list(LANGUAGES + OPENERS)}, lower(name)) AND NOT regexp_matches(lower(name), '^({"|".join(LANGUAGES)})-(only|first|speaking|language)$') AND NOT list_contains({_KNOWN_SQL}, lower(name)))
SELECT doc_id, list(name ORDER BY i) AS entities FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY i) AS r FROM e) WHERE r = 1 GROUP BY 1""")
def locale_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.create_map(*[x for k, v in KNOWN.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])[F.expr(_LOC)]
    d = _named(spark, sf_dir).select("doc_id", X.locale_entities(F.array("t"), LANGUAGES, OPENERS, known).alias("entities"))
    return d.where(F.size("entities") > 0)


TERMS = ["Lin Mei", "WeChat", "Naqsh-e Jahan Square"]


@query("WITH " + _NAMED_SQL + f""", n AS (SELECT doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(t, '\\b([A-Z][a-zA-Z''\\-]{{1,}}(?:[\\s\\-][A-Z][a-zA-Z''\\-]+)*)\\b', 1), lambda x: lower(regexp_replace(x, '^(?:[Tt]he|THE|[Aa]|[Aa]n)\\s+', ''))), lambda x: length(x) >= 3 AND NOT list_contains({_STOP}, regexp_extract(x, '^\\S+')))) AS names FROM named)
SELECT doc_id, round(CASE WHEN len(names) = 0 THEN 1 ELSE len(list_filter(names, lambda x: list_contains({_list([t.lower() for t in TERMS])}, x))) / len(names) END, 6) AS fidelity FROM n""")
def locale_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: against a locale's terms."""
    return _named(spark, sf_dir).select("doc_id", F.round(X.fidelity(F.col("t"), TERMS), 6).alias("fidelity"))


#: Foods in documents by id; what is mentioned follows from the wording.
FOOD = "CASE doc_id % 5 WHEN 0 THEN 'We had Ash Reshteh, then ash.' WHEN 1 THEN 'Ashes and a hot dog; hotdog!' WHEN 2 THEN 'rice' WHEN 3 THEN 'fried rice with rice, price' ELSE 'none' END"


@query("""SELECT term, count(*) AS n FROM (SELECT unnest(CASE doc_id % 5 WHEN 0 THEN ['ash reshteh', 'ash'] WHEN 1 THEN ['hot dog'] WHEN 2 THEN ['rice'] WHEN 3 THEN ['fried rice', 'rice'] ELSE [] END) AS term FROM documents) GROUP BY 1""")
def food_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.mentions(["ash", "Ash reshteh", "rice", "fried rice", "hot dog"])
    d = table(spark, sf_dir, "documents").select(F.explode(found(F.expr(FOOD))).alias("term"))
    return d.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT doc_id, regexp_replace(lower(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '', 'g') || 'full1fi' AS folded FROM documents")
def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compatibility forms become ASCII, other scripts go."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "")
    return table(spark, sf_dir, "documents").select("doc_id", X.normalised(F.concat(plain, F.lit(" Ｆｕｌｌ ① ﬁ 你"))).alias("folded"))


#: Turns that ask or pivot, by id (fixed values of the entity).
ASKED = """CASE WHEN role = 'user' AND (conv_id + turn) % 5 = 1 THEN concat(content, ' How do you say it? ') WHEN role = 'user' AND (conv_id + turn) % 5 = 2 THEN concat(content, ' What''s the rule for of?')
  WHEN role = 'assistant' AND (conv_id + turn) % 4 = 0 THEN concat('Oh, interesting! ', content) WHEN role = 'assistant' AND (conv_id + turn) % 4 = 1 THEN concat(content, ' Have you tried jianbing?') ELSE content END"""


@query(TURNS + f", a AS (SELECT conv_id, turn, role, {ASKED} AS content FROM turns) SELECT conv_id, max(turn) FILTER (role = 'user' AND (conv_id + turn) % 5 IN (1, 2))::INT AS ask, min(turn) FILTER (role = 'assistant' AND ((conv_id + turn) % 4 IN (0, 1) OR contains(content, 'By the way, have you')))::INT AS pivot FROM a GROUP BY 1")
def asks_and_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ask for grammar and the first pivot of a dialogue."""
    t = E.turns(spark, sf_dir).withColumn("content", F.expr(ASKED))
    ask = (F.col("role") == "user") & F.col("content").rlike("(?i)" + X.GRAMMAR_ASK)
    pivot = (F.col("role") == "assistant") & X.shows_pivot(F.col("content"))
    return t.groupBy("conv_id").agg(F.max(F.when(ask, F.col("turn"))).cast("int").alias("ask"), F.min(F.when(pivot, F.col("turn"))).cast("int").alias("pivot"))


@query(D + f""", a AS (SELECT conv_id, id, list_transform(messages, lambda m, i: CASE WHEN m.role = 'user' AND (conv_id + i - 1) % 5 IN (1, 2) THEN i - 1 END) AS asks, messages FROM dialogues), l AS (SELECT *, list_max(asks)::INT AS ask_turn FROM a)
SELECT 'ped_' || id AS id, ask_turn, {_J.format(x='list_slice(messages, 1, ask_turn + 1)')} AS context FROM l WHERE ask_turn >= 1 AND ('0x' || substr(sha256(substr(id, 5)), 1, 8))::BIGINT % 100 >= 30""")
def probe_pedagogy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q12, J-18: dialogues whose seeds no probe uses yet, cut after the last ask for grammar."""
    d = E.dialogues(spark, sf_dir)
    asked = F.transform("messages", lambda m, i: F.struct(m["role"].alias("role"), F.when((m["role"] == "user") & ((F.col("conv_id") + i) % 5).isin(1, 2), F.lit("How do you say it?")).otherwise(F.lit("")).alias("content")))
    d = d.withColumn("ask_turn", X.last_grammar_ask(asked)).withColumn("seed", C.seed_id(F.col("id")))
    used = d.select("seed").where(H.in_pool(F.col("seed"), 30)).distinct()
    fresh = d.join(used, "seed", "left_anti").where("ask_turn >= 1")
    return fresh.select(F.concat(F.lit("ped_"), "id").alias("id"), "ask_turn", _joined(Q.prefix(F.col("messages"), F.col("ask_turn") + 1)).alias("context"))


@query(D + ", p AS (SELECT id, level, list_filter(messages, lambda m: m.role = 'user') AS u FROM dialogues WHERE ('0x' || substr(sha256(substr(id, 5)), 1, 8))::BIGINT % 100 < 20 AND coalesce(locale, 'china') = 'china') SELECT 'leak_' || id AS id, level, u[1].content AS opening FROM p WHERE len(u) > 0")
def probe_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.dialogues(spark, sf_dir).where(H.in_pool(C.seed_id(F.col("id")), 20) & (F.coalesce("locale", F.lit("china")) == "china"))
    return d.select(F.concat(F.lit("leak_"), "id").alias("id"), "level", F.get(T.contents(F.col("messages"), "user"), F.lit(0)).alias("opening")).where("opening is not null")


#: Streams of the dialogues that hold a late marker.
_AXES = ["redirect", "persona_redirect", "country_taboo"]
_AX = _list(_AXES)
_LEVEL = "CASE WHEN conv_id % 24 < 12 THEN 'A1' ELSE 'B1' END"
VIOL = MARK + f", e AS (SELECT id, {_LEVEL} AS level, stream, messages, s, messages[s - 4].content AS v FROM located WHERE s >= 5 AND list_contains({_AX}, stream) AND messages[s - 4].role = 'user')"


@query(VIOL + " SELECT id, s::INT AS marker_index, v AS violation FROM e")
def first_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.dialogues(spark, sf_dir).where(F.col("stream").isin(_AXES)).withColumn("marker_index", Q.marker_index(F.col("messages")))
    return d.select("id", "marker_index", P.first_violation(F.col("messages"), F.col("marker_index"))["content"].alias("violation")).where("violation is not null")


@query(VIOL + f""", p AS (SELECT stream AS other, level, list(v ORDER BY v, id) AS pool FROM e GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY stream, level ORDER BY id) - 1 AS k FROM e),
c AS (SELECT k.id, list({{'other': other, 'v': pool[k % len(pool) + 1]}} ORDER BY list_position({_AX}, other)) AS cand FROM k JOIN p ON p.level = k.level AND p.other <> k.stream GROUP BY 1),
x AS (SELECT k.*, cand[k % len(cand) + 1] AS pick FROM k JOIN c USING (id) WHERE k < 8)
SELECT id, level, stream AS axis, pick.other AS distractor_axis, condition, 'user: ' || pick.v || chr(10) || 'assistant: {P.BENIGN}' || chr(10) || {_J.format(x='list_slice(messages, 1, s - back)')} AS context FROM x, (VALUES ('fire_correct', 0), ('distractor_sub', 2)) w(condition, back)""")
def probe_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.mixed_probe(E.dialogues(spark, sf_dir).withColumn("level", F.expr(_LEVEL)), _AXES, 8).withColumn("context", _joined(F.col("context")))


#: Recorded generations of the mixed probe, by id.
_AXIS = "CASE doc_id % 4 WHEN 0 THEN 'off_topic' WHEN 1 THEN 'language_violation' WHEN 2 THEN 'persona_break' ELSE 'role_swap' END"
_OTHER = "CASE doc_id % 4 WHEN 0 THEN 'role_swap' WHEN 1 THEN 'off_topic' WHEN 2 THEN 'language_violation' ELSE 'persona_break' END"
_COND = "CASE WHEN doc_id % 5 < 3 THEN 'fire_correct' ELSE 'distractor_sub' END"
_GEN = f"""CASE doc_id % 7 WHEN 0 THEN 'Go on.' WHEN 1 THEN concat('End. [SESSION_END: ', {_AXIS}, ']') WHEN 2 THEN concat('[SESSION_END : ', {_OTHER}, ' ] bye') WHEN 3 THEN 'Bye [SESSION_END]'
  WHEN 4 THEN '[SESSION_END: elsewhere]' WHEN 5 THEN concat(text, '') ELSE concat('[SESSION_END:', {_AXIS}, ']') END"""


@query(f"""WITH r AS (SELECT source, {_COND} AS condition, doc_id % 7 AS g FROM documents) SELECT source, count(*) FILTER (condition = 'fire_correct') AS fire_n,
  round(count(*) FILTER (condition = 'fire_correct' AND g IN (1, 2, 3, 4, 6)) / nullif(count(*) FILTER (condition = 'fire_correct'), 0), 4) AS fire_rate,
  round(count(*) FILTER (condition = 'fire_correct' AND g IN (1, 6)) / nullif(count(*) FILTER (condition = 'fire_correct' AND g IN (1, 2, 4, 6)), 0), 4) AS correct_axis_rate,
  round(count(*) FILTER (condition = 'fire_correct' AND g = 2) / nullif(count(*) FILTER (condition = 'fire_correct' AND g IN (1, 2, 4, 6)), 0), 4) AS distractor_axis_rate,
  count(*) FILTER (condition = 'fire_correct' AND g = 3) AS no_axis_fires, count(*) FILTER (condition = 'distractor_sub') AS sub_n,
  round(count(*) FILTER (condition = 'distractor_sub' AND g IN (1, 2, 3, 4, 6)) / nullif(count(*) FILTER (condition = 'distractor_sub'), 0), 4) AS premature_rate FROM r GROUP BY 1""")
def mixed_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", F.expr(_COND).alias("condition"), F.expr(_GEN).alias("generation"), F.expr(_AXIS).alias("axis"), F.expr(_OTHER).alias("distractor_axis"))
    return P.mixed_rates(d, ["source"])


@query(f"""WITH r AS (SELECT doc_id, {_AXIS} AS axis, CASE doc_id % 7 WHEN 1 THEN {_AXIS} WHEN 2 THEN {_OTHER} WHEN 4 THEN 'elsewhere' WHEN 6 THEN {_AXIS} END AS named FROM documents)
SELECT axis, count(*) AS n, count(named) AS n_named, round(count(*) FILTER (named = axis) / nullif(count(named), 0), 6) AS accuracy, """ + ", ".join(f"count(*) FILTER (named = '{a}') AS {a}" for a in ("off_topic", "language_violation", "persona_break", "role_swap")) + " FROM r GROUP BY 1")
def attribution_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The axis a marker names against the expected one, zero-filled, with the accuracy over named ones."""
    axes = ["off_topic", "language_violation", "persona_break", "role_swap"]
    named = F.regexp_extract("generation", P.OPEN_AXIS, 1)
    d = table(spark, sf_dir, "documents").select(F.expr(_AXIS).alias("axis"), F.expr(_GEN).alias("generation")).select("axis", F.when(named != "", named).alias("named"))
    right = F.col("named") == F.col("axis")
    return d.groupBy("axis").agg(F.count(F.lit(1)).alias("n"), F.count("named").alias("n_named"), F.round(F.try_divide(F.count_if(right).cast("double"), F.count("named")), 6).alias("accuracy"), *[F.count_if(F.col("named") == a).alias(a) for a in axes])


#: Recorded redirect replies, by id, and the labels they are held against.
_REPLY = "concat(CASE doc_id % 6 WHEN 0 THEN 'I like StarBucks and hot dogs. ' WHEN 1 THEN 'Please speak English with me. ' WHEN 2 THEN 'A hotdog? I understand. ' WHEN 3 THEN '你好 in english ' WHEN 4 THEN 'The weather is fine. ' ELSE '' END, lower(substr(source, 1, 2)))"
_EXPECTED = "CASE (doc_id // 6) % 3 WHEN 0 THEN 'locale' WHEN 1 THEN 'language' ELSE 'topic' END"


@query(f"""WITH r AS (SELECT source AS baseline, doc_id % 6 AS k, {_EXPECTED} AS axis FROM documents WHERE doc_id % 11 <> 0), s AS (SELECT baseline, axis, CASE axis WHEN 'locale' THEN k NOT IN (0, 2) WHEN 'language' THEN k IN (1, 2) ELSE k = 4 END AS ok FROM r)
SELECT baseline, """ + ", ".join(f"round(coalesce(avg(ok::INT) FILTER (axis = '{a}'), 0), 6) AS {a}" for a in ("locale", "language", "topic")) + " FROM s GROUP BY 1")
def redirect_mechanical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-5, A14, R2, R6: replies joined to their expected axis; pass rates per axis, 0 without any."""
    d = table(spark, sf_dir, "documents")
    replies = d.select("doc_id", F.col("source").alias("baseline"), F.expr(_REPLY).alias("reply"))
    expected = d.where("doc_id % 11 <> 0").select("doc_id", F.expr(_EXPECTED.replace("//", "div")).alias("axis"))
    low = F.lower("reply")
    entity = low.rlike(X.optional_hyphens(["Starbucks", "hot-dog", "hot-dogs"]))
    cues = F.exists(F.array(*[F.lit(c) for c in ("english", "your language", "i understand")]), lambda c: low.contains(c))
    words = F.filter(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= 4)
    topic = F.arrays_overlap(words, F.array(F.lit("weather"), F.lit("rain")))
    ok = F.when(F.col("axis") == "locale", ~entity).when(F.col("axis") == "language", ~F.col("reply").rlike(r"[\x{4E00}-\x{9FFF}]") & cues).otherwise(topic)
    r = replies.join(expected, "doc_id").withColumn("ok", ok.cast("int"))
    return r.groupBy("baseline").agg(*[F.round(F.coalesce(F.avg(F.when(F.col("axis") == a, F.col("ok"))), F.lit(0.0)), 6).alias(a) for a in ("locale", "language", "topic")])


@query("""WITH c AS (SELECT source AS baseline, 'judge_' || j AS judge, doc_id % 2 AS part, count(*) FILTER ((doc_id + j) % 3 = 0) AS withheld, count(*) AS n FROM documents, (VALUES (0), (1)) v(j) WHERE NOT (source = 'src1' AND doc_id % 2 = 1) GROUP BY 1, 2, 3),
p AS (SELECT baseline, judge, sum(withheld) AS withheld, sum(n) AS n FROM c GROUP BY 1, 2) SELECT baseline, sum(withheld)::BIGINT AS withheld, sum(n)::BIGINT AS n, round(avg(withheld / nullif(n, 0)), 6) AS mean_rate FROM p GROUP BY 1""")
def pooled_withholding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18, J-20: two probe sets pooled per judge, a missing one counting as 0; the judges' mean."""
    d = table(spark, sf_dir, "documents").where("not (source = 'src1' and doc_id % 2 = 1)")
    rows = d.select(F.col("source").alias("baseline"), "doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    counts = rows.groupBy("baseline", F.concat(F.lit("judge_"), F.col("j").cast("string")).alias("judge"), (F.col("doc_id") % 2).alias("part")).agg(F.count_if((F.col("doc_id") + F.col("j")) % 3 == 0).alias("withheld"), F.count(F.lit(1)).alias("n"))
    keys = counts.select("baseline", "judge").distinct()
    sets = [keys.join(counts.where(F.col("part") == k).drop("part"), ["baseline", "judge"], "left") for k in (0, 1)]
    out = P.pooled_rates(sets[0].unionByName(sets[1]), ["baseline"], "judge")
    return out.withColumn("mean_rate", F.round("mean_rate", 6))


@query(f"SELECT a.axis, coalesce(n.n, 0) AS n FROM (SELECT unnest(['off_topic', 'language_violation', 'persona_break', 'role_swap', 'never']) AS axis) a LEFT JOIN (SELECT {_AXIS} AS axis, count(*) AS n FROM documents GROUP BY 1) n USING (axis)")
def axis_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existing counts per axis, zero-filled."""
    axes = spark.createDataFrame([(a,) for a in ("off_topic", "language_violation", "persona_break", "role_swap", "never")], "axis string")
    counts = table(spark, sf_dir, "documents").groupBy(F.expr(_AXIS).alias("axis")).agg(F.count(F.lit(1)).alias("n"))
    return axes.join(counts, "axis", "left").na.fill(0, ["n"])


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1")
def mean_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of a model's recorded value per group."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query(TURNS + " SELECT conv_id, turn, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS user_number FROM turns")
def user_turn_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.numbered_users(E.turns(spark, sf_dir)).select("conv_id", "turn", "user_number")


@query("WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE length(word) > 4 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS r FROM c) SELECT doc_id, list(word ORDER BY r) AS offenders FROM r WHERE r <= 10 GROUP BY 1")
def top_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).where(F.length("word") > 4)
    return X.top_offenders(w.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n")), "doc_id")


@query("SELECT doc_id, list_transform(list_sort([{'s': doc_id % 5, 'm': 'a'}, {'s': doc_id % 3, 'm': 'b'}, {'s': doc_id % 7, 'm': 'c'}]), lambda x: x.m)[1:2] AS weakest FROM documents")
def weakest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two metrics of the lowest scores, for a reason text."""
    metrics = F.array(*[F.struct((F.col("doc_id") % k).alias("s"), F.lit(m).alias("m")) for m, k in (("a", 5), ("b", 3), ("c", 7))])
    return table(spark, sf_dir, "documents").select("doc_id", F.slice(F.transform(F.array_sort(metrics), lambda x: x["m"]), 1, 2).alias("weakest"))


@query(REC + " SELECT id FROM records WHERE doc_id % 4 <> 0 ORDER BY id LIMIT 50")
def new_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit on work that isn't done yet (the limit is the feature)."""
    r = E.records(spark, sf_dir)
    return r.join(r.where("doc_id % 4 = 0").select("id"), "id", "left_anti").orderBy("id").limit(50).select("id")


@query(REC + ", a AS (SELECT id, 0 AS k, 'redirect' AS origin FROM records WHERE doc_id % 2 = 0 AND stream = 'pedagogy_redirect' UNION ALL SELECT id, 1, 'extra' FROM records WHERE doc_id % 3 = 0 AND stream = 'pedagogy_redirect') SELECT id, arg_min(origin, k) AS origin FROM a GROUP BY 1")
def withholding_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q13: the pedagogy rows of two sets, the first set's where both hold an id."""
    r = E.records(spark, sf_dir).where("stream = 'pedagogy_redirect'")
    both = r.where("doc_id % 2 = 0").select("id", F.lit(0).alias("k"), F.lit("redirect").alias("origin")).unionByName(r.where("doc_id % 3 = 0").select("id", F.lit(1).alias("k"), F.lit("extra").alias("origin")))
    return SC.first_per_key(both, ["id"], ["k"]).select("id", "origin")


@query(MARK + f", f AS (SELECT stream, arg_min(id, list_position({_list(E.LEVELS)}, level) * 1000000 + conv_id) AS id FROM located WHERE s = 5 AND level IN ('A2', 'B2', 'C2') AND ('0x' || substr(sha256(substr(id, 5)), 1, 8))::BIGINT % 100 >= 20 GROUP BY 1) SELECT stream, l.id, array_to_string(list_transform(messages[:s + 1], lambda m, i: CASE WHEN m.role = 'user' THEN 'Learner: ' ELSE 'Tutor: ' || CASE i - 1 - s WHEN 0 THEN '(' || stream || ' strike 3: end) ' WHEN -2 THEN '(' || stream || ' strike 2) ' WHEN -4 THEN '(' || stream || ' strike 1) ' ELSE '(no strike) ' END END || m.content), chr(10)) AS example FROM f JOIN located l USING (id, stream)")
def fewshot_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-17, Q14: per stream the first training dialogue with the marker at a place, by level, written out with strikes."""
    d = E.dialogues(spark, sf_dir).withColumn("s", Q.marker_index(F.col("messages"))).where((F.col("s") == 5) & F.col("level").isin("A2", "B2", "C2") & ~H.in_pool(C.seed_id(F.col("id")), 20))
    rank = F.array_position(F.array(*[F.lit(x) for x in E.LEVELS]), F.col("level"))
    first = SC.first_per_key(d.withColumn("l", rank), ["stream"], ["l", "conv_id"])
    return first.select("stream", "id", P.strike_tally(F.col("messages"), F.col("stream")).alias("example"))


@query(D + f", a AS (SELECT id, messages, nullif(list_position(list_transform(messages, lambda m: contains(m.content, '[SESSION_END')), true), 0) AS p FROM dialogues) SELECT id, coalesce(p < len(messages), false) AS trimmed, {_J.format(x='CASE WHEN coalesce(p < len(messages), false) THEN list_slice(messages, 1, p) ELSE messages END')} AS dialogue FROM a")
def trim_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, cut = P.trim_after_count(F.col("messages"))
    return E.dialogues(spark, sf_dir).select("id", cut.alias("trimmed"), _joined(kept).alias("dialogue"))


#: What metadata says of the marker turn, by id: right, shifted, out of range, missing.
_HINT = "CASE conv_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 99 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 5 END"
_POLICY = "CASE conv_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Bye. [SESSION_END]' ELSE concat('Let us go on, ', conv_id) END"
_ERR = """CASE WHEN h IS NULL THEN 'no marker metadata' WHEN h >= len(messages) THEN 'out of range' WHEN messages[h + 1].role <> 'assistant' THEN 'not the assistant' WHEN NOT contains(messages[h + 1].content, '[SESSION_END') THEN 'no marker in the turn'
  WHEN conv_id % 7 = 0 THEN 'no policy text' WHEN conv_id % 5 = 0 THEN 'empty policy text' WHEN conv_id % 5 = 1 THEN 'policy fired itself' END"""


@query(D + f", x AS (SELECT *, {_HINT}::INT AS h FROM dialogues), y AS (SELECT *, {_ERR} AS error FROM x) SELECT id, error, CASE WHEN error IS NULL THEN {_J.format(x='list_slice(messages, 1, h)')} END AS prompt, CASE WHEN error IS NULL THEN messages[h + 1].content END AS chosen, CASE WHEN error IS NULL THEN {_POLICY} END AS rejected FROM y")
def policy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker pairs against policy texts, and why the others fail."""
    d = E.dialogues(spark, sf_dir)
    policy = d.where("conv_id % 7 <> 0").select("id", F.expr(_POLICY).alias("text"))
    p = P.policy_pairs(d.select("id", "messages", F.expr(_HINT).cast("int").alias("hint"), F.lit("[SESSION_END]").alias("marker")), policy)
    return p.select("id", "error", _joined(F.col("prompt")).alias("prompt"), "chosen", "rejected")


@query(REC + " SELECT error, n FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'a' WHEN doc_id % 5 = 0 THEN 'b' END AS error, count(*) AS n FROM records GROUP BY 1) WHERE error IS NOT NULL")
def failure_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures counted by reason."""
    r = E.records(spark, sf_dir).select(F.expr("CASE WHEN doc_id % 3 = 0 THEN 'a' WHEN doc_id % 5 = 0 THEN 'b' END").alias("error"))
    return r.where("error is not null").groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query(REC + " SELECT id, array_to_string(list_filter([category, nullif(locale, ''), source, CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE level END], lambda p: p IS NOT NULL AND trim(p) <> ''), ' ') AS features FROM records")
def feature_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array(F.col("source"), F.expr("CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE level END"))
    return E.records(spark, sf_dir).select("id", X.feature_text(F.array("category"), F.array("locale"), parts).alias("features"))


@query("SELECT r.id, ['food', 'place', 'brand'][(row_number() OVER (ORDER BY r.id) - 1) % 3 + 1] AS axis FROM (SELECT item_id AS id FROM benchmark) r")
def probe_axis_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes in turn over the scenarios of a hold-out (a bounded set)."""
    axes = F.array(*[F.lit(a) for a in ("food", "place", "brand")])
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    return b.withColumn("r", F.row_number().over(Window.orderBy("id")) - 1).select("id", F.get(axes, (F.col("r") % 3).cast("int")).alias("axis"))
