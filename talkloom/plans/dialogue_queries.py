"""Registered queries over dialogues, pairs and duplicates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkloom.functions import text as T
from talkloom.operators import dedup as DD
from talkloom.operators import extraction as X
from talkloom.operators import sampling as S
from talkloom.operators import scoring as SC
from talkloom.operators import turns as Q
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


D = "WITH " + E.DIALOGUES_SQL
TURNS = "WITH " + E.TURNS_SQL
REC = "WITH " + E.RECORDS_SQL
_M = r"(?i)\[session_end|\[ended_by_tutor|<session_end"
MARK = D + f", located AS (SELECT *, nullif(list_position(list_transform(messages, lambda m: m.role = 'assistant' AND regexp_matches(m.content, '{_M}')), true), 0) - 1 AS s FROM dialogues)"
_J = "array_to_string(list_transform({x}, lambda m: m.role || ': ' || m.content), chr(10))"


def _joined(c):
    return F.array_join(F.transform(c, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


@query(MARK + " SELECT id, s::INT AS marker_index FROM located")
def marker_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.dialogues(spark, sf_dir).select("id", Q.marker_index(F.col("messages")).alias("marker_index"))


@query(MARK + f" SELECT id, {_J.format(x='CASE WHEN s IS NULL THEN messages ELSE list_slice(messages, 1, s + 1) END')} AS trimmed FROM located")
def trim_after_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.dialogues(spark, sf_dir).select("id", _joined(Q.trim_after_marker(F.col("messages"))).alias("trimmed"))


@query(MARK + f" SELECT id, level, stream, s::INT AS marker_index, {_J.format(x='list_slice(messages, 1, s)')} AS context FROM (SELECT *, row_number() OVER (PARTITION BY stream, level ORDER BY id) AS r FROM located WHERE s >= 2) WHERE r <= 10")
def probe_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.dialogues(spark, sf_dir).withColumn("marker_index", Q.marker_index(F.col("messages"))).where("marker_index >= 2")
    return S.cap_per_cell(d, ["stream", "level"], ["id"], 10).select("id", "level", "stream", "marker_index", _joined(Q.prefix(F.col("messages"), F.col("marker_index"))).alias("context"))


@query(MARK + f" SELECT id, cut, context FROM (SELECT id, p::INT AS cut, {_J.format(x='list_slice(messages, 1, p)')} AS context, row_number() OVER (PARTITION BY level, p ORDER BY id) AS r FROM located, (VALUES (5), (7), (9), (11)) v(p) WHERE s IS NULL AND len(messages) > p) WHERE r <= 5")
def probe_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.dialogues(spark, sf_dir).where(Q.marker_index(F.col("messages")).isNull()).withColumn("cut", F.explode(F.array(*[F.lit(p) for p in (5, 7, 9, 11)])))
    long = S.cap_per_cell(d.where(F.size("messages") > F.col("cut")), ["level", "cut"], ["id"], 5)
    return long.select("id", "cut", _joined(Q.prefix(F.col("messages"), F.col("cut"))).alias("context"))


@query(MARK + f" SELECT id, cut, context FROM (SELECT id, (s - k)::INT AS cut, {_J.format(x='list_slice(messages, 1, s - k)')} AS context, row_number() OVER (PARTITION BY stream, level, k ORDER BY id) AS r FROM located, (VALUES (4), (2)) v(k) WHERE s >= 5 AND messages[s - k].role = 'user') WHERE r <= 10")
def probe_premature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10: contexts cut four and two before the marker, each kind capped by itself."""
    d = E.dialogues(spark, sf_dir).withColumn("s", Q.marker_index(F.col("messages"))).where("s >= 5").withColumn("back", F.explode(F.array(F.lit(4), F.lit(2)))).withColumn("cut", F.col("s") - F.col("back"))
    fit = S.cap_per_cell(d.where(F.get("messages", F.col("cut") - 1)["role"] == "user"), ["stream", "level", "back"], ["id"], 10)
    return fit.select("id", "cut", _joined(Q.prefix(F.col("messages"), F.col("cut"))).alias("context"))


@query(MARK + f", lead AS (SELECT level, coalesce(locale, 'china') AS l, p, list_slice(arg_min(messages, id), 1, 2 * p) AS lead FROM located, (VALUES (1), (2)) v(p) WHERE len(messages) >= 2 * p AND messages[1].role = 'user' GROUP BY 1, 2, 3) SELECT id, (s + 2 * p)::INT AS marker_index, {_J.format(x='list_concat(lead, list_slice(messages, 1, s))')} AS context FROM located a JOIN lead ON a.level = lead.level AND coalesce(a.locale, 'china') = l WHERE s = 5")
def probe_offposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: dialogues with the marker at one place, moved on by one or two donor exchanges (here 5, to 7 and 9; no dialogue of the table reaches 11)."""
    d = E.dialogues(spark, sf_dir).withColumn("locale", F.coalesce("locale", F.lit("china")))
    marked = d.withColumn("s", Q.marker_index(F.col("messages"))).where("s = 5")
    moved = None
    for pairs in (1, 2):
        one = marked.join(Q.donors(d, ["level", "locale"], pairs), ["level", "locale"]).select("id", (F.col("s") + 2 * pairs).alias("marker_index"), _joined(F.concat("lead", Q.prefix(F.col("messages"), F.col("s")))).alias("context"))
        moved = one if moved is None else moved.unionByName(one)
    return moved


#: The axis asked for, by id, and metadata that hints at a turn for half the dialogues.
_AXIS = "CASE conv_id % 6 WHEN 0 THEN 'language' WHEN 1 THEN 'locale' WHEN 2 THEN 'persona' WHEN 3 THEN 'role_swap' WHEN 4 THEN 'pedagogy' ELSE 'topic' END"
_HINT = "CASE WHEN conv_id % 2 = 0 THEN conv_id % 5 END"
_RE2V = {k: v.replace(r"(?!\s+fries)", "").replace(r"(?!\s+food)", "").replace("'", "''") for k, v in Q.VIOLATIONS.items()}
_SHOWS = "CASE ax " + " ".join(f"WHEN '{k}' THEN regexp_matches(m.content, '(?i){v}')" for k, v in _RE2V.items()) + " ELSE true END"
_PIVOTS = X.PIVOT.replace("'", "''")


VIOLATED = D + f""", t AS (SELECT id, messages, {_AXIS} AS ax, {_HINT} AS h FROM dialogues), f AS (SELECT *, coalesce(h < len(messages) AND messages[h + 1].role = 'user', false) AS at_user,
  list_transform(messages, lambda m: m.role = 'user' AND {_SHOWS}) AS shows, list_transform(messages, lambda m, i: m.role = 'assistant' AND i - 1 BETWEEN 3 AND 15 AND messages[i - 1].role = 'user' AND regexp_matches(m.content, '(?i){_PIVOTS}')) AS pivots,
  list_transform(messages, lambda m, i: m.role = 'user' AND i - 1 >= 5) AS late FROM t),
g AS (SELECT id, CASE WHEN at_user THEN CASE WHEN shows[h + 1] THEN 'metadata' WHEN list_contains(shows, true) THEN 'metadata_corrected' ELSE 'metadata_invalid' END WHEN list_contains(pivots, true) THEN 'pivot' WHEN list_contains(late, true) THEN 'fallback' ELSE 'no_user_in_range' END AS reason, h, shows, pivots, late FROM f),
found AS (SELECT id, reason, CASE reason WHEN 'metadata' THEN h WHEN 'metadata_corrected' THEN list_position(shows, true) - 1 WHEN 'pivot' THEN list_position(pivots, true) - 2 WHEN 'fallback' THEN list_position(late, true) - 1 END::INT AS turn FROM g)"""


@query(VIOLATED + " SELECT * FROM found")
def violation_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn, reason = Q.violation_turn(F.col("messages"), F.expr(_AXIS), F.expr(_HINT).cast("int"))
    return E.dialogues(spark, sf_dir).select("id", turn.alias("turn"), reason.alias("reason"))


_TYPED = rf"\[SESSION_END:\s*(?:persistent_(?:{T.AXES}))\s*\]"


@query(D + f" SELECT 'a7_' || id AS id, array_to_string(list_transform(messages, lambda m: m.role || ': ' || CASE WHEN m.role = 'assistant' THEN regexp_replace(m.content, '{_TYPED}', '[SESSION_END]', 'g') ELSE m.content END), chr(10)) AS dialogue, coalesce(list_sum(list_transform(messages, lambda m: CASE WHEN m.role = 'assistant' THEN len(regexp_extract_all(m.content, '{_TYPED}')) ELSE 0 END)), 0)::INT AS n_replaced FROM dialogues")
def generic_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, n = Q.generic_marker(F.col("messages"))
    return E.dialogues(spark, sf_dir).select(F.concat(F.lit("a7_"), "id").alias("id"), _joined(m).alias("dialogue"), n.alias("n_replaced"))


_AT = f"(nullif(list_position(list_transform(messages, lambda m: m.role = 'assistant' AND regexp_matches(m.content, '{_TYPED}')), true), 0))"


@query(D + f""", a AS (SELECT id, messages, {_AT} AS p FROM dialogues), x AS (SELECT *, regexp_extract(messages[p].content, '\\[SESSION_END:\\s*(persistent_[a-z_]+)', 1) AS axis, coalesce(p >= 5 AND messages[p - 4].role = 'assistant' AND messages[p - 2].role = 'assistant', false) AS fits FROM a)
SELECT id, array_to_string(list_transform(messages, lambda m, i: m.role || ': ' || CASE WHEN fits AND i = p THEN regexp_replace(m.content, '\\[SESSION_END:\\s*(persistent_[a-z_]+)\\s*\\]', '[SESSION_END: STRIKE=3: \\1]', 'g') WHEN fits AND i = p - 2 THEN m.content || ' [STRIKE=2: ' || axis || ']' ELSE m.content END), chr(10)) AS dialogue FROM x""")
def count_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.dialogues(spark, sf_dir).select("id", _joined(Q.count_marker(F.col("messages"))).alias("dialogue"))


@query(D + f" SELECT id || '_t2' AS id, {_J.format(x='list_slice(messages, 3, len(messages))')} AS dialogue, greatest(len(messages) - 2, 0)::INT AS n_messages FROM dialogues")
def shift_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.dialogues(spark, sf_dir).withColumn("m", Q.shift_window(F.col("messages"), 2))
    return d.select(F.concat("id", F.lit("_t2")).alias("id"), _joined(F.col("m")).alias("dialogue"), F.size("m").alias("n_messages"))


_NAME = "CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Tutor' ELSE upper(role[1]) || role[2:] END"


@query(TURNS + f", r AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS u FROM turns) SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '[user turn ' || (u - 1)::BIGINT || '] ' || content ELSE '[tutor] ' || content END, chr(10) ORDER BY turn) FILTER (role <> 'system') AS transcript, string_agg({_NAME} || ': ' || content, chr(10) ORDER BY turn) AS labelled, string_agg('[' || upper({_NAME}) || '] ' || content, chr(10) ORDER BY turn) AS bracketed FROM r GROUP BY 1")
def render_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("messages")
    return E.dialogues(spark, sf_dir).select("conv_id", Q.render(m).alias("transcript"), Q.render(m, "labelled").alias("labelled"), Q.render(m, "bracketed").alias("bracketed"))


@query(TURNS + " SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_user, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM turns")
def prior_user_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.prior_user_turn(E.turns(spark, sf_dir)).select("conv_id", "turn", "prior_user", "next_role")


@query(TURNS + ", n AS (SELECT *, lead(role) OVER w AS nr, lead(content) OVER w AS nc FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn + 1 AS turn, nc AS reply FROM n WHERE role = 'user' AND nr = 'assistant' AND regexp_matches(content, '[\\x{4E00}-\\x{9FFF}]')")
def post_l1_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = E.turns(spark, sf_dir).withColumn("nr", F.lead("role").over(w)).withColumn("reply", F.lead("content").over(w))
    return t.where((F.col("role") == "user") & (F.col("nr") == "assistant") & F.col("content").rlike(r"[\x{4E00}-\x{9FFF}]")).select("conv_id", (F.col("turn") + 1).alias("turn"), "reply")


_STRIP = r"regexp_replace(regexp_replace(messages[s + 1].content, '\s*\[SESSION_END(?::\s*[A-Za-z_]+\s*)?\]\s*', ' ', 'g'), '\s+', ' ', 'g')"


@query(MARK + f", p AS (SELECT id, s, messages[s + 1].content AS chosen, coalesce(nullif(trim({_STRIP}), ''), 'Let''s keep going.') AS rejected FROM located WHERE s >= 1 AND messages[s].role = 'user') SELECT 'dpo_' || id AS id, chosen, rejected FROM p WHERE chosen <> rejected")
def offline_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.dialogues(spark, sf_dir).withColumn("s", Q.marker_index(F.col("messages"))).where((F.col("s") >= 1) & (F.get("messages", F.col("s") - 1)["role"] == "user"))
    p = d.withColumn("chosen", F.get("messages", F.col("s"))["content"]).withColumn("rejected", T.strip_marker(F.col("chosen")))
    return p.where("chosen <> rejected").select(F.concat(F.lit("dpo_"), "id").alias("id"), "chosen", "rejected")


@query(D + ", f AS (SELECT id, list_filter(messages, lambda m: m.role <> 'system') AS m, level FROM dialogues), g AS (SELECT *, list_position(list_transform(m, lambda x: x.role), 'user') AS u FROM f) SELECT id, '<|im_start|>system' || chr(10) || 'Tutor for ' || level || '<|im_end|>' || chr(10) || array_to_string(list_transform(m, lambda x, i: '<|im_start|>' || x.role || chr(10) || CASE WHEN i = u AND NOT contains(x.content, '/no_think') THEN '/no_think ' ELSE '' END || x.content || '<|im_end|>' || chr(10)), '') AS chat FROM g WHERE u > 0")
def format_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.dialogues(spark, sf_dir)
    v = Q.conversation_view(F.col("messages"), F.concat(F.lit("Tutor for "), "level"))
    return d.withColumn("v", v).where("v is not null").select("id", Q.chat_text(F.col("v")).alias("chat"))


@query(TURNS + r""", w AS (SELECT conv_id, role, len(regexp_extract_all(content || '<|im_end|>', '[^ \t\n\r\f\v]+')) AS n FROM turns) SELECT conv_id, sum(n + 1)::INT AS n_tokens, coalesce(sum(n) FILTER (role = 'assistant'), 0)::INT AS n_trained FROM w GROUP BY 1""")
def loss_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.dialogues(spark, sf_dir).withColumn("mask", Q.loss_mask(F.col("messages")))
    return d.select("conv_id", F.size("mask").alias("n_tokens"), F.aggregate("mask", F.lit(0), lambda s, x: s + x).alias("n_trained"))


@query(MARK + ", a AS (SELECT id, s, list_filter(list_transform(messages, lambda m, i: CASE WHEN m.role = 'assistant' THEN i - 1 END), lambda i: i IS NOT NULL) AS c FROM located), b AS (SELECT id, s, CASE WHEN len(c) > 1 THEN c[2:] ELSE c END AS c FROM a WHERE len(c) > 0), e AS (SELECT id, c, list_filter(c, lambda i: s IS NULL OR i <> s) AS f FROM b), g AS (SELECT id, CASE WHEN len(f) > 0 THEN f ELSE c END AS c FROM e) SELECT id, c[(('0x' || substr(sha256(id), 1, 8))::BIGINT % len(c))::INT + 1]::INT AS turn FROM g")
def pick_turn_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An assistant turn by the id's hash, the first and the marker's left out where others remain."""
    from talkloom.functions import hashing as H

    at = F.filter(F.transform("messages", lambda m, i: F.when(m["role"] == "assistant", i)), lambda i: i.isNotNull())
    d = E.dialogues(spark, sf_dir).withColumn("s", Q.marker_index(F.col("messages"))).withColumn("c", at).where(F.size("c") > 0)
    d = d.withColumn("c", F.when(F.size("c") > 1, F.slice("c", F.lit(2), F.size("c") - 1)).otherwise(F.col("c")))
    d = d.withColumn("f", F.filter("c", lambda i: F.col("s").isNull() | (i != F.col("s")))).withColumn("c", F.when(F.size("f") > 0, F.col("f")).otherwise(F.col("c")))
    return d.select("id", F.get("c", (H.number(F.col("id")) % F.size("c")).cast("int")).alias("turn"))


# duplicates

_STOP = "[" + ", ".join(f"'{w}'" for w in DD.STOPWORDS) + "]"
_TOK = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 3 AND NOT list_contains({_STOP}, t))"
TFIDF = f"""WITH d AS (SELECT doc_id, lang, source, {_TOK} AS ts FROM documents), n AS (SELECT lang, source, count(*) AS n FROM d GROUP BY 1, 2),
tf AS (SELECT lang, source, doc_id, term, count(*) AS tf FROM (SELECT lang, source, doc_id, unnest(ts) AS term FROM d) GROUP BY ALL), df AS (SELECT lang, source, term, count(*) AS df FROM tf GROUP BY ALL),
raw AS (SELECT tf.*, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (lang, source, term) JOIN n USING (lang, source)), w AS (SELECT lang, source, doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""
# every link, copies' included
_LINKS = "links AS (SELECT a.lang, a.source, a.doc_id AS a, b.doc_id AS b, sum(a.weight * b.weight) AS similarity FROM w a JOIN w b ON a.lang = b.lang AND a.source = b.source AND a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL HAVING sum(a.weight * b.weight) >= 0.75)"
# pairs: links of documents that are the smallest of their text, and of such a one with each other document of the text
PAIRS = TFIDF + f""", same AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, source, low) AS rep FROM (SELECT doc_id, lang, source, lower(text) AS low FROM documents)),
{_LINKS},
pairs AS (SELECT l.* FROM links l JOIN same x ON x.doc_id = l.a JOIN same y ON y.doc_id = l.b WHERE x.rep = l.a AND (y.rep = l.b OR y.rep = l.a))"""


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DD.tfidf(table(spark, sf_dir, "documents"), ["lang", "source"], "doc_id", "text")


def _near_and_copies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(``a, b, similarity`` of 0.75 or more between representatives; ``a, b`` from each of these to its copies)."""
    docs, cell = table(spark, sf_dir, "documents"), ["lang", "source"]
    return DD.near_pairs(docs, cell, "doc_id", "text", 0.75).select("a", "b", "similarity"), DD.copy_links(docs, cell, "doc_id", "text")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``a, b, similarity`` of 0.75 or more: between representatives, and from each to its copies.

    A copy has its representative's links too, which are not repeated here.
    """
    near, copies = _near_and_copies(spark, sf_dir)
    return near.unionByName(copies.select("a", "b", F.lit(1.0).alias("similarity")))


@query(f"SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_terms FROM (SELECT doc_id, {_TOK} AS t FROM documents)")
def dedup_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", DD.topic_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"))


@query(TFIDF + " SELECT doc_id, term, round(weight, 6) AS weight FROM w")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(PAIRS + " SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def pairwise_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4, J-19: pairs of one cell that are alike, copies linked to the first of them alone."""
    return links(spark, sf_dir).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(TFIDF + f", {_LINKS}" + """, o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents), e AS (SELECT list(a) AS before, b FROM links GROUP BY b)
SELECT doc_id, kept FROM (WITH RECURSIVE walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS dropped, NULL::BIGINT AS doc_id, true AS kept UNION ALL
  SELECT o.k, CASE WHEN len(list_filter(coalesce(e.before, []), lambda x: NOT list_contains(w.dropped, x))) > 0 THEN list_append(w.dropped, o.doc_id) ELSE w.dropped END, o.doc_id, len(list_filter(coalesce(e.before, []), lambda x: NOT list_contains(w.dropped, x))) = 0
  FROM walk w JOIN o ON o.k = w.k + 1 LEFT JOIN e ON e.b = o.doc_id) SELECT doc_id, kept FROM walk WHERE k > 0)""")
def dedup_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In order of their ids, documents stay that are near to none that stayed before; every link counts, copies' too."""
    near, copies = _near_and_copies(spark, sf_dir)
    return DD.prune_in_order(table(spark, sf_dir, "documents").select("doc_id"), near, "doc_id", copies)


@query()
def dedup_farthest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DD.farthest_point(table(spark, sf_dir, "documents"), _weights(spark, sf_dir), ["lang", "source"], "doc_id", 5)


_TOPIC = "concat('topic ', doc_id % 40)"


@query(REC + f", t AS (SELECT doc_id, level, coalesce(locale, 'china') AS locale, {_TOPIC} AS topic FROM records), old AS (SELECT DISTINCT level, locale, topic FROM t WHERE doc_id % 10 = 0), fresh AS (SELECT * FROM t WHERE doc_id % 10 <> 0) SELECT doc_id FROM (SELECT f.doc_id, row_number() OVER (PARTITION BY f.level, f.locale, f.topic ORDER BY f.doc_id) AS r FROM fresh f LEFT JOIN old o USING (level, locale, topic) WHERE o.topic IS NULL) WHERE r = 1")
def dedup_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New topics of a level and locale that no existing seed has, the first of each."""
    t = E.records(spark, sf_dir).select("doc_id", "level", F.coalesce("locale", F.lit("china")).alias("locale"), F.expr(_TOPIC).alias("topic"))
    cell = ["level", "locale", "topic"]
    fresh = t.where("doc_id % 10 <> 0").join(t.where("doc_id % 10 = 0").select(*cell).distinct(), cell, "left_anti")
    return SC.first_per_key(fresh, cell, ["doc_id"]).select("doc_id")


_CITY = "CASE WHEN doc_id % 5 < 2 THEN 'Paris' WHEN doc_id % 5 = 2 THEN source END"
_WHO = "CASE WHEN doc_id % 6 = 0 THEN 'Li' WHEN doc_id % 8 = 1 THEN 'Bo' ELSE source END"


@query(REC + f", c AS (SELECT doc_id, {_CITY} AS city, {_WHO} AS learner FROM records), n AS (SELECT *, count(*) OVER (PARTITION BY city) AS nc, count(*) OVER (PARTITION BY learner) AS nl, count(*) OVER () AS n FROM c) SELECT doc_id, city, learner FROM n WHERE (city IS NULL OR nc <= 0.30 * n) AND nl <= 0.15 * n")
def drop_overrepresented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose city or learner's name has too large a share of all candidates go."""
    r = E.records(spark, sf_dir).select("doc_id", F.expr(_CITY).alias("city"), F.expr(_WHO).alias("learner"))
    return SC.share_filters(r, {"city": 0.30, "learner": 0.15}).select("doc_id", "city", "learner")


@query("WITH u AS (SELECT doc_id, 'first' AS origin, 0 AS o FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'second', 1 FROM documents WHERE doc_id % 2 = 0) SELECT doc_id, origin FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS r FROM u) WHERE r = 1")
def merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    a = d.where("doc_id % 3 = 0").withColumn("origin", F.lit("first")).withColumn("o", F.lit(0))
    b = d.where("doc_id % 2 = 0").withColumn("origin", F.lit("second")).withColumn("o", F.lit(1))
    return SC.first_per_key(a.unionByName(b), ["doc_id"], ["o"]).select("doc_id", "origin")


@query()
def rewrite_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = E.turns(spark, sf_dir).where("role = 'assistant'")
    return t.select("conv_id", "turn", F.round(DD.similarity_ratio(F.col("content"), T.strip_marker(F.col("content"))), 6).alias("ratio"))


@query(REC + " SELECT id FROM records WHERE doc_id % 3 <> 0 EXCEPT SELECT id FROM records WHERE doc_id % 2 = 0")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = E.records(spark, sf_dir).select("doc_id", "id")
    return r.where("doc_id % 3 <> 0").join(r.where("doc_id % 2 = 0").select("id"), "id", "left_anti").select("id")
