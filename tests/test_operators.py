"""Literal edge cases of texts, filters, turns, sampling, scoring and statistics."""

import pytest
from pyspark.sql import functions as F

from talkloom.functions import statistics as ST
from talkloom.functions import replies as R
from talkloom.functions import text as T
from talkloom.operators import curation as C
from talkloom.operators import dedup as DD
from talkloom.operators import filters as FL
from talkloom.operators import sampling as S
from talkloom.operators import scoring as SC
from talkloom.operators import turns as Q

DIALOGUE = "id string, level string, stream string, messages array<struct<role string, content string>>"


def dialogue(spark, *turns, stream="normal", level="A1"):
    return spark.createDataFrame([("x", level, stream, list(turns))], DIALOGUE)


def one(df, column):
    return df.select(column.alias("c")).first().c


@pytest.mark.parametrize(
    "text, expected",
    [
        ("[SESSION_END]", {"any_phrase", "three_prefixes", "any_bracket", "closed_axis", "with_count", "open_axis", "absorbing", "generic"}),
        ("[SESSION_END: persistent_role_swap]", {"any_phrase", "three_prefixes", "any_bracket", "closed_axis", "with_count", "open_axis", "absorbing", "typed"}),
        ("[SESSION_END: STRIKE=3: persistent_role_swap]", {"any_phrase", "three_prefixes", "any_bracket", "with_count"}),
        ("[SESSION_END : other ]", {"any_phrase", "three_prefixes", "any_bracket", "open_axis"}),
        ("I must end this session.", {"any_phrase"}),
        ("[END_SESSION]", {"any_phrase"}),
        ("nothing", set()),
    ],
)
def test_marker_dialects_disagree(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(*[T.marked(F.col("t"), d).alias(d) for d in T.DIALECTS]).first()
    assert {d for d in T.DIALECTS if row[d]} == expected


@pytest.mark.parametrize("value, score", [(1.9, 0.0), (2.0, 0.0), (2.5, 0.5), (3.0, 1.0), (8.0, 1.0), (11.0, 0.5), (14.0, 0.0), (14.1, 0.0)])
def test_band_score_edges(spark, value, score):
    df = spark.createDataFrame([(value,)], "v double")
    assert one(df, T.band_score(F.col("v"), *[F.lit(float(x)) for x in (2, 3, 8, 14)])) == pytest.approx(score)
    assert one(df, T.band_score(F.lit(0.0), *[F.lit(float(x)) for x in (0, 0, 1, 1)])) == 1.0


def test_text_functions(spark):
    df = spark.createDataFrame([("He said: yes. \"No!\" he isn't I'm. Well, you know, you know.",)], "t string")
    t = F.col("t")
    assert one(df, F.size(T.sentences(t))) == 3 and one(df, T.contracted(t)) == 2 and one(df, T.discourse(t)) == 3
    for text, visible in (("a<think>x</think> b", "a b"), ("<think>open", ""), ("keep <THINK>cut", "keep"), ("plain", "plain")):
        assert one(spark.createDataFrame([(text,)], "t string"), R.strip_reasoning(t)) == visible
    for text, grade in (("3 faults [RESULT] 4", 4), ("[result]7", None), ("4 of 5", None), ("[RESULT] 2 [RESULT] 3", 2)):
        assert one(spark.createDataFrame([(text,)], "t string"), R.grade(t)) == grade
    assert one(spark.createDataFrame([(" [SESSION_END: abc] ",)], "t string"), T.strip_marker(t)) == "Let's keep going."
    assert [one(spark.createDataFrame([(x,)], "t string"), T.word_count(t)) for x in ("", "  ", " a b ")] == [0, 0, 2]


@pytest.mark.parametrize("pair", [r.split("-") for r in T.SCRIPTS.split()])
def test_every_script_is_found(spark, pair):
    char = chr(int(pair[0], 16) + 1)
    assert not FL_run(spark, ("assistant", f"hi {char}"))["passed"]
    assert FL_run(spark, ("user", char), ("assistant", "hi"), stream="redirect")["passed"]
    assert not FL_run(spark, ("user", char), ("assistant", "hi"))["passed"]


def FL_run(spark, *turns, stream="normal"):
    df = dialogue(spark, *turns, stream=stream)
    return one(df, FL.non_latin_script(df))


def test_banned_terms(spark):
    check = FL.banned_terms({"food": ["hot dog", "hot dog bun", "pie"], "place": ["Rome"]})
    df = dialogue(spark, ("user", "pie"), ("assistant", "a hot dog bun, pies, pie Romes Rome"), ("system", "pie " * 20))
    r = one(df, check(df))
    assert not r.passed and r.score == 8 and r.reason == "food: hot dog bun"
    df = dialogue(spark, ("user", "pie Rome"), ("assistant", "PIE rome magpie"))
    assert one(df, check(df)).passed


def test_pipeline_stops_at_the_first_failure(spark):
    df = dialogue(spark, ("user", "hi"), ("assistant", "<think>Rome</think> 你"))
    f = {"banned_terms": FL.banned_terms({"p": ["Rome"]})(df), "custom": FL.result(F.lit(False)), "mode_consistency": FL.mode_consistency(df), "non_latin_script": FL.non_latin_script(df)}
    r = FL.run_pipeline(df, f).first()
    assert [x.name for x in r.runs] == ["non_latin_script", "banned_terms", "mode_consistency", "custom"]
    assert [x.skipped for x in r.runs] == [False, True, True, True] and [x.passed for x in r.runs] == [False, True, True, True]
    assert not r.passed and r.failing_filter == "non_latin_script"
    r = FL.run_pipeline(df, f, short_circuit=False).first()
    assert not any(x.passed for x in r.runs) and r.failing_filter == "non_latin_script"


def test_turn_operators(spark):
    turns = [("user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(8)]
    turns[5] = ("assistant", "bye [SESSION_END: persistent_off_topic]")
    df = dialogue(spark, *turns)
    m = F.col("messages")
    assert one(df, Q.marker_index(m)) == 5 and one(df, F.size(Q.trim_after_marker(m))) == 6
    counted = one(df, Q.count_marker(m))
    assert counted[5].content == "bye [SESSION_END: STRIKE=3: persistent_off_topic]" and counted[3].content == "t3 [STRIKE=2: persistent_off_topic]" and counted[1].content == "t1"
    again = spark.createDataFrame([("x", "A1", "normal", counted)], DIALOGUE)
    assert one(again, Q.count_marker(m)) == counted
    trimmed = spark.createDataFrame([("x", "A1", "normal", one(df, Q.trim_after_marker(m)))], DIALOGUE)
    assert one(trimmed, Q.trim_after_marker(m)) == one(df, Q.trim_after_marker(m))
    assert one(dialogue(spark, *turns[:4]), Q.marker_index(m)) is None
    mask = one(dialogue(spark, ("user", "a b"), ("assistant", "c d e")), Q.loss_mask(m))
    assert mask == [0, 0, 0, 0, 1, 1, 1]
    assert one(dialogue(spark, ("system", "s"), ("assistant", "x")), Q.conversation_view(m, F.lit("p"))) is None


@pytest.mark.parametrize("n, share", [(1, 1), (9, 1), (10, 1), (30, 2), (50, 2), (70, 4)])
def test_stratified_split_rounds_half_to_even(spark, n, share):
    df = spark.createDataFrame([(f"id{i}", "s", None) for i in range(n)], "id string, stratum string, other string")
    out = S.stratified_split(df, ["stratum", "other"], F.col("id"), 0.05)
    assert out.count() == n and out.where("validation").count() == share


def test_sampling_is_stable_and_bounded(spark):
    df = spark.createDataFrame([(f"id{i}",) for i in range(200)], "id string")
    first = {r.id for r in S.hash_sample(df, F.col("id"), 0.1).collect()}
    assert len(first) == 20 and first == {r.id for r in S.hash_sample(df.repartition(5).orderBy(F.desc("id")), F.col("id"), 0.1).collect()}
    assert S.hash_sample(df, F.col("id"), 0).count() == 0 and S.hash_sample(df, F.col("id"), 1).count() == 200 and S.hash_sample(df, F.col("id"), 1e-9).count() == 1
    assert S.resolve_targets({"a": 80}, {"b": 0.2}) == {"a": 80, "b": 20}
    for bad in (({"a": 1}, {"a": 0.1}), ({"a": 1}, {"b": 1.0}), ({"a": -1}, {}), ({}, {"b": 0.5}), ({"a": 1}, {"b": 0.6, "c": 0.5})):
        with pytest.raises(ValueError):
            S.resolve_targets(*bad)


def test_detection_rules_for_zero(spark):
    rows = [("silent", False, True), ("silent", False, False), ("none", False, None)]
    df = spark.createDataFrame(rows, "g string, fired boolean, should_fire boolean")
    a = {r.g: r for r in SC.detection_summary(df, ["g"]).collect()}
    assert a["silent"].recall == 0 and a["silent"].precision is None and a["silent"].f1 is None and a["none"].recall is None
    b = {r.g: r for r in SC.detection_summary(df, ["g"], precision_if_silent=1.0).collect()}
    assert b["silent"].precision == 1 and b["silent"].f1 == 0


def test_published_counts(spark):
    # 110 of 142 positives, 0 of 232 negatives
    df = spark.createDataFrame([(True, True)] * 110 + [(False, True)] * 32 + [(False, False)] * 232, "fired boolean, should_fire boolean").withColumn("g", F.lit(1))
    r = SC.detection_summary(df, ["g"]).first()
    assert round(r.recall, 4) == 0.7746 and r.precision == 1 and round(r.f1, 4) == 0.873
    n = spark.createDataFrame([(66, 318), (249, 318), (0, 0)], "k int, n int")
    low, high = ST.wilson(F.col("k"), F.col("n"))
    got = [(round(r.a, 4), round(r.b, 4)) for r in n.select(low.alias("a"), high.alias("b")).collect()]
    assert got == [(0.1666, 0.2555), (0.7345, 0.8248), (0.0, 0.0)]


def test_exact_tests(spark):
    t = spark.createDataFrame([(3, 1, 1, 3)], "a int, b int, c int, d int")
    assert one(t, ST.fisher_exact(*[F.col(x) for x in "abcd"])) == pytest.approx(0.4857142857)
    m = spark.createDataFrame([(0, 0), (5, 0), (2, 6)], "b int, c int")
    assert [r.c for r in m.select(ST.mcnemar_exact(F.col("b"), F.col("c")).alias("c")).collect()] == [pytest.approx(x) for x in (1.0, 0.0625, 0.2890625)]


def test_median_and_majority_ties(spark):
    df = spark.createDataFrame([("a", "j1", 0, 2), ("a", "j2", 1, 4), ("a", "j3", 2, None), ("b", "j1", 0, 1), ("b", "j2", 1, 2), ("b", "j3", 2, 3), ("b", "j4", 3, 4)], "id string, judge string, judge_order int, score int")
    assert {r.id: r["median"] for r in SC.upper_median(df, ["id"]).collect()} == {"a": 4, "b": 3}
    assert {r.id: r.majority for r in SC.majority(df, ["id"], "score", "judge_order").collect()} == {"a": 2, "b": 1}


def test_tfidf_pruning_and_farthest(spark):
    texts = ["alpha beta gamma", "alpha beta gamma", "alpha beta delta", "", "omega sigma theta"]
    df = spark.createDataFrame([(i, "c", t) for i, t in enumerate(texts)], "doc_id long, cell string, text string")
    w = DD.tfidf(df, ["cell"], "doc_id", "text")
    pairs = {(r.a, r.b): round(r.similarity, 6) for r in DD.cosine_pairs(w, ["cell"], "doc_id", 0.3).collect()}
    assert pairs[(0, 1)] == 1.0 and set(pairs) == {(0, 1), (0, 2), (1, 2)}
    kept = {r.doc_id for r in DD.prune_in_order(df, DD.cosine_pairs(w, ["cell"], "doc_id", 0.9), "doc_id").where("kept").collect()}
    assert kept == {0, 2, 3, 4}
    # a chain: 1 goes because of 0, so 2 stays though it is close to 1
    chain = spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")
    assert {r.doc_id for r in DD.prune_in_order(df, chain, "doc_id").where("kept").collect()} == {0, 2, 3, 4}
    assert [r.doc_id for r in DD.farthest_point(df, w, ["cell"], "doc_id", 2).orderBy("rank").collect()] == [4, 0]


def test_axis_assignment_balances(spark):
    rows = [("g", f"{i:02d}", ["a", "b"] if i % 3 else ["a"]) for i in range(9)]
    df = spark.createDataFrame(rows, "g string, id string, applicable array<string>")
    got = [r.axis for r in C.assign_axes(df, "g", "id", ["a", "b"]).orderBy("id").collect()]
    assert got == ["a", "b", "a", "a", "b", "b", "a", "b", "a"]


def test_entry_and_registry():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90


def test_json_fields_reach_every_event(spark, tmp_path):
    from talkloom.plans.registry import QUERIES

    props = ['{"page": "/a"}', '{"page": 3}', '{"page": ', None, "[]", '{"x": {"page": "/b"}}', '{"page": "é"}']
    spark.createDataFrame(list(enumerate(props)), "event_id long, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: (r.page, r.valid) for r in QUERIES["json_fields"](spark, str(tmp_path)).collect()}
    assert got == {0: ("/a", True), 1: ("3", True), 2: (None, False), 3: (None, False), 4: (None, True), 5: (None, True), 6: ("é", True)}


def test_names_and_bands_reach_every_document(spark, tmp_path):
    from talkloom.plans.registry import QUERIES

    names = [f"Name{'abcdefgh'[i] * 2}" for i in range(8)]
    rows = [(7, ", ".join(names), "en"), (8, "Jean Valjean a vu Paris", "fr"), (9, "Anna sah Bonn", None), (10, None, "de")]
    spark.createDataFrame([(i, t, g, "s") for i, t, g in rows], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [r.short_names for r in QUERIES["proper_nouns"](spark, str(tmp_path)).orderBy("id").collect()]
    assert sorted(got, key=repr) == sorted([names, ["Jean Valjean", "Paris"], ["Anna", "Bonn"], None], key=repr)
    bands = {r.word: r.band for r in QUERIES["vocab_bands"](spark, str(tmp_path)).collect()}
    assert bands["nameaa"] == 1 and bands["vu"] == 2 and bands["bonn"] == 3 and len(bands) == 8 + 5 + 3


def dense_farthest(vectors, k, threshold):
    keys = sorted(vectors)
    cos = lambda a, b: sum(w * vectors[b].get(t, 0.0) for t, w in vectors[a].items())
    mean = {a: sum(cos(a, b) for b in keys if b != a) / max(1, len(keys) - 1) for a in keys}
    chosen = [min(keys, key=lambda a: (round(mean[a], 12), a))]
    while len(chosen) < min(k, len(keys)):
        worst = {a: max(cos(a, b) for b in chosen) for a in keys if a not in chosen}
        nxt = min(worst, key=lambda a: (round(worst[a], 12), a))
        if worst[nxt] >= threshold:
            break
        chosen.append(nxt)
    return chosen


def test_similar_pairs_and_choices_are_brute_force(spark):
    import random

    r = random.Random(6)
    words = [f"word{i}" for i in range(25)]
    rows = [(i, "xy"[i % 2], " ".join(r.choice(words) for _ in range(r.choice([4, 9, 9, 30])))) for i in range(60)]
    rows += [(100 + i, "x", rows[i * 2][2].upper()) for i in range(5)] + [(200, "x", "the of"), (201, "x", "the of"), (202, "y", None)]
    df = spark.createDataFrame(rows, "id long, cell string, text string")
    weights = DD.tfidf(df, ["cell"], "id", "text")
    vectors = {}
    for w in weights.collect():
        vectors.setdefault((w.cell, w.id), {})[w.term] = w.weight
    want = {}
    for (c, a), x in vectors.items():
        for (d, b), y in vectors.items():
            s = sum(w * y.get(t, 0.0) for t, w in x.items())
            if c == d and a < b and s >= 0.5:
                want[a, b] = round(s, 9)
    assert {(p.a, p.b): round(p.similarity, 9) for p in DD.cosine_pairs(weights, ["cell"], "id", 0.5).collect()} == want
    reps, others = DD.fold(df, ["cell"], "id", "text")
    copies = {(o.rep, o.id) for o in others.collect()}
    assert copies == {(2 * i, 100 + i) for i in range(5)} | {(200, 201)} and reps.count() == len(rows) - 6
    folded = {(w.cell, w.id, w.term): round(w.weight, 9) for w in DD.tfidf(reps, ["cell"], "id", "text", "copies").collect()}
    assert folded == {(c, i, t): round(w, 9) for (c, i), v in vectors.items() for t, w in v.items() if i < 100 or i >= 200}
    for k, threshold in ((4, 0.9), (50, 0.3)):
        got = DD.farthest_point(df, weights, ["cell"], "id", k, threshold).collect()
        for cell in "xy":
            mine = {i: v for (c, i), v in vectors.items() if c == cell}
            assert [g.id for g in sorted((g for g in got if g.cell == cell), key=lambda g: g["rank"])] == dense_farthest(mine, k, threshold)


def test_near_pairs_lose_nothing_between_blocks(spark, monkeypatch):
    import random

    rng = random.Random(7)
    words = [f"w{i}x" for i in range(60)]
    texts = []
    for i in range(150):
        near = texts[rng.randrange(len(texts))].split() if texts and i % 3 else []
        own = near[: len(near) - rng.randrange(3)] + rng.choices(words, k=rng.randrange(1, 5) if near else rng.randrange(2, 25))
        texts.append(" ".join(own))
    texts += [texts[3].upper(), texts[3], texts[8], "the of it", "The of it", "", "", None, None]
    rows = [(i * 7 % 211, "ab"[i % 2] if i < 158 else "a", t) for i, t in enumerate(texts)] + [(900, None, texts[3]), (901, None, texts[3])]
    df = spark.createDataFrame(rows, "id long, cell string, text string")
    weights = DD.tfidf(df, ["cell"], "id", "text")
    vectors = {}
    for w in weights.where("cell is not null").collect():
        vectors.setdefault((w.cell, w.id), {})[w.term] = w.weight
    low = {}
    for i, c, t in sorted(rows, key=lambda r: r[0]):
        if (c, i) in vectors:
            low.setdefault((c, t.lower()), []).append(i)
    first = [(c, ids[0]) for (c, _), ids in low.items()]
    want = {}
    for c, a in first:
        for k, b in first:
            if c == k and a < b:
                s = sum(w * vectors[c, b].get(t, 0) for t, w in vectors[c, a].items())
                if s >= 0.5:
                    want[a, b] = round(s, 9)
    copies = {(ids[0], b) for ids in low.values() for b in ids[1:]}
    assert len(want) > 50 and len(copies) > 1
    for terms in (10**6, 300, 40):  # one block a cell, a few, and many
        monkeypatch.setattr(DD, "BLOCK_TERMS", terms)
        got = DD.near_pairs(df, ["cell"], "id", "text", 0.5).collect()
        assert len(got) == len(want) and {(p.a, p.b): round(p.similarity, 9) for p in got} == want
    assert sorted((r.a, r.b) for r in DD.copy_links(df, ["cell"], "id", "text").collect()) == sorted(copies)


def test_near_pairs_send_a_text_once_whatever_the_blocks(spark, monkeypatch):
    import random

    rng = random.Random(8)
    words = [f"w{i}x" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=120)) for _ in range(400)]
    texts[399] = texts[0] + " more"
    df = spark.createDataFrame([(i, "a", t) for i, t in enumerate(texts)], "id long, cell string, text string")
    context = spark.sparkContext._jsc.sc()

    def sent() -> int:
        context.listenerBus().waitUntilEmpty()
        executors = context.statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    used = []
    for terms in (10**6, 3_000):  # one block, and some fifteen
        monkeypatch.setattr(DD, "BLOCK_TERMS", terms)
        before = sent()
        assert [(p.a, p.b) for p in DD.near_pairs(df, ["cell"], "id", "text", 0.75).collect()] == [(0, 399)]
        used.append(sent() - before)
    assert 0 < used[1] < 2.5 * used[0]
    assert DD.near_pairs(df.where("id < 0"), ["cell"], "id", "text", 0.75).collect() == []


def test_copies_of_a_dropped_row_go_with_it(spark, tmp_path):
    import random

    import duckdb

    from talkloom.plans import dialogue_queries as DQ

    rng = random.Random(9)
    words = [f"w{i}x" for i in range(80)]
    base = " ".join(words[:12])
    # 1 goes for 0; 2 and 3 are copies of 1 and near to 0; no link of texts without topic words
    texts = [base, base + " more", base.upper() + " MORE", base + " more", "the of", "The of", "", None, None]
    while len(texts) < 150:
        kind, old = rng.randrange(3), rng.choice([t for t in texts if t]).split()
        texts.append(" ".join(rng.choices(words, k=14) if kind == 0 else old if kind == 1 else [*old, rng.choice(words)]))
    df = spark.createDataFrame([(i, "en" if i < 100 else "de", "web" if i < 140 else None, t) for i, t in enumerate(texts)], "doc_id long, lang string, source string, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    vectors = {}
    for w in DD.tfidf(df.where("source is not null"), ["lang", "source"], "doc_id", "text").collect():
        vectors.setdefault(w.doc_id, (w.lang, {}))[1][w.term] = w.weight
    stay, gone = [], []
    for i in range(len(texts)):
        lang, v = vectors.get(i, (None, {}))
        near = [k for k in stay if vectors.get(k, ("", {}))[0] == lang and sum(w * vectors[k][1].get(t, 0) for t, w in v.items()) >= 0.75]
        (gone if near else stay).append(i)
    firsts = {}
    for i, t in enumerate(texts):
        firsts.setdefault((vectors.get(i, (None,))[0], (t or "").lower()), i)
    late = [i for i in gone if firsts[vectors[i][0], texts[i].lower()] in gone and i not in firsts.values()]
    got = sorted(tuple(r) for r in DQ.dedup_threshold(spark, str(tmp_path)).collect())
    assert {1, 2, 3} <= set(gone) and {2, 3} <= set(late) and len(late) > 10 and {0, 4, 5, 6, 7, 8} <= set(stay)
    assert got == [(i, i in stay) for i in range(len(texts))]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(con.execute(DQ.SQL["dedup_threshold"]).fetchall()) == got
    # every pair, or those of first rows and their copies: the same
    pairs = [(a, b) for b in vectors for a in vectors if a < b and vectors[a][0] == vectors[b][0] and sum(w * vectors[b][1].get(t, 0) for t, w in vectors[a][1].items()) >= 0.75]
    every = DD.prune_in_order(df.select("doc_id"), spark.createDataFrame(pairs, "a long, b long"), "doc_id")
    assert sorted(tuple(r) for r in every.collect()) == got


def test_fisher_exact_of_large_counts(spark):
    import math

    tables = [(3, 1, 1, 3), (0, 5, 5, 0), (0, 0, 0, 0), (4, 0, 2, 0), (10, 20, 300, 400), (20_000, 20_100, 20_150, 19_950), (90_000, 10, 0, 90_000)]

    def p(a, b, c, d):
        choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
        at = [choose(a + b, x) + choose(c + d, a + c - x) - choose(a + b + c + d, a + c) for x in range(max(0, a - d), min(a + b, a + c) + 1)]
        return min(1, sum(math.exp(x) for x in at if x <= at[a - max(0, a - d)] + 1e-7))

    df = spark.createDataFrame(tables, "a long, b long, c long, d long")
    got = [r.p for r in df.select(ST.fisher_exact(*[F.col(x) for x in "abcd"]).alias("p")).collect()]
    assert got == [pytest.approx(p(*t), abs=1e-6) for t in tables]


def test_answers_beside_letters_beyond_ascii(spark, tmp_path):
    import duckdb

    from talkloom.plans import text_queries as TQ

    texts = ["noítaga dora", "un asñno", "asnoñ", "YES, no", "a_no no1", "nothing", "é no é", "", "no\tñ", None]
    spark.createDataFrame([(i, 1, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = sorted(con.execute(TQ.SQL["reply_parsing"]).fetchall())
    assert sorted(tuple(r) for r in TQ.reply_parsing(spark, str(tmp_path)).collect()) == want
    assert [r[3] for r in want] == ["no", "no", None, "yes", None, None, "no", None, "no", None]
    df = spark.createDataFrame([("noítaga",), ("No.",)], "t string")
    assert [r.c for r in df.select(T.yes_no(F.col("t")).alias("c")).collect()] == [None, "no"]
