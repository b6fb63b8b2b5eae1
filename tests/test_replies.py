"""Replies, names, probes and views on literal tables."""

import difflib
import json

import pytest
from pyspark.sql import functions as F

from talkloom.functions import replies as R
from talkloom.operators import curation as C
from talkloom.operators import dedup as DD
from talkloom.operators import extraction as X
from talkloom.operators import filters as FL
from talkloom.operators import probes as P
from talkloom.operators import responders as RE
from talkloom.operators import sampling as S
from talkloom.operators import synthetic as SY
from talkloom.operators import turns as Q
from talkloom.operators import views as V

MESSAGES = "array<struct<role:string,content:string>>"


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r.x for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def talk(*turns):
    return [{"role": r, "content": c} for r, c in turns]


def test_fences(spark):
    table = {
        "plain": "plain",
        "  x  ": "x",
        "```json\n{}\n```": "{}",
        "```\na\nb": "a\nb",
        "```": "",
        "before ```json\n{}\n```": "before ```json\n{}\n```",
        "```py\na\n``` \n": "a",
        "```a\n```\nb": "```\nb",
    }
    assert column(spark, list(table), R.strip_fence) == list(table.values())


def test_reasoning(spark):
    table = {
        "<think>a</think>b": "b",
        "<THINK x>a</THINK >b <think>c</think>": "b",
        "a <think>b <think>c": "a <think>b",
        "x<|channel|>analysis<|message|>y<|channel|>final<|message|>z<|end|>w": "z",
        "<|channel|>analysis<|message|>y<|end|>z<|start|>": "z",
        "<|channel|>final<|message|>a<|message|>b": "ab",
        "": "",
    }
    assert column(spark, list(table), R.strip_reasoning) == list(table.values())


def test_located_json(spark):
    table = {
        '{"a": "}"} tail': '{"a":"}"}',
        'x [1, {"b": 2}]': '{"b":2}',
        "x [1, 2] y": "[1,2]",
        '"text"': '"text"',
        "{'a': 1}": None,
        '{"a": "\\"}"}x': '{"a":"\\"}"}',
        "{": None,
        None: None,
    }
    assert column(spark, list(table), R.locate_json) == list(table.values())
    assert column(spark, ['{"a": "}"}', "{1}", 'a {"b": {"c": 1}} {'], lambda t: R.locate_json(t, "first_object")) == [None, None, '{"b":{"c":1}}']
    loose = ['{"a": [1, 2,],}', "{'a': True, 'b': None}", "{a}", '{"a": 1} and {"b": 2}', "no"]
    assert column(spark, loose, lambda t: R.locate_json(t, "repaired_object")) == ['{"a":[1,2]}', '{"a":true,"b":null}', None, None, None]


def evaluation(**scores):
    base = dict.fromkeys(R.DIMENSIONS, 3)
    return json.dumps({**dict.fromkeys(R.EVALUATION_FIELDS, "x"), "scores": {**base, **scores}})


def test_evaluations(spark):
    rows = [evaluation(), evaluation(fluency=4.9), evaluation(fluency="5"), evaluation(fluency=6), evaluation(fluency="good"), evaluation(fluency=None), '{"scores": {}}', "[1]"]
    assert column(spark, rows, lambda t: R.has_fields(t, R.EVALUATION_FIELDS)) == [True] * 6 + [False, False]
    assert [None if s is None else s.fluency for s in column(spark, rows, R.dimension_scores)] == [3, 4, 5, None, None, None, None, None]
    assert column(spark, ["a </think> ```json\n{}\n``` x", "no tags {}", "</THINK>  z "], R.payload) == ["{}", "no tags {}", "z"]


def test_verdicts(spark):
    rows = ['{"winner": "A", "margin": "3", "reason_axis": "tone", "note": 5}', '{"winner": "tie", "margin": "many"}', '{"winner": "a"}', "[]", None]
    got = column(spark, rows, lambda t: R.verdict(t, ["tone"], "other"))
    assert [None if v is None else tuple(v) for v in got] == [("A", 3, "tone", "5"), ("tie", 0, "other", ""), None, None, None]
    assert column(spark, ['{"winner": " tie "}', '{"winner": "b"}', None, "{}"], R.json_winner) == ["TIE", "B", "TIE", "TIE"]
    assert column(spark, ["[RESULT] b.", "RESULT A", "[result]A"], R.tagged_winner) == ["B", "TIE", "A"]
    assert column(spark, ["Feedback: a [RESULT] 3", "b", "x" * 400], R.feedback) == ["a", "b", "x" * 280]


def test_names(spark):
    text = "The Old Bridge. Naqsh-e Jahan Square and Lin Mei; Oh Paris' sky. An It"
    assert column(spark, [text], X.proper_nouns) == [["Naqsh-e Jahan Square", "Lin Mei"]]
    assert column(spark, ["Today Rome. In Lin Mei City Hall Annex", "the end"], X.city_guess) == ["In Lin Mei City", None]
    got = column(spark, [["Wechat met Anna. French", "anna and Anna Bell. English-only! Absolutely"]], lambda t: X.locale_entities(t, ["french", "english"], ["absolutely"], F.array(F.lit("wechat"))), "array<string>")
    assert got == [["Anna", "Anna Bell"]]
    assert column(spark, ["No name here", "Yes, Bob", "yes Al"], lambda t: X.real_name(t, ["yes"])) == [False, True, False]
    assert column(spark, ["A hot dog. Ash Reshteh, ash; ashes", "hotdog", None], X.mentions(["ash", "ash reshteh", "hot dog"])) == [["ash reshteh", "hot dog", "ash"], [], []]
    assert column(spark, ["Ｆｕｌｌ-Width ﬁne 你", None], X.normalised) == ["fullwidthfine", None]


def test_terms_are_taken_literally(spark):
    pattern = C.gazetteer_pattern(["St. Moritz", "7-eleven", "c++"])
    assert column(spark, ["st.  moritz", "stx moritz", "7 ELEVEN", "7eleven", "ccc"], lambda t: t.rlike(pattern)) == [True, False, True, True, False]
    assert column(spark, ["a hot dog", "hotdog!", "hot-dog", "hot  dog", "shotdog"], lambda t: t.rlike(X.optional_hyphens(["Hot-Dog"]))) == [True, True, True, False, False]


@pytest.mark.parametrize("axis, limit", [*DD.NO_OP_LIMITS.items(), ("unknown", 0.92)])
def test_near_no_op(spark, axis, limit):
    base = "the quick brown fox jumps over the lazy dog again and again"
    texts = [base, base + "!", base[:40], base.replace("fox", "cat"), "", base[::-1], None]
    got = column(spark, texts, lambda t: DD.near_no_op(t, F.lit(base), F.lit(axis)))
    assert got == [difflib.SequenceMatcher(None, (t or "").strip(), base).ratio() >= limit for t in texts]


def test_speaks_l1(spark):
    said = "I want to buy two apples, please."
    rows = [
        (talk(("user", "你好"), ("assistant", "Hi"), ("user", said), ("assistant", f'You could say in English: "{said}"')), "speaks_l1"),
        (talk(("assistant", f'You could say in English: "{said}"'), ("user", "你好")), "speaks_l1"),
        (talk(("user", said), ("assistant", f"In English, ‘{said}’")), "speaks_l1"),
        (talk(("user", "你好 " + said), ("assistant", f"In English, “{said}”")), "speaks_l1"),
        (talk(("user", said)), None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, messages {MESSAGES}, trigger string")
    got = [r.r.reason for r in df.select("i", FL.l1_sanity(F.col("messages"), F.col("trigger")).alias("r")).orderBy("i").collect()]
    assert got == ["english_echo", None, "no_l1_turn", None, None]


def test_violations(spark):
    d = talk(("user", "Hello"), ("assistant", "Hi"), ("user", "Are you a robot?"), ("assistant", "Oh, interesting!"), ("user", "Yes"), ("assistant", "So"), ("user", "Let me teach"))
    rows = [("persona", 2), ("persona", 0), ("locale", 0), ("topic", 0), ("persona", 1), ("persona", None), ("persona", 99)]
    df = spark.createDataFrame([(i, d, a, h) for i, (a, h) in enumerate(rows)], f"i int, messages {MESSAGES}, axis string, hint int")
    turn, reason = Q.violation_turn(F.col("messages"), F.col("axis"), F.col("hint"))
    got = [(r.t, r.r) for r in df.select("i", turn.alias("t"), reason.alias("r")).orderBy("i").collect()]
    assert got == [(2, "metadata"), (2, "metadata_corrected"), (None, "metadata_invalid"), (0, "metadata"), (2, "pivot"), (2, "pivot"), (2, "pivot")]
    short = spark.createDataFrame([(d[:2],), ([*d[:2], d[2], d[5], d[4], d[5], d[6]],)], f"messages {MESSAGES}")
    turn, reason = Q.violation_turn(F.col("messages"), F.lit("persona"), F.lit(None).cast("int"))
    assert sorted((r.t or -1, r.r) for r in short.select(turn.alias("t"), reason.alias("r")).collect()) == [(-1, "no_user_in_range"), (6, "fallback")]


@pytest.mark.parametrize("axis, yes, no", [
    ("language", ["你好", "in Chinese please"], ["hello"]), ("locale", ["I like pizza", "a French film"], ["french fries? no: French  fries", "pizzas"]),
    ("role_swap", ["I'll be the one", "Swap roles", "now I'm the teacher"], ["be nice"]), ("pedagogy", ["what's the rule", "how do you say it"], ["the rule"]), ("topic", ["anything"], []),
])
def test_violation_patterns(spark, axis, yes, no):
    if axis == "locale":
        no = ["pizzas"]
    assert column(spark, yes + no, lambda t: Q.shows_violation(t, F.lit(axis))) == [True] * len(yes) + [False] * len(no)


def test_marker_pairs(spark):
    marked = talk(("user", "a"), ("assistant", "Bye [SESSION_END: x]"))
    rows = [("ok", marked, 1, "m"), ("none", marked, None, "m"), ("far", marked, 5, "m"), ("user", marked, 0, "m"), ("bare", talk(("user", "a"), ("assistant", "b")), 1, "m"), ("lost", marked, 1, "m"), ("blank", marked, 1, "m"), ("fired", marked, 1, "m")]
    d = spark.createDataFrame(rows, f"id string, messages {MESSAGES}, hint int, marker string")
    policy = spark.createDataFrame([("ok", " go on "), ("blank", "  "), ("fired", "[SESSION_END]")], "id string, text string")
    got = {r.id: (r.error, r.rejected) for r in P.policy_pairs(d, policy).collect()}
    assert got == {
        "ok": (None, "go on"), "none": ("no marker metadata", None), "far": ("out of range", None), "user": ("not the assistant", None), "bare": ("no marker in the turn", None),
        "lost": ("no policy text", None), "blank": ("empty policy text", None), "fired": ("policy fired itself", None),
    }


def test_spans(spark):
    rows = [["<s>", "user", "a", "</s>", "<s>", "bot", "b", "c", "</s>", "x", "<s>", "bot", "d"], ["a"], ["<s>", "bot", "</s>"]]
    assert column(spark, rows, lambda t: V.span_mask(t, ["<s>", "bot"], "</s>"), "array<string>") == [[0] * 6 + [1, 1, 1, 0, 0, 0, 1], None, [0, 0, 1]]
    assert column(spark, rows, lambda t: V.span_mask(t, ["<s>", "bot"], "</s>", 7), "array<string>")[0] == [0] * 6 + [1]


def test_ranks_are_exact(spark):
    df = spark.range(3000).selectExpr("id", "id % 3 as s", "sha2(cast(id % 2500 as string), 256) as h")
    got = S.ranked(df, ["s"], F.substring("h", 1, 6), F.col("id")).collect()
    for s in range(3):
        rows = sorted((r.h[:6], r.id, r._r) for r in got if r.s == s)
        assert [r for _, _, r in rows] == list(range(1, 1001))


def test_top_ups(spark):
    seeds = spark.createDataFrame([(f"s{i:03d}",) for i in range(100)], "id string")
    done = seeds.limit(0)
    passed, fraction, rounds = S.top_up_fraction(seeds, F.col("id"), done, lambda rows: rows.where("id < 's050'"), seeds.limit(0), 30, 0.2)
    assert passed.count() >= 30 and rounds == round((fraction - 0.2) / S.TOP_UP_STEP) + 1 and fraction <= 1
    none, fraction, rounds = S.top_up_fraction(seeds, F.col("id"), done, lambda rows: rows.limit(0), seeds.limit(0), 5, 0.5)
    assert none.count() == 0 and rounds == 5 and fraction == 1.0
    state = {"passed": 10}

    def generate(n):
        state["passed"] += n // 2

    assert S.top_up_seeds(generate, lambda: state["passed"], 20, 25) == (20 + 24 + 5 + 2, 3)  # gaps of 15, 3 and 1
    assert S.top_up_seeds(lambda n: None, lambda: 0, 10, 100) == (40, 1)


def test_support_chats():
    draws = SY.Draws(7)
    lines = SY.Lines(["hm"], ["manager!"], ["sorry"], ["thanks"], ["bye"], "[ESCALATE]")
    chats = [SY.chat(draws, lines) for _ in range(600)]
    assert chats == [SY.chat(d, lines) for d in [SY.Draws(7)] for _ in range(600)]
    for messages, end in chats:
        asked = sum(m["content"] == "manager!" for m in messages)
        assert [m["role"] for m in messages] == ["user", "assistant"] * (len(messages) // 2)
        assert (asked == 3 and messages[end - 1]["content"].endswith("[ESCALATE]")) if end else asked <= 1
    assert 0.13 < sum(end is not None for _, end in chats) / 600 < 0.23
    train, held = SY.split_pool([str(i) for i in range(10)], 0.25, 3)
    assert sorted(train + held) == sorted(map(str, range(10))) and len(held) == 2


def test_responders(spark):
    seeds = spark.createDataFrame([(f"s{i}",) for i in range(6)], "id string")
    good = json.dumps(talk(("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")))
    replies = spark.createDataFrame([("s0", good, 1), ("s1", '{"messages": ' + good + "}", 1), ("s2", "nothing", 1), ("s3", good.replace("user", "assistant"), 1), ("s4", "[]", 2), ("s4", good, 1)], "id string, text string, at int")
    prompt = lambda df: df.withColumn("system", F.lit("s")).withColumn("messages", F.array().cast(MESSAGES))
    emitted, failed = RE.run_stream(seeds, RE.recorded(replies), prompt, 1.0, F.col("id"), seeds.limit(0), 4)
    assert sorted(r.id for r in emitted.collect()) == ["s0", "s1"]
    assert {r.id: r.error for r in failed.collect()} == {"s2": "no messages", "s3": "roles do not alternate", "s4": "too few turns", "s5": "no reply"}

    def call(system, messages):
        if len(messages) == 1:
            raise ValueError("down")
        return f"{system}:{len(messages)}"

    prompts = spark.createDataFrame([("a", "x", []), ("b", "x", talk(("user", "q")))], f"id string, system string, messages {MESSAGES}")
    assert {r.id: r.text for r in RE.mapped(call)(prompts).collect()} == {"a": "x:0", "b": None}
    judges = {"rubric": (RE.recorded(replies.selectExpr("id", "'[RESULT] 4' as text")), lambda t: R.grade(t).cast("string")), "winner": (RE.recorded(replies.limit(0)), R.tagged_winner)}
    got = {(r.id, r.judge): r.verdict for r in RE.judged(prompt(seeds), judges).collect()}
    assert got["s0", "rubric"] == "4" and got["s5", "rubric"] is None and got["s0", "winner"] == "TIE"


def test_filters_by_name(spark):
    FL.register("mode_consistency", FL.mode_consistency)
    FL.register("own", lambda df: FL.result(F.size("messages") > 1))
    assert FL.assemble({}) == [n for n in FL.ORDER if n in FL.MECHANICAL]
    assert set(FL.assemble({"use_locale_judge": True})) == {*FL.MECHANICAL, "locale_judge"}
    df = spark.createDataFrame([(talk(("user", "a")),), (talk(("user", "a"), ("assistant", "<think>b")),)], f"messages {MESSAGES}")
    assert sorted(str(r.failing_filter) for r in FL.run_registered(df, ["own", "mode_consistency"]).collect()) == ["mode_consistency", "own"]
    with pytest.raises(KeyError):
        FL.run_registered(df, ["unknown"])
    assert Q.thinking_mode({"default": "on"}, "judge", True) == "on" and Q.thinking_mode({}, "judge", False) == "unsupported"
    with pytest.raises(ValueError):
        Q.thinking_mode({"judge": "maybe"}, "judge", True)


def test_queries_without_sql_are_brute_force(spark, sf_dir):
    from talkloom.functions import text as T
    from talkloom.plans import entities as E
    from talkloom.plans.registry import QUERIES

    turns = E.turns(spark, sf_dir).where("role = 'assistant'").select("conv_id", "turn", "content", T.strip_marker(F.col("content")).alias("bare")).collect()
    ratio = {(r.conv_id, r.turn): difflib.SequenceMatcher(None, r.content.strip(), r.bare.strip()).ratio() for r in turns}
    got = {(r.conv_id, r.turn): r.ratio for r in QUERIES["rewrite_similarity"](spark, sf_dir).collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in ratio.items()} and min(got.values()) < 1
    back = {(r.conv_id, r.turn): difflib.SequenceMatcher(None, r.bare.strip(), r.content.strip()).ratio() for r in turns}
    axes = ["off_topic", "accuracy_error", "other"]
    want = {k: v >= DD.NO_OP_LIMITS.get(axes[k[0] % 3], DD.NO_OP_DEFAULT) for k, v in back.items()}
    assert {(r.conv_id, r.turn): r.no_op for r in QUERIES["near_no_op_rewrites"](spark, sf_dir).collect()} == want
