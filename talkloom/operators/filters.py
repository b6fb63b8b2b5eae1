"""Quality filters as struct columns, and the ordered pipeline over them.

A filter is a function of a DataFrame that returns a column
``struct<passed boolean, score double, reason string>``. The pipeline evaluates
all of them in one projection; Spark runs no Python and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.functions import text as T

#: The order in which filters run; others follow in the order given.
ORDER = ["speaks_l1_sanity", "non_latin_script", "banned_terms", "mode_consistency", "naturalness", "locale_judge", "naturalness_judge"]

#: A level's targets, four numbers each for sentence length, markers per 100 tokens, opener variety, contraction rate.
LEVEL_TARGETS = {
    "A1": [(2, 3, 8, 14), (0, 0.5, 4, 8), (0.1, 0.4, 1, 1), (0, 0, 0.4, 0.8)],
    "A2": [(2, 4, 10, 18), (0, 1, 5, 10), (0.2, 0.5, 1, 1), (0, 0.2, 0.6, 0.9)],
    "B1": [(4, 6, 14, 24), (0, 1.5, 6, 12), (0.3, 0.6, 1, 1), (0, 0.3, 0.7, 0.95)],
    "B2": [(5, 8, 18, 30), (0.5, 2, 7, 14), (0.4, 0.65, 1, 1), (0.1, 0.4, 0.8, 0.97)],
    "C1": [(6, 10, 22, 36), (1, 2.5, 9, 16), (0.5, 0.7, 1, 1), (0.2, 0.5, 0.85, 0.98)],
    "C2": [(6, 10, 26, 42), (1, 2.5, 10, 18), (0.5, 0.7, 1, 1), (0.2, 0.5, 0.85, 0.98)],
}
METRICS = ["sentence_length", "discourse_per_100", "opener_variety", "contraction_rate"]
PASS_ABOVE, MIN_TOKENS, DISCOURSE_TOKENS, MIN_CONTRACTIONS = 0.6, 40, 80, 3
HIT_CAP = 8

#: Admissions of being a model, and giving in to a swap of roles.
ADMISSIONS = [
    r"\b(?:I am|I'm)\s+an?\s+AI\b",
    r"\bAs\s+an\s+AI\b",
    r"\b(?:I am|I'm)\s+a\s+(?:language model|chatbot|bot)\b",
    r"\b(?:I am|I'm)\s+(?:a\s+)?large\s+language\s+model\b",
    r"\b(?:I am|I'm)\s+(?:Claude|ChatGPT|GPT-?\d*|Gemini|Qwen|Llama)\b",
    r"\bI\s+was\s+(?:trained|created|built)\s+by\b",
]
CAPITULATIONS = [
    r"\bOkay,\s*(?:I'll|I will)\s+be\s+the\s+(?:learner|student|customer)\b",
    r"\b(?:Sure|Alright|Fine),\s*(?:you|you'll)\s+(?:can\s+)?be\s+the\s+(?:tutor|vendor|doctor|teacher|shopkeeper)\b",
    r"\bTeach\s+me\b",
]
AXIS_CHECKS = {
    "persistent_language_violation": T.script_class(T.NARROW_SCRIPTS),
    "persistent_persona_break": "(?i)" + "|".join(ADMISSIONS),
    "persistent_role_swap": "(?i)" + "|".join(CAPITULATIONS),
}


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated once per row, however often they are used.

    The optimiser merges adjacent projections and would write a reused
    expression out at each use; a one-row generator stands between them.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def result(passed: Column, score: Column | None = None, reason: Column | None = None) -> Column:
    null = lambda c, kind: F.lit(None).cast(kind) if c is None else c.cast(kind)
    return F.struct(passed.alias("passed"), null(score, "double").alias("score"), null(reason, "string").alias("reason"))


def non_latin_script(df: DataFrame) -> Column:
    """Fails on other scripts in any message; user turns of redirect streams are exempt."""
    scanned = F.filter("messages", lambda m: ~((m["role"] == "user") & (F.col("stream") != "normal")))
    bad = F.size(F.filter(scanned, lambda m: m["content"].rlike(T.script_class(T.SCRIPTS))))
    return result(bad == 0, F.when(bad == 0, 1.0).otherwise(0.0), F.when(bad > 0, F.concat(F.lit("other scripts in "), bad.cast("string"), F.lit(" fields"))))


def term_pattern(terms: list[str]) -> str:
    """One alternation, longest term first, bounded by anything but ASCII letters."""
    ordered = sorted(terms, key=lambda t: (-len(t), t))
    return "(?<![A-Za-z])(?:" + "|".join("\\Q" + t + "\\E" for t in ordered) + ")(?![A-Za-z])"


def banned_terms(categories: dict[str, list[str]]) -> Callable[[DataFrame], Column]:
    """Fails on a listed term, case-sensitively, in any turn but the user's; the score is the number of hits, 8 at most."""

    def check(df: DataFrame) -> Column:
        def of(category: str, content: Column) -> Column:
            found = F.regexp_extract_all(content, F.lit(term_pattern(categories[category])), F.lit(0))
            return F.transform(found, lambda t: F.concat(F.lit(category + ": "), t))

        def hits(m: Column) -> Column:
            return F.concat(*[of(c, m["content"]) for c in categories])

        found = F.slice(F.flatten(F.transform(F.filter("messages", lambda m: m["role"] != "user"), hits)), 1, HIT_CAP)
        return result(F.size(found) == 0, F.size(found), F.get(found, F.lit(0)))

    return check


def mode_consistency(df: DataFrame) -> Column:
    """Fails if an assistant turn holds a think tag."""
    bad = F.exists(T.contents(F.col("messages"), "assistant"), lambda c: c.rlike(r"(?i)</?think\b"))
    return result(~bad, None, F.when(bad, F.lit("think tag in an assistant turn")))


def naturalness_parts(text: Column, level: Column) -> dict[str, Column]:
    """Token and sentence counts, the four metrics, and their band scores for the level."""
    n, s = F.size(T.tokens(text)), F.size(T.sentences(text))
    c, u, d = T.contracted(text), T.uncontracted(text), T.discourse(text)
    first = T.openers(text)
    value = {
        "sentence_length": F.when(s > 0, n / s).otherwise(0.0),
        "discourse_per_100": F.when(n > 0, d * 100.0 / n).otherwise(0.0),
        "opener_variety": F.when(F.size(first) > 0, F.size(F.array_distinct(first)) / F.size(first)).otherwise(0.0),
        "contraction_rate": F.when(c + u > 0, c / (c + u)).otherwise(0.0),
    }
    return {"n_tokens": n, "n_sentences": s, "contracted": c, "uncontracted": u, **value}


def level_scores(df: DataFrame) -> DataFrame:
    """Add ``score_<metric>`` from the measured columns and the level's targets (a literal map, no join)."""
    def scored(i: int, metric: str) -> Column:
        edge = [F.create_map(*[x for lv, t in LEVEL_TARGETS.items() for x in (F.lit(lv), F.lit(float(t[i][k])))])[F.col("level")] for k in range(4)]
        return T.band_score(F.col(metric), *edge)

    return once(df, {f"score_{m}": scored(i, m) for i, m in enumerate(METRICS)})


def measure_naturalness(df: DataFrame, due: Column | None = None) -> DataFrame:
    """Add assistant text measures and band scores; with ``due`` only those of the rows where it holds."""
    text = T.assistant_text(F.col("messages"))
    texts = once(df, {"_text": text if due is None else F.when(due, text)})
    return level_scores(once(texts, naturalness_parts(F.col("_text"), F.col("level"))))


def naturalness(df: DataFrame) -> Column:
    """Over :func:`measure_naturalness`: the mean of two to four band scores must exceed 0.6; short texts pass."""
    use_d = (F.col("n_tokens") >= DISCOURSE_TOKENS).cast("int")
    use_c = (F.col("contracted") + F.col("uncontracted") >= MIN_CONTRACTIONS).cast("int")
    total = F.col("score_sentence_length") + F.col("score_opener_variety") + use_d * F.col("score_discourse_per_100") + use_c * F.col("score_contraction_rate")
    mean = total / (2 + use_d + use_c)
    blank = F.trim(F.col("_text")) == ""
    short = F.col("n_tokens") < MIN_TOKENS
    return result(
        F.when(blank, False).when(short, True).otherwise(mean > PASS_ABOVE),
        F.when(~blank & ~short, mean),
        F.when(blank, F.lit("no assistant text")).when(short, F.lit("too short")).when(mean <= PASS_ABOVE, F.lit("unnatural")),
    )


def axis_check(df: DataFrame) -> Column:
    """Tutor turns of a persistent stream must not break its axis's rule."""
    def breaks(pattern: str) -> Column:
        return F.exists(T.contents(F.col("messages"), "assistant"), lambda c: c.rlike(pattern))

    bad = F.lit(False)
    for axis, pattern in AXIS_CHECKS.items():
        bad = F.when(F.col("stream") == axis, breaks(pattern)).otherwise(bad)
    return result(~bad, None, F.when(bad, F.col("stream")))


def structure(df: DataFrame, least: int = 4) -> Column:
    """Strict alternation from the user on, and so many turns at least."""
    turns = F.filter("messages", lambda m: m["role"] != "system")
    odd = F.exists(F.transform(turns, lambda m, i: m["role"] != F.when(i % 2 == 0, "user").otherwise("assistant")), lambda b: b)
    few = F.size(turns) < least
    return result(~odd & ~few, F.size(turns), F.when(few, F.lit("too few turns")).when(odd, F.lit("roles do not alternate")))


def marker_structure(messages: Column, count: int) -> tuple[Column, Column]:
    """(exactly so many messages besides the system's, the marker in exactly one message and that the tutor's)."""
    marked = F.filter(messages, lambda m: m["content"].contains("[SESSION_END"))
    one = (F.size(marked) == 1) & F.coalesce(F.get(marked, F.lit(0))["role"] == "assistant", F.lit(False))
    return F.size(F.filter(messages, lambda m: m["role"] != "system")) == count, one


def run_pipeline(df: DataFrame, filters: dict[str, Column], short_circuit: bool = True) -> DataFrame:
    """Add ``runs`` (one struct per filter, in order), ``passed``, ``failing_filter`` and ``failing_reason``.

    With ``short_circuit`` the runs after the first failure are recorded as
    passed and skipped. Only the first failure is reported either way.
    """
    names = [n for n in ORDER if n in filters] + [n for n in filters if n not in ORDER]
    df = once(df, {f"_f_{n}": filters[n] for n in names})
    runs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"_f_{n}.passed").alias("passed"), F.col(f"_f_{n}.score").alias("score"), F.col(f"_f_{n}.reason").alias("reason")) for n in names])
    df = once(df, {"_runs": runs})
    df = once(df, {"_first": F.array_position(F.transform("_runs", lambda r: r["passed"]), False)})
    skipped = lambda i: (F.col("_first") > 0) & (i + 1 > F.col("_first")) & F.lit(short_circuit)
    df = df.withColumn(
        "runs",
        F.transform("_runs", lambda r, i: F.struct(r["name"].alias("name"), (r["passed"] | skipped(i)).alias("passed"), F.when(~skipped(i), r["score"]).alias("score"), F.when(~skipped(i), r["reason"]).alias("reason"), skipped(i).alias("skipped"))),
    )
    failing = F.filter("_runs", lambda r: ~r["passed"])
    df = df.withColumn("passed", F.col("_first") == 0).withColumn("failing_filter", F.get(failing, F.lit(0))["name"]).withColumn("failing_reason", F.get(failing, F.lit(0))["reason"])
    return df.drop("_runs", "_first", *[f"_f_{n}" for n in names])


def run_staged(df: DataFrame, cheap: dict[str, Column], dear: str, measure: Callable[[DataFrame, Column], DataFrame], check: Callable[[DataFrame], Column]) -> DataFrame:
    """:func:`run_pipeline` in two stages: what the dear filter (last in order) needs is measured only on rows that pass the cheap ones."""
    df = once(df, {f"_c_{n}": c for n, c in cheap.items()})
    due = F.lit(True)
    for n in cheap:
        due = due & F.col(f"_c_{n}.passed")
    df = measure(df, due)
    return run_pipeline(df, {**{n: F.col(f"_c_{n}") for n in cheap}, dear: check(df)})


#: The names a configuration may list; judges are added where they are switched on.
MECHANICAL = ["speaks_l1_sanity", "non_latin_script", "banned_terms", "mode_consistency", "naturalness"]
JUDGES = {"use_locale_judge": "locale_judge", "use_naturalness_judge": "naturalness_judge"}
_REGISTRY: dict[str, Callable[[DataFrame], Column]] = {}


def register(name: str, check: Callable[[DataFrame], Column]) -> None:
    """Make a filter known: a function of the DataFrame that returns its result column (see :func:`result`)."""
    _REGISTRY[name] = check


def assemble(config: dict[str, bool]) -> list[str]:
    """The filters of a configuration in canonical order: the mechanical ones, and the judges it switches on."""
    chosen = MECHANICAL + [name for key, name in JUDGES.items() if config.get(key)]
    return [n for n in ORDER if n in chosen] + [n for n in chosen if n not in ORDER]


def run_registered(df: DataFrame, names: list[str]) -> DataFrame:
    """:func:`run_pipeline` over registered filters; an unknown name raises KeyError."""
    return run_pipeline(df, {n: _REGISTRY[n](df) for n in names})


#: Phrases that introduce an English version, the quoted span, and the limits of an echo.
ECHO_INTRO = r"(?i)(?:you could say in english|in english (?:we'?d|you'?d|you would) say|let me say it in english|in english(?: that)?(?: would be)?[:,])"
QUOTED = "['\"\u2018\u2019\u201c\u201d]([^'\"\u2018\u2019\u201c\u201d]{4,200})['\"\u2018\u2019\u201c\u201d]"
ECHO_SIMILARITY, ECHO_CHARS = 0.85, 12


def l1_sanity(messages: Column, trigger: Column) -> Column:
    """Of rows with the trigger ``speaks_l1``: fails without a user turn in another script, or if a tutor turn quotes the prior English user turn as its own translation."""
    import difflib
    import re
    import unicodedata

    other = T.script_class(T.SCRIPTS)
    spoken = F.exists(messages, lambda m: (m["role"] == "user") & m["content"].rlike(other))
    quoted = lambda c: F.trim(F.regexp_extract(c, QUOTED, 1))

    def pair(m: Column, i: Column) -> Column:
        before = F.filter(F.slice(messages, F.lit(1), i), lambda x: x["role"] == "user")
        prior = F.try_element_at(before, F.lit(-1))["content"]
        ok = (m["role"] == "assistant") & m["content"].rlike(ECHO_INTRO) & (F.length(quoted(m["content"])) >= ECHO_CHARS) & (F.length(prior) >= ECHO_CHARS) & ~prior.rlike(other)
        return F.when(ok, F.struct(quoted(m["content"]).alias("q"), prior.alias("p")))

    @F.pandas_udf("boolean")
    def echoes(pairs: pd.Series) -> pd.Series:
        fold = lambda t: re.sub("[^a-z0-9]+", "", unicodedata.normalize("NFKC", t).lower())
        close = lambda x: difflib.SequenceMatcher(None, fold(x["p"]), fold(x["q"])).ratio() >= ECHO_SIMILARITY
        return pairs.map(lambda xs: any(close(x) for x in xs))

    echo = echoes(F.filter(F.transform(messages, pair), lambda x: x.isNotNull()))
    due = F.coalesce(trigger == "speaks_l1", F.lit(False))
    reason = F.when(due & ~spoken, F.lit("no_l1_turn")).when(due & echo, F.lit("english_echo"))
    return result(reason.isNull(), F.when(due, F.when(reason.isNull(), 1.0).otherwise(0.0)), reason)


def summary(run: DataFrame) -> DataFrame:
    """Per filter: documents it checked, failed, and was the first to fail."""
    # counted per pattern of flags first: few rows, and every filter is evaluated once
    flags = F.transform("runs", lambda r: F.struct(r["name"].alias("name"), r["passed"].alias("passed"), r["skipped"].alias("skipped")))
    patterns = run.select("failing_filter", flags.alias("flags")).groupBy("failing_filter", "flags").agg(F.count(F.lit(1)).alias("n"))
    rows = patterns.select("failing_filter", "n", F.explode("flags").alias("r"))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    return rows.groupBy(F.col("r.name").alias("filter")).agg(
        total(~F.col("r.skipped")).alias("n_checked"),
        total(~F.col("r.passed")).alias("n_failed"),
        total(F.col("failing_filter") == F.col("r.name")).alias("n_first"),
    )
