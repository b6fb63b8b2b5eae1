"""Record cleaning, vocabulary and locale checks, pair selection, balanced assignment."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.functions import hashing as H
from talkloom.functions import text as T
from talkloom.operators import extraction as X

LEVELS = ["A1", "A2", "B1", "B2", "C1", "C2"]


def clean_messages(messages: Column) -> Column:
    """Messages that have both a role and a content."""
    return F.filter(messages, lambda m: m["role"].isNotNull() & m["content"].isNotNull())


def seed_id(record_id: Column) -> Column:
    """The 12 hex digits at an id's end, before an optional variant; null without them."""
    found = F.regexp_extract(record_id, r"([0-9a-f]{12})(?:_v\d+)?$", 1)
    return F.when(found != "", found)


def variant(record_id: Column) -> Column:
    """The variant tag, v0 without one."""
    found = F.regexp_extract(record_id, r"_(v\d+)$", 1)
    return F.when(found == "", "v0").otherwise(found)


#: What a system prompt tells of its markers, and how tutor turns help or give answers away.
AXIS_TELL, GENERIC_TELL = "[SESSION_END: persistent_off_topic]", "Emit this sentinel for ALL four persistent axes"
SCAFFOLD = r"\?|\b(?:try|think|what do you|listen|how about|let'?s see|guess|your turn|hint|spot the)\b"
DIRECT_ANSWER = r"\bthe rule (?:for|is)\b|\bthe answer is\b|\brule\s*\d\b|\bfirst[,]?\s+(?:we|you)\s+(?:use|say)\b|^\s*[-*\x{2022}]\s"
#: Capitalised words that are no names.
NAME_OPENERS = (
    "yes no oh well ok okay sure hi hello hey bye thanks thank goodbye please sorry when where why how what who which if or and but so then there here "
    "this that these those the a an i you he she we they it my your his her our their some any today tomorrow yesterday monday tuesday wednesday thursday friday saturday sunday"
).split()
FALLBACK = "Sorry, let us go back to our topic."


def classify_prompt(prompt: Column) -> Column:
    """One of five labels by the two tells; blank prompts are missing."""
    axis, generic = prompt.contains(AXIS_TELL), prompt.contains(GENERIC_TELL)
    return F.when(F.coalesce(prompt, F.lit("")) == "", "missing").when(axis & generic, "MIXED (BUG?)").when(axis, "axis_specific").when(generic, "generic").otherwise("neither (BUG?)")


def starter_turn(name: Column, topic: Column) -> Column:
    """The learner's opener: name and topic are left out where they are blank."""
    part = lambda before, x, after: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(before), x, F.lit(after))).otherwise("")
    return F.concat(F.lit("Hello."), part(" My name is ", name, "."), part(" I want to practice English about ", topic, "."))


def guarded(drafts: list[Column], ok) -> tuple[Column, Column]:
    """(reply, its number from 1): the first draft that passes, else the canned reply."""
    reply, number = F.lit(FALLBACK), F.lit(len(drafts) + 1)
    for i in range(len(drafts) - 1, -1, -1):
        fine = F.coalesce(ok(drafts[i]), F.lit(False))
        reply, number = F.when(fine, drafts[i]).otherwise(reply), F.when(fine, i + 1).otherwise(number)
    return reply, number


def applicable_axes(text: Column, axes: list[str]) -> Column:
    """The axes a turn has material for: ``accuracy`` needs eight words, ``locale`` a real name; all of them if none applies."""
    named = F.exists(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-zA-Z]{2,}\b"), F.lit(0)), lambda x: ~F.lower(x).isin(NAME_OPENERS))
    fits = {"accuracy": T.word_count(text) >= 8, "locale": named}
    some = F.filter(F.array(*[F.when(fits.get(a, F.lit(True)), F.lit(a)) for a in axes]), lambda a: a.isNotNull())
    return F.when(F.size(some) > 0, some).otherwise(F.array(*[F.lit(a) for a in axes]))


def quality_gate(df: DataFrame, by: str, least: float = 0.60, positive: float = 0.50, negative: float = 0.10) -> DataFrame:
    """Per group of ``messages, passed``: pass rate, share of tutor turns with the good and the bad pattern, and whether all three are within limits."""
    rows = df.groupBy(by).agg(F.count(F.lit(1)).alias("n_raw"), F.count_if("passed").alias("n_passed"))
    turns = df.select(by, F.explode(T.contents(F.col("messages"), "assistant")).alias("c")).where(F.trim("c") != "")
    rate = lambda p: F.avg(F.col("c").rlike(p).cast("int"))
    shown = turns.groupBy(by).agg(rate("(?i)" + SCAFFOLD).alias("positive_rate"), rate("(?im)" + DIRECT_ANSWER).alias("negative_rate"))
    out = rows.join(shown, by, "left").na.fill(0.0, ["positive_rate", "negative_rate"]).withColumn("pass_rate", F.col("n_passed") / F.col("n_raw"))
    return out.withColumn("ok", (F.col("pass_rate") >= least) & (F.col("positive_rate") >= positive) & (F.col("negative_rate") <= negative))


def above_band(df: DataFrame, bands: DataFrame, key: str, text: Column, level: str = "level", lower: bool = True, offenders: int = 0) -> DataFrame:
    """Per row the known words, those above its level, their share, and with ``offenders`` so many of the latter, most frequent first.

    ``bands`` (word, band 0..5) is joined by Spark's choice: broadcast only
    under its size threshold. Words are counted per row before the join.
    """
    tokens = T.tokens(F.lower(text) if lower else text)
    words = df.select(key, level, F.explode(tokens).alias("word")).groupBy(key, level, "word").agg(F.count(F.lit(1)).alias("n"))
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col(level)) - 1
    found = words.join(bands, "word").withColumn("above", F.col("band") > rank)
    known = found.groupBy(key).agg(F.sum("n").alias("n_known"), F.sum(F.when(F.col("above"), F.col("n")).otherwise(0)).alias("n_above"))
    out = df.select(key, level).join(known, key, "left").na.fill(0, ["n_known", "n_above"])
    if offenders:
        out = out.join(X.top_offenders(found.where("above"), key, offenders), key, "left")
    return out.withColumn("ratio", F.when((F.col(level) == "C2") | (F.col("n_known") == 0), 0.0).otherwise(F.col("n_above") / F.col("n_known")))


def vocabulary_filter(measured: DataFrame, most: float = 0.05, least: int = 30) -> Column:
    """C2 and texts of few known words pass; others if the share above their band is at most ``most``."""
    return (F.col("level") == "C2") | (F.col("n_known") < least) | (F.col("ratio") <= most)


def locale_scores(entities: DataFrame, verdicts: DataFrame, key: str, weight: float = 0.7, least: float = 0.5) -> DataFrame:
    """Per row the share of entities in the locale, ambiguous ones weighted; an entity without a verdict is ambiguous.

    Passes at ``least`` or more without any entity out of the locale.
    """
    v = F.coalesce("verdict", F.lit("ambiguous"))
    g = entities.join(verdicts, ["entity", "locale"], "left").groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(v == "in").alias("n_in"), F.count_if(v == "ambiguous").alias("n_ambiguous"), F.count_if(v == "out").alias("n_out"))
    score = (F.col("n_in") + weight * F.col("n_ambiguous")) / F.col("n")
    return g.withColumn("score", score).withColumn("passed", (score >= least) & (F.col("n_out") == 0))


def gazetteer_pattern(terms: list[str]) -> str:
    """Whole words, case ignored; spaces flexible, a hyphen standing for a space or nothing."""
    plain = ["".join(r"\s+" if c == " " else r"(?:\s|-)?" if c == "-" else re.escape(c) for c in t) for t in sorted(terms, key=lambda t: (-len(t), t))]
    return r"(?i)\b(?:" + "|".join(plain) + r")\b"


def redirect_success(reply: Column, avoided: str, subtopics: list[str]) -> Column:
    """At least 8 words, no avoided term, and a subtopic named or 60 words at most."""
    n = T.word_count(reply)
    named = F.lit(False)
    for s in subtopics:
        named = named | F.lower(reply).contains(s.lower())
    return (n >= 8) & ~reply.rlike(avoided) & (named | (n <= 60))


def judged_pairs(df: DataFrame, margin: int = 2) -> DataFrame:
    """Add ``outcome`` for every verdict and keep flag ``is_pair``: the teacher wins by the margin or more.

    The teacher stood first where the salted id hash is even.
    """
    first = H.number(F.concat(F.lit("ab:"), F.col("id"))) % 2 == 0
    teacher = F.when(F.col("winner") == "tie", "tie").when((F.col("winner") == "a") == first, "teacher_win").when(F.col("winner").isin("a", "b"), "policy_win").otherwise("invalid")
    out = df.withColumn("outcome", teacher)
    return out.withColumn("is_pair", (F.col("outcome") == "teacher_win") & (F.coalesce("margin", F.lit(0)) >= margin))


def first_valid_axis(candidates: DataFrame, key: str, axes: list[str], attempts: int = 3) -> DataFrame:
    """Per row the first valid candidate, axes tried cyclically from the assigned one."""
    position = F.array_position(F.array(*[F.lit(a) for a in axes]), F.col("axis"))
    assigned = F.array_position(F.array(*[F.lit(a) for a in axes]), F.col("assigned"))
    distance = F.pmod(position - assigned, F.lit(len(axes)))
    tried = candidates.withColumn("_d", distance).where((F.col("_d") < attempts) & F.col("valid"))
    return tried.groupBy(key).agg(F.min_by("axis", "_d").alias("axis"), F.min("_d").cast("int").alias("n_skipped"))


def assign_axes(df: DataFrame, by: str, key: str, axes: list[str], seed: dict[str, int] | None = None) -> DataFrame:
    """Walking a group's ids in order, each takes its applicable axis of lowest running count, ties by axis order.

    State runs from row to row, so a group is one task by nature; only the key
    and the options go there, some 100 bytes a row, so a group may hold tens of
    millions of rows at most. ``seed`` gives counts to start from.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        counts, chosen = {a: (seed or {}).get(a, 0) for a in axes}, []
        pdf = pdf.sort_values(key)
        for options in pdf["applicable"]:
            axis = min((a for a in axes if a in set(options)), key=lambda a: (counts[a], axes.index(a)))
            counts[axis] += 1
            chosen.append(axis)
        return pd.DataFrame({by: pdf[by], key: pdf[key], "axis": chosen})

    return df.select(by, key, "applicable").groupBy(by).applyInPandas(walk, f"`{by}` string, `{key}` string, axis string")


def metric_paths(df: DataFrame, section: str, metrics: list[str]) -> DataFrame:
    """``path, value``: one row per section and metric, dotted."""
    pairs = F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("v")) for m in metrics])
    return df.select(section, F.inline(pairs)).select(F.concat_ws(".", F.col(section), "m").alias("path"), F.col("v").alias("value"))
