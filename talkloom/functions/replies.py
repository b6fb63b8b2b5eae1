"""Reading model replies: fences, reasoning blocks, located JSON, grades and verdicts.

All but the bracket scans are column expressions. A scan for the first balanced
block needs a counter from character to character, which no built-in has; it
runs over Arrow batches.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reasoning blocks, channel markers, the result tag, the fence around a payload.
THINK_BLOCK = r"(?is)<think\b[^>]*>.*?</think\s*>"
FINAL_CHANNEL = r"(?is)<\|channel\|>\s*final\s*<\|message\|>(.*?)(?:<\|end\|>|$)"
ANALYSIS_CHANNEL = r"(?is)<\|channel\|>\s*analysis\s*<\|message\|>.*?(?:<\|end\|>|(?=<\|channel\|>)|$)"
CHANNEL_TOKEN = r"(?i)<\|(?:end|start|channel|message)\|>"
RESULT_TAG = r"(?i)\[RESULT\]\s*(\d+)"
PAYLOAD_FENCE = r"(?is)```(?:json)?\s*(.*?)\s*```"
#: Fields of an evaluation, and its dimensions.
EVALUATION_FIELDS = ["overall_cefr_estimate", "scores", "specific_feedback", "strengths", "suggested_practice"]
DIMENSIONS = ["fluency", "accuracy", "vocabulary", "interaction", "topic_adherence"]
NOTE_CHARS, FEEDBACK_CHARS = 240, 280
SPACE = r"[ \t\n\x0B\f\r]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def strip_fence(text: Column) -> Column:
    """The trimmed text; if it opens with a code fence, without its first line, and without its last if that opens with a fence too."""
    lines = F.split(strip(text), r"\r\n|\n|\r")
    body = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    closed = F.slice(body, F.lit(1), F.greatest(F.size(body) - 1, F.lit(0)))
    last = F.coalesce(strip(F.get(body, F.size(body) - 1)).startswith("```"), F.lit(False))
    return F.when(strip(text).startswith("```"), F.array_join(F.when(last, closed).otherwise(body), "\n")).otherwise(strip(text))


def strip_reasoning(text: Column) -> Column:
    """The answer: the final channel's body if there is one; else the text without analysis channels, stray
    channel tokens and closed think blocks, cut at a think tag that stays open."""
    final = F.regexp_extract(text, FINAL_CHANNEL, 1)
    bare = F.regexp_replace(F.regexp_replace(text, ANALYSIS_CHANNEL, ""), CHANNEL_TOKEN, "")
    closed = F.regexp_replace(bare, THINK_BLOCK, "")
    open_at = F.length(closed) - F.length(F.regexp_extract(closed, r"(?is)<think(?!.*<think).*$", 0))
    cut = F.when(F.lower(closed).contains("<think"), F.substring(closed, F.lit(1), open_at)).otherwise(closed)
    return F.when(text.rlike(FINAL_CHANNEL), strip(F.regexp_replace(final, CHANNEL_TOKEN, ""))).otherwise(strip(cut))


def payload(text: Column) -> Column:
    """What follows the first closing think tag, or all of it; of that the body of the first code fence, if any."""
    close = F.regexp_extract(text, r"(?is)^.*?</think\s*>(.*)$", 1)
    after = F.when(text.rlike(r"(?i)</think\s*>"), close).otherwise(text)
    return strip(F.when(after.rlike(PAYLOAD_FENCE), F.regexp_extract(after, PAYLOAD_FENCE, 1)).otherwise(after))


def _balanced(text: str, opener: str, closer: str, strings: bool) -> str | None:
    """The first balanced block; brackets within strings don't count if ``strings``."""
    start, depth, quoted, escaped = text.find(opener), 0, False, False
    for at in range(start, len(text)) if start >= 0 else ():
        c = text[at]
        if strings and escaped:
            escaped = False
        elif strings and c == "\\":
            escaped = True
        elif strings and c == '"':
            quoted = not quoted
        elif not quoted and c in (opener, closer):
            depth += 1 if c == opener else -1
            if not depth:
                return text[start : at + 1]
    return None


def _parsed(text: str | None) -> str | None:
    """The JSON value in one form (sorted keys, no spaces), or None."""
    try:
        return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return None


def _first_value(text: str) -> str | None:
    """The whole text if it parses; else the first balanced object; a text without one gives its first balanced array."""
    if (whole := _parsed(text)) is not None:
        return whole
    for opener, closer in ("{}", "[]"):
        if (block := _balanced(text, opener, closer, True)) is not None:
            return _parsed(block)
    return None


def _first_object(text: str) -> str | None:
    """The first block of balanced braces, strings not heeded."""
    return _parsed(_balanced(text, "{", "}", False))


def _repaired_object(text: str) -> str | None:
    """From the first brace to the last one: as it is, without trailing commas, or as a Python literal."""
    start, end = text.find("{"), text.rfind("}")
    if start < 0 or end < start:
        return None
    block = text[start : end + 1]
    for some in (block, re.sub(r",(\s*[}\]])", r"\1", block)):
        if (value := _parsed(some)) is not None:
            return value
    try:
        value = ast.literal_eval(block)
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False) if isinstance(value, dict) else None
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None


def _locator(find: Callable[[str], str | None]):
    @F.pandas_udf("string")
    def locate(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else find(t))

    return locate


#: How JSON is located: ``first_value`` heeds strings, ``first_object`` doesn't, ``repaired_object`` mends what it takes.
LOCATORS = {"first_value": _first_value, "first_object": _first_object, "repaired_object": _repaired_object}


def locate_json(text: Column, how: str = "first_value") -> Column:
    """The located JSON in one form (keys sorted, no spaces); null if there is none or it doesn't parse."""
    return _locator(LOCATORS[how])(text)


def first_json(text: Column) -> Column:
    """The first JSON value of a reply: reasoning and an enclosing fence go first."""
    return locate_json(strip_fence(strip_reasoning(text)))


def is_object(value: Column) -> Column:
    return F.coalesce(value.startswith("{"), F.lit(False))


def has_fields(value: Column, fields: list[str]) -> Column:
    """Whether located JSON is an object with all of these keys."""
    keys = F.json_object_keys(F.when(is_object(value), value))
    return F.coalesce(F.size(F.array_intersect(keys, F.array(*[F.lit(f) for f in fields]))) == len(fields), F.lit(False))


def whole_number(value: Column) -> Column:
    """A JSON scalar as an integer: numbers are cut towards zero, numeric strings taken, others null."""
    return F.when(value.rlike(rf"^{SPACE}*[-+]?\d+{SPACE}*$"), F.try_to_number(strip(value), F.lit("S999999999")).cast("int")).when(value.rlike(r"^-?\d+\.\d+$"), F.regexp_extract(value, r"^(-?\d+)", 1).cast("int"))


def dimension_scores(value: Column) -> Column:
    """A struct of the five scores of located evaluation JSON; null if one is missing, no number, or outside 1..5."""
    scores = [whole_number(F.get_json_object(value, f"$.scores.{d}")) for d in DIMENSIONS]
    good = has_fields(value, EVALUATION_FIELDS)
    for s in scores:
        good = good & F.coalesce(s.between(1, 5), F.lit(False))
    return F.when(good, F.struct(*[s.alias(d) for s, d in zip(scores, DIMENSIONS, strict=True)]))


def grade(text: Column) -> Column:
    """The number behind the first result tag if it is 1..5, else null."""
    n = F.regexp_extract(text, RESULT_TAG, 1)
    return F.when(n.rlike("^0*[1-5]$"), n.cast("int"))


def feedback(text: Column) -> Column:
    """The prose before the result tag without its first label, at most 280 characters."""
    head = F.when(text.rlike(RESULT_TAG), F.regexp_extract(text, rf"(?is)^(.*?){RESULT_TAG[4:]}", 1)).otherwise(text)
    at = F.instr(head, "Feedback:")
    bare = F.when(at > 0, F.concat(F.substring(head, F.lit(1), at - 1), F.substring(head, at + 9, F.length(head)))).otherwise(head)
    return F.substring(strip(bare), 1, FEEDBACK_CHARS)


def tagged_winner(text: Column) -> Column:
    """A or B behind the result tag, else TIE."""
    found = F.upper(F.regexp_extract(text, r"(?i)\[RESULT\]\s*([AB])", 1))
    return F.when(found != "", found).otherwise("TIE")


def json_winner(value: Column) -> Column:
    """The winner in located JSON: A, B or TIE, case ignored; TIE for anything else."""
    found = F.upper(strip(F.get_json_object(F.when(is_object(value), value), "$.winner")))
    return F.when(found.isin("A", "B"), found).otherwise("TIE")


def verdict(value: Column, axes: list[str], default: str) -> Column:
    """``winner, margin, reason_axis, note`` of located JSON; null without a winner of A, B or tie.

    A margin that is no number is 0, an unknown axis the default, a note is cut at 240 characters.
    """
    field = lambda name: F.get_json_object(F.when(is_object(value), value), f"$.{name}")
    axis = F.when(field("reason_axis").isin(axes), field("reason_axis")).otherwise(default)
    note = F.substring(F.coalesce(field("note"), F.lit("")), 1, NOTE_CHARS)
    found = F.struct(field("winner").alias("winner"), F.coalesce(whole_number(field("margin")), F.lit(0)).alias("margin"), axis.alias("reason_axis"), note.alias("note"))
    return F.when(field("winner").isin("A", "B", "tie"), found)


def repair_evaluation(text: Column) -> tuple[Column, Column]:
    """(text, error) of a generated evaluation: loose prose becomes a think block, doubled close tags collapse;
    replies without reasoning or JSON, or with fewer than 30 characters of it, are errors (the text is null)."""
    tagged = text.contains("<think>") & text.contains("</think>")
    brace = F.instr(text, "{")
    head = strip(F.substring(text, F.lit(1), brace - 1))
    wrapped = F.concat(F.lit("<think>\n"), head, F.lit("\n</think>\n"), F.substring(text, brace, F.length(text)))
    opens, closes = F.instr(text, "<think>") + 7, F.instr(text, "</think>")
    body = strip(F.substring(text, opens, closes - opens))
    whole = F.when(tagged, text).otherwise(wrapped)
    tail = F.regexp_extract(whole, r"(?s)^.*</think>(.*)$", 1)
    error = (
        F.when(~tagged & (brace == 0), "no reasoning and no JSON")
        .when(~tagged & (head == ""), "JSON only")
        .when(tagged & (closes < opens), "close before open")
        .when(tagged & (F.length(body) < 30), "trivial reasoning")
        .when(~tail.contains("{"), "no JSON after the reasoning")
    )
    return F.when(error.isNull(), F.concat(F.regexp_extract(whole, r"(?s)^(.*?</think>)", 1), tail)), error


def topic_ratio(value: Column, declared: Column) -> Column:
    """Judged topic adherence from located JSON: ``covered`` of ``total`` (by default the declared), within 0..1; 1 if none are declared or counted, 0 without a verdict."""
    field = lambda name: F.get_json_object(F.when(is_object(value), value), f"$.{name}")
    covered = F.when(field("covered").isNull(), 0).otherwise(whole_number(field("covered")))
    total = F.when(field("total").isNull(), declared).otherwise(whole_number(field("total")))
    share = F.when(total <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), covered.cast("double") / total)))
    return F.when(declared == 0, 1.0).when(~is_object(value) | covered.isNull() | total.isNull(), 0.0).otherwise(F.coalesce(share, F.lit(0.0)))


def natural_score(value: Column) -> Column:
    """A judged naturalness of 0..5 from located JSON, cut to that range; 0 without a verdict."""
    n = F.get_json_object(F.when(is_object(value), value), "$.score").try_cast("double")
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(5.0), n))).otherwise(0.0)
