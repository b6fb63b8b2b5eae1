"""Model calls as DataFrame functions: a responder takes ``id, system, messages`` and returns ``id, text``.

The library brings recorded responders, which join replies that are stored
already, and a mapped one that calls any Python function from each partition
(a client of the user's own). Streams, judges and the simulated hold-out are
written against the protocol, so they run alike on either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.functions import replies as R
from talkloom.operators import sampling as S


class Responder(Protocol):
    def __call__(self, prompts: DataFrame) -> DataFrame:
        """``id, text`` for ``id, system, messages``; a prompt without a reply has no row or a null text."""


def recorded(replies: DataFrame) -> Responder:
    """Replies from a table ``id, text``; the last of an id by ``at`` if that column is there."""
    if "at" in replies.columns:
        replies = replies.groupBy("id").agg(F.max_by("text", F.struct("at", "text")).alias("text"))
    return lambda prompts: prompts.select("id").join(replies.select("id", "text"), "id")


def mapped(call: Callable[[str | None, list[dict]], str], attempts: int = 3) -> Responder:
    """Replies of ``call(system, messages)`` from each partition; a call that raises ``attempts`` times leaves a null text."""

    def answer(system, messages) -> str | None:
        turns = [{"role": m["role"], "content": m["content"]} for m in (messages if messages is not None else [])]
        for _ in range(attempts):
            try:
                return call(system, turns)
            except Exception:  # noqa: BLE001, S112: whatever a client raises counts as a failed attempt
                continue
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"id": rows["id"], "text": [answer(s, m) for s, m in zip(rows["system"], rows["messages"], strict=True)]})

    return lambda prompts: prompts.select("id", "system", "messages").mapInPandas(run, f"id {prompts.schema['id'].dataType.simpleString()}, text string")


def judged(prompts: DataFrame, judges: dict[str, tuple[Responder, Callable[[Column], Column]]]) -> DataFrame:
    """``id, judge, verdict``: every judge's replies, each read by its own protocol (a function of the text column); null without a reply."""
    parts = [prompts.select("id").join(ask(prompts), "id", "left").select("id", F.lit(name).alias("judge"), read(F.col("text")).alias("verdict")) for name, (ask, read) in judges.items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def run_stream(seeds: DataFrame, responder: Responder, prompt: Callable[[DataFrame], DataFrame], fraction: float, key: Column, done: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(emitted, failed) of one dialogue stream: sampled seeds that aren't done are prompted, replies parsed to messages, checked, and kept or logged.

    ``prompt`` adds ``system, messages`` to seeds (``id``). A reply must hold a
    JSON array of messages with at least ``least`` whole ones, in turn from the
    user on; ``failed`` has ``id, error``.
    """
    chosen = S.hash_sample(seeds, key, fraction).join(done.select("id"), "id", "left_anti")
    asked = prompt(chosen)
    texts = asked.select("id").join(responder(asked), "id", "left")
    found = R.first_json(F.col("text"))
    inner = F.coalesce(F.get_json_object(F.when(R.is_object(found), found), "$.messages"), F.when(found.startswith("["), found))
    parsed = texts.withColumn("messages", F.filter(F.from_json(inner, "array<struct<role:string,content:string>>"), lambda m: m["role"].isNotNull() & m["content"].isNotNull()))
    odd = F.exists(F.transform("messages", lambda m, i: m["role"] != F.when(i % 2 == 0, "user").otherwise("assistant")), lambda b: b)
    error = F.when(F.col("text").isNull(), "no reply").when(F.col("messages").isNull(), "no messages").when(F.size("messages") < least, "too few turns").when(odd, "roles do not alternate")
    marked = parsed.withColumn("error", error)
    return marked.where(F.col("error").isNull()).select("id", "messages"), marked.where(F.col("error").isNotNull()).select("id", "error")


def simulate(seeds: DataFrame, learner: Responder, tutor: Responder, probe: Callable[[DataFrame], DataFrame], user_turns: int = 8, probe_at: int = 3) -> DataFrame:
    """``id, system, messages``: learner and tutor talk in turn, ``user_turns`` times; at user turn ``probe_at`` the probe's text takes the learner's place.

    ``seeds`` has ``id, system``; ``probe`` gives ``id, text``. A side without a
    reply says nothing more, and the dialogue ends there.
    """
    from talkloom.session import materialise

    empty = F.array().cast("array<struct<role:string,content:string>>")
    state = seeds.select("id", "system", empty.alias("messages"), F.lit(True).alias("live"))

    def say(df: DataFrame, said: DataFrame, role: str) -> DataFrame:
        joined = df.join(said.select("id", F.col("text").alias("_t")), "id", "left")
        go = F.col("live") & F.col("_t").isNotNull()
        message = F.struct(F.lit(role).alias("role"), F.col("_t").alias("content"))
        return joined.select("id", "system", F.when(go, F.concat("messages", F.array(message))).otherwise(F.col("messages")).alias("messages"), go.alias("live"))

    for turn in range(user_turns):
        state = say(state, probe(state) if turn == probe_at else learner(state), "user")
        state = materialise(say(state, tutor(state), "assistant"), "simulated")
    return state.select("id", "system", "messages")
