"""Cleaned records and training views."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.functions import replies as R
from talkloom.operators import turns as Q

#: What a cleaned preference record keeps, in this order.
PAIR_FIELDS = ["id", "metadata", "system_prompt", "prompt_messages", "chosen", "rejected"]
PAIR_METADATA = ["cefr_level", "locale", "category", "axis"]
#: Characters that a token is reckoned at in the length guard.
CHARS_PER_TOKEN = 6


def keep_fields(record: Column, fields: list[str]) -> Column:
    """A JSON object's listed fields in the list's order, as JSON; absent ones stay absent."""
    values = F.from_json(record, "map<string,string>")
    shown = F.array(*[F.when(F.array_contains(F.map_keys(values), f), F.concat(F.lit(f'"{f}":'), _raw(record, f))) for f in fields])
    return F.concat(F.lit("{"), F.array_join(F.filter(shown, lambda x: x.isNotNull()), ","), F.lit("}"))


def _raw(record: Column, field: str) -> Column:
    """A field's value as JSON text."""
    return F.to_json(F.variant_get(F.parse_json(record), f"$.{field}", "variant"))


def whole_messages(messages: Column) -> Column:
    """Messages with both role and content; null if none is left."""
    kept = F.filter(messages, lambda m: m["role"].isNotNull() & m["content"].isNotNull())
    return F.when(F.size(kept) > 0, kept)


def clean_pairs(df: DataFrame) -> DataFrame:
    """Preference records with id, metadata, a prompt message, and both sides whole; the others go. Other fields are dropped."""
    side = lambda c: F.when(F.col(f"{c}.role").isNotNull() & F.col(f"{c}.content").isNotNull(), F.col(c))
    out = df.withColumn("prompt_messages", whole_messages(F.col("prompt_messages"))).withColumn("chosen", side("chosen")).withColumn("rejected", side("rejected"))
    good = (F.coalesce("id", F.lit("")) != "") & F.col("metadata").isNotNull() & F.col("prompt_messages").isNotNull() & F.col("chosen").isNotNull() & F.col("rejected").isNotNull()
    return out.where(good).select([c for c in PAIR_FIELDS if c in df.columns])


def side_texts(messages: Column, chosen: Column) -> Column:
    """The assistant's texts: of the messages if there are any, else the chosen side's alone."""
    own = F.transform(F.filter(messages, lambda m: (m["role"] == "assistant") & m["content"].isNotNull()), lambda m: m["content"])
    other = F.when(chosen["content"].isNotNull(), F.array(chosen["content"])).otherwise(F.array().cast("array<string>"))
    return F.when(messages.isNotNull(), own).otherwise(other)


def stamped_batch(df: DataFrame, reply: str, categories: str) -> DataFrame:
    """One row per object of a reply's JSON array (or of an array under scenarios, items or data): ``position, item, category`` by place; other values in it are skipped."""
    found = R.first_json(F.col(reply))
    inner = F.coalesce(*[F.get_json_object(F.when(R.is_object(found), found), f"$.{k}") for k in ("scenarios", "items", "data")])
    array = F.when(found.startswith("["), found).otherwise(F.when(inner.startswith("["), inner))
    items = F.from_json(array, "array<string>")
    rows = df.select("*", F.posexplode(items).alias("position", "item")).where(F.col("item").startswith("{"))
    return rows.withColumn("category", F.get(F.col(categories), F.col("position")))


def render_prompt(template: str, fields: dict[str, Column]) -> Column:
    """``{name}`` of a template replaced by the columns; null if any of them is null or blank."""
    out, whole = F.lit(template), F.lit(True)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
        whole = whole & (F.trim(F.coalesce(value, F.lit(""))) != "")
    return F.when(whole, out)


def rerender(df: DataFrame, prompt: str, template: str, fields: dict[str, Column]) -> DataFrame:
    """``prompt`` rendered anew where no field is missing, with ``changed`` and ``skipped``."""
    fresh = render_prompt(template, fields)
    rows = df.withColumn("_fresh", fresh).withColumn("skipped", F.col("_fresh").isNull())
    rows = rows.withColumn("changed", ~F.col("skipped") & ~F.col("_fresh").eqNullSafe(F.col(prompt)))
    return rows.withColumn(prompt, F.coalesce("_fresh", F.col(prompt))).drop("_fresh")


def preference_rows(df: DataFrame, system: Column, max_length: int) -> DataFrame:
    """``id, prompt, chosen, rejected``: the prompt's chat text with an open assistant turn; rows without a user turn, or beyond ``6 * max_length`` characters with the longer side, go."""
    view = Q.conversation_view(F.col("prompt_messages"), system)
    rows = df.withColumn("_v", view).where(F.col("_v").isNotNull())
    rows = rows.select("id", F.concat(Q.chat_text(F.col("_v")), F.lit("<|im_start|>assistant\n")).alias("prompt"), F.col("chosen.content").alias("chosen"), F.col("rejected.content").alias("rejected"))
    return rows.where(F.length("prompt") + F.greatest(F.length("chosen"), F.length("rejected")) <= CHARS_PER_TOKEN * max_length)


def span_mask(tokens: Column, opening: list[str], closing: str, limit: int | None = None) -> Column:
    """Per token 1 from behind an opening sequence to its closing token, that included, else 0; an open last span runs to the end.

    Null if no opening is found; cut to ``limit`` tokens after that. The state
    runs from token to token, so it is a walk over Arrow batches.
    """
    k = len(opening)

    def walk(found: list[str] | None) -> list[int] | None:
        found, mask, on, any_open = list(found if found is not None else []), [], False, False
        for i, token in enumerate(found):
            if i >= k and found[i - k : i] == opening:
                on = any_open = True
            mask.append(int(on))
            on = on and token != closing
        return mask[:limit] if any_open else None

    @F.pandas_udf("array<int>")
    def masks(found: pd.Series) -> pd.Series:
        return found.map(walk)

    return masks(tokens)


def tokenised(df: DataFrame, tokens: str, mask: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(rows that may be trained on, one row of counters): rows without a mask are errors, rows beyond ``limit`` tokens too long; both go."""
    state = F.when(F.col(mask).isNull(), "error").when(F.size(tokens) > limit, "too_long").otherwise("kept")
    marked = df.withColumn("_state", state)
    counts = marked.agg(*[F.count_if(F.col("_state") == s).alias(s) for s in ("kept", "too_long", "error")])
    return marked.where(F.col("_state") == "kept").drop("_state"), counts


def filter_pass_rates(df: DataFrame, runs: str = "runs") -> DataFrame:
    """``n_samples`` and a column per filter: the share of rows that passed it, skipped runs counted as passed; 0 without rows."""
    names = ["non_latin_script", "banned_terms", "mode_consistency", "naturalness"]
    passed = lambda n: F.exists(F.col(runs), lambda r: (r["name"] == n) & r["passed"])
    return df.agg(F.count(F.lit(1)).alias("n_samples"), *[F.coalesce(F.avg(passed(n).cast("int")), F.lit(0.0)).alias(n) for n in names])
