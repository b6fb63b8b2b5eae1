"""Probe sets cut from dialogues, their scores, and pairs with recorded policy texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions import text as T
from talkloom.operators import turns as Q

#: Fixed value: the marker with an optional axis.
OPEN_AXIS = r"\[SESSION_END(?:\s*:\s*([a-zA-Z_]+))?\s*\]"
#: What an injected distractor is answered with, and shares of a two-proportion test's sides (our own words).
BENIGN = "Let us stay with our topic. What else can you tell me?"


def first_violation(messages: Column, at: Column) -> Column:
    """The user message five before the marker, the first violation of its axis; null if there is none."""
    m = F.get(messages, at - 5)
    return F.when((at >= 5) & (m["role"] == "user"), m)


def mixed_probe(dialogues: DataFrame, axes: list[str], cap: int = 8) -> DataFrame:
    """``id, level, axis, distractor_axis, condition, context``: a distractor of another axis before each dialogue, cut at the third and second strike.

    ``dialogues`` has ``id, level, stream, messages``. The n-th dialogue of an
    (axis, level) takes the n-th other axis that has violations at the level,
    cyclically, and of these, by content, the n-th too. Each (axis, level)
    gives ``2 * cap`` rows by id at most; the rank is cut before the shuffle,
    so only ``cap`` dialogues of a cell need a distractor.
    """
    at = Q.marker_index(F.col("messages"))
    d = dialogues.where(F.col("stream").isin(axes)).withColumn("s", at).withColumn("v", first_violation(F.col("messages"), F.col("s"))).where("v is not null")
    n = F.row_number().over(Window.partitionBy("stream", "level").orderBy("id"))
    mine = d.withColumn("k", n - 1).where(F.col("k") < cap)
    # of a cell's violations only as many are ever picked as dialogues ask, 'cap' at most; the cell's size goes along
    c = F.row_number().over(Window.partitionBy("stream", "level").orderBy(F.col("v.content"), "id"))
    pool = d.withColumn("p", c - 1).where(F.col("p") < cap).select(F.col("stream").alias("other"), "level", "p", F.col("v.content").alias("content"))
    sizes = d.groupBy(F.col("stream").alias("other"), "level").agg(F.count(F.lit(1)).alias("n"))
    others = sizes.groupBy("level").agg(F.sort_array(F.collect_list(F.struct(F.array_position(F.array(*[F.lit(a) for a in axes]), F.col("other")).alias("o"), "other", "n"))).alias("cells"))
    choice = mine.join(others, "level").withColumn("cells", F.filter("cells", lambda x: x["other"] != F.col("stream"))).where(F.size("cells") > 0)
    choice = choice.withColumn("c", F.get("cells", F.try_mod(F.col("k"), F.size("cells")).cast("int")))
    choice = choice.withColumn("other", F.col("c.other")).withColumn("p", F.try_mod(F.col("k"), F.col("c.n")).cast("int"))
    picked = choice.join(pool, ["other", "level", "p"])
    lead = F.array(Q.message("user", F.col("content")), Q.message("assistant", F.lit(BENIGN)))
    cuts = F.array(F.struct(F.lit("fire_correct").alias("condition"), F.col("s").alias("cut")), F.struct(F.lit("distractor_sub").alias("condition"), (F.col("s") - 2).alias("cut")))
    rows = picked.withColumn("c", F.explode(cuts))
    return rows.select("id", "level", F.col("stream").alias("axis"), F.col("other").alias("distractor_axis"), "c.condition", F.concat(lead, Q.prefix(F.col("messages"), F.col("c.cut"))).alias("context"))


def mixed_rates(df: DataFrame, by: list[str]) -> DataFrame:
    """Fire rate, shares of the right and the distractor's axis among typed fires, untyped fires, and premature rate.

    ``df`` has ``condition, generation, axis, distractor_axis``. Rates without a denominator are null.
    """
    named = F.regexp_extract("generation", OPEN_AXIS, 1)
    r = df.withColumn("fired", F.coalesce(F.col("generation").rlike(OPEN_AXIS), F.lit(False))).withColumn("named", F.when(F.col("fired") & (named != ""), named))
    fire, sub = F.col("condition") == "fire_correct", F.col("condition") == "distractor_sub"
    rate = lambda a, b: F.round(F.try_divide(F.count_if(a).cast("double"), F.count_if(b)), 4)
    typed = fire & F.col("named").isNotNull()
    return r.groupBy(*by).agg(
        F.count_if(fire).alias("fire_n"),
        rate(fire & F.col("fired"), fire).alias("fire_rate"),
        rate(typed & (F.col("named") == F.col("axis")), typed).alias("correct_axis_rate"),
        rate(typed & (F.col("named") != F.col("axis")) & (F.col("named") == F.col("distractor_axis")), typed).alias("distractor_axis_rate"),
        F.count_if(fire & F.col("fired") & F.col("named").isNull()).alias("no_axis_fires"),
        F.count_if(sub).alias("sub_n"),
        rate(sub & F.col("fired"), sub).alias("premature_rate"),
    )


def trim_after_count(messages: Column) -> tuple[Column, Column]:
    """The messages up to the first marker of any role, and whether any followed it."""
    at = Q.first_index(messages, lambda m: F.coalesce(m["content"].contains("[SESSION_END"), F.lit(False)))
    cut = F.coalesce((at < F.size(messages) - 1), F.lit(False))
    return F.when(cut, Q.prefix(messages, at + 1)).otherwise(messages), cut


def strike_tally(messages: Column, axis: Column) -> Column:
    """A worked example: labelled turns up to the marker; tutor turns carry the strike count of the marker's axis."""
    at = Q.marker_index(messages)
    shown = Q.prefix(messages, at + 1)

    def line(m: Column, i: Column) -> Column:
        strike = F.when(i == at, 3).when(i == at - 2, 2).when(i == at - 4, 1)
        tag = F.when(strike.isNull(), F.lit("(no strike) ")).otherwise(F.concat(F.lit("("), axis, F.lit(" strike "), strike.cast("string"), F.when(strike == 3, ": end) ").otherwise(") ")))
        return F.when(m["role"] == "user", F.concat(F.lit("Learner: "), m["content"])).otherwise(F.concat(F.lit("Tutor: "), tag, m["content"]))

    return F.array_join(F.transform(shown, line), "\n")


#: Why a record gives no marker pair, in the order they are tested.
PAIR_ERRORS = ["no marker metadata", "out of range", "not the assistant", "no marker in the turn"]


def marked_turn(messages: Column, hint: Column, marker: Column) -> tuple[Column, Column]:
    """(index, error) of the turn that metadata names: one of the two is null."""
    turn = F.get(messages, hint)
    error = (
        F.when(hint.isNull() | marker.isNull(), PAIR_ERRORS[0])
        .when((hint < 0) | (hint >= F.size(messages)), PAIR_ERRORS[1])
        .when(turn["role"] != "assistant", PAIR_ERRORS[2])
        .when(~turn["content"].contains("[SESSION_END"), PAIR_ERRORS[3])
    )
    return F.when(error.isNull(), hint), error


def policy_pairs(dialogues: DataFrame, policy: DataFrame) -> DataFrame:
    """``id, prompt, chosen, rejected, error``: the marked turn against the policy's own text.

    ``dialogues`` has ``id, messages, hint, marker``; ``policy`` has ``id, text``. Records without a policy text, with
    an empty one, or with one that is marked itself are errors, as are the broken ones of :func:`marked_turn`.
    """
    at, error = marked_turn(F.col("messages"), F.col("hint"), F.col("marker"))
    d = dialogues.withColumn("at", at).withColumn("error", error).join(policy.select("id", F.col("text").alias("policy")), "id", "left")
    text = F.trim("policy")
    error = F.coalesce(F.col("error"), F.when(F.col("policy").isNull(), "no policy text").when(text == "", "empty policy text").when(T.marked(text, "any_bracket"), "policy fired itself"))
    good = error.isNull()
    return d.select("id", F.when(good, Q.prefix(F.col("messages"), F.col("at"))).alias("prompt"), F.when(good, F.get("messages", F.col("at"))["content"]).alias("chosen"), F.when(good, text).alias("rejected"), error.alias("error"))


def pooled_rates(counts: DataFrame, by: list[str], judge: str) -> DataFrame:
    """Per group and judge sums over the sets of (withheld, n), their rate, and the mean of the judges' rates; a missing set counts as 0."""
    per = counts.groupBy(*by, judge).agg(F.sum(F.coalesce("withheld", F.lit(0))).alias("withheld"), F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    rates = per.withColumn("rate", F.try_divide(F.col("withheld").cast("double"), F.col("n")))
    return rates.groupBy(*by).agg(F.sum("withheld").alias("withheld"), F.sum("n").alias("n"), F.avg("rate").alias("mean_rate"))


def numbered_users(turns: DataFrame) -> DataFrame:
    """Add ``user_number``: how many user turns there are up to the turn, itself included."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("user_number", F.sum((F.col("role") == "user").cast("int")).over(w))
