"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger stores the measurements
and one failure bit per rule. Policies are versioned bit masks over the ledger,
so changing a policy or ablating a rule never reads the texts again.

Only DataFrame functions are used: no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that parts words, and the characters counted as symbols.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Positions share a long with 43 bits of a window's hash; texts with more words take the exact path.
POSITION_BITS = 21


@dataclass(frozen=True)
class Rule:
    """``failed`` is a SQL predicate over the measurements; its truth sets ``bit``."""

    name: str
    bit: int
    failed: str


#: The base rules are those every policy has; the others are chosen by policy.
RULES = (
    Rule("too_few_words", 0, "n_words < 50"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbol_heavy", 2, "10 * n_symbols > 4 * n_words"),
    Rule("duplicate_lines", 3, "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines"),
    Rule("long_words", 4, "word_chars > 15 * n_words"),
    Rule("short_words", 5, "word_chars < 2 * n_words"),
    Rule("few_letters", 6, "10 * n_letter_words < 6 * n_words"),
    Rule("bullet_lines", 7, "n_lines >= 4 and 10 * n_bullet_lines > 9 * n_lines"),
    Rule("ellipsis_lines", 8, "n_lines >= 4 and 10 * n_ellipsis_lines > 3 * n_lines"),
)
BASE_MASK = 0b11

#: Versioned policies: the failure bits that reject a document.
POLICIES = {
    "base": BASE_MASK,
    "v1": BASE_MASK | 0b1100,
    "v2": BASE_MASK | 0b111100,
    "v3": BASE_MASK | 0b111111100,
}
PRODUCTION_POLICY = "v3"

#: A word from its first letter on: there are as many matches as words with a letter.
FROM_LETTER = r"\p{L}[^\x20\x09-\x0D]*+"
#: What a bullet line opens with and an ellipsis line ends in.
BULLETS, ELLIPSES = ["-", "*", "\u2022"], ["...", "\u2026"]


def _removed(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _covered_words() -> str:
    """SQL for the number of words that repeated 3-word windows cover, over a lambda variable ``w`` (the words).

    A sorted array of longs holds, per window, high bits of its hash and its
    position; equal neighbours are compared word by word. Should two different
    windows share the bits (or a text have over 2^21 words), the windows
    themselves are sorted instead, so the number is always exact.
    """
    bits, low = POSITION_BITS, (1 << POSITION_BITS) - 1
    same = "w[(x & {low}) + {k}] = w[(y & {low}) + {k}]"
    equal = " and ".join(same.format(low=f"{low}L", k=k) for k in range(3))
    packed = f"sort_array(transform(sequence(0, size(w) - 3), i -> (xxhash64(w[i], w[i + 1], w[i + 2]) & ~{low}L) | i))"
    pairs = f"zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1), (x, y) -> if(shiftright(x, {bits}) <> shiftright(y, {bits}), 0, if({equal}, 1, 2)))"
    # 0: differs from the next, 1: same window as the next, 2: the bits clash
    hit = f"transform(filter(s, (x, j) -> (j > 0 and m[j - 1] = 1) or (j < size(m) and m[j] = 1)), x -> x & {low}L)"
    spans = "aggregate(sort_array({hit}), named_struct('n', 0L, 'stop', 0L), (a, p) -> named_struct('n', a.n + p + 3 - greatest(a.stop, p), 'stop', p + 3), a -> a.n)"
    fast = spans.format(hit=hit)
    exact_sorted = "sort_array(transform(sequence(0, size(w) - 3), i -> named_struct('g', concat_ws(' ', w[i], w[i + 1], w[i + 2]), 'p', cast(i as bigint))))"
    exact_hit = "transform(filter(e, (x, j) -> (j > 0 and e[j - 1].g = x.g) or (j + 1 < size(e) and e[j + 1].g = x.g)), x -> x.p)"
    exact = f"element_at(transform(array({exact_sorted}), e -> {spans.format(hit=exact_hit)}), 1)"
    return (
        f"if(size(w) < 4, 0L, if(size(w) > {low}, {exact}, "
        f"element_at(transform(array({packed}), s -> element_at(transform(array({pairs}), m -> "
        f"if(not exists(m, b -> b > 0), 0L, if(exists(m, b -> b = 2), {exact}, {fast}))), 1)), 1)))"
    )


def measurements(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the struct column ``measured``: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_letter_words, n_bullet_lines, n_ellipsis_lines.

    A null text counts as one without words. A line counts if it holds a word;
    it is a duplicate if it equals an earlier line byte for byte. A letter word
    holds a letter of any script; a bullet line opens with a hyphen, asterisk
    or bullet, an ellipsis line ends in one.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    # transform over a one-element array names a value, so that it is computed once
    measured = F.expr(
        "element_at(transform(array(filter(split({t}, '{sp}'), x -> x <> '')), w -> named_struct("
        "'n_words', cast(size(w) as bigint), "
        "'n_repeat_words', {covered})), 1)".format(
            t="_text", sp=SPACE_CLASS.replace("\\", "\\\\"), covered=_covered_words()
        )
    )
    line_stats = F.transform(
        F.array(lines),
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x, lambda y: F.substring(F.ltrim(y, F.lit(SPACES)), 1, 1).isin(BULLETS))).cast("long").alias("n_bullet_lines"),
            F.size(F.filter(x, lambda y: F.rtrim(y, F.lit(SPACES)).endswith(ELLIPSES[0]) | F.rtrim(y, F.lit(SPACES)).endswith(ELLIPSES[1]))).cast("long").alias("n_ellipsis_lines"),
        ),
    )[0]
    out = docs.withColumn("_text", text).withColumn("_by_word", measured).withColumn("_by_line", line_stats)
    return out.withColumn(
        "measured",
        F.struct(
            F.col("_by_word.n_words").alias("n_words"),
            (F.length("_text") - _removed(F.col("_text"), SPACES)).cast("long").alias("word_chars"),
            _removed(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
            F.col("_by_line.n_lines").alias("n_lines"),
            F.col("_by_line.n_dup_lines").alias("n_dup_lines"),
            F.col("_by_word.n_repeat_words").alias("n_repeat_words"),
            F.regexp_count("_text", F.lit(FROM_LETTER)).cast("long").alias("n_letter_words"),
            F.col("_by_line.n_bullet_lines").alias("n_bullet_lines"),
            F.col("_by_line.n_ellipsis_lines").alias("n_ellipsis_lines"),
        ),
    ).drop("_text", "_by_word", "_by_line")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, every measurement, and ``failed_bits`` (bit ``r.bit`` set where rule ``r`` fails).

    Repeated ids are kept as rows of their own; an empty table gives an empty ledger.
    """
    measured = measurements(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("text")))
    return measured.select(F.col(f"`{id_col}`"), "measured.*").withColumn("failed_bits", _failed_bits())


def _failed_bits() -> Column:
    """Every rule's bit, over the measurements' columns."""
    bits = F.lit(0)
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.failed), F.lit(1 << rule.bit)).otherwise(F.lit(0)))
    return bits


def _kept(policy: str) -> Column:
    return F.col("failed_bits").bitwiseAND(POLICIES[policy] | BASE_MASK) == 0


def apply_policy(ledger_df: DataFrame, policy: str = PRODUCTION_POLICY) -> DataFrame:
    """Add ``base_failed`` and ``kept`` under the policy's mask; the texts are not read."""
    return ledger_df.withColumn("base_failed", F.col("failed_bits").bitwiseAND(BASE_MASK) != 0).withColumn("kept", _kept(policy))


def ablation(ledger_df: DataFrame, policy: str = PRODUCTION_POLICY) -> DataFrame:
    """Per rule of the policy: how many documents fail it, fail it alone, and would be kept without it.

    The ledger is first reduced to counts per distinct bit pattern (at most
    2^rules of them), with partial aggregation before the shuffle.
    """
    mask = POLICIES[policy] | BASE_MASK
    patterns = ledger_df.groupBy(F.col("failed_bits").bitwiseAND(mask).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    chosen = [r for r in RULES if mask >> r.bit & 1]
    aggs = []
    for r in chosen:
        failed = F.col("bits").bitwiseAND(1 << r.bit) != 0
        alone = F.col("bits") == (1 << r.bit)
        aggs.append(
            F.struct(
                F.lit(r.name).alias("rule"),
                F.coalesce(F.sum(F.when(failed, F.col("n"))), F.lit(0)).alias("n_failed"),
                F.coalesce(F.sum(F.when(alone, F.col("n"))), F.lit(0)).alias("n_failed_alone"),
                F.coalesce(F.sum(F.when(alone | (F.col("bits") == 0), F.col("n"))), F.lit(0)).alias("n_kept_without"),
            )
        )
    return patterns.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def reject_documents(docs: DataFrame, policy: str = PRODUCTION_POLICY, text_col: str = "text") -> DataFrame:
    """The documents that the policy keeps by their ledger's bits, with their columns unchanged; one narrow pass, no shuffle."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = measurements(docs.select(F.struct(*columns).alias("_row"), F.col(f"`{text_col}`").alias("text")))
    kept = out.select("_row", "measured.*").withColumn("failed_bits", _failed_bits()).where(_kept(policy))
    return kept.select([F.col("_row")[c].alias(c) for c in docs.columns])
