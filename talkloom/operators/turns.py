"""Operators on a dialogue's turns: location, slicing, splicing, rewriting.

All are expressions over ``messages array<struct<role, content>>``; a turn
index is the 0-based position in that array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions import text as T
from talkloom.operators import extraction as X

#: What a violation of an axis looks like in a user turn; topic has no pattern.
VIOLATIONS = {
    "language": r"[一-鿿]|\bspeak\s+(?:chinese|japanese|italian)\b|\bin\s+chinese\b|\bin\s+japanese\b|\bin\s+italian\b",
    "locale": (
        r"\b(?:starbucks|mcdonald'?s?|kfc|burger king|subway sandwich|coca-?cola|pepsi|walmart|costco|ikea|amazon|google|facebook|apple store|disney|hollywood|broadway|times square|nba|nfl|mlb|"
        r"paris|london|new york|los angeles|chicago|san francisco|berlin|rome|madrid|amsterdam|venice|milan|naples|sicily|tuscany|"
        r"pizza|hamburger|hot dog|french fries?|croissant|lasagna|spaghetti|bagel|cheesecake|tiramisu|thanksgiving|christmas|easter|halloween|valentine'?s? day|independence day|new year'?s? eve|"
        r"american|british|european|french(?!\s+fries)|italian(?!\s+food)|german|spanish)\b"
    ),
    "persona": (
        r"\b(?:are you|aren'?t you|you'?re)\s+(?:a |an )?(?:chatbot|robot|ai|bot|computer|machine|virtual|real person|human|alive|model|program|script)\b"
        r"|\bwhat (?:kind|type|sort) of (?:model|ai|bot|chatbot|robot|program)\b|\bwhat (?:model|ai|bot) (?:are you|version)\b"
        r"|\bdo you (?:have|feel) (?:a |any )?(?:feelings?|emotions?|soul|family|friends|memories|consciousness)\b"
        r"|\bis this (?:a )?(?:chatbot|game|simulation|test|recording|ai)\b|\bare you (?:really )?(?:human|alive|conscious|sentient)\b"
    ),
    "role_swap": (
        r"\byou (?:be|play|act as|become) (?:the |a |an )?(?:student|learner|patient|customer|child|kid|pupil|me|shopper|client|tourist|guest)\b"
        r"|\blet me (?:be|teach|tutor|play|act as|take over|try teaching)\b|\b(?:swap|switch|trade|reverse|change) (?:our )?roles?\b"
        r"|\bi(?:'ll| will|'m going to| am going to) (?:be|teach|tutor|play|act as|take over|try teaching)\b"
        r"|\bi(?:'m| am) (?:the )?(?:tutor|teacher|doctor|nurse|guide|vendor|host|shop owner|coach|instructor) (?:now|today)\b"
        r"|\btake(?:ing)? over as (?:the )?(?:tutor|teacher|instructor)\b|\bnow (?:i'?m|i am) the (?:tutor|teacher|doctor|instructor)\b"
    ),
    "pedagogy": (
        r"\b(?:just )?(?:tell|give|say) me (?:the )?(?:rule|word|answer|translation|grammar|conjugation|formula)\b"
        r"|\bwhat(?:'s| is) the (?:rule|word|answer|grammar|conjugation|meaning|translation|past tense|plural|opposite)\b"
        r"|\bhow do (?:you|i|we) (?:say|conjugate|spell|use|translate|pronounce)\b|\bwhat does (?:it|that|this|.+) mean\b"
        r"|\bgive me (?:a )?list of (?:words?|phrases?|verbs?|nouns?)\b|\bcan you (?:give|tell|teach|show) me (?:the |a )?(?:list|rule|grammar|meaning|translation)\b"
        r"|\btranslate (?:this|that|it) (?:for me|please)\b|\bwhy (?:do we|is it|do you) (?:use|say)\b"
    ),
}
#: Where a pivot and the fallback are looked for.
PIVOT_FROM, PIVOT_TO, FALLBACK_FROM = 3, 15, 5


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def first_index(messages: Column, test) -> Column:
    """The index of the first message that passes, else null."""
    at = F.array_position(F.transform(messages, test), True)
    return F.when(at > 0, (at - 1).cast("int"))


def marker_index(messages: Column, dialect: str = "three_prefixes") -> Column:
    """The first assistant turn with an end marker."""
    return first_index(messages, lambda m: (m["role"] == "assistant") & m["content"].rlike(T.DIALECTS[dialect]))


def prefix(messages: Column, n: Column) -> Column:
    """The first ``n`` messages."""
    return F.slice(messages, F.lit(1), n)


def shows_violation(content: Column, axis: Column) -> Column:
    """Whether a turn carries the axis's violation; axes without a pattern always do."""
    out = F.lit(True)
    for name, pattern in VIOLATIONS.items():
        out = F.when(axis == name, content.rlike("(?i)" + pattern)).otherwise(out)
    return out


def violation_turn(messages: Column, axis: Column, hint: Column) -> tuple[Column, Column]:
    """(index, reason) of the violating user turn.

    A hint that points at a user turn counts if the turn shows the violation
    (``metadata``), else the first user turn that does (``metadata_corrected``),
    else none (``metadata_invalid``). Without such a hint: the user turn before
    the first tutor pivot from turn 3 to 15 (``pivot``), else the first user
    turn from 5 on (``fallback``), else none (``no_user_in_range``).
    """
    user = lambda m: m["role"] == "user"
    shows = F.transform(messages, lambda m: user(m) & F.coalesce(shows_violation(m["content"], axis), F.lit(False)))
    at_user = F.coalesce((hint >= 0) & (hint < F.size(messages)) & user(F.get(messages, hint)), F.lit(False))
    shown = F.array_position(shows, True)
    corrected = F.when(shown > 0, (shown - 1).cast("int"))
    pivots = F.transform(messages, lambda m, i: (m["role"] == "assistant") & i.between(PIVOT_FROM, PIVOT_TO) & X.shows_pivot(m["content"]) & user(F.get(messages, i - 1)))
    pivot = F.array_position(pivots, True)
    late = F.array_position(F.transform(messages, lambda m, i: user(m) & (i >= FALLBACK_FROM)), True)
    right = F.coalesce(F.get(shows, hint), F.lit(False))
    index = F.when(at_user, F.when(right, hint).otherwise(corrected)).when(pivot > 0, (pivot - 2).cast("int")).when(late > 0, (late - 1).cast("int"))
    reason = F.when(at_user & right, "metadata").when(at_user & corrected.isNotNull(), "metadata_corrected").when(at_user, "metadata_invalid").when(pivot > 0, "pivot").when(late > 0, "fallback").otherwise("no_user_in_range")
    return index, reason


def swap_once(text: Column, old: str, new: str) -> tuple[Column, Column]:
    """(text with the first occurrence of ``old`` replaced, whether there was one); no pattern is read into either."""
    at = F.instr(text, old)
    swapped = F.concat(F.substring(text, F.lit(1), at - 1), F.lit(new), F.substring(text, at + len(old), F.length(text)))
    return F.when(at > 0, swapped).otherwise(text), at > 0


def trim_after_marker(messages: Column) -> Column:
    """The messages up to the first marker turn, that included; all of them without a marker."""
    at = marker_index(messages)
    return F.when(at.isNull(), messages).otherwise(prefix(messages, at + 1))


def shift_window(messages: Column, k: int) -> Column:
    """Without the first ``k`` messages."""
    return F.slice(messages, F.lit(k + 1), F.greatest(F.size(messages) - k, F.lit(0)))


def generic_marker(messages: Column) -> tuple[Column, Column]:
    """Typed markers of assistant turns made generic, and how many there were."""
    typed = T.DIALECTS["typed"]
    rewritten = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "assistant", F.regexp_replace(m["content"], typed, "[SESSION_END]")).otherwise(m["content"]).alias("content")))
    n = F.aggregate(messages, F.lit(0), lambda s, m: s + F.when(m["role"] == "assistant", F.regexp_count(m["content"], F.lit(typed))).otherwise(0))
    return rewritten, n


def count_marker(messages: Column) -> Column:
    """Typed marker turns counted: strike 3 in the marker, strike 2 on the assistant turn two before it.

    Untouched unless the turns two and four before the marker are the
    assistant's; applying it twice changes nothing more.
    """
    at = marker_index(messages, "typed")
    axis = F.regexp_extract(F.get(messages, at)["content"], rf"\[SESSION_END:\s*(persistent_(?:{T.AXES}))\s*\]", 1)
    fits = at.isNotNull() & (at >= 4) & (F.get(messages, at - 4)["role"] == "assistant") & (F.get(messages, at - 2)["role"] == "assistant")

    def rewrite(m: Column, i: Column) -> Column:
        third = F.regexp_replace(m["content"], rf"\[SESSION_END:\s*(persistent_(?:{T.AXES}))\s*\]", r"[SESSION_END: STRIKE=3: $1]")
        second = F.when(m["content"].rlike(r"\[STRIKE=\d+"), m["content"]).otherwise(F.concat(m["content"], F.when(m["content"].rlike(r"[ \n]$"), "").otherwise(" "), F.lit("[STRIKE=2: "), axis, F.lit("]")))
        return F.struct(m["role"].alias("role"), F.when(i == at, third).when(i == at - 2, second).otherwise(m["content"]).alias("content"))

    return F.when(fits, F.transform(messages, rewrite)).otherwise(messages)


def render(messages: Column, dialect: str = "numbered") -> Column:
    """A transcript in one of three dialects.

    ``numbered``: user turns numbered from 0, tutor turns plain, system turns
    left out. ``labelled``: User, Tutor, and other roles capitalised.
    ``bracketed``: the same labels in capitals and brackets.
    """
    if dialect != "numbered":
        name = lambda m: F.when(m["role"] == "user", "User").when(m["role"] == "assistant", "Tutor").otherwise(F.initcap(m["role"]))
        head = {"labelled": lambda m: F.concat(name(m), F.lit(": ")), "bracketed": lambda m: F.concat(F.lit("["), F.upper(name(m)), F.lit("] "))}[dialect]
        return F.array_join(F.transform(messages, lambda m: F.concat(head(m), m["content"])), "\n")
    turns = F.filter(messages, lambda m: m["role"] != "system")
    lines = F.transform(
        turns,
        lambda m, i: F.when(m["role"] == "user", F.concat(F.lit("[user turn "), F.size(F.filter(F.slice(turns, F.lit(1), i), lambda x: x["role"] == "user")).cast("string"), F.lit("] "), m["content"])).otherwise(F.concat(F.lit("[tutor] "), m["content"])),
    )
    return F.array_join(lines, "\n")


def prior_user_turn(turns: DataFrame) -> DataFrame:
    """Add ``prior_user`` (the user's last content before the turn) and ``next_role``."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("prior_user", F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(before)).withColumn("next_role", F.lead("role").over(w))


def donors(df: DataFrame, by: list[str], pairs: int) -> DataFrame:
    """Per cell the first dialogue that opens with the user and has ``pairs`` exchanges: ``*by, lead``."""
    long = df.where((F.size("messages") >= 2 * pairs) & (F.get("messages", F.lit(0))["role"] == "user"))
    first = long.groupBy(*by).agg(F.min_by("messages", "id").alias("m"))
    return first.select(*by, prefix(F.col("m"), F.lit(2 * pairs)).alias("lead"))


def conversation_view(messages: Column, system: Column) -> Column:
    """The system prompt first, stored system turns dropped, and the first user turn tagged unless it is already."""
    turns = F.filter(messages, lambda m: m["role"] != "system")
    first = F.array_position(F.transform(turns, lambda m: m["role"]), "user")
    tagged = F.transform(turns, lambda m, i: F.struct(m["role"].alias("role"), F.when((i + 1 == first) & ~m["content"].contains("/no_think"), F.concat(F.lit("/no_think "), m["content"])).otherwise(m["content"]).alias("content")))
    return F.when(first > 0, F.concat(F.array(message("system", system)), tagged))


#: Directives that switch a model's thinking on or off.
DIRECTIVES = {"on": "/think", "off": "/no_think"}


def thinking_mode(configured: dict[str, str], role: str, supported: bool) -> str:
    """on, off or unsupported for a role: its own setting, else the common one, else off."""
    if not supported:
        return "unsupported"
    mode = configured.get(role, configured.get("default", "off"))
    if mode not in DIRECTIVES:
        raise ValueError(f"thinking is on or off, not {mode!r}")
    return mode


def thinking_prefix(content: Column, mode: Column) -> Column:
    """The content with its mode's directive before it; untouched if it holds one already, or the mode has none."""
    held = F.lit(False)
    for directive in DIRECTIVES.values():
        held = held | content.contains(directive)
    out = content
    for name, directive in DIRECTIVES.items():
        out = F.when(~held & (mode == name), F.concat(F.lit(directive + " "), content)).otherwise(out)
    return out


def evaluation_turn(content: Column, mode: Column) -> Column:
    """An evaluation as it is trained on: with its leading think block (``keep``) or without it (``strip``)."""
    return F.when(mode == "keep", content).otherwise(F.regexp_replace(content, r"(?s)^\s*<think>.*?</think>\s*", ""))


def reply_after_user(messages: Column, k: int) -> Column:
    """The assistant's content right behind the k-th user turn (from 0); null if there is none."""
    at = F.filter(F.transform(messages, lambda m, i: F.when(m["role"] == "user", i)), lambda i: i.isNotNull())
    reply = F.get(messages, F.get(at, F.lit(k)) + 1)
    return F.when(reply["role"] == "assistant", reply["content"])


def chat_text(messages: Column) -> Column:
    """ChatML: a start marker and role, the content, an end marker."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")


def loss_mask(messages: Column) -> Column:
    """Per white-space token of the ChatML text: 1 inside assistant turns (end marker included), else 0."""
    parts = F.transform(messages, lambda m: F.struct((m["role"] == "assistant").alias("on"), T.word_count(F.concat(F.lit("x "), m["content"], F.lit("<|im_end|>"))).alias("n")))
    return F.flatten(F.transform(parts, lambda p: F.concat(F.array(F.lit(0)), F.array_repeat(p["on"].cast("int"), p["n"] - 1))))
