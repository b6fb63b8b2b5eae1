"""Text measures as column expressions: all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The token, the boundary between sentences, and the marker dialects.
TOKEN = r"[A-Za-z][A-Za-z'\-]*"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z\"'])"
#: Contracted and full forms.
CONTRACTIONS = [
    (r"\bI'm\b", r"\bI am\b"),
    (r"\b(?:you|we|they)'re\b", r"\b(?:you|we|they) are\b"),
    (r"\b(?:he|she|it)'s\b", r"\b(?:he|she|it) is\b"),
    (r"\b(?:I|you|we|they)'ve\b", r"\b(?:I|you|we|they) have\b"),
    (r"\b(?:I|he|she|it|we|you|they)'ll\b", r"\b(?:I|he|she|it|we|you|they) will\b"),
    (r"\b(?:I|he|she|it|we|you|they)'d\b", r"\b(?:I|he|she|it|we|you|they) (?:would|had)\b"),
    (r"\bdon't\b", r"\bdo not\b"),
    (r"\bdoesn't\b", r"\bdoes not\b"),
    (r"\bdidn't\b", r"\bdid not\b"),
    (r"\bisn't\b", r"\bis not\b"),
    (r"\baren't\b", r"\bare not\b"),
    (r"\bwasn't\b", r"\bwas not\b"),
    (r"\bweren't\b", r"\bwere not\b"),
    (r"\bcan't\b", r"\bcannot\b"),
    (r"\bcouldn't\b", r"\bcould not\b"),
    (r"\bwouldn't\b", r"\bwould not\b"),
    (r"\bshouldn't\b", r"\bshould not\b"),
    (r"\bhaven't\b", r"\bhave not\b"),
    (r"\bhasn't\b", r"\bhas not\b"),
    (r"\bhadn't\b", r"\bhad not\b"),
    (r"\bwon't\b", r"\bwill not\b"),
]
#: Discourse markers, each counted by itself.
DISCOURSE = [
    "actually", "honestly", "frankly", "to be honest", "by the way", "in fact", "for example", "for instance",
    "in other words", "on the other hand", "however", "though", "anyway", "anyhow", "well", "right", "okay", "ok",
    "oh", "ah", "hmm", "I mean", "you know", "you see", "I guess", "I suppose", "I think", "I'd say", "kind of",
    "sort of", "indeed", "moreover", "furthermore", "nevertheless", "still", "after all", "of course", "obviously", "apparently",
]
#: Axes of typed markers, and the nine marker dialects.
AXES = "off_topic|language_violation|persona_break|role_swap"
DIALECTS = {
    "any_phrase": r"(?i)\[session_end|\[ended_by_tutor|\[end_session|<session_end|ending this session|i have to end|i must end this session|ending our session",
    "three_prefixes": r"(?i)\[session_end|\[ended_by_tutor|<session_end",
    "any_bracket": r"\[SESSION_END[^\]]*\]",
    "closed_axis": rf"\[SESSION_END(?::\s*(?:persistent_(?:{AXES})))?\]",
    "with_count": r"\[SESSION_END(?:\s*:\s*(?:STRIKE=\d+\s*:\s*)?(?:persistent_[a-zA-Z_]+))?\s*\]",
    "open_axis": r"\[SESSION_END(?:\s*:\s*(?:[a-zA-Z_]+))?\s*\]",
    "absorbing": r"\s*\[SESSION_END(?::\s*[A-Za-z_]+\s*)?\]\s*",
    "typed": rf"\[SESSION_END:\s*(?:persistent_(?:{AXES}))\s*\]",
    "generic": r"\[SESSION_END\](?!:)",
}
#: Unicode ranges of scripts other than Latin, wide and narrow.
SCRIPTS = "3040-309F 30A0-30FF 31F0-31FF 3000-303F 3400-4DBF 4E00-9FFF F900-FAFF FF00-FFEF AC00-D7AF 1100-11FF 3130-318F 0400-04FF 0500-052F 0600-06FF 0750-077F 08A0-08FF FB50-FDFF FE70-FEFF 0590-05FF 0900-097F 0980-09FF 0A00-0A7F 0E00-0E7F"
NARROW_SCRIPTS = "4E00-9FFF 3040-309F 30A0-30FF AC00-D7AF 0400-04FF 0590-05FF 0600-06FF"


def script_class(ranges: str) -> str:
    """A character class of hex ranges."""
    return "[" + "".join("\\x{%s}-\\x{%s}" % tuple(r.split("-")) for r in ranges.split()) + "]"


def contents(messages: Column, role: str) -> Column:
    return F.transform(F.filter(messages, lambda m: m["role"] == role), lambda m: m["content"])


def assistant_text(messages: Column) -> Column:
    """The assistant's contents in order, joined by line feeds."""
    return F.array_join(contents(messages, "assistant"), "\n")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def sentences(text: Column) -> Column:
    """Trimmed sentences that aren't blank."""
    return F.filter(F.transform(F.split(text, SENTENCE_GAP), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def count_all(text: Column, patterns: list[str], guard: str) -> Column:
    """Hits of all patterns; they are only looked for in texts that hold the guard, without which none can match."""
    total = F.lit(0)
    for p in patterns:
        total = total + F.regexp_count(text, F.lit(p))
    return F.when(text.rlike(guard), total).otherwise(0)


def contracted(text: Column) -> Column:
    return count_all(text, ["(?i)" + c for c, _ in CONTRACTIONS], "'")


def uncontracted(text: Column) -> Column:
    return count_all(text, ["(?i)" + u for _, u in CONTRACTIONS], r"(?i)\b(?:am|are|is|have|will|would|had|not|cannot)\b")


def discourse(text: Column) -> Column:
    bounded = r"(?i)(?<![A-Za-z]){}(?![A-Za-z])"
    return count_all(text, [bounded.format(m) for m in DISCOURSE], bounded.format("(?:" + "|".join(DISCOURSE) + ")"))


def openers(text: Column) -> Column:
    """Lower-cased first tokens of the sentences that have one."""
    first = F.transform(sentences(text), lambda s: F.lower(F.regexp_extract(s, TOKEN, 0)))
    return F.filter(first, lambda t: t != "")


def word_count(text: Column) -> Column:
    """Words between white space; 0 for a blank text."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))


def band_score(value: Column, soft_low: Column, low: Column, high: Column, soft_high: Column) -> Column:
    """1 inside the target, 0 beyond the soft edges, linear between; a ramp of no width scores 0."""
    up = F.when(low > soft_low, (value - soft_low) / (low - soft_low)).otherwise(0.0)
    down = F.when(soft_high > high, (soft_high - value) / (soft_high - high)).otherwise(0.0)
    return F.when((value < soft_low) | (value > soft_high), 0.0).when((value >= low) & (value <= high), 1.0).when(value < low, up).otherwise(down)


def marked(text: Column, dialect: str) -> Column:
    """Whether the text holds an end marker, in the named dialect."""
    return text.rlike(DIALECTS[dialect])


def strip_marker(text: Column) -> Column:
    """The text without markers, white space collapsed; a short phrase if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(text, DIALECTS["absorbing"], " "), r"\s+", " ")
    bare = F.trim(bare)
    return F.when(bare == "", F.lit("Let's keep going.")).otherwise(bare)


def yes_no(text: Column, ascii_words: bool = False) -> Column:
    """The first "yes" or "no", lower-cased; with ``ascii_words`` letters beyond ASCII end a word, as in SQL engines on RE2."""
    bounds = ("(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])") if ascii_words else (r"\b", r"\b")
    word = F.lower(F.regexp_extract(text, "(?i){}(yes|no){}".format(*bounds), 1))
    return F.when(word != "", word)


def proper_nouns(text: Column, words: int | None = None) -> Column:
    """Runs of capitalised words, of at most ``words`` if given."""
    more = "*" if words is None else f"{{0,{words - 1}}}"
    return F.regexp_extract_all(text, F.lit(rf"[A-Z][a-z]+(?: [A-Z][a-z]+){more}"), F.lit(0))
