"""Names, places, terms and asks found in texts.

Word lists are parameters; the short lists here are our own but where a
comment says that they are fixed.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One to four capitalised words; any number of them; words that open sentences.
PROPER = r"\b([A-Z][a-zA-Z'\-]{1,}(?:[\s\-][A-Z][a-zA-Z'\-]+){0,3})\b"
PROPER_ANY = r"\b([A-Z][a-zA-Z'\-]{1,}(?:[\s\-][A-Z][a-zA-Z'\-]+)*)\b"
SENTENCE_OPENERS = (
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december "
    "today tomorrow yesterday tonight morning afternoon evening night spring summer autumn fall winter "
    "the a an i you he she we they it this that these those my your his her our their some any no yes oh well ok okay sure hi hello hey bye thanks thank "
    "when where why how what who which if or and but so then there here"
).split()
CITY_STOPWORDS = "today tomorrow yesterday morning afternoon evening night spring summer autumn winter monday tuesday wednesday thursday friday saturday sunday the a an".split()
#: The pivot that follows a violation, and the ask for a rule of grammar.
PIVOT = "|".join([
    r"\boh,?\s+interesting\b", r"\boh,?\s+i see\b", r"\bi see\b\.?\s*(?:that sounds|well,?\s|but )", r"\banyway,?\s+(?:how about|let|let's|why)",
    r"\bby the way,?\s+(?:have you|do you|would you|how about|let's|let me)", r"\bspeaking of\b", r"\bthat sounds (?:nice|worrying|interesting|fun|cool)\b",
    r"\blet'?s (?:get )?back to (?:the )?(?:lesson|topic|class|english|book|book)", r"\b(?:well|but),?\s+(?:in )?(?:china|here|locally)\b", r"\bhave you tried\b",
    r"\bjianbing\b|\bbaozi\b|\bnoodle soup\b", r"\bi'?m (?:just )?(?:the|your) (?:tutor|teacher|shop owner|vendor|doctor|host|guide)\b",
    r"\bi (?:can'?t|cannot|won'?t|will not) (?:swap|switch|be the|act as)\b", r"\bi (?:must|need to|should) (?:stay|keep|focus) (?:in|on|with)\b",
])
GRAMMAR_ASK = "|".join([
    r"how do (?:you|i|we) (?:say|conjugate|spell|use|translate|pronounce|write)\b",
    r"what(?:'s| is) the (?:rule|word|answer|grammar|conjugation|meaning|translation|past tense|present tense|plural|opposite|difference)\b",
    r"what does .{0,25}? mean\b", r"\bdo (?:i|we) (?:say|use|write) ['\"]?\w+['\"]? or ['\"]?\w+",
    r"(?:tell|give|teach|show) me (?:the |a )?(?:rule|word|answer|translation|grammar|conjugation|meaning|list)\b",
    r"what(?:'s| is) (?:the )?(?:past|present|future) (?:tense|form)\b", r"the (?:rule|grammar|conjugation|past tense|plural) (?:for|of)\b",
])


def _first_word(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"^\S+", 0))


def _listed(name: Column, words: list[str]) -> Column:
    return F.coalesce(name.isin(words), F.lit(False)) if words else F.lit(False)


def proper_nouns(text: Column, stopwords: list[str] = SENTENCE_OPENERS, pattern: str = PROPER) -> Column:
    """Capitalised phrases of three characters or more whose first word doesn't merely open a sentence, in order, repeats kept."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.filter(found, lambda x: (F.length(x) >= 3) & ~_listed(_first_word(x), stopwords))


def is_person(name: Column) -> Column:
    """One word is taken for a person, several for a place."""
    return ~name.rlike(r"\s")


def city_guess(text: Column, stopwords: list[str] = CITY_STOPWORDS) -> Column:
    """The first capitalised phrase of up to four words whose first word is no stop-word; null without one."""
    found = F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-zA-Z'\-]+(?:\s[A-Z][a-zA-Z'\-]+){0,3})\b"), F.lit(1))
    return F.get(F.filter(found, lambda x: ~_listed(_first_word(x), stopwords)), F.lit(0))


def locale_entities(texts: Column, languages: list[str], openers: list[str], known: Column) -> Column:
    """Entities that a locale judge must see: proper nouns of all texts without language names, language-policy
    phrases, common openers and what the locale is known to hold (an array of lower-case names); one spelling, the
    first, of each."""
    names = F.flatten(F.transform(texts, lambda t: proper_nouns(t)))
    policy = r"(?i)^(?:" + "|".join(re.escape(x) for x in languages) + r")-(?:only|first|speaking|language)$"

    def judged(x: Column) -> Column:
        low = F.lower(x)
        return ~_listed(low, languages) & ~_listed(low, openers) & ~x.rlike(policy) & ~F.coalesce(F.array_contains(known, low), F.lit(False))

    # sorted by spelling and place, the first of each spelling opens its run; a one-element array names the sorted list
    marked = F.array_sort(F.transform(F.filter(names, judged), lambda x, i: F.struct(F.lower(x).alias("l"), i.alias("i"), x.alias("x"))))
    firsts = F.transform(F.array(marked), lambda s: F.filter(s, lambda y, j: (j == 0) | (F.get(s, j - 1)["l"] != y["l"])))[0]
    return F.transform(F.array_sort(F.transform(firsts, lambda y: F.struct(y["i"], y["x"]))), lambda z: z["x"])


def real_name(text: Column, openers: list[str]) -> Column:
    """Whether a text holds a capitalised word of three letters or more that is no listed opener."""
    return F.exists(F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]{2,})\b"), F.lit(1)), lambda x: ~_listed(F.lower(x), openers))


def fidelity(text: Column, terms: list[str] | None) -> Column:
    """The share of distinct names (three characters or more, a leading article dropped) that are terms of the locale; 1 without text, terms or names."""
    names = F.regexp_extract_all(text, F.lit(PROPER_ANY), F.lit(1))
    bare = F.transform(names, lambda x: F.lower(F.regexp_replace(x, r"(?i)^(?:the|a|an)\s+", "")))
    some = F.array_distinct(F.filter(bare, lambda x: (F.length(x) >= 3) & ~_listed(_first_word(x), SENTENCE_OPENERS)))
    if not terms:
        return F.lit(1.0)
    known = F.size(F.filter(some, lambda x: x.isin([t.lower() for t in terms])))
    return F.when(F.coalesce(F.size(some), F.lit(0)) <= 0, 1.0).otherwise(known / F.size(some))


def mentions(terms: list[str]):
    """A function of a text column: the listed terms it mentions, longest terms first, none of it counted within a longer one.

    Terms stand between characters that are no letters or digits; spans may
    overlap in part, which one alternation can't express.
    """
    ordered = sorted({t.lower() for t in terms}, key=lambda t: (-len(t), t))

    def of(text: str | None) -> list[str]:
        low, spans, out = (text or "").lower(), [], []
        for term in ordered:
            at = low.find(term)
            while at >= 0:
                end = at + len(term)
                free = (at == 0 or not low[at - 1].isalnum()) and (end == len(low) or not low[end].isalnum())
                if free and not any(a <= at and end <= b for a, b in spans):
                    out.append(term), spans.append((at, end))
                at = low.find(term, end)
        return out

    @F.pandas_udf("array<string>")
    def found(text: pd.Series) -> pd.Series:
        return text.map(of)

    return found


def optional_hyphens(terms: list[str]) -> str:
    """The second gazetteer: lower-cased whole words, a hyphen standing for a hyphen, a space or nothing."""
    return r"\b(?:" + "|".join(re.escape(t.lower()).replace(r"\-", "[- ]?").replace(r"\ ", " ") for t in sorted(terms, key=lambda t: (-len(t), t))) + r")\b"


def shows_pivot(text: Column) -> Column:
    return text.rlike("(?i)" + PIVOT)


def last_grammar_ask(messages: Column) -> Column:
    """The index of the last user turn that asks for grammar; null without one."""
    hits = F.filter(F.transform(messages, lambda m, i: F.when((m["role"] == "user") & m["content"].rlike("(?i)" + GRAMMAR_ASK), i)), lambda i: i.isNotNull())
    return F.when(F.size(hits) > 0, F.element_at(hits, -1)).cast("int")


def feature_text(*parts: Column) -> Column:
    """Topic, setting and subtopics joined by spaces, blank parts left out."""
    return F.array_join(F.filter(F.flatten(F.array(*parts)), lambda p: p.isNotNull() & (F.trim(p) != "")), " ")


def normalised(text: Column) -> Column:
    """NFKC, lower case, ASCII letters and digits only."""
    import unicodedata

    @F.pandas_udf("string")
    def fold(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else re.sub("[^a-z0-9]+", "", unicodedata.normalize("NFKC", x).lower()))

    return fold(text)


def top_offenders(words: DataFrame, key: str, k: int = 10) -> DataFrame:
    """``key, offenders``: the ``k`` most frequent ``word`` of each row by ``n``, ties by the word; cut before the shuffle."""
    from pyspark.sql import Window

    ranked = words.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "word"))).where(F.col("_r") <= k)
    return ranked.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "word"))), lambda x: x["word"]).alias("offenders"))
