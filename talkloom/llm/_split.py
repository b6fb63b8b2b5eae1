"""Cutting texts where the byte-level split pattern always cuts.

The pattern's pieces never run from another character into white space, and
the last character of a run of white space is a piece of its own or opens the
next one. So a space or line feed may be cut before if it is the first or the
last of its run; only inside runs of three characters or more, or in a run of
two at a text's end, does the pattern take several of them together.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

#: The byte-level split pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a text that are cut up at a time.
PART_CHARS = 1 << 20

_LONG_RUN = re.compile(r"\s\s\s|\s\s\Z").search
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)").search


def parts(text: str) -> Iterator[str]:
    """The text in parts of about ``PART_CHARS``, cut before single spaces; a part goes on where it has none."""
    at = 0
    while len(text) - at > PART_CHARS and (cut := _SAFE_SPACE(text, at + PART_CHARS)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def chunks(text: str) -> list[str] | None:
    """Names of the text's chunks, which begin at its spaces and line feeds (:func:`chunk_text`); None if it holds a long run.

    The first name is the text up to there, as it stands.
    """
    return None if _LONG_RUN(text) else text.replace("\n", " \n").split(" ")


def chunk_text(name: str) -> str:
    """The chunk that a name other than the first stands for."""
    return name if name[:1] == "\n" else " " + name


#: ASCII punctuation: at a chunk's end it is one piece.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def chunk_pieces(name: str, find: Callable) -> list[str]:
    """The chunk's pieces; ``find`` splits what isn't plainly a word."""
    word = name.rstrip(PUNCTUATION)
    if word.isalpha():
        return [" " + word, name[len(word) :]] if len(word) < len(name) else [" " + word]
    return find(chunk_text(name))


class Known(dict):
    """Values of short keys in two generations, each bounded in bytes: what is still in use outlives the older one.

    ``find`` makes the value of a key that ``known[key]`` lacks.
    """

    #: Bytes that a dictionary's entry takes besides its text and value; characters of a key that is kept.
    ENTRY, KEY_CHARS = 180, 32

    def __init__(self, megabytes: int, find: Callable | None = None):
        super().__init__()
        self.find, self.limit = find, megabytes << 20
        self.older: dict = {}
        self.used = 0

    def __missing__(self, key):
        if (value := self.older.get(key)) is None:
            return self.find(key)
        self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(key) <= self.KEY_CHARS:
            self[key] = value
            self.used += self.ENTRY + 2 * len(key) + (len(value) if isinstance(value, bytes) else 0)

    def keep_all(self, values: dict) -> None:
        """:meth:`keep` for many; the values are bytes."""
        short = {k: v for k, v in values.items() if len(k) <= self.KEY_CHARS}
        self.update(short)
        self.used += self.ENTRY * len(short) + 2 * sum(map(len, short)) + sum(map(len, short.values()))

    def recall(self, key):
        """The older generation's value, which is taken over; None if there is none."""
        if (value := self.older.get(key)) is not None:
            self.keep(key, value)
        return value

    def unknown(self, keys: set) -> set:
        """The keys without a value (bytes); those of the older generation are taken over."""
        new, older = keys.difference(self), self.older
        if older and (found := {k: older[k] for k in new if k in older}):
            self.keep_all(found)
            new.difference_update(found)
        return new

    def turn(self) -> None:
        """Start a new generation if this one is full."""
        if self.used > self.limit:
            self.older = dict(self)
            self.clear()
            self.used = 0

    def forget(self) -> None:
        """Let go of everything."""
        self.clear()
        self.older, self.used = {}, 0
