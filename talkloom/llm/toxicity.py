"""Toxicity scores: boosted trees over dense features, calibrated isotonically.

Features are rates over the whole text: hits of a fixed lexicon and of lexicons
learned from the training labels (words and word beginnings), their nearness to
second-person words, capitals, punctuation, and obfuscated spellings.

Everything is learned from a bounded sample of labelled rows outside the
held-out fold. Scoring is one narrow pass over all texts, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.llm._arrow import text_steps
from talkloom.llm._words import _LOWER, _SPACE, _runs, compact, text_buffer
from talkloom.llm.boosting import Boosted, fit, isotonic
from talkloom.session import materialise

#: Production parameters. The sample takes the training rows of smallest id hash.
TRAIN_ROWS = 20_000
HELD_OUT_FOLDS, HELD_OUT_FOLD = 3, 1
PREDICT_AT = 0.7
#: A learned entry is in so many toxic rows, as a share and at least, and so much likelier there.
LEXICON_SHARE, LEXICON_LEAST, LEXICON_ODDS, LEXICON_SIZE = 0.01, 4, 6.0, 400
#: Bytes of word beginnings; words of context on each side of a hit.
PREFIXES = (5, 6, 7, 8)
NEAR = 5

#: Insults, and words for the second person.
INSULTS = "idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting clown clowns ugly filthy vermin imbecile coward liar creep freak jerk fool hate shut kill die".split()
SECOND = "you your yours yourself u ur tu toi te ton ta vous votre du dich dir dein deine ihr euch ti tus usted vosotros".split()

_PLAIN = np.array([not (33 <= b < 128 and not chr(b).isalnum()) for b in range(256)])
_LEET_KEEP = _PLAIN.copy()
_LEET_KEEP[[ord(c) for c in "@$"]] = True
_LEET = _LOWER.copy()
for _sign, _letter in zip("0134578@$", "oieastbas", strict=True):
    _LEET[ord(_sign)] = _LOWER[ord(_letter)]
_WORD = (~_SPACE).astype(np.uint8)
FEATURES = ["lexicon", "words", "beginnings", "leet", "distinct", "near", "hits", "share_second", "capitals", "shouted", "exclaims", "punctuation", "mixed", "length", "last_hit"]


def _hash_words(words: list[str]) -> np.ndarray:
    return np.unique(_runs(*text_buffer(pa.array([" ".join(words)])), _WORD, _LOWER).hashes)


_INSULTS, _SECOND = _hash_words(INSULTS), _hash_words(SECOND)


@dataclass
class Parsed:
    hashes: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    buffer: np.ndarray

    def beginnings(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first ``size`` bytes of the words that are longer, and those words' positions."""
        at = np.flatnonzero(self.ends - self.starts > size)
        out = np.full(len(at), size, np.uint64)
        for k in range(size):
            out = out * np.uint64(0x100000001B3) ^ _LOWER[self.buffer[self.starts[at] + k]]
        return out ^ np.uint64(size), at


def _parse(buffer: np.ndarray, offsets: np.ndarray, keep: np.ndarray, codes: np.ndarray) -> Parsed:
    small, at = compact(buffer, offsets, keep)
    w = _runs(small, at, _WORD, codes)
    return Parsed(w.hashes, np.repeat(np.arange(len(at) - 1), np.diff(w.first)), w.first, w.starts, w.ends, small)


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All lexicon candidates (word and beginning hashes) and their documents."""
    p = _parse(*text_buffer(column), _PLAIN, _LOWER)
    hashes, docs = [p.hashes], [p.doc]
    for size in PREFIXES:
        h, at = p.beginnings(size)
        hashes.append(h), docs.append(p.doc[at])
    return np.concatenate(hashes), np.concatenate(docs)


def features(column: pa.Array, words: np.ndarray, beginnings: np.ndarray) -> np.ndarray:
    """Rows of ``FEATURES`` for a string array; a text without words has zeros."""
    n = len(column)
    buffer, offsets = text_buffer(column)
    plain, leet = _parse(buffer, offsets, _PLAIN, _LOWER), _parse(buffer, offsets, _LEET_KEEP, _LEET)
    count = lambda doc, w=None: np.bincount(doc, w, minlength=n).astype(float)
    total = np.maximum(count(plain.doc), 1)
    fixed, learned, second = (np.isin(plain.hashes, s) for s in (_INSULTS, words, _SECOND))
    begins = np.zeros(len(plain.hashes), bool)
    for size in PREFIXES:
        h, at = plain.beginnings(size)
        begins[at[np.isin(h, beginnings)]] = True
    hit = fixed | learned | begins
    hits = np.flatnonzero(hit)
    # words of the second person within NEAR words of a hit, in the same text
    sums = np.concatenate([[0], np.cumsum(second)])
    low = np.maximum(hits - NEAR, plain.first[plain.doc[hits]])
    high = np.minimum(hits + NEAR + 1, plain.first[plain.doc[hits] + 1])
    near = (sums[high] - sums[low]) > 0
    leet_hit = np.isin(leet.hashes, _INSULTS) | np.isin(leet.hashes, words)
    pairs = np.unique(np.stack([plain.doc[hits].astype(np.uint64), plain.hashes[hits]]), axis=1)[0].astype(np.int64) if len(hits) else np.zeros(0, np.int64)
    doc_of = np.repeat(np.arange(n), np.diff(offsets))
    upper = (buffer >= 65) & (buffer <= 90)
    letters = np.maximum(count(doc_of, (upper | (buffer >= 97) & (buffer <= 122)).astype(float)), 1)
    size = np.maximum(np.diff(offsets), 1)
    digit = (plain.buffer >= 48) & (plain.buffer <= 57)
    digits = np.concatenate([[0], np.cumsum(digit)])
    inside = digits[plain.ends] - digits[plain.starts]
    mixed = (inside > 0) & (inside < plain.ends - plain.starts)
    caps = np.concatenate([[0], np.cumsum((plain.buffer >= 65) & (plain.buffer <= 90))])
    shouted = (caps[plain.ends] - caps[plain.starts] == plain.ends - plain.starts) & (plain.ends - plain.starts > 1)
    n_hits = count(plain.doc[hits])
    last = np.zeros(n)  # how far into the text the last hit is
    if len(hits):
        np.maximum.at(last, plain.doc[hits], (hits - plain.first[plain.doc[hits]]) / total[plain.doc[hits]])
    return np.stack(
        [
            count(plain.doc, fixed) / total,
            count(plain.doc, learned) / total,
            count(plain.doc, begins) / total,
            np.maximum(count(leet.doc, leet_hit) - count(plain.doc, fixed | learned), 0),
            count(pairs),
            count(plain.doc[hits], near.astype(float)) / total,
            n_hits,
            count(plain.doc, second) / total,
            count(doc_of, upper.astype(float)) / letters,
            count(plain.doc, shouted) / total,
            count(doc_of, (buffer == 33).astype(float)) / size,
            count(doc_of, (~_PLAIN[buffer]).astype(float)) / size,
            count(plain.doc, mixed) / total,
            np.log1p(count(plain.doc)),
            last,
        ],
        axis=1,
    )


@dataclass
class Model:
    words: np.ndarray
    beginnings: np.ndarray
    trees: Boosted
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, column: pa.Array) -> np.ndarray:
        margin = self.trees.margin(features(column, self.words, self.beginnings))
        # the calibrated value, with the margin deciding within a step of it
        return np.clip(0.999 * np.interp(margin, *self.knots) + 0.001 / (1 + np.exp(-margin)), 0, 1)


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % HELD_OUT_FOLDS == HELD_OUT_FOLD


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> DataFrame:
    """``id, text, toxic`` of at most ``rows`` labelled rows outside the held-out fold, written to the shared folder.

    An id with contradicting labels counts as toxic; null ids and labels don't count.
    """
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    sample = usable.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # the sample is bounded by a parameter, so it may be broadcast
    return materialise(texts.join(F.broadcast(materialise(sample, "tox-ids")), "id").select("id", "text", "toxic"), "tox-train")


def _document_counts(rows: DataFrame, only: np.ndarray | None) -> dict[int, int]:
    """Of each lexicon candidate (or those of ``only``) the number of rows that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in text_steps(batch, 0):
                hashes, doc = _entries(part.column(0))
                if only is not None:
                    kept = np.isin(hashes, only)
                    hashes, doc = hashes[kept], doc[kept]
                if len(hashes):
                    once = np.unique(np.stack([hashes, doc.astype(np.uint64)]), axis=1)[0]
                    values, n = np.unique(once, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    counted = rows.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    if only is None:
        least = max(LEXICON_LEAST, int(LEXICON_SHARE * rows.count()))
        counted = counted.where(F.col("n") >= least)
    return {r.h: r.n for r in counted.collect()}


def train(rows: DataFrame) -> Model | None:
    """A model from ``text, toxic`` rows; None if a class is missing."""
    n_toxic, n_clean = (rows.where(F.col("toxic") == v).count() for v in (1, 0))
    if not n_toxic or not n_clean:
        return None
    toxic = _document_counts(rows.where("toxic = 1"), None)
    keys = np.array(list(toxic), np.int64).view(np.uint64)
    clean = _document_counts(rows.where("toxic = 0"), keys) if len(keys) else {}
    odds = {h: ((t + 0.5) / (n_toxic + 1)) / ((clean.get(h, 0) + 0.5) / (n_clean + 1)) for h, t in toxic.items()}
    chosen = sorted((h for h in odds if odds[h] >= LEXICON_ODDS and toxic[h] >= 3 * clean.get(h, 0) * n_toxic / n_clean), key=lambda h: (-toxic[h], h))[:LEXICON_SIZE]
    lexicon = np.unique(np.array(chosen, np.int64).view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in text_steps(batch, 1):
                x = features(part.column(1), lexicon, lexicon)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["id", "toxic", "x"])

    kind = rows.schema["id"].dataType.simpleString()
    table = rows.select("id", "text", "toxic").mapInArrow(run, f"id {kind}, toxic int, x array<double>").orderBy("id").collect()
    x, y = np.array([r.x for r in table]), np.array([r.toxic for r in table], float)
    fold = np.arange(len(y)) % 5
    margins = np.zeros(len(y))
    for k in range(5):  # margins of rows their trees have not seen
        rest = fold != k
        if 0 < y[rest].sum() < rest.sum():
            margins[~rest] = fit(x[rest], y[rest]).margin(x[~rest])
    return Model(lexicon, lexicon, fit(x, y), isotonic(margins, y))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, predicted`` per row, from whole texts alone.

    Null and empty texts get the score of a text without words. Without a
    model (no labels of one class) scores are 0. Repeated ids stay rows of
    their own; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in text_steps(batch):
                value = model.score(part.column(1)) if model else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(value), pa.array((value >= PREDICT_AT).astype(np.int32))], [id_col, "score", "predicted"])

    chosen = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return chosen.mapInArrow(run, f"`{id_col}` {chosen.schema[0].dataType.simpleString()}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the labels outside the held-out fold and score every document: ``id_col, held_out, score, predicted``."""
    scored = score(docs, train(training_rows(docs, labels, id_col, text_col)), id_col, text_col)
    return scored.select(id_col, F.coalesce(held_out(F.col(f"`{id_col}`")), F.lit(False)).alias("held_out"), "score", "predicted")
