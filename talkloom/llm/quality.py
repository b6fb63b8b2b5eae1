"""Quality selection by importance resampling.

Two generative models over hashed n-grams are counted: one of the target (rows
labelled good), one of all raw text. A document's log weight is the log of the
ratio of the two models' probabilities of it, the sum of its n-grams' log
ratios; Gumbel noise keyed by the document turns the k largest keys into a
sample without replacement in proportion to the weights. Noise decides between
documents whose weights are close, as short ones' are.

``k`` is a count, or follows from a share of the documents: by default the
upper end of the 95 % interval of the share of good ones among the labelled
documents of the input. The raw model, the scores, the share and the k-th key
cover every document. Only the target model is fitted on a bounded sample of
labelled rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm._arrow import text_steps
from talkloom.llm._words import mix, tokens
from talkloom.session import materialise

#: Production parameters. The sample takes the labelled rows of smallest id hash.
BUCKETS = 16_384
TARGET_ROWS = 20_000
SEED = 17
#: Of a normal distribution, for the interval of the share.
Z = 1.959963984540054

_U = np.uint64


def ngram_buckets(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams of tokens, and the document of each.

    Tokens are runs of word bytes or of punctuation, case kept. All bigrams of
    a token with itself share one bucket: repetition is a trait of its own.
    """
    t = tokens(column)
    doc = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
    pair = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
    a, b = t.hashes[pair], t.hashes[pair + 1]
    two = np.where(a == b, _U(0x9E3779B97F4A7C15), mix(a * _U(0xFF51AFD7ED558CCD) + b))
    return np.concatenate([mix(t.hashes), two]) % _U(buckets), np.concatenate([doc, doc[pair]])


def verdicts(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """``id_col, _good`` per labelled id; an id with contradicting labels is not good. Null ids and labels don't count."""
    known = labels.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{quality_col}`").alias("_q")).dropna()
    return known.groupBy(id_col).agg((F.min("_q") == 1).alias("_good"))


def target_sample(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality", rows: int = TARGET_ROWS) -> DataFrame:
    """At most ``rows`` ids labelled good, those of smallest hash."""
    return verdicts(labels, id_col, quality_col).where("_good").select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(rows)


def log_ratios(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket log(target share / raw share), both smoothed by one count.

    A task sends one row per bucket it met, whatever its number of documents;
    the driver gets one row per bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets), np.zeros(buckets)
        for batch in batches:
            for part, _ in text_steps(batch, 0):
                bucket, doc = ngram_buckets(part.column(0), buckets)
                raw += np.bincount(bucket.astype(np.int64), minlength=buckets)
                good = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                target += np.bincount(bucket[good[doc]].astype(np.int64), minlength=buckets)
        met = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(raw[met]), pa.array(target[met])], ["bucket", "raw", "target"])

    # the sample is bounded by a parameter, so it may be broadcast
    texts = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text"))
    flagged = texts.join(F.broadcast(sample.select(id_col, F.lit(True).alias("_good"))), id_col, "left")
    counts = flagged.select("_text", F.coalesce("_good", F.lit(False)).alias("good")).mapInArrow(run, "bucket bigint, raw double, target double")
    rows = counts.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.ones(buckets), np.ones(buckets)
    for bucket, r, t in rows:
        raw[bucket] += r
        target[bucket] += t
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def _sortable(x: np.ndarray) -> np.ndarray:
    """Longs in the order of the doubles."""
    bits = x.astype(np.float64).view(np.int64)
    return np.where(bits >= 0, bits, bits ^ np.int64(0x7FFFFFFFFFFFFFFF))


def gumbel(noise: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Standard Gumbel numbers drawn by longs (the ids' hashes)."""
    u = (mix(noise.astype(np.int64).view(_U) + _U(seed * 0x9E3779B97F4A7C15 % 2**64)) >> _U(11)).astype(np.float64) / 2**53
    return -np.log(-np.log(np.clip(u, 1e-300, 1 - 1e-16)))


def scored(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """``_row`` (the input row), ``log_weight`` (double) and ``sample_key`` (long, ordered as log weight plus Gumbel noise).

    A text without tokens, empty or null, has log weight 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in text_steps(batch):
                n = part.num_rows
                bucket, doc = ngram_buckets(part.column(1), len(ratios))
                weight = np.bincount(doc, weights=ratios[bucket.astype(np.int64)], minlength=n).astype(np.float64)  # of no tokens: longs
                key = weight + gumbel(part.column(0).to_numpy(zero_copy_only=False), seed)
                yield pa.RecordBatch.from_arrays([part.column(2), pa.array(weight), pa.array(_sortable(key))], ["_row", "log_weight", "sample_key"])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.xxhash64(F.col(f"`{id_col}`")).alias("_noise"), F.col(f"`{text_col}`").alias("_text"), row.alias("_row"))
    return rows.mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}, log_weight double, sample_key bigint")


def kth_largest(keys: DataFrame, k: int, column: str = "sample_key") -> int:
    """The k-th largest long, exactly: four counts over 16 bits each, at most 65,536 rows to the driver each time."""
    rows, low, left = keys.select(F.col(column).alias("x")), None, k
    for shift in (48, 32, 16, 0):
        part = rows if low is None else rows.where(F.shiftright("x", shift + 16) == low)
        counts = {r[0]: r[1] for r in part.groupBy(F.shiftright("x", shift).alias("h")).agg(F.count(F.lit(1))).collect()}
        for h in sorted(counts, reverse=True):
            if left <= counts[h]:
                low = h
                break
            left -= counts[h]
    return low


def share_of_good(keys: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> float | None:
    """The upper end of the 95 % (Wilson) interval of the good share of labelled documents among ``keys``; None without any."""
    n, good = keys.select(id_col).join(verdicts(labels, id_col), id_col).agg(F.count(F.lit(1)), F.count_if("_good")).first()
    if not good:
        return None
    p = good / n
    return min(1.0, (p + Z * Z / (2 * n) + Z * math.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n))


def _cut(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, share: float | None, k: int | None) -> tuple[np.ndarray, DataFrame, int | None]:
    """The log ratios, the keys (``id_col, log_weight, sample_key`` per row), and the least key of the sample (None: everything is kept)."""
    sample = materialise(target_sample(labels, id_col), "target")
    ratios = log_ratios(docs, sample, id_col, text_col)
    narrow = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    keys = materialise(scored(narrow, ratios, id_col, text_col).select(F.col("_row")[id_col].alias(id_col), "log_weight", "sample_key"), "keys")
    total = keys.count()
    if k is None:
        share = share_of_good(keys, labels, id_col) if share is None else share
        k = total if share is None else math.ceil(share * total)
    if k >= total:
        return ratios, keys, None
    return ratios, keys, kth_largest(keys, k) if k > 0 else 2**63 - 1


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float | None = None, k: int | None = None) -> DataFrame:
    """``id_col, log_weight, sample_key, kept`` per row, as :func:`resample`, without a further pass over the texts."""
    _, keys, least = _cut(docs, labels, id_col, text_col, share, k)
    return keys.withColumn("kept", F.lit(True) if least is None else F.col("sample_key") >= F.lit(least))


def _sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, share: float | None, k: int | None) -> DataFrame:
    """:func:`scored` with ``kept``: a row's key is found again rather than joined, which would shuffle the texts."""
    ratios, _, least = _cut(docs, labels, id_col, text_col, share, k)
    return scored(docs, ratios, id_col, text_col).withColumn("kept", F.lit(True) if least is None else F.col("sample_key") >= F.lit(least))


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float | None = None, k: int | None = None) -> DataFrame:
    """The input's columns (but any of the added names) with ``log_weight``, ``sample_key`` and ``kept`` (the k largest keys).

    ``k`` rows are kept, or ``share`` of them (rounded up), or, with neither,
    the share of good documents (:func:`share_of_good`). Rows tied with the
    k-th key are all kept; rows that repeat an id and text tie. A text without
    tokens, empty or null, has log weight 0. Without labelled good documents
    everything is kept; an empty table gives an empty result.
    """
    added = ["log_weight", "sample_key", "kept"]
    names = [c for c in docs.columns if c.lower() not in added]
    return _sampled(docs, labels, id_col, text_col, share, k).select(*[F.col("_row")[c].alias(c) for c in names], *added)


def reject_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float | None = None, k: int | None = None) -> DataFrame:
    """The documents that :func:`resample` keeps, with their columns (a pipeline stage)."""
    return _sampled(docs, labels, id_col, text_col, share, k).where("kept").select([F.col("_row")[c].alias(c) for c in docs.columns])
