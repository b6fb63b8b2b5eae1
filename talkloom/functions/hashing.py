"""Deterministic choices from SHA-256 prefixes; the same on every engine and cluster."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix(key: Column, digits: int) -> Column:
    """The first hex digits of the key's SHA-256; of fixed width, they sort as the number does."""
    return F.substring(F.sha2(key.cast("binary"), 256), 1, digits)


def number(key: Column, digits: int = 8) -> Column:
    """The prefix as a long (15 digits at most)."""
    return F.conv(prefix(key, digits), 16, 10).cast("long")


def in_pool(key: Column, percent: int) -> Column:
    """Whether the key falls into the share of ``percent`` of 100."""
    return number(key) % 100 < percent


def keep(key: Column, rate: float) -> Column:
    """A Bernoulli choice at ``rate``; none at 0 or less, all at 1 or more."""
    if rate <= 0 or rate >= 1:
        return F.lit(rate >= 1)
    return number(key) / F.lit(float(0xFFFFFFFF)) < rate


def choose(key: Column, n: int, digits: int = 8) -> Column:
    """One of 0 .. n-1."""
    return (number(key, digits) % n).cast("int")
