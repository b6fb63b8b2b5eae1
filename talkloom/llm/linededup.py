"""Line dedup by site-relative frequency.

Pages are grouped by host. For each line, the pages of the host that contain it
are divided by the host's page total; lines whose ratio exceeds the boilerplate
ratio are dropped from every page of that host. Only DataFrame functions run.

Lines travel as 128-bit fingerprints, never as text. Equal pages of a host are
one row with a count before anything is exploded or joined, counts are combined
before each shuffle, and the joins are on (host, line) or (host, text), so a
large host or a group of copies is never gathered. A page brings with it only
the fingerprints of its own lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.session import materialise

#: Production parameters: a line is boilerplate in more than 1 % of a host's
#: pages, in 3 pages at least; whole copies of a page are left to near-dedup.
RATIO = 0.01
MIN_PAGES = 3
SPARE = "copies"
SPARED = ("none", "copies", "all")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _fingerprint(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def _host(host: str) -> Column:
    return F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("\x00null"))


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _pages(docs: DataFrame, host: str, text: str) -> DataFrame:
    """``host, ta, tb`` (the text's fingerprint) ``, n`` (rows) ``, lines`` (distinct fingerprints of its lines with a word) per distinct page."""
    rows = docs.select(_host(host).alias("host"), F.col(f"`{text}`").alias("text"))
    lines = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _has_word), _fingerprint))
    marked = rows.select("host", F.xxhash64("text").alias("ta"), F.xxhash64(F.lit(7), "text").alias("tb"), lines.alias("lines"))
    return materialise(marked.groupBy("host", "ta", "tb").agg(F.count(F.lit(1)).alias("n"), F.first("lines").alias("lines")), "pages")


def boilerplate_lines(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, a, b`` of each line (as fingerprint) in more than ``ratio`` of its host's pages and in ``min_pages`` at least.

    A page counts once per line however often it repeats the line. Lines
    without a word are never boilerplate. A null host is a host of its own;
    rows that repeat a page are counted as pages of their own.
    """
    totals = pages.groupBy("host").agg(F.sum("n").alias("n_host_pages"))
    counts = pages.select("host", "n", F.explode("lines").alias("f")).groupBy("host", F.col("f.a").alias("a"), F.col("f.b").alias("b")).agg(F.sum("n").alias("n_pages"))
    return counts.where(F.col("n_pages") >= min_pages).join(totals, "host").where(F.col("n_pages") > ratio * F.col("n_host_pages")).select("host", "a", "b")


def dedup_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, spare: str = SPARE) -> DataFrame:
    """The input's columns (but any of the two added names) with boilerplate lines cut from ``text``, plus ``n_lines`` and ``n_dropped_lines``.

    The other lines keep their order and are joined by one line feed again, so
    a text without boilerplate comes back byte for byte. A null text stays
    null. An empty table gives an empty result.

    ``spare`` says what becomes of pages made of nothing but boilerplate lines:
    ``none`` drops their lines as the rule has it; ``copies`` leaves those
    whole whose text another page of the host has too, for the near-duplicate
    stage to decide on (else no page of a large group of copies would keep its
    text); ``all`` leaves all of them. ``min_pages=1, spare="none"`` is the
    plain rule, under which hosts with few pages lose every line.
    """
    cut = _cut(docs, host, text, ratio, min_pages, spare)
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped_lines")]
    columns = [F.col("_new").alias(c) if c == text else F.col("_row")[c].alias(c) for c in names]
    return cut.select(*columns, F.col("_lines").alias("n_lines"), F.col("_gone").alias("n_dropped_lines"))


def _dropped(pages: DataFrame, ratio: float, min_pages: int, spare: str) -> DataFrame:
    """``host, ta, tb, drop``: the fingerprints of the lines to drop, of the pages that have any."""
    if spare not in SPARED:
        raise ValueError(f"spare is one of {SPARED}")
    found = materialise(boilerplate_lines(pages, ratio, min_pages), "lines")
    lines = pages.select("host", "ta", "tb", "n", F.size("lines").alias("of"), F.explode("lines").alias("f")).select("*", F.col("f.a").alias("a"), F.col("f.b").alias("b"))
    # a group is one page's own lines
    hits = lines.join(found, ["host", "a", "b"], "left_semi").groupBy("host", "ta", "tb").agg(F.collect_list("f").alias("drop"), F.first("of").alias("of"), F.first("n").alias("n"))
    whole = F.size("drop") == F.col("of")
    spared = {"none": F.lit(False), "copies": whole & (F.col("n") > 1), "all": whole}[spare]
    return materialise(hits.where(~spared).select("host", "ta", "tb", "drop"), "drop")


def _cut(docs: DataFrame, host: str, text: str, ratio: float, min_pages: int, spare: str) -> DataFrame:
    """``_row`` (the input row), ``_new`` (its text without boilerplate), ``_lines``, ``_gone``."""
    drop = _dropped(_pages(docs, host, text), ratio, min_pages, spare)
    body = F.col(f"`{text}`")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), _host(host).alias("host"), F.xxhash64(body).alias("ta"), F.xxhash64(F.lit(7), body).alias("tb"))
    # a merge join at every size: it splits a large group of copies over tasks, and needs no table to be small
    joined = keyed.join(drop.hint("merge"), ["host", "ta", "tb"], "left").withColumn("_text", F.col("_row")[text])
    cut = F.transform(
        F.array(_lines(F.col("_text"))),
        lambda lines: F.transform(
            F.array(F.filter(lines, lambda x: ~F.array_contains(F.col("drop"), _fingerprint(x)))),
            lambda kept: F.struct((F.size(lines) - F.size(kept)).cast("long").alias("gone"), F.array_join(kept, "\n").alias("text")),
        )[0],
    )[0]
    done = joined.withColumn("_cut", F.when(F.col("drop").isNotNull() & F.col("_text").isNotNull(), cut))
    return done.select(
        "_row",
        F.coalesce(F.col("_cut.text"), F.col("_text")).alias("_new"),
        (F.length("_text") - F.length(F.translate("_text", "\n", "")) + 1).cast("long").alias("_lines"),
        F.coalesce(F.col("_cut.gone"), F.lit(0).cast("long")).alias("_gone"),
    ).withColumn("_lines", F.coalesce("_lines", F.lit(1).cast("long")))


def strip_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", length_col: str | None = None, ratio: float = RATIO, min_pages: int = MIN_PAGES, spare: str = SPARE) -> DataFrame:
    """As :func:`dedup_lines`, with the input's columns only; ``length_col`` follows a text that was cut (a pipeline stage)."""

    def value(c: str):
        if c == text:
            return F.col("_new")
        if c == length_col:
            return F.when(F.col("_gone") > 0, F.length("_new").cast(docs.schema[c].dataType)).otherwise(F.col("_row")[c])
        return F.col("_row")[c]

    return _cut(docs, host, text, ratio, min_pages, spare).select([value(c).alias(c) for c in docs.columns])
