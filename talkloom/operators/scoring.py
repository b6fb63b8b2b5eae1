"""Detection scores, judge consolidation, run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    """part / whole, null where there is nothing to divide by."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def verdict(fired: Column, should_fire: Column) -> Column:
    """tp, fn, fp or tn; null without an expectation."""
    return F.when(should_fire & fired, "tp").when(should_fire, "fn").when(~should_fire & fired, "fp").when(~should_fire, "tn")


def detection_summary(df: DataFrame, by: list[str], precision_if_silent: float | None = None, off: Column | None = None) -> DataFrame:
    """Counts, recall, false-positive rate, precision and F1 per group.

    Rates without a denominator are null; F1 also where precision and recall
    are both 0. ``precision_if_silent`` gives the precision where nothing
    fires (and then F1 is 0 in place of null). Rows that are ``off`` position
    are left out of all this and give ``off_recall`` of their own.
    """
    apart = F.lit(False) if off is None else F.coalesce(off, F.lit(False))
    v = verdict(F.col("fired"), F.col("should_fire"))
    counts = [F.count_if((F.col("_v") == k) & ~F.col("_off")).alias(k) for k in ("tp", "fn", "fp", "tn")]
    recall = rate(F.count_if(F.col("_off") & (F.col("_v") == "tp")), F.count_if(F.col("_off") & F.col("_v").isin("tp", "fn"))).alias("off_recall")
    counted = df.withColumn("_v", v).withColumn("_off", apart).groupBy(*by).agg(*counts, *([] if off is None else [recall]))
    out = counted.withColumn("recall", rate(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("fp_rate", rate(F.col("fp"), F.col("fp") + F.col("tn")))
    precision = rate(F.col("tp"), F.col("tp") + F.col("fp"))
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    if precision_if_silent is not None:
        return out.withColumn("precision", F.coalesce(precision, F.lit(precision_if_silent))).withColumn("f1", F.coalesce(f1, F.lit(0.0)))
    return out.withColumn("precision", precision).withColumn("f1", f1)


def upper_median(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Per group the element at n / 2 of the sorted scores (the upper of two middle ones); nulls don't count."""
    return df.where(F.col(score).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_list(score)).alias("_s")).select(*by, F.get("_s", F.floor(F.size("_s") / 2).cast("int")).alias("median"), F.size("_s").alias("n_judges"))


def majority(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Per group the most frequent value; ties go to the one whose first judge comes first."""
    votes = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_o"))
    return votes.groupBy(*by).agg(F.max_by(F.col(value), F.struct(F.col("_n"), -F.col("_o"))).alias("majority"), F.sum("_n").alias("n_votes"))


def first_seen_top(df: DataFrame, value: str, order: str, k: int, warn_above: float = 0.25) -> DataFrame:
    """The ``k`` most frequent values with shares; ties by first occurrence; a warning above the share."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    total = counts.agg(F.sum("n").alias("_total"))
    top = counts.orderBy(F.desc("n"), "_first").limit(k).crossJoin(F.broadcast(total))
    return top.select(value, "n", (F.col("n") / F.col("_total")).alias("share"), (F.col("n") / F.col("_total") > warn_above).alias("warn"))


#: The direction in which a metric is better; others are 0, and any shift of them is flagged.
DIRECTIONS = {"topic_adherence": 1, "locale_fidelity": 1, "redirect_success": 1, "naturalness_judge": 1, "mode_consistency": 1, "json_validity": 1, "above_band_ratio": -1}


def compare_runs(base: DataFrame, candidate: DataFrame, on: list[str], threshold: float = 0.05) -> DataFrame:
    """Full outer join of two metric tables (``*on, metric, value``): delta, direction, regression."""
    a = base.select(*on, "metric", F.col("value").alias("baseline"))
    b = candidate.select(*on, "metric", F.col("value").alias("candidate"))
    joined = a.join(b, [*on, "metric"], "full_outer").withColumn("delta", F.col("candidate") - F.col("baseline"))
    direction = F.lit(0)
    for metric, d in DIRECTIONS.items():
        direction = F.when(F.col("metric") == metric, F.lit(d)).otherwise(direction)
    joined = joined.withColumn("direction", direction)
    worse = F.when(F.col("direction") > 0, F.col("delta") < -threshold).when(F.col("direction") < 0, F.col("delta") > threshold).otherwise(F.abs("delta") > threshold)
    return joined.withColumn("regression", F.coalesce(worse, F.lit(False)))


def share_filter(df: DataFrame, value: str, most: float) -> DataFrame:
    """Rows whose value's share of all rows is at most ``most``; null values stay.

    The counts are one row per value; the total is a scalar.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    heavy = counts.where(F.col(value).isNotNull()).crossJoin(F.broadcast(total)).where(F.col("_n") > most * F.col("_all")).select(value)
    return df.join(heavy, value, "left_anti")


def share_filters(df: DataFrame, most: dict[str, float]) -> DataFrame:
    """:func:`share_filter` by several columns; every share is one of all rows, whatever another column removes."""
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    out = df
    for value, share in most.items():
        counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
        heavy = counts.where(F.col(value).isNotNull()).crossJoin(F.broadcast(total)).where(F.col("_n") > share * F.col("_all")).select(value)
        out = out.join(heavy, value, "left_anti")
    return out


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order; limited in each task before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") == 1).drop("_n")
