"""Samples, splits, caps and quotas by hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions import hashing as H


def hash_sample(df: DataFrame, key: Column, fraction: float) -> DataFrame:
    """The ``max(1, round(n * fraction))`` rows of smallest key hash (half to even); all at 1 or more, none at 0 or less.

    The number of rows is counted first; the cut is found by a histogram of
    hash prefixes, so no task sorts the whole table.
    """
    if fraction >= 1:
        return df
    if fraction <= 0:
        return df.limit(0)
    keyed = df.withColumn("_h", H.prefix(key, 16))
    n = keyed.count()
    k = max(1, round(n * fraction))
    left, at = k, None
    for r in keyed.groupBy(F.substring("_h", 1, 4).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():  # 65,536 rows at most
        if left <= r.n:
            at = r.p
            break
        left -= r.n
    if at is None:
        return df
    sure = keyed.where(F.substring("_h", 1, 4) < at)
    edge = keyed.where(F.substring("_h", 1, 4) == at).orderBy("_h", key).limit(left)
    return sure.unionByName(edge).drop("_h")


def ranked(df: DataFrame, by: list[str], digits: Column, key: Column) -> DataFrame:
    """Add ``_r``, a row's rank from 1 in its stratum by a hash's hex digits, ties by the key.

    A histogram of the first four digits (65,536 rows a stratum at most) gives
    the rows before a prefix; only rows of one stratum and prefix are sorted
    together, so a large stratum is spread over the tasks.
    """
    marked = df.withColumn("_h", digits).withColumn("_p", F.substring("_h", 1, 4)).withColumn("_s", F.to_json(F.struct(*by)))
    counts = marked.groupBy("_s", "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_s", "_p", (F.sum("_n").over(Window.partitionBy("_s").orderBy("_p")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_s", "_p").orderBy("_h", key))
    return marked.withColumn("_k", within).join(before, ["_s", "_p"]).withColumn("_r", F.col("_before") + F.col("_k")).drop("_h", "_p", "_s", "_k", "_before")


def holdout(df: DataFrame, key: Column, by: str, n: int, salt: str = "") -> DataFrame:
    """Add ``held_out``: per stratum the first ``n`` rows by salted 12-digit hash."""
    rows = ranked(df, [by], H.prefix(F.concat(F.lit(salt), F.coalesce(key, F.lit(""))), 12), key)
    return rows.withColumn("held_out", F.col("_r") <= n).drop("_r")


def cap_per_cell(df: DataFrame, cell: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each cell; the rank is limited before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*cell).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def stratified_split(df: DataFrame, strata: list[str], key: Column, share: float) -> DataFrame:
    """Add ``validation``: per stratum ``max(1, round(n * share))`` rows by hash (half to even)."""
    sizes = df.groupBy(F.to_json(F.struct(*strata)).alias("_s")).agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * F.lit(share)).cast("int")).alias("_k"))
    rows = ranked(df, strata, H.prefix(key, 16), key).withColumn("_s", F.to_json(F.struct(*strata)))
    return rows.join(sizes, "_s").withColumn("validation", F.col("_r") <= F.col("_k")).drop("_s", "_k", "_r")


def mix_pools(pools: DataFrame, pool: str, shares: dict[str, float], key: Column) -> DataFrame:
    """Rows of the pools in the given shares: the scarcest pool sets the total, the others give ``int(total * share)``, by hash order.

    Empty pools are left out of the solution and the shares of the others stand.
    """
    sizes = {r[0]: r[1] for r in pools.groupBy(pool).count().collect()}  # one row per pool
    live = {p: s for p, s in shares.items() if sizes.get(p)}
    if not live:
        return pools.limit(0)
    total = min(sizes[p] / s for p, s in live.items() if s > 0)
    caps = {p: min(sizes[p], int(total * s + 1e-9)) for p, s in live.items()}
    cap = F.create_map(*[x for p, c in caps.items() for x in (F.lit(p), F.lit(c))])[F.col(pool)]
    return ranked(pools, [pool], H.prefix(key, 16), key).where(F.col("_r") <= cap).drop("_r")


def mix_two(larger: DataFrame, smaller: DataFrame, ratio: float, key: Column) -> DataFrame:
    """The union of two pools with ``larger`` trimmed, by hash order, to ``int(n_smaller * ratio)`` rows if it has more than that share.

    Either pool empty: nothing is trimmed.
    """
    n, m = larger.count(), smaller.count()
    if m and n / m > ratio:
        cut = ranked(larger.withColumn("_one", F.lit(1)), ["_one"], H.prefix(key, 16), key).where(F.col("_r") <= int(m * ratio))
        larger = cut.select(*larger.columns)
    return larger.unionByName(smaller)


def mix_and_split(sft: DataFrame, evaluation: DataFrame, key: Column, shares: tuple[float, float] | None, share: float) -> DataFrame:
    """Both pools with ``validation``, stratified by ``(type, level)``; ``shares`` trims the larger pool to their ratio, None keeps all."""
    sft, evaluation = sft.withColumn("type", F.lit("sft")), evaluation.withColumn("type", F.lit("evaluation"))
    if shares is None:
        both = sft.unionByName(evaluation)
    elif sft.count() * shares[1] > evaluation.count() * shares[0]:
        both = mix_two(sft, evaluation, shares[0] / shares[1], key)
    else:
        both = mix_two(evaluation, sft, shares[1] / shares[0], key)
    return stratified_split(both, ["type", "level"], key, share)


def coverage_deficits(counts: DataFrame, grid: DataFrame, cell: list[str], pools: list[str], target: int, most: int) -> DataFrame:
    """The grid with each pool's count, the largest shortfall against ``target`` (``raw_deficit``), and it capped at ``most``."""
    wide = counts.groupBy(*cell).pivot("pool", pools).agg(F.sum("n"))
    out = grid.join(wide, cell, "left").na.fill(0, pools)
    raw = F.greatest(*[F.greatest(F.lit(0), F.lit(target) - F.col(p)) for p in pools]) if len(pools) > 1 else F.greatest(F.lit(0), F.lit(target) - F.col(pools[0]))
    return out.withColumn("raw_deficit", raw.cast("long")).withColumn("deficit", F.least(F.lit(most), F.col("raw_deficit")).cast("long"))


#: Rounds, step, attrition and ceiling of a top-up.
TOP_UP_ROUNDS, TOP_UP_STEP, ATTRITION, CEILING = 5, 0.15, 1.6, 4.0


def top_up_fraction(candidates: DataFrame, key: Column, done: DataFrame, run, passed, target: int, fraction: float) -> tuple[DataFrame, float, int]:
    """Raise the sampled fraction until ``target`` rows pass: ``(passed rows, fraction, rounds)``.

    ``run(rows)`` generates for the sampled rows that ``done`` (their keys, as
    ``id``) lacks and returns the passed ones; ``passed`` are those so far. At
    most five rounds, 0.15 more each, up to the whole.
    """
    rounds = 0
    while passed.count() < target and rounds < TOP_UP_ROUNDS:
        if rounds:
            if fraction >= 1:
                break
            fraction = min(1.0, fraction + TOP_UP_STEP)
        rounds += 1
        fresh = hash_sample(candidates, key, fraction).join(done, "id", "left_anti")
        passed = passed.unionByName(run(fresh))
        done = done.unionByName(fresh.select("id")).distinct()
    return passed, fraction, rounds


def top_up_seeds(generate, count_passed, base: int, target: int) -> tuple[int, int]:
    """Ask for more seeds until ``target`` rows pass: ``(seeds asked for, rounds)``.

    Each round adds the gap times 1.6, rounded up, to at most four times the base; five rounds at most.
    """
    import math

    asked, rounds = base, 0
    while (gap := target - count_passed()) > 0 and rounds < TOP_UP_ROUNDS:
        more = min(math.ceil(gap * ATTRITION), int(base * CEILING) - asked)
        if more <= 0:
            break
        asked += more
        rounds += 1
        generate(more)
    return asked, rounds


def allocate(existing: DataFrame, by: str, more: int, categories: list[str], per_batch: int) -> DataFrame:
    """``by, category, n, n_batches``: ``more`` new rows a group, dealt round the categories from offset ``n`` (what exists) on; batches are of one category."""
    slots = existing.select(by, F.explode(F.sequence(F.lit(0), F.lit(more - 1))).alias("_k"), "n")
    cats = F.array(*[F.lit(c) for c in categories])
    dealt = slots.groupBy(by, F.get(cats, ((F.col("n") + F.col("_k")) % len(categories)).cast("int")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return dealt.withColumn("n_batches", F.ceil(F.col("n") / per_batch).cast("long"))


def proportional_cap(sizes: DataFrame, total: int) -> DataFrame:
    """Add ``take``: banker's rounded shares of ``total``; the residual of ±1 goes to the largest files first."""
    everything = Window.partitionBy()
    rounded = F.bround(F.col("n") / F.sum("n").over(everything) * total).cast("long")
    df = sizes.withColumn("_t", rounded).withColumn("_left", F.lit(total) - F.sum("_t").over(everything))
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), "file"))
    step = F.when(rank <= F.abs("_left"), F.signum("_left")).otherwise(0)
    return df.withColumn("take", (F.col("_t") + step).cast("long")).drop("_t", "_left")


def resolve_targets(absolute: dict[str, int], ratio: dict[str, float]) -> dict[str, int]:
    """Rows per stream from absolute and relative targets: ``T = sum(absolute) / (1 - sum(ratio))``."""
    import math

    if set(absolute) & set(ratio):
        raise ValueError("a stream has both an absolute and a relative target")
    if any(v < 0 for v in absolute.values()) or any(not 0 <= r < 1 for r in ratio.values()):
        raise ValueError("targets must be non-negative and ratios below 1")
    if sum(ratio.values()) >= 1:
        raise ValueError("the ratios leave nothing for absolute targets")
    if ratio and not sum(absolute.values()):
        raise ValueError("relative targets need an absolute one")
    total = sum(absolute.values()) / (1 - sum(ratio.values()))
    return {**absolute, **{s: max(1, math.ceil(r * total - 1e-9)) for s, r in ratio.items()}}
