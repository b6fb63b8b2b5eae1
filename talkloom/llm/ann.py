"""Nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes smallest distance: vectors are extended by one
coordinate so that all have the norm of the longest; queries are scaled to that
norm and extended by 0. Each table hashes a vector to a bucket of ``K`` cells,
``floor((a . x + b) / w)`` with Gaussian ``a``. A query visits its own bucket
and perturbed ones in the order of their estimated chance to hold a neighbour,
until the chances sum to the target, and the candidates of all tables are
merged and ranked again by the exact inner product of the original vectors.

The cells' width follows from a calibrated neighbour distance. Queries whose
list came out short, or reaches far beyond that distance, go another round,
calibrated on them alone; what is left after the rounds, or is few enough for
one block, is compared with every row in blocks.

Equal vectors are folded first: a group keeps its ``top + 1`` smallest ids,
which is all that ties ask for, so copies never fill a bucket. Buckets and
their visitors are cut into blocks of bounded size by salted keys; a block pair
is one matrix product in a task and gives ``top + 1`` rows a query at most.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import product as every_one

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkloom.session import materialise

#: Production parameters: tables, hash functions of a table, cells' width in neighbour distances.
TABLES = 2
K = 5
WIDTH = 2.2
#: Estimated chance that a neighbour at the calibrated distance is in a visited bucket of some table.
TARGET = 0.985
TOP = 20
#: Rows of a block of a bucket, and visitors of a block.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048
#: Calibration: so many query vectors are compared with every row.
CALIBRATION_QUERIES = 64
#: Rounds of hashing; a list that reaches beyond so many calibrated distances goes another round.
ROUNDS, BEYOND = 3, 1.5
#: Combinations of cells considered a query and table, at most.
COMBINATIONS = 4096
SEED = 11

_erf = np.frompyfunc(math.erf, 1, 1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, a, b`` (a 128-bit fingerprint) ``, dim, norm, v`` (array of double), without null ids or vectors, null or non-finite components, and zero vectors; 0.0 and -0.0 are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy().astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            ends = np.cumsum(size)
            upto = lambda x: np.concatenate([[0], np.cumsum(x)])
            within = lambda x: (s := upto(x))[ends] - s[ends - size]
            good = (size > 0) & (within(~np.isfinite(flat)) == 0) & (within(flat != 0) > 0)
            rows = np.flatnonzero(good)
            if not len(rows):
                continue
            v = [flat[ends[i] - size[i] : ends[i]] for i in rows]
            prints = np.frombuffer(b"".join(hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in v), "<i8").reshape(-1, 2)
            bounds = np.concatenate([[0], np.cumsum(size[rows])]).astype(np.int32)
            columns = [batch.column(0).take(pa.array(rows)), *(pa.array(prints[:, k].copy()) for k in (0, 1)), pa.array(size[rows].astype(np.int32)), pa.array([float(np.linalg.norm(x)) for x in v]), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(v)))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "a", "b", "dim", "norm", "v"])

    plain = vectors.schema[vector_col].dataType.simpleString() in ("array<float>", "array<double>")
    v = F.col(f"`{vector_col}`") if plain else F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, a bigint, b bigint, dim int, norm double, v array<double>")


def fold_equal(rows: DataFrame, keep: int) -> DataFrame:
    """``a, b, dim, norm, rep, v, ids``: distinct vectors with their ``keep`` smallest ids; rows that repeat an id and vector count once.

    The rank is cut per task before the shuffle (a group limit of the window),
    so a group of copies is never gathered.
    """
    once = rows.dropDuplicates(["a", "b", "id"])
    few = once.withColumn("_n", F.row_number().over(Window.partitionBy("a", "b").orderBy("id"))).where(F.col("_n") <= keep)
    return few.groupBy("a", "b").agg(F.first("dim").alias("dim"), F.first("norm").alias("norm"), F.min("id").alias("rep"), F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Hashing:
    """The tables' projections, fixed by the seed, for extended vectors of a dimension."""

    def __init__(self, dim: int, norm: float, distance: float, tables: int = TABLES, k: int = K, width: float = WIDTH, target: float = TARGET, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.norm, self.distance, self.tables, self.k = norm, max(distance, 1e-9 * norm), tables, k
        self.a = rng.standard_normal((tables, k, dim + 1))
        self.w = width * self.distance
        self.b = rng.uniform(0, self.w, (tables, k))
        self.per_table = 1 - (1 - target) ** (1 / tables)

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        """``(a . x + b) / w`` of the extended vectors: rows, tables, functions."""
        if query:
            full = np.hstack([x * (self.norm / np.linalg.norm(x, axis=1, keepdims=True)), np.zeros((len(x), 1))])
        else:
            full = np.hstack([x, np.sqrt(np.maximum(self.norm**2 - (x**2).sum(1, keepdims=True), 0))])
        return (np.einsum("nd,tkd->ntk", full, self.a) + self.b) / self.w

    def codes(self, table: int, cells: np.ndarray) -> np.ndarray:
        """One long per row of cells."""
        out = np.full(len(cells), table + 1, np.int64)
        for j in range(self.k):
            out = out * 1_000_003 + cells[:, j].astype(np.int64)
        return out

    def probes(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells that queries at ``f`` (one table) visit, likeliest first, until their chances sum to the target: how many each, and all in a row.

        Only the offsets within the queries' own cells decide the order. The
        likeliest few cells of every function are combined.
        """
        few = max(2, min(7, int(COMBINATIONS ** (1 / self.k))))
        combos = np.array(list(every_one(range(few), repeat=self.k)))
        steps = np.arange(-3, 5)
        counts, cells = [], []
        for start in range(0, len(f), 128):
            part = f[start : start + 128]
            own = np.floor(part)
            below = 0.5 * (1 + _erf((steps - (part - own)[:, :, None]) / (math.sqrt(2) * self.distance / self.w)).astype(np.float64))
            chance = np.diff(below, axis=2)  # of the cells from 3 below to 3 above
            order = np.argsort(-chance, axis=2, kind="stable")[:, :, :few]
            logs = np.log(np.maximum(np.take_along_axis(chance, order, 2), 1e-300))
            at = (own[:, :, None] + steps[order]).astype(np.int64)
            total = sum(logs[:, j, combos[:, j]] for j in range(self.k))
            rank = np.argsort(-total, axis=1, kind="stable")
            likely = np.exp(np.take_along_axis(total, rank, 1))
            visited = np.cumsum(likely, axis=1) - likely < self.per_table
            row, place = np.nonzero(visited & (likely > 1e-12))
            chosen = combos[rank[row, place]]
            counts.append(np.bincount(row, minlength=len(part)))
            cells.append(at[row[:, None], np.arange(self.k), chosen])
        return np.concatenate(counts), np.concatenate(cells)


def best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, inner product) of each query's ``top`` largest, ties to the smaller id."""
    out = []
    longest = np.linalg.norm(x, axis=1).max()
    for start in range(0, len(q), 32):
        some = q[start : start + 32]
        s = some @ x.T
        if x.shape[0] > top:
            floor = np.partition(s, -top, axis=1)[:, -top]
            i, j = np.nonzero(s >= (floor - 1e-12 * np.linalg.norm(some, axis=1) * longest)[:, None])
        else:
            i, j = np.divmod(np.arange(s.size), x.shape[0])
        # summed anew, in one order for every pair, so that equal vectors score alike
        exact = (some[i] * x[j]).sum(axis=1)
        order = np.lexsort((ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        out.append((start + i[rank < top], j[rank < top], exact[rank < top]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def calibrate(reps: DataFrame, queries: DataFrame, top: int, norm: float) -> float:
    """The 0.9 quantile of the distances to the ``top``-th neighbour.

    A bounded sample of queries (those of smallest id hash) is compared with
    all rows; a task returns ``top`` numbers per sampled query.
    """
    sample = np.array([r.v for r in queries.orderBy(F.xxhash64("rep"), "rep").limit(CALIBRATION_QUERIES).select("v").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.full((len(sample), top + 1), -np.inf)
        for batch in batches:
            x = _vectors(batch.column(0))
            if len(x):
                held = -np.sort(-np.hstack([held, sample @ x.T]), axis=1)[:, : top + 1]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sample))), pa.array(list(held), pa.list_(pa.float64()))], ["q", "s"])

    rows = reps.select("v").mapInArrow(run, "q bigint, s array<double>").select("q", F.explode("s").alias("s")).where(F.col("s") > float("-inf"))
    near = rows.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))).where(F.col("_n") <= top + 1)
    lows = near.groupBy("q").agg(F.min("s").alias("s")).collect()
    scaled = [np.sqrt(max(0.0, 2 * norm**2 - 2 * r.s * norm / np.linalg.norm(sample[r.q]))) for r in lows]
    return float(np.quantile(scaled, 0.9)) if scaled else norm


def _hashed(h: Hashing, rows: DataFrame, query: bool) -> DataFrame:
    """``buckets`` (array: those of a row, or those a query visits) ``, rep, v``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            f, n = h.project(_vectors(batch.column(1)), query), batch.num_rows
            counts, rows, codes = np.zeros(n, np.int64), [], []
            for t in range(h.tables):
                each, cells = h.probes(f[:, t]) if query else (np.ones(n, np.int64), np.floor(f[:, t]))
                counts += each
                rows.append(np.repeat(np.arange(n), each)), codes.append(h.codes(t, cells))
            order = np.argsort(np.concatenate(rows), kind="stable")
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(np.concatenate(codes)[order]))
            yield pa.RecordBatch.from_arrays([lists, batch.column(0), batch.column(1)], ["buckets", "rep", "v"])

    kind = rows.schema["rep"].dataType.simpleString()
    return rows.select("rep", "v").mapInArrow(run, f"buckets array<bigint>, rep {kind}, v array<double>")


def _compared(index: DataFrame, probes: DataFrame, top: int) -> DataFrame:
    """``q, rep, score``: per query its ``top`` best of the rows it shares a bucket with; a pair once for each such bucket."""
    kind = index.schema["rep"].dataType.simpleString()
    sizes = lambda df, size, name: df.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    cut = materialise(sizes(index, BLOCK_ROWS, "ni").join(sizes(probes, BLOCK_QUERIES, "nq"), "bucket"), "blocks")
    salt = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spread = lambda df: df.select(F.explode("buckets").alias("bucket"), "rep", "v").join(cut, "bucket")
    left = spread(index).select("bucket", salt("ni").alias("i"), every("nq").alias("q"), "rep", "v")
    right = spread(probes).select("bucket", every("ni").alias("i"), salt("nq").alias("q"), "rep", "v")

    def product(key, x: pa.Table, q: pa.Table) -> pa.Table:
        names = ["q", "rep", "score"]
        if not x.num_rows or not q.num_rows:
            return pa.table([pa.array([], x.schema.field("rep").type), pa.array([], x.schema.field("rep").type), pa.array([], pa.float64())], names)
        x, q = x.combine_chunks(), q.combine_chunks()
        vx, vq = (_vectors(t.column("v").combine_chunks()) for t in (x, q))
        i, j, s = best(vq, vx, x.column("rep").to_numpy(), top)
        return pa.table([q.column("rep").take(pa.array(i)), x.column("rep").take(pa.array(j)), pa.array(s)], names)

    found = left.groupBy("bucket", "i", "q").cogroup(right.groupBy("bucket", "i", "q")).applyInArrow(product, f"q {kind}, rep {kind}, score double")
    # the group limit of the window cuts each task's rows before the shuffle
    near = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    return found.withColumn("_n", F.dense_rank().over(near)).where(F.col("_n") <= top).drop("_n")


def _lists(found: DataFrame, reps: DataFrame, top: int) -> DataFrame:
    """``q, found`` (array of (-score, id), best first, ``top`` at most) of distinct candidates."""
    listed = found.distinct().join(reps.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("c"))
    full = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    listed = listed.withColumn("_n", F.row_number().over(full)).where(F.col("_n") <= top)
    return listed.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "c"))).alias("found"))


def _search(reps: DataFrame, visitors: DataFrame, top: int, dim: int, norm: float, candidates: int, **options) -> list[DataFrame]:
    """Lists (``q, found``) of all visitors among ``reps``, both of one length, in parts."""
    done, rest, need = [], visitors, min(top, candidates)
    for turn in range(ROUNDS + 1):
        left = rest.count()
        if not left:
            break
        if turn == ROUNDS or (turn and left <= BLOCK_QUERIES):
            whole = lambda df: df.select(F.array(F.lit(0).cast("long")).alias("buckets"), "rep", "v")
            done.append(_lists(_compared(whole(reps), whole(rest), top), reps, top))
            break
        distance = calibrate(reps, rest, top, norm)
        h = Hashing(dim, norm, distance, **options)
        index = materialise(_hashed(h, reps, False), "index")
        # the few visitors may lie in one file: their probes are found by many tasks
        tasks = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        probes = materialise(_hashed(h, rest.repartition(tasks, "rep"), True), "probes")
        lists = materialise(_lists(_compared(index, probes, top), reps, top), "lists")
        far = F.sqrt(F.greatest(F.lit(0.0), 2 * norm**2 + 2 * norm * F.element_at("found", -1)["s"] / F.col("norm")))
        fine = (F.size("found") >= need) & (far <= BEYOND * h.distance)
        settled = lists.join(rest.select(F.col("rep").alias("q"), "norm"), "q").where(fine).select("q", "found")
        done.append(settled)
        rest = materialise(rest.join(settled.select(F.col("q").alias("rep")), "rep", "left_anti"), "visitors")
    return done


def nearest(vectors: DataFrame, queries: DataFrame, top: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """``query_id, rank, <id_col>, score``: each query row's ``top`` largest inner products among the other rows.

    Ranks follow the score, ties the smaller id. Vectors that are null, zero,
    or hold null or non-finite components take no part. Each length of vectors
    is searched by itself: there is no inner product between lengths. Rows that
    repeat an id and vector count as one candidate; a query id with several
    vectors asks with the least of them. Empty tables give an empty result.
    """
    rows = usable(vectors, id_col, vector_col)
    asked = materialise(usable(queries, id_col, vector_col).groupBy("id").agg(F.min(F.struct("v", "a", "b", "dim", "norm")).alias("r")).select("id", "r.*"), "asked")
    kind = rows.schema["id"].dataType.simpleString()
    # one more than asked for, as a row may find itself
    reps = materialise(fold_equal(rows, top + 1).drop("a", "b"), "reps")
    visitors = materialise(fold_equal(asked, 1).drop("ids"), "visitors")
    lists: list[DataFrame] = []
    for dim, norm, candidates in sorted(tuple(r) for r in reps.groupBy("dim").agg(F.max("norm"), F.sum(F.size("ids"))).collect()):
        some = reps.where(F.col("dim") == dim).select("rep", "v", "ids")
        lists += _search(some, visitors.where(F.col("dim") == dim), top + 1, dim, norm, candidates, **options)
    if not lists:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score double")
    found = lists[0]
    for more in lists[1:]:
        found = found.unionByName(more)
    # every asking row takes its vector's list, less itself
    keys = asked.select("id", "a", "b").join(visitors.select(F.col("rep").alias("q"), "a", "b"), ["a", "b"]).select("id", "q")
    own = keys.join(found, "q").select("id", F.slice(F.filter("found", lambda x: x["c"] != F.col("id")), 1, top).alias("found"))
    return own.select(F.col("id").alias("query_id"), F.posexplode("found").alias("p", "r")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("r.c").alias(id_col), (-F.col("r.s")).alias("score"))
