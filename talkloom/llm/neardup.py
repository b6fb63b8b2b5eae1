"""Near-duplicate groups by a chosen-path set similarity join.

Documents are sets of word shingles. Equal sets are first folded into their
smallest id. A document's minwise signature then walks independent random
trees: at a node some coordinates of the signature are chosen by the node
itself, 1 / threshold of them on average, and the document goes to the child
named by the coordinate and its minwise token there. Pairs of the threshold's
similarity meet in a leaf of each tree with a fair chance, and the number of
trees brings the chance of meeting nowhere below ``MISS``.

Nodes with more than ``WIDE`` documents branch on, unless they kept most of
their parent's documents: what a few more levels don't part is alike. As a
pair at the threshold shares one child a node on average, and so dies out with
depth, each of these nodes branches several times: as often as keeps the
chance below ``MISS`` at the deepest level (:func:`plan`). Small
and final nodes are compared exhaustively: every member with the node's smallest id first, then, after
these links are known, the members they leave apart with all members of the
node. Pairs already connected need no look: they cannot change a component.
The second comparison runs in blocks of bounded size, so no group is gathered
in a task, and no pair that isn't a link becomes a row. Every link is
confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm._arrow import text_steps
from talkloom.llm._words import mix, sets, words
from talkloom.llm.components import components
from talkloom.session import materialise

#: Production parameters.
SHINGLE_WORDS = 5
THRESHOLD = 0.8
SIGNATURE = 64
#: Trees at least, and the chance, at most, that a pair at the threshold meets in no final node.
TREES = 14
MISS = 1e-5
#: Levels a round of branching goes down, rounds at most, and documents of a node compared exhaustively.
LEVELS = 3
ROUNDS = 5
WIDE = 4096
#: A node that kept this share of what documents just at the threshold would keep is final.
DENSE = 0.8
#: Members of a block when nodes are compared exhaustively.
BLOCK = 256

_U = np.uint64
_A = mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64) * _U(0xA0761D6478BD642F)) | _U(1)
_B = mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64) * _U(0xE7037ED1A0B428DB))


def signature(values: np.ndarray) -> np.ndarray:
    """The minwise tokens (32 bits each) of a set of 64-bit hashes."""
    best = np.full(SIGNATURE, np.iinfo(np.uint64).max, _U)
    for i in range(0, len(values), 512):
        block = values[i : i + 512, None] * _A
        block += _B
        np.minimum(best, block.min(axis=0), out=best)
    return (best >> _U(32)).astype("<u4")


def signatures(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, fa, fb, sig`` per row: set size, 128-bit set fingerprint, signature; nulls for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in text_steps(batch):
                found = sets(words(part.column(1)), size)
                prints = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8") if len(s) else (None, None) for s in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([None if p[0] is None else int(p[0]) for p in prints], pa.int64()), pa.array([None if p[1] is None else int(p[1]) for p in prints], pa.int64()), pa.array([signature(s).tobytes() if len(s) else None for s in found], pa.binary())],
                    ["id", "n_shingles", "fa", "fb", "sig"],
                )

    chosen = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return chosen.mapInArrow(run, f"id {chosen.schema[0].dataType.simpleString()}, n_shingles bigint, fa bigint, fb bigint, sig binary")


def full_sets(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, elements``: the sorted shingle hashes of each row, as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in text_steps(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.astype("<u8").tobytes() for s in sets(words(part.column(1)), size)], pa.binary())], ["id", "elements"])

    chosen = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return chosen.mapInArrow(run, f"id {chosen.schema[0].dataType.simpleString()}, elements binary")


def missed(threshold: float, trees: int, repeats: int, rounds: int) -> float:
    """The chance that two documents of the threshold's similarity share no node after the first round and ``rounds`` more.

    Exact, given the coordinates their signatures agree in: each shared node
    has one child or two of them, independently of other nodes.
    """
    extra, total = min(1.0, 1 / threshold - 1), 0.0
    for agree in range(SIGNATURE + 1):
        one = agree / SIGNATURE
        both = one * (agree - 1) / (SIGNATURE - 1)
        q = 0.0  # of a node: no shared node at the last level below it
        for left in range(rounds, -1, -1):
            for _ in range(LEVELS):
                q = (1 - extra) * (1 - one + one * q) + extra * (both * q * q + 2 * (one - both) * q + 1 - 2 * one + both)
            q **= repeats if left else 1
        total += comb(SIGNATURE, agree) * threshold**agree * (1 - threshold) ** (SIGNATURE - agree) * q**trees
    return total


def plan(threshold: float) -> tuple[int, int]:
    """Trees, and how often a node branches in rounds after the first, so that :func:`missed` is at most ``MISS`` at every depth."""
    trees = TREES
    while missed(threshold, trees, 1, 0) > MISS / 2:
        trees += 1
    repeats = 1
    while missed(threshold, trees, repeats, ROUNDS) > MISS:
        repeats += 1
    return trees, repeats


def _starts(nodes: np.ndarray, repeats: int) -> list[np.ndarray]:
    """The nodes under another name for each time they branch."""
    return [mix(nodes ^ salt) for salt in mix(np.arange(1, repeats + 1, dtype=np.uint64))]


def _descend(nodes: np.ndarray, sigs: np.ndarray, threshold: float, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Children, ``levels`` down, of rows (node, signature): their keys and the row each comes from."""
    row = np.arange(len(nodes))
    extra = _U(int(min(1.0, 1 / threshold - 1) * 2**32))
    for _ in range(levels):
        drawn = mix(nodes ^ _U(0x8EBC6AF09C88C6E3))
        first = (drawn % _U(SIGNATURE)).astype(np.int64)
        second = (first + 1 + (mix(drawn) % _U(SIGNATURE - 1)).astype(np.int64)) % SIGNATURE  # another one
        twice = (drawn >> _U(32)) < extra
        key = lambda pick, i: mix(mix(nodes[i] + pick.astype(_U) * _U(0x9E3779B97F4A7C15)) ^ sigs[row[i], pick].astype(_U))
        every, some = np.arange(len(nodes)), np.flatnonzero(twice)
        nodes, row = np.concatenate([key(first, every), key(second[some], some)]), np.concatenate([row, row[some]])
    return nodes, row


def _branch(rows: DataFrame, threshold: float, trees: int | None, repeats: int = 1) -> DataFrame:
    """``node, id, parent_n`` of the children of each row's node, which branches ``repeats`` times; with ``trees``, of their roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, SIGNATURE)
            ids = batch.column(0)
            starts = [mix(np.full(batch.num_rows, t + 1, _U)) for t in range(trees)] if trees else _starts(batch.column(2).to_numpy().view(np.uint64), repeats)
            parents = pa.array(np.full(batch.num_rows, 1 << 62)) if trees else batch.column(3)
            for nodes in starts:
                keys, row = _descend(nodes, sigs, threshold, LEVELS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), ids.take(pa.array(row)), parents.take(pa.array(row))], ["node", "id", "parent_n"])

    return rows.mapInArrow(run, f"node bigint, id {rows.schema[0].dataType.simpleString()}, parent_n bigint")


def tree_nodes(reps: DataFrame, threshold: float) -> DataFrame:
    """``node, id, pivot``: members of all final nodes of two documents or more, with the node's smallest id."""
    trees, repeats = plan(threshold)

    def shared(rows: DataFrame) -> DataFrame:
        # a document may reach a node twice; sizes only steer the branching
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("pivot"), F.max("id").alias("_most"), F.max("parent_n").alias("parent_n"))
        sizes = sizes.where("pivot < _most").drop("_most")
        final = (F.col("n") <= WIDE) | (F.col("n") >= F.col("parent_n") * (DENSE * threshold**LEVELS))
        return materialise(rows.drop("parent_n").join(sizes, "node").withColumn("final", final), "nodes")

    found, level = [], shared(_branch(reps.select("id", "sig"), threshold, trees))
    for _ in range(ROUNDS):
        found.append(level.where("final"))
        large = level.where("not final").select("node", "id", "n")
        if large.isEmpty():
            large = None
            break
        level = shared(_branch(large.join(reps, "id").select("id", "sig", "node", F.col("n").alias("parent_n")), threshold, None, repeats))
    if large is not None:
        found.append(level)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("node", "id", "pivot")


def confirmed(pairs: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    """The rows (a, b) whose full sets have ``intersection >= threshold * union``, exactly."""
    parts, whole = _ratio(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py(), "<u8") for v in (x, y))
                short, long = sorted((x, y), key=len)
                if not len(short) or whole * len(short) < parts * len(long):
                    keep.append(False)
                    continue
                at = np.searchsorted(long, short)
                both = int((long[np.minimum(at, len(long) - 1)] == short).sum())
                keep.append(whole * both >= parts * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    left = elements.select(F.col("id").alias("a"), F.col("elements").alias("x"))
    right = elements.select(F.col("id").alias("b"), F.col("elements").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, f"a {kind}, b {kind}")


def links(docs: DataFrame, reps: DataFrame, size: int, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``vertex, component`` of the representatives that are linked to another one."""
    members = materialise(tree_nodes(reps, threshold), "members")
    needed = members.select("id").distinct()
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    elements = materialise(full_sets(texts.join(needed, "id", "left_semi"), size, "id", "text"), "sets")
    star = materialise(members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "star")
    linked = materialise(confirmed(star, elements, threshold), "linked")
    known = components(linked)
    # what the first links leave apart within a node is compared member by member, in blocks
    of = members.select("pivot", "id").distinct().join(known.withColumnRenamed("vertex", "id"), "id", "left").withColumn("c", F.coalesce("component", "id"))
    of = of.join(known.select(F.col("vertex").alias("pivot"), F.col("component").alias("_p")), "pivot", "left").withColumn("p", F.coalesce("_p", "pivot"))
    of = materialise(of.select("pivot", "id", "c", "p"), "apart")
    more = materialise(rest_links(of, elements, threshold), "linked")
    if more.isEmpty():
        return known
    return components(linked.unionByName(more))


def _ratio(threshold: float) -> tuple[int, int]:
    """The threshold as a fraction; two decimals are taken at their word."""
    return (round(threshold * 100), 100) if abs(threshold * 100 - round(threshold * 100)) < 1e-9 else threshold.as_integer_ratio()


def intersections(x: list[np.ndarray], y: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all sets of ``x`` with all of ``y``, exactly, as products of incidence blocks."""
    flat_x, flat_y = np.concatenate(x), np.concatenate(y)
    row_x, row_y = (np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (x, y))
    both = np.intersect1d(flat_x, flat_y)
    out = np.zeros((len(x), len(y)), np.float64)
    if not len(both):
        return out

    def columns_of(flat: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        found = both[at] == flat
        order = np.argsort(at[found], kind="stable")
        return at[found][order], row[found][order]

    (cx, rx), (cy, ry) = columns_of(flat_x, row_x), columns_of(flat_y, row_y)
    for low in range(0, len(both), columns):
        high = min(low + columns, len(both))
        parts = []
        for c, r, n in ((cx, rx, len(x)), (cy, ry, len(y))):
            i, j = np.searchsorted(c, [low, high])
            m = np.zeros((n, high - low), np.float32)
            m[r[i:j], c[i:j] - low] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def rest_links(of: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between members of a pivot's nodes that lie in different components so far.

    ``of`` has ``pivot, id, c`` (the member's component) ``, p`` (the pivot's).
    Members outside the pivot's component are compared with all members, in
    blocks of bounded size; a block gives a spanning forest of its links.
    """
    parts, whole = _ratio(threshold)
    kind = of.schema["id"].dataType.simpleString()
    ceil = lambda n: F.ceil(n / BLOCK).cast("int")
    # two members are the pivot and a member compared already
    sizes = of.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c") != F.col("p")).alias("nu")).where("nu > 0 and n > 2")
    rows = of.join(sizes.select("pivot", ceil(F.col("n")).alias("ns"), ceil(F.col("nu")).alias("nq")), "pivot").join(elements, "id")
    salt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("c <> p").select("pivot", salt("nq").alias("u"), every("ns").alias("s"), "id", "c", "elements")
    # aliases, so that the two sides' columns can be told apart
    right = rows.select(F.col("pivot").alias("pivot"), every("nq").alias("u"), salt("ns").alias("s"), *[F.col(c).alias(c) for c in ("id", "c", "elements")])

    def compare(key, x, y):
        none = pa.table([pa.array([], x.schema.field("id").type)] * 2, ["a", "b"])
        if not x.num_rows or not y.num_rows:
            return none
        ids, comps, found = [], [], []
        for t in (x, y):
            ids.append(t.column("id").to_pylist()), comps.append(t.column("c").to_pylist())
            found.append([np.frombuffer(v, np.uint64) for v in t.column("elements").to_pylist()])
        both = intersections(*found)
        n, m = (np.array([len(v) for v in f], np.float64) for f in found)
        hits = np.argwhere(whole * both >= parts * (n[:, None] + m[None, :] - both))
        root: dict = {}

        def find(v):
            while (up := root.get(v, v)) != v:
                root[v] = root.get(up, up)
                v = up
            return v

        a, b = [], []
        for i, j in hits.tolist():
            p, q = find(comps[0][i]), find(comps[1][j])
            if p != q:
                root[max(p, q)] = min(p, q)
                a.append(min(ids[0][i], ids[1][j])), b.append(max(ids[0][i], ids[1][j]))
        return pa.table([pa.array(a, x.schema.field("id").type), pa.array(b, x.schema.field("id").type)], ["a", "b"])

    keys = ["pivot", "u", "s"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` per row.

    Two texts are linked if the Jaccard similarity of their sets of
    ``size``-word shingles (A-Z lower-cased; words are runs of other bytes
    than space and 9 to 13) is at least the threshold. ``component_id`` is the
    smallest id reachable over links, the row's own included; ``kept`` marks
    the rows whose id it is.

    Null, empty and blank texts have empty sets and are linked with nothing.
    Texts with fewer words than a shingle are one shingle. Rows that repeat an
    id and its text share a component; an id with several texts is one vertex
    to which the links of each of them count. Rows with a null id take no part
    and are kept, without a component. An empty table gives an empty
    result; other columns are not read.
    """
    base = materialise(signatures(docs, size, id_col, text_col), "sigs")
    sized = base.where("n_shingles > 0 and id is not null")
    folded = sized.groupBy("fa", "fb").agg(F.min(F.struct("id", "sig")).alias("r"), F.count(F.lit(1)).alias("n"))
    folded = materialise(folded.select("fa", "fb", F.col("r.id").alias("rep"), F.col("r.sig").alias("sig"), "n"), "reps")
    grouped = links(docs, folded.select(F.col("rep").alias("id"), "sig"), size, threshold, id_col, text_col)
    of_set = folded.join(grouped.withColumnRenamed("vertex", "rep"), "rep", "left").where((F.col("n") > 1) | F.col("component").isNotNull())
    of_set = of_set.select("fa", "fb", F.coalesce("component", "rep").alias("component_id"))
    out = base.select("id", "n_shingles", "fa", "fb").join(of_set, ["fa", "fb"], "left")
    out = out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _once(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row of those that share an id and a set of shingles; null is an id here, but its empty sets all stay."""
    repeated = docs.groupBy(F.col(f"`{id_col}`").alias("_repeated_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = materialise(repeated.select("_repeated_id"), "repeated")
    if repeated.isEmpty():
        return docs
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("_repeated_id"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    prints = signatures(docs.join(repeated, same, "left_semi").select(row, F.col(f"`{text_col}`").alias("_text")), size, "_row", "_text")
    prints = materialise(prints.select(F.col("id").alias("_row"), "fa", "fb"), "prints")
    alone = F.col("_row")[id_col].isNull() & F.col("fa").isNull()
    first = F.min_by("_row", F.coalesce(F.col("_row")[text_col], F.lit(""))).alias("_row")
    folded = prints.where(~alone).groupBy(F.col("_row")[id_col].alias("_id"), "fa", "fb").agg(first).select("_row")
    rows = folded.unionByName(prints.where(alone).select("_row")).select([F.col("_row")[c].alias(c) for c in docs.columns])
    return docs.join(repeated, same, "left_anti").unionByName(rows)


def keep_one(docs: DataFrame, size: int = SHINGLE_WORDS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, with their columns.

    That is one of each group: rows that repeat an id and its set of shingles
    stay once, and so do rows with a null id that share a set.
    """
    dropped = near_duplicates(docs, size, threshold, id_col, text_col).where(~F.col("kept")).select(id_col)
    return _once(docs, size, id_col, text_col).join(dropped.distinct(), id_col, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
