"""Token sequences in training order, as fixed-stride binary shards.

Documents, each with an end id, follow one another in the order of a hash of
their id and tokens; this stream is cut into sequences of one length. How many
there are is counted first. A keyed Feistel permutation of exactly these
numbers, with cycle-walking where its domain of powers of two is larger, is a
sequence's global slot. A shard is a range of slots, written as records of one
stride, so a slot's file and byte follow from two divisions. Nothing of this
depends on how the table was split into tasks: the same rows give the same
bytes.

The texts are tokenised once, into files in the shared folder. The running
offset of each document comes from a narrow table of hashes and lengths: totals
of 65,536 hash buckets, then sums within a bucket; copies of a document are one
row a file there, so a group of copies is never gathered. A task then reads one
file of tokens, cuts it at the sequences' bounds, and sends what belongs to a
shard together. A task writes one shard under a name of its own attempt and
renames it, so tasks that run again replace whole files.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkloom.llm._arrow import binary_array, store, text_steps
from talkloom.llm._words import mix
from talkloom.llm.packing import END_ID, SEQUENCE_TOKENS, tokenizer
from talkloom.session import discard, materialise, scratch, shared_dir

#: Production parameters: sequences of a shard, at least and at most (a quarter of a gigabyte), and shards aimed at between.
SHARD_LEAST, SHARD_MOST, SHARDS = 256, 65_536, 128
KEY = 0x5EED
ROUNDS = 4
#: Hash buckets that the running offsets are summed in, and bytes of tokens that a task cuts at a time.
BUCKETS = 65_536
CUT_BYTES = 32 << 20
#: Compression of the tokens while they are at rest and while they are sent.
REST_LEVEL, SENT_LEVEL = 3, 3
#: Bytes of tokens that are compressed together while at rest.
FLUSH_BYTES = 16 << 20

_U = np.uint64


@dataclass(frozen=True)
class Feistel:
    """A keyed permutation of 0 .. size-1."""

    size: int
    key: int = KEY

    def _once(self, x: np.ndarray) -> np.ndarray:
        half = _U((max(2, (self.size - 1).bit_length()) + 1) // 2)
        mask = _U((1 << int(half)) - 1)
        left, right = x >> half, x & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (mix(right + _U((self.key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % 2**64)) & mask)
        return (left << half) | right

    def __call__(self, index: np.ndarray) -> np.ndarray:
        out = self._once(np.asarray(index).astype(_U))
        while len(outside := np.flatnonzero(out >= _U(self.size))):  # walk the cycle back into the domain
            out[outside] = self._once(out[outside])
        return out.astype(np.int64)


def shard_size(sequences: int) -> int:
    """Sequences of a shard: a power of two that follows from their number alone."""
    return min(SHARD_MOST, max(SHARD_LEAST, 1 << max(0, (sequences // SHARDS).bit_length())))


def _tokens(docs: DataFrame, path: str, folder: str, id_col: str, text_col: str, end_id: int, dtype: str) -> DataFrame:
    """``file, a, b, n, size``: per file of tokens and fingerprint (of id and ids) the length of one such row and of all.

    A task writes its rows' ``id, n, ids`` (``dtype`` numbers, the end id last) ``, a, b`` to a file of its own number in
    the folder, under a name of its attempt first; a task that runs again writes the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        import xxhash

        tok, end, number = tokenizer(path, np.dtype(dtype).itemsize), np.array([end_id], dtype).tobytes(), TaskContext.get().partitionId()
        files, root = store(folder)
        files.create_dir(root, recursive=True)
        name, writer, held, size = f"{root}/.{number:08d}-{uuid.uuid4().hex}", None, [], 0

        def flush() -> None:
            nonlocal writer, held, size
            rows = pa.Table.from_batches(held)
            if writer is None:
                writer = pq.ParquetWriter(files.open_output_stream(name), rows.schema, compression="zstd", compression_level=REST_LEVEL, use_dictionary=False, write_statistics=False, data_page_size=4 << 20)
            writer.write_table(rows)
            held, size = [], 0

        for batch in batches:
            for part, texts in text_steps(batch):
                ids = [x + end for x in tok.encode(texts)]
                n = pa.array([len(x) // len(end) for x in ids], pa.int64())
                prints = b"".join([xxhash.xxh3_128_digest(x, seed=xxhash.xxh3_64_intdigest(repr(i))) for i, x in zip(part.column(0).to_pylist(), ids, strict=True)])
                a, b = (pa.array(x.copy()) for x in np.frombuffer(prints, "<i8").reshape(-1, 2).T)
                held.append(pa.RecordBatch.from_arrays([part.column(0), n, binary_array(ids), a, b], ["id", "n", "ids", "a", "b"]))
                size += held[-1].nbytes
                if size >= FLUSH_BYTES:
                    flush()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), number, np.int32)), a, b, n], ["file", "a", "b", "n"])
        if held:
            flush()
        if writer is not None:
            writer.close()
            _replace(files, name, f"{root}/{number:08d}")

    chosen = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = chosen.mapInArrow(run, "file int, a bigint, b bigint, n bigint")
    return materialise(rows.groupBy("file", "a", "b").agg(F.max("n").alias("n"), F.sum("n").alias("size")), "offsets")


def _replace(files, name: str, done: str) -> None:
    """Give a finished file its name, in place of one that an earlier attempt wrote; some stores don't move onto a file."""
    if files.get_file_info(done).is_file:
        files.delete_file(done)
    files.move(name, done)


def _offsets(each: DataFrame) -> DataFrame:
    """``file, a, b, start``: where in the stream the rows of a file with this fingerprint begin, one after the other."""
    each = each.withColumn("bucket", F.pmod("a", F.lit(BUCKETS)))
    totals = each.groupBy("bucket").agg(F.sum("size").alias("size"))
    # at most BUCKETS rows, whatever the input
    base = totals.select("bucket", (F.sum("size").over(Window.orderBy("bucket")) - F.col("size")).alias("base"))
    within = Window.partitionBy("bucket").orderBy("a", "b", "n", "file")
    summed = each.withColumn("start", F.sum("size").over(within) - F.col("size"))
    return summed.join(base, "bucket").select("file", "a", "b", (F.col("base") + F.col("start")).alias("start"))


def write_shards(docs: DataFrame, path: str, directory: str | None = None, id_col: str = "doc_id", text_col: str = "text", stride: int = SEQUENCE_TOKENS, shard_sequences: int | None = None, key: int = KEY, end_id: int = END_ID, dtype: str | None = None) -> tuple[DataFrame, str]:
    """Write the shards and return the manifest and the folder.

    The manifest has a row per (document, sequence) span: ``id_col, start,
    length`` (which of the document's ids), ``ids_crc32`` (of these as
    little-endian unsigned 32-bit numbers), ``slot, shard, record`` (the place
    in the shard), ``offset`` (the token's place in the record). Records are
    ``stride`` numbers of ``dtype``, of 16 or 32 bits, by default the narrower
    that holds the vocabulary (one that doesn't raises ValueError); the last
    sequence of the stream is padded with ``end_id``.

    Null and empty texts are the end id alone. Repeated ids are documents of
    their own, each of repeated rows too. An empty table gives an empty
    manifest and no shard. A writing task holds one shard, SHARD_MOST
    sequences at most.
    """
    spark = docs.sparkSession
    size = max(tokenizer(path).vocabulary_size(), end_id + 1)
    dtype = dtype or ("<u2" if size <= 1 << 16 else "<u4")
    if dtype not in ("<u2", "<u4") or size > 1 << 8 * np.dtype(dtype).itemsize:
        raise ValueError(f"{size} ids don't fit into {dtype}")
    directory = directory or f"{shared_dir(spark)}/talkloom/shards-{uuid.uuid4().hex}"
    item = np.dtype(dtype).itemsize
    folder = scratch(spark, "tokens")
    tokens = _tokens(docs, path, folder, id_col, text_col, end_id, dtype)
    id_type = docs.schema[id_col].dataType.simpleString()
    total = tokens.agg(F.sum("size")).first()[0] or 0
    n = -(-total // stride)
    width = shard_sequences or shard_size(n)
    names = ["id", "start", "length", "ids_crc32", "record", "offset"]
    kinds = [id_type, "bigint", "int", "bigint", "int", "int"]
    flat = f"{', '.join(f'{c} {k}' for c, k in zip(names, kinds, strict=True))}, shard int"
    if not n:
        return _manifest(spark.createDataFrame([], flat), id_col, width), directory
    order = Feistel(n, key)
    short = int(order(np.array([n - 1]))[0]) // width  # the shard of the last sequence, which is padded

    def cut(key: tuple, starts: pa.Table) -> Iterator[pa.RecordBatch]:
        """One file's tokens, cut at the sequences' bounds and put together by shard."""
        import pyarrow.parquet as pq
        a, b, start = (starts.column(c).to_pylist() for c in ("a", "b", "start"))
        at = {(x, y): z for x, y, z in zip(a, b, start, strict=True)}
        files, root = store(folder)
        with files.open_input_file(f"{root}/{key[0].as_py():08d}") as source:
            held, size = [], 0
            for batch in pq.ParquetFile(source).iter_batches(batch_size=256, columns=["id", "n", "ids", "a", "b"]):
                held.append(batch)
                size += batch.column("ids").nbytes
                if size >= CUT_BYTES:
                    yield from sent(pa.Table.from_batches(held), at)
                    held, size = [], 0
            if held:
                yield from sent(pa.Table.from_batches(held), at)

    def sent(rows: pa.Table, at: dict) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=SENT_LEVEL).compress
        begin = []
        for k, n in zip(zip(rows.column("a").to_pylist(), rows.column("b").to_pylist(), strict=True), rows.column("n").to_pylist(), strict=True):
            begin.append(at[k])
            at[k] += n
        begin, n = np.array(begin, np.int64), rows.column("n").to_numpy()
        first, last = begin // stride, (begin + n - 1) // stride
        row = np.repeat(np.arange(len(n)), last - first + 1)
        sequence = first[row] + np.arange(len(row)) - np.searchsorted(row, row)
        low = np.maximum(sequence * stride, begin[row])
        length = np.minimum((sequence + 1) * stride, begin[row] + n[row]) - low
        start, offset, slot = low - begin[row], low - sequence * stride, order(sequence)
        shard, record = slot // width, slot % width
        by_shard = np.lexsort((offset, record, shard))
        payload = b"".join(rows.column("ids").to_pylist())
        at_token = np.cumsum(n)[row] - n[row] + start
        ends = (at_token + length)[by_shard].tolist()
        at_token = at_token[by_shard].tolist()
        parts = [payload[item * i : item * j] for i, j in zip(at_token, ends, strict=True)]
        wide = memoryview(np.frombuffer(payload, dtype).astype("<u4").tobytes())
        crcs = np.array([zlib.crc32(wide[4 * i : 4 * j]) for i, j in zip(at_token, ends, strict=True)], np.int64)
        shards, where = np.unique(shard[by_shard], return_index=True)
        where = np.append(where, len(by_shard))
        blocks = binary_array([squeeze(b"".join(parts[i:j])) for i, j in zip(where[:-1], where[1:], strict=True)])
        bounds = pa.array(where.astype(np.int32))
        ids = rows.column("id").combine_chunks().take(pa.array(row[by_shard]))
        narrow = lambda v: pa.array(v[by_shard].astype(np.int32))
        values = [ids, pa.array(start[by_shard]), narrow(length), pa.array(crcs), narrow(record), narrow(offset)]
        yield pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int32)), blocks, *(pa.ListArray.from_arrays(bounds, v) for v in values)], ["shard", "payload", *names])

    lists = ", ".join(f"{c} array<{k}>" for c, k in zip(names, kinds, strict=True))
    made = _offsets(tokens).groupBy("file").applyInArrow(lambda key, group: pa.Table.from_batches(cut(key, group)), f"shard int, payload binary, {lists}")
    # a range of slots to a task
    dealt = made.repartitionById(-(-n // width), "shard")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        expand = zstandard.ZstdDecompressor().decompress
        files, root = store(directory)
        files.create_dir(root, recursive=True)
        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
        current, filled, buffer = None, 0, None

        def finish() -> None:
            if current is None:
                return
            if filled != len(buffer) - (n * stride - total if current == short else 0):
                raise ValueError(f"shard {current} holds {filled} tokens")
            with files.open_output_stream(f"{root}/.{current:08d}-{attempt}") as file:
                file.write(buffer.tobytes())
            _replace(files, f"{root}/.{current:08d}-{attempt}", f"{root}/{current:08d}.bin")

        for batch in batches:
            columns = [batch.column(2 + k).flatten() for k in range(len(names))]
            counts = pa.compute.list_value_length(batch.column(2)).to_numpy()
            places = columns[4].to_numpy().astype(np.int64) * stride + columns[5].to_numpy()
            spans, k = list(zip(places.tolist(), columns[2].to_pylist(), strict=True)), 0
            for i, (shard, m) in enumerate(zip(batch.column(0).to_pylist(), counts.tolist(), strict=True)):
                if shard != current:
                    finish()
                    current, filled = shard, 0
                    buffer = np.full(min(width, n - shard * width) * stride, end_id, dtype)
                tokens, at = np.frombuffer(expand(batch.column(1)[i].as_py()), dtype), 0
                for place, length in spans[k : k + m]:
                    buffer[place : place + length] = tokens[at : at + length]
                    at += length
                filled, k = filled + at, k + m
            shards = np.repeat(batch.column(0).to_numpy(), counts)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(shards, pa.int32())], [*names, "shard"])
        finish()

    written = materialise(dealt.mapInArrow(write, flat), "manifest")
    discard(spark, folder)
    _write_index(directory, {"stride": stride, "dtype": dtype, "n_sequences": n, "shard_sequences": width})
    return _manifest(written, id_col, width), directory


def _manifest(spans: DataFrame, id_col: str, width: int) -> DataFrame:
    slot = (F.col("shard") * F.lit(width).cast("long") + F.col("record")).alias("slot")
    wide = [F.col(c).cast("long").alias(c) for c in ("start", "length", "ids_crc32")]
    return spans.select(F.col("id").alias(id_col), *wide, slot, "shard", F.col("record").cast("long").alias("record"), F.col("offset").cast("long").alias("offset"))


def _write_index(directory: str, index: dict) -> None:
    files, root = store(directory)
    with files.open_output_stream(f"{root}/index.json") as file:
        file.write(json.dumps(index).encode())


def read_slots(directory: str, start: int = 0, stop: int | None = None) -> Iterator[np.ndarray]:
    """The records of slots ``start`` to ``stop``, in order; a reader resumes at any slot with one seek."""
    files, root = store(directory)
    with files.open_input_stream(f"{root}/index.json") as file:
        index = json.loads(file.read())
    size, width = index["stride"] * np.dtype(index["dtype"]).itemsize, index["shard_sequences"]
    stop = index["n_sequences"] if stop is None else min(stop, index["n_sequences"])
    while start < stop:
        shard, record = divmod(start, width)
        with files.open_input_file(f"{root}/{shard:08d}.bin") as file:
            file.seek(record * size)
            for _ in range(min(stop, (shard + 1) * width) - start):
                yield np.frombuffer(file.read(size), index["dtype"])
        start = min(stop, (shard + 1) * width)
