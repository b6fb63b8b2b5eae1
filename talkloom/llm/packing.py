"""Bounded-space best-fit packing of documents into token sequences.

A fixed number of bins is open at a time. They stand in a bitset keyed by free
space, so the tightest bin that fits is the lowest set bit at or above the
piece's length. When one bin too many is open, the fullest closes.

Tokenisation is a narrow pass that keeps no ids: only (document, piece, start,
length, checksum) rows are shuffled, and each packing task holds the open bins
and nothing else.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm._arrow import text_steps
from talkloom.llm._split import PATTERN, PUNCTUATION, Known, chunk_text, chunks, parts

#: Production parameters. Pieces of a window are placed from the longest on.
SEQUENCE_TOKENS = 2048
OPEN_BINS = 8192
WINDOW_PIECES = 16384
END_ID = 0

#: Megabytes of a generation of known chunks; a quarter as much for pieces.
KNOWN_MB = 80


class JsonTokenizer:
    """Ids of whole texts as ``tokenizers`` gives them, with known chunks and pieces, bounded in bytes.

    Texts are cut into chunks whose ids don't depend on their surroundings
    (:mod:`talkloom.llm._split`), texts with long runs of white space into
    pieces. Texts that hold a special token's string go through the library
    whole.
    """

    def __init__(self, path: str, width: int = 4):
        import regex
        from tokenizers import Tokenizer

        self.type = {2: "H", 4: "I"}[width]
        if sys.byteorder != "little" or array(self.type).itemsize != width:
            raise ValueError("ids are laid out as this machine's unsigned numbers, which must be little-endian")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kind = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True):
            raise ValueError("a byte-level tokenizer without normaliser and prefix space is needed")
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.tokenize = self.whole.model.tokenize
        self.find = regex.compile(PATTERN).findall
        # bytes that print stand for themselves, the others for the code points from 256 on, in order
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: 256 + i for i, b in enumerate(hidden)}
        self.space = chr(self.letters[32])
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.known, self.pieces = Known(KNOWN_MB, self._chunk), Known(KNOWN_MB // 4, self._piece)

    def vocabulary_size(self) -> int:
        return self.whole.get_vocab_size()

    def _shown(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(self.letters)

    def _piece(self, piece: str) -> bytes:
        ids = array(self.type, [t.id for t in self.tokenize(self._shown(piece))]).tobytes()
        self.pieces.keep(piece, ids)
        return ids

    def _ids(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, pieces))

    def _chunk(self, name: str) -> bytes:
        """Ids of a chunk by its name: of a word and the punctuation behind it, or piece by piece."""
        word = name.rstrip(PUNCTUATION)
        if word.isalpha():
            bare = len(word) == len(name)
            if bare or (ids := self.known.get(word)) is None:
                ids = array(self.type, [t.id for t in self.tokenize(self.space + self._shown(word))]).tobytes()
            if not bare:
                ids += self.pieces[name[len(word) :]]
        else:
            ids = self._ids(self.find(chunk_text(name)))
        self.known.keep(name, ids)
        return ids

    def release(self) -> None:
        """Forget what is known: workers outlive their tasks, and other stages need the memory. The common chunks are soon known again."""
        self.known.forget(), self.pieces.forget()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned ids of ``width`` bytes per text, without added special tokens."""
        out = []
        for text in texts:
            if not text:
                out.append(b"")
            elif any(s in text for s in self.special):
                out.append(array(self.type, self.whole.encode(text, add_special_tokens=False).ids).tobytes())
            else:
                out.append(b"".join(map(self._part, parts(text))))
        return out

    def _part(self, text: str) -> bytes:
        names = chunks(text)
        self.known.turn(), self.pieces.turn()
        if names is None:
            return self._ids(self.find(text))
        first = self._ids(self.find(names.pop(0)))
        return b"".join([first, *map(self.known.__getitem__, names)])


@lru_cache(maxsize=2)
def tokenizer(path: str, width: int = 4) -> JsonTokenizer:
    return JsonTokenizer(path, width)


class BestFit:
    """Online best-fit with at most ``max_open`` open bins."""

    def __init__(self, capacity: int, max_open: int):
        self.capacity, self.max_open = capacity, max_open
        self.bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = self.n_bins = 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        bin_ = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        """The bin's number and the piece's offset in it."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.capacity, self.n_bins
            self.n_bins += 1
        left = free - length
        if left:
            if self.n_open >= self.max_open:
                fullest = (self.bits & -self.bits).bit_length() - 1
                if left <= fullest:  # this bin itself is the fullest
                    return bin_, self.capacity - free
                self._take(fullest)
            self.by_free[left].append(bin_)
            self.bits |= 1 << left
            self.n_open += 1
        return bin_, self.capacity - free


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32`` (and ``ids``, binary) per piece.

    A document's ids end with ``end_id``; a null or empty text is that id
    alone. Documents longer than a sequence are cut so that every piece but
    the first is full.
    """
    names = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part, texts in text_steps(batch):
                row, piece, start, length, crc, payload = [], [], [], [], [], []
                for i, ids in enumerate(tok.encode(texts)):
                    ids += end
                    n = len(ids) // 4
                    cut = n % capacity or capacity
                    for k, (a, b) in enumerate([(0, cut), *((x, x + capacity) for x in range(cut, n, capacity))]):
                        row.append(i), piece.append(k), start.append(a), length.append(b - a)
                        some = ids[4 * a : 4 * b]
                        crc.append(zlib.crc32(some))
                        if with_ids:
                            payload.append(some)
                arrays = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(payload, pa.binary())] if with_ids else [])], names)
        tok.release()

    chosen = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kinds = [chosen.schema[0].dataType.simpleString(), "int", "bigint", "bigint", "bigint", "binary"]
    return chosen.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=False)))


def place(pieces: DataFrame, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), capacity: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS, window_pieces: int = WINDOW_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a length of at most ``capacity``.

    The rows are rebalanced by the order columns into tasks of the session's
    advisory size, so that each has many rows to fill its bins with, and come
    in an order drawn from a hash: the same rows of a task give the same
    sequences when it runs again. Each window of that order is placed from its
    longest piece on, into bins that stay open from window to window; with
    ``window_pieces=1`` pieces are placed online, in the order in which they
    come. Sequence ids are the task's number in the high bits and the bin's in
    the low ones. A task holds one window of rows and the open bins.
    """
    spread = pieces.hint("rebalance", *[F.col(f"`{c}`") for c in order])
    ordered = spread.sortWithinPartitions(F.xxhash64(*[F.col(f"`{c}`") for c in order]), *[F.col(f"`{c}`") for c in order])
    names = [f.name for f in pieces.schema]
    at = names.index(length_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        packer = BestFit(capacity, open_bins)
        window, size = [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                window.append(batch)
                size += batch.num_rows
            if window and (batch is None or size >= window_pieces):
                rows = pa.Table.from_batches(window).combine_chunks()
                if window_pieces > 1:
                    rows = rows.take(np.argsort(-rows.column(at).to_numpy(), kind="stable"))
                placed = [packer.place(n) for n in rows.column(at).to_pylist()]
                rows = rows.append_column("sequence_id", pa.array([base + b for b, _ in placed], pa.int64()))
                yield from rows.append_column("offset", pa.array([o for _, o in placed], pa.int64())).to_batches()
                window, size = [], 0

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ordered.mapInArrow(run, f"{kinds}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS, end_id: int = END_ID, window_pieces: int = WINDOW_PIECES) -> DataFrame:
    """Pieces of all documents with their place: see :func:`token_pieces` and :func:`place`.

    A worker holds the texts of a step (one text at least) and two generations
    of known chunks and pieces, ``KNOWN_MB`` and a quarter of that each. Repeated ids are packed as documents of their own; an empty table gives an
    empty result; columns other than the two named are not read.
    """
    return place(token_pieces(docs, path, id_col, text_col, capacity, end_id), order=(id_col, "piece", "start", "ids_crc32"), capacity=capacity, open_bins=open_bins, window_pieces=window_pieces)


def sequences(placed: DataFrame, capacity: int = SEQUENCE_TOKENS, pad_id: int = END_ID) -> DataFrame:
    """``sequence_id, n_tokens, ids``: each sequence's ids (array of int), padded to the capacity.

    Needs the pieces' ids (``token_pieces(with_ids=True)``). A group is one
    sequence, so it never holds more than ``capacity`` ids.
    """

    def join(key, group):
        group = group.sort_by("offset")
        ids = np.frombuffer(b"".join(group.column("ids").to_pylist()), "<u4").astype(np.int32)
        padded = np.concatenate([ids, np.full(capacity - len(ids), pad_id, np.int32)])
        return pa.table({"sequence_id": pa.array([key[0].as_py()], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int32()), "ids": pa.array([padded], pa.list_(pa.int32()))})

    return placed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(join, "sequence_id bigint, n_tokens int, ids array<int>")
