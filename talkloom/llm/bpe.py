"""Byte-level BPE encoding and decoding by recursive DuckDB queries.

Each task runs DuckDB inside its Python worker. Texts are cut by the split
pattern; the distinct pieces of a step become rows of token positions, which a
recursive query joins with the merge table: in every round each word contracts
its leftmost pair of minimum rank, until no pair is left. Decoding looks token
positions up in the vocabulary and aggregates the bytes in order.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm._arrow import binary_array, text_steps
from talkloom.llm._split import PATTERN, Known, chunk_pieces, chunks, parts

#: Bytes of the words of one recursive query; DuckDB's memory in a worker.
QUERY_BYTES = 1 << 19
MEMORY = "320MB"
#: Megabytes of a generation of known chunks, and of known pieces.
CHUNK_MB, PIECE_MB = 120, 44
#: Characters of a step; a recursive query costs the same whether its words are few or many.
STEP_CHARS = 1_600_000
#: Words of more bytes are encoded in blocks of ``BLOCK`` bytes, whose seams are then mended; a mended
#: stretch reaches over ``SEAM`` tokens on each side at first.
LONG_WORD = 64
BLOCK = 32
SEAM = 8
#: Tokens that one decoding query reads at most; longer documents are decoded in parts.
DECODE_TOKENS = 250_000

# One contraction per word and round. ``best`` holds rank and position in one number.
_SHORT = """
WITH RECURSIVE s(w, toks) AS (
  SELECT w, toks FROM words
  UNION ALL
  SELECT s.w, s.toks[:p.best % 4294967296 - 1] || [(p.best // 4294967296)::INTEGER] || s.toks[p.best % 4294967296 + 2:]
  FROM (
    SELECT w, min(m * 4294967296 + i) AS best
    FROM (SELECT w, i, toks[i]::BIGINT * 65536 + toks[i + 1] AS k FROM (SELECT w, toks, unnest(range(1, len(toks))) AS i FROM s))
    JOIN merges USING (k) GROUP BY w
  ) p JOIN s USING (w)
)
SELECT w, arg_min(toks, len(toks)) AS toks FROM s GROUP BY w
"""

# All non-overlapping pairs of the minimum rank per round, from the left, where the merged token can't
# open a pair of lower rank (then the order of these contractions doesn't matter); else the leftmost alone.
_LONG = """
WITH RECURSIVE s(w, toks) USING KEY (w) AS (
  SELECT w, toks FROM words
  UNION
  SELECT w, list(tok ORDER BY i) AS toks FROM (
    WITH spots AS (SELECT w, i, toks[i] AS tok, toks[i + 1] AS nxt FROM (SELECT w, toks, unnest(range(1, len(toks) + 1)) AS i FROM s)),
    pairs AS (SELECT w, i, m FROM spots JOIN merges ON k = tok::BIGINT * 65536 + nxt),
    least AS (SELECT w, min(m) AS m, arg_min(i, m * 4294967296 + i) AS first FROM pairs GROUP BY w),
    runs AS (SELECT w, i, m, i - row_number() OVER (PARTITION BY w ORDER BY i) AS run FROM pairs JOIN least USING (w, m)),
    turns AS (SELECT w, i, m, row_number() OVER (PARTITION BY w, run ORDER BY i) AS turn FROM runs),
    starts AS (SELECT t.w, t.i, t.m FROM turns t JOIN least USING (w) LEFT JOIN unsafe u ON u.m = t.m WHERE CASE WHEN u.m IS NULL THEN t.turn % 2 = 1 ELSE t.i = first END)
    SELECT x.w, x.i, coalesce(a.m::INTEGER, x.tok) AS tok
    FROM spots x SEMI JOIN starts z ON z.w = x.w LEFT JOIN starts a ON a.w = x.w AND a.i = x.i LEFT JOIN starts b ON b.w = x.w AND b.i = x.i - 1
    WHERE b.i IS NULL
  ) GROUP BY w
)
SELECT w, toks FROM s
"""

# ``vocabulary`` is one row: the tokens' bytes, in hex, at their ids.
_DECODE = """
SELECT d, string_agg(tokens[id + 1], '' ORDER BY i) AS x
FROM (SELECT d, unnest(ids) AS id, unnest(range(len(ids))::INTEGER[]) AS i FROM docs), vocabulary GROUP BY d
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file: a base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _numbers(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


class Codec:
    """A rank file's merge table and vocabulary in a worker's DuckDB."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        if pattern != PATTERN:
            raise ValueError("texts can't be cut into chunks safely for another split pattern than the byte-level one")
        self.ranks = ranks = read_ranks(path)
        self.token = {rank: token for token, rank in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.chunks, self.pieces = Known(CHUNK_MB), Known(PIECE_MB)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self.con.register("found", pa.table({"l": pa.array(left, pa.int64()), "r": pa.array(right, pa.int64()), "m": pa.array(merged, pa.int64())}))
        self.con.execute("CREATE TABLE merges AS SELECT l * 65536 + r AS k, m FROM found")
        # merged tokens that are part of a pair of lower rank than their own
        self.con.execute("CREATE TABLE unsafe AS SELECT DISTINCT x AS m FROM (SELECT l AS x, m FROM found UNION ALL SELECT r, m FROM found) WHERE m <= x")
        tokens = [self.token.get(rank, b"").hex() for rank in range(max(self.token) + 1)]
        self.con.register("all_tokens", pa.table({"tokens": pa.array([tokens])}))
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM all_tokens")

    def _contract(self, words: list[bytes], query: str) -> list[bytes]:
        lengths = np.fromiter(map(len, words), np.int32, len(words))
        flat = self.single[np.frombuffer(b"".join(words), np.uint8)]
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        self.con.register("words", pa.table({"w": pa.array(np.arange(len(words), dtype=np.int32)), "toks": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))}))
        found = self.con.sql(query).to_arrow_table().combine_chunks()
        self.con.unregister("words")
        toks = found.column("toks").combine_chunks()
        raw = toks.flatten().to_numpy().astype("<u4").tobytes()
        ends = 4 * np.cumsum(pa.compute.list_value_length(toks).to_numpy())
        out, start = [b""] * len(words), 0
        for w, end in zip(found.column("w").to_pylist(), ends.tolist(), strict=True):
            out[w] = raw[start:end]
            start = end
        return out

    def _direct(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids (little-endian unsigned 32-bit) of distinct words by the recursive query; a word that is a token is that token."""
        ranks = self.ranks
        out = {w: r.to_bytes(4, "little") for w in words if (r := ranks.get(w)) is not None}
        rest = [w for w in words if w not in out and w]
        for query, part in ((_SHORT, [w for w in rest if len(w) <= LONG_WORD]), (_LONG, [w for w in rest if len(w) > LONG_WORD])):
            start = size = 0
            for i, w in enumerate([*part, None]):
                if i > start and (w is None or size + len(w) > QUERY_BYTES):
                    out.update(zip(part[start:i], self._contract(part[start:i], query), strict=True))
                    start, size = i, 0
                size += len(w or b"")
        return out

    def _in_blocks(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of long words, in time proportional to their length.

        A sequence of tokens is a word's encoding if each two neighbours are
        the encoding of their own bytes. That holds within blocks that are
        encoded for themselves; where it fails at a seam, the tokens around it
        are encoded anew, over a stretch that doubles until it holds.
        """
        cut = [[w[i : i + BLOCK] for i in range(0, len(w), BLOCK)] for w in words]
        known = self._direct(list({b for bs in cut for b in bs}))
        state = []  # per word: its tokens, and the seams to look at
        for blocks in cut:
            ids = [_numbers(known[b]) for b in blocks]
            state.append(([t for i in ids for t in i], np.cumsum([len(i) for i in ids])[:-1].tolist()))
        reach, open_ = SEAM, list(range(len(words)))
        while open_:
            text = lambda toks: b"".join([self.token[t] for t in toks])
            pairs = {(toks[s - 1], toks[s]) for w in open_ for toks, seams in [state[w]] for s in seams}
            joined = self._direct(list({text(p) for p in pairs}))
            wrong = {p for p in pairs if _numbers(joined[text(p)]) != list(p)}
            spans = {}
            for w in open_:
                toks, seams = state[w]
                found: list[list[int]] = []
                for s in seams:
                    if (toks[s - 1], toks[s]) in wrong:
                        low, high = max(0, s - reach), min(len(toks), s + reach)
                        if found and low <= found[-1][1]:
                            found[-1][1] = high
                        else:
                            found.append([low, high])
                if found:
                    spans[w] = [(low, high, text(toks[low:high])) for low, high in found]
            mended = self._direct(list({x for found in spans.values() for _, _, x in found}))
            for w, found in spans.items():
                toks, out, seams, at = state[w][0], [], [], 0
                for low, high, x in found:
                    out += toks[at:low]
                    new = _numbers(mended[x])
                    edges = [len(out), len(out) + len(new)]
                    out += new
                    seams += [e for e, inside in zip(edges, (low > 0, high < len(toks)), strict=True) if inside]
                    at = high
                state[w] = out + toks[at:], seams
            open_, reach = list(spans), 2 * reach
        return {w: np.array(toks, "<u4").tobytes() for w, (toks, _) in zip(words, state, strict=True)}

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids (little-endian unsigned 32-bit) of distinct words."""
        out = self._direct([w for w in words if len(w) <= LONG_WORD])
        out.update(self._in_blocks([w for w in words if len(w) > LONG_WORD]))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each whole text's ids."""
        for cache in (self.chunks, self.pieces):
            cache.turn()
        # per text and part: the pieces up to the first chunk, and the chunks' names
        cut, names = [], set()
        for text in texts:
            found = []
            for part in parts(text) if text else ():
                if (some := chunks(part)) is None:
                    found.append((self.find(part), ()))
                else:
                    first, *some = some
                    found.append((self.find(first), some))
                    names.update(some)
            cut.append(found)
        split = {c: chunk_pieces(c, self.find) for c in self.chunks.unknown(names)}
        every = {p for ps in split.values() for p in ps}
        every.update(p for found in cut for ps, _ in found for p in ps)
        words = {p.encode(): p for p in self.pieces.unknown(every)}
        # the step's own ids; the short keys' are kept beyond it
        piece, chunk = {words[w]: i for w, i in self.encode_words(list(words)).items()}, {}
        self.pieces.find = piece.__getitem__
        for c, ps in split.items():
            chunk[c] = b"".join([piece.get(p) or self.pieces[p] for p in ps])
        self.chunks.find = chunk.__getitem__
        of_piece, of_chunk = self.pieces.__getitem__, self.chunks.__getitem__
        out = [b"".join([x for ps, some in found for x in (*map(of_piece, ps), *map(of_chunk, some))]) for found in cut]
        self.pieces.keep_all(piece)
        self.chunks.keep_all(chunk)
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each document's ids, aggregated in their order."""
        width = 4 * DECODE_TOKENS
        parts = [(d, x[i : i + width]) for d, x in enumerate(ids) for i in range(0, len(x), width)]
        out: list[list[bytes]] = [[] for _ in ids]
        start = 0
        while start < len(parts):
            end, size = start, 0
            while end < len(parts) and (end == start or size + len(parts[end][1]) <= width):
                size += len(parts[end][1])
                end += 1
            flat = np.frombuffer(b"".join([x for _, x in parts[start:end]]), "<u4").astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for _, x in parts[start:end]])]).astype(np.int32)
            self.con.register("docs", pa.table({"d": pa.array(np.arange(start, end, dtype=np.int32)), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))}))
            for k, x in sorted(self.con.execute(_DECODE).fetchall()):
                out[parts[k][0]].append(bytes.fromhex(x))
            self.con.unregister("docs")
            start = end
        return [b"".join(x) for x in out]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids`` per row; ``ids`` is binary, little-endian unsigned 32-bit numbers.

    Every match of the pattern is encoded by itself, special strings as
    ordinary text. Null and empty texts have empty ids. Repeated ids stay rows
    of their own; an empty table gives an empty result. Words without end cost
    time in proportion to their length. A worker holds a step's texts (one
    text at least), two generations of known chunks and pieces (``Known``) and
    DuckDB's ``MEMORY``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for part, texts in text_steps(batch, limit=STEP_CHARS):
                yield pa.RecordBatch.from_arrays([part.column(0), binary_array(c.encode(texts))], [id_col, "ids"])

    chosen = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return chosen.mapInArrow(run, f"`{id_col}` {chosen.schema[0].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, ids, decoded``: the bytes (binary) of each row's ids. Null ids decode as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), binary_array(c.decode(part.column(1).to_pylist()))], [id_col, ids_col, "decoded"])

    chosen = encoded.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{ids_col}`"), F.lit(b"")).alias(ids_col))
    return chosen.mapInArrow(run, f"`{id_col}` {chosen.schema[0].dataType.simpleString()}, `{ids_col}` binary, decoded binary")


def encode_and_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids, decoded``: :func:`encode` and :func:`decode` of its ids, step by step in one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for part, texts in text_steps(batch, limit=STEP_CHARS):
                ids = c.encode(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), binary_array(ids), binary_array(c.decode(ids))], [id_col, "ids", "decoded"])

    chosen = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return chosen.mapInArrow(run, f"`{id_col}` {chosen.schema[0].dataType.simpleString()}, ids binary, decoded binary")
