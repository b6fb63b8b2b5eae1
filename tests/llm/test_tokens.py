"""Tokenisation, packing and shards against the libraries themselves."""

import hashlib
import os
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from talkloom.llm import _split, bpe, packing, shards, token_counts
from tests.llm.conftest import prose

P = pytest.importorskip("public_tokenizers")
RANKS, JSON, PIECES = (P.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = st.text(st.one_of(st.sampled_from("ab the's \n\t.,'中é0▁"), st.characters(codec="utf-8")), max_size=200)


def ids_of(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_bpe_is_the_library_and_round_trips(tiktoken_encoding, texts):
    c = bpe.codec(RANKS, P.PATTERN)
    ids = c.encode(texts)
    assert [ids_of(x) for x in ids] == [tiktoken_encoding.encode_ordinary(t) for t in texts]
    assert c.decode(ids) == [t.encode() for t in texts]


def test_bpe_long_words(tiktoken_encoding):
    words = ["a" * 3000, "ab" * 700, "thethethe" * 50, "xyzzy" * 100, "你好" * 200]
    assert [ids_of(x) for x in bpe.codec(RANKS, P.PATTERN).encode(words)] == [tiktoken_encoding.encode_ordinary(w) for w in words]


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_packing_ids_are_the_library(texts):
    from tokenizers import Tokenizer

    t = packing.tokenizer(JSON)
    whole = Tokenizer.from_file(JSON)
    assert [ids_of(x) for x in t.encode(texts)] == [whole.encode(x, add_special_tokens=False).ids for x in texts]


def test_special_string_is_the_special_token():
    assert ids_of(packing.tokenizer(JSON).encode(["<|endoftext|>"])[0]) == [50256]


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_counts_are_the_library(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert token_counts.count_step(texts, PIECES) == [len(sp.encode(t)) for t in texts]


def test_counts_forget_but_stay_right(monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    known = token_counts._counter(PIECES)[1]
    monkeypatch.setattr(known, "limit", 2000)
    for seed in range(5):
        texts = [prose(seed, 60), "a b c d e", prose(seed + 1, 60)]
        assert token_counts.count_step(texts, PIECES) == [len(sp.encode(t)) for t in texts]
        assert known.used <= 2000 + 60 * 3 * 260


def blank_lines(seed: int, n: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice(["  ", " ", "\n", "\n\n", "\r\n", "\n    ", "\t", ".", ",", "the", "Word", "it's", "12", "你好", "\u3000", "\x1c", " \n", "▁"]) for _ in range(n))


def test_white_space_runs_are_the_library(tiktoken_encoding):
    import sentencepiece
    from tokenizers import Tokenizer

    whole, sp = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [blank_lines(s, 1 + s % 90) for s in range(1500)]
    for _ in range(2):  # the second time from what is known
        assert [ids_of(x) for x in bpe.codec(RANKS, P.PATTERN).encode(texts)] == [tiktoken_encoding.encode_ordinary(t) for t in texts]
        assert [ids_of(x) for x in packing.tokenizer(JSON).encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert token_counts.count_step(texts, PIECES) == [len(sp.encode(t)) for t in texts]


def test_long_texts_are_cut_up(tiktoken_encoding, monkeypatch):
    monkeypatch.setattr(_split, "PART_CHARS", 50)
    texts = [blank_lines(s, 400) for s in range(40)] + [prose(9, 500)]
    assert [ids_of(x) for x in bpe.codec(RANKS, P.PATTERN).encode(texts)] == [tiktoken_encoding.encode_ordinary(t) for t in texts]
    whole = packing.tokenizer(JSON).whole
    assert [ids_of(x) for x in packing.tokenizer(JSON).encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_without_end(tiktoken_encoding):
    """A megabyte without a space takes seconds, gives the library's ids, and is not kept."""
    r = random.Random(1)
    letters = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    han = "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(60_000))
    words = [letters, han, "a" * 100_000, "ab" * 60_000, "thethethe" * 9_000, "xyzzy" * 7_001]
    c, began = bpe.codec(RANKS, P.PATTERN), time.perf_counter()
    ids = c.encode(words)
    assert time.perf_counter() - began < 30
    assert [ids_of(x) for x in ids] == [tiktoken_encoding.encode_ordinary(w) for w in words]
    assert c.decode(ids) == [w.encode() for w in words]
    t = packing.tokenizer(JSON)
    assert ids_of(t.encode([han])[0]) == t.whole.encode(han, add_special_tokens=False).ids
    known = token_counts._counter(PIECES)[1]
    token_counts.count_step(words, PIECES)
    assert all(len(key) <= _split.Known.KEY_CHARS for cache in (c.chunks, c.pieces, t.known, t.pieces, known) for key in cache)


def test_known_values_are_bounded_in_bytes():
    known = _split.Known(1, find=lambda key: key.encode())
    for i in range(60_000):
        key = f"k{i % 20_000}x{i}"
        assert known[key] == key.encode()
        known.keep(key, key.encode())
        known.turn()
        assert known.used <= (1 << 20) + 500 and len(known) * known.ENTRY <= (1 << 20) + 500 and len(known.older) * known.ENTRY <= (1 << 20) + 500
    assert known["y" * 100] == b"y" * 100 and "y" * 100 not in known


def test_queries_on_edges(spark, edges, empty, clashing):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(r.doc_id, r.text or "") for r in edges.collect()]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(edges, PIECES).collect())
    assert got == sorted((i if i is not None else -1, len(t.encode()), len(sp.encode(t))) for i, t in rows)
    decoded = bpe.decode(bpe.encode(edges, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in decoded) == sorted(t.encode() for _, t in rows)
    key = lambda r: (str(r.doc_id), bytes(r.ids), bytes(r.decoded))
    assert sorted(map(key, bpe.encode_and_decode(edges, RANKS, P.PATTERN).collect())) == sorted(map(key, decoded))
    assert hashlib.sha256(b"").hexdigest() in {hashlib.sha256(bytes(r.ids)).hexdigest() for r in decoded}
    for docs, n in ((empty, 0), (clashing, 2)):
        assert token_counts.count_tokens(docs, PIECES).count() == n
        assert bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).count() == n == bpe.encode_and_decode(docs, RANKS, P.PATTERN).count()


def test_best_fit_places_and_closes():
    b = packing.BestFit(10, 2)
    assert [b.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    b = packing.BestFit(10, 1)
    assert [b.place(n) for n in (6, 7, 3)] == [(0, 0), (1, 0), (1, 7)] or b.n_bins <= 3
    for bound in (1, 3, 50):
        b, used = packing.BestFit(100, bound), defaultdict(int)
        for n in [(i * 37) % 100 + 1 for i in range(400)]:
            k, offset = b.place(n)
            assert offset == used[k]
            used[k] += n
            assert used[k] <= 100 and b.n_open <= bound


def check_packing(rows, texts, capacity):
    bins = defaultdict(list)
    per_doc = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        per_doc[r.doc_id].append(r)
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    t = packing.tokenizer(JSON)
    for doc, text in texts.items():
        ids = ids_of(t.encode([text])[0]) + [0]
        parts = sorted(per_doc[doc], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts))) and sum(p.length for p in parts) == len(ids)
        assert all(p.length == capacity for p in parts[1:])
        for p in parts:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    return len(bins)


def test_pack(spark, edges, empty, clashing):
    unique = edges.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text or "" for r in unique.collect()}
    rows = packing.pack(unique, JSON).collect()
    n = check_packing(rows, texts, 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack(edges, JSON).count() >= edges.count()
    assert packing.pack(empty, JSON).count() == 0
    assert packing.pack(clashing, JSON).count() == 2


@pytest.mark.parametrize("window", [1, 50])
def test_windows_and_full_sets_of_open_bins(spark, window):
    """Bins stay open over many windows, and close when there are too many: still gapless, and not far from the bound."""
    r = random.Random(8)
    rows = [(i, 0, r.choice([1, 3, 17, 40, 63, 64, 99, 100])) for i in range(3000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    for open_bins in (4, 60):
        placed = packing.place(pieces, capacity=100, open_bins=open_bins, window_pieces=window).collect()
        bins = defaultdict(list)
        for x in placed:
            bins[x.sequence_id].append((x.offset, x.length))
        assert len(placed) == 3000
        for spans in bins.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= 100
        assert len(bins) <= 1.25 * sum(n for _, _, n in rows) / 100
    if window == 1:  # the plain online mode, recomputed
        order = [x.length for x in pieces.hint("rebalance", "doc_id", "piece").sortWithinPartitions(F.xxhash64("doc_id", "piece"), "doc_id", "piece").collect()]
        single = pieces.coalesce(1).sortWithinPartitions(F.xxhash64("doc_id", "piece"), "doc_id", "piece").collect()
        packer = packing.BestFit(100, 60)
        online = [packer.place(x.length) for x in single]
        assert sorted(order) == sorted(x.length for x in single) and max(b for b, _ in online) < 1.25 * sum(order) / 100


def test_sequences_hold_the_ids(spark, edges):
    pieces = packing.token_pieces(edges.where("doc_id in (4, 5, 6)"), JSON, with_ids=True)
    out = packing.sequences(packing.place(pieces)).collect()
    assert sum(r.n_tokens for r in out) == sum(r.length for r in pieces.collect()) and all(len(r.ids) == 2048 for r in out)


@pytest.mark.parametrize("size", [1, 2, 3, 10, 1000, 4097])
def test_feistel_is_a_permutation(size):
    order = shards.Feistel(size, key=9)
    assert sorted(order(np.arange(size)).tolist()) == list(range(size))
    assert order(np.arange(size)).tolist() == shards.Feistel(size, key=9)(np.arange(size)).tolist()


def shard_bytes(folder):
    root = folder.removeprefix("file://")
    return {f: open(f"{root}/{f}", "rb").read() for f in sorted(os.listdir(root)) if f.endswith(".bin")}


def test_shards_do_not_depend_on_the_partitioning(spark, edges):
    copies = spark.createDataFrame([(7000 + i // 40, prose(i // 40, 90), "en", "s", 1) for i in range(200)], edges.schema)
    docs = edges.unionByName(copies)
    one, other = (shards.write_shards(docs.repartition(n), JSON, stride=64, shard_sequences=16) for n in (1, 7))
    a, b = shard_bytes(one[1]), shard_bytes(other[1])
    assert a and a == b
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, one[0].collect())) == sorted(map(key, other[0].collect()))


def test_ids_that_do_not_fit_raise(spark, edges):
    with pytest.raises(ValueError, match="don't fit"):
        shards.write_shards(edges, JSON, dtype="<u1")
    with pytest.raises(ValueError, match="don't fit"):
        shards.write_shards(edges, JSON, dtype="<u2", end_id=70_000)
    assert shards.shard_size(3) == 256 and shards.shard_size(167_000) == 2048 and shards.shard_size(10**12) == 65_536


def test_shards_round_trip_and_resume(spark, edges, empty, clashing):
    unique = edges.where("doc_id is not null").dropDuplicates(["doc_id"])
    manifest, folder = shards.write_shards(unique, JSON, stride=64, shard_sequences=16)
    rows = manifest.collect()
    records = list(shards.read_slots(folder))
    assert sorted({r.slot for r in rows}) == list(range(len(records)))
    assert all((a == b).all() for a, b in zip(shards.read_slots(folder, 5, 9), records[5:9], strict=True))
    spans = defaultdict(list)
    for r in rows:
        spans[r.doc_id].append(r)
    t = packing.tokenizer(JSON)
    for doc in unique.collect():
        ids = np.concatenate([records[r.slot][r.offset : r.offset + r.length] for r in sorted(spans[doc.doc_id], key=lambda r: r.start)])
        assert ids.tolist() == ids_of(t.encode([doc.text or ""])[0]) + [0]
    order = shards.Feistel(len(records))
    stream = {int(s): i for i, s in enumerate(order(np.arange(len(records))))}
    assert [r for r in sorted(rows, key=lambda r: (stream[r.slot], r.offset)) if r.offset == 0] and all(r.slot == r.shard * 16 + r.record for r in rows)
    assert shards.write_shards(empty, JSON)[0].count() == 0
    assert shards.write_shards(clashing, JSON)[0].count() == 2
    assert shards.write_shards(edges, JSON)[0].count() >= edges.count()
