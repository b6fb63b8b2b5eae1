"""Token counts without token ids.

A text is cut into pre-tokens no merge can cross. Each step of a task counts
the pieces of every distinct pre-token once, joins these counts to the
documents' pre-token frequencies, and sums. The ids of a document never exist.

The join is local to the scan's partition: a join over the whole corpus would
shuffle every (document, pre-token) pair, which is more than the corpus itself.
The counts of short pre-tokens are carried from step to step in a worker, in
two generations bounded in bytes; long ones (texts without spaces) are counted
anew each time, which costs time in proportion to their length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm._arrow import text_steps
from talkloom.llm._split import Known

#: Megabytes of a generation of known counts.
KNOWN_MB = 48

_RUNS = re.compile(r" +[^ ]+| +$")


@lru_cache(maxsize=2)
def _counter(model_path: str):
    """The processor, the known counts, and that of a lone space at a text's end. Raises if a piece could cross a pre-token's edge."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    for i in range(sp.get_piece_size()):
        if "▁" in sp.id_to_piece(i).lstrip("▁"):
            raise ValueError("a piece of this model spans words; its counts don't add up over pre-tokens")
    if sp.decode(sp.encode("a  Ａ　ﬁ")) != "a  Ａ　ﬁ":
        raise ValueError("this model normalises texts; its counts don't add up over pre-tokens")
    # the lone space would be dropped as empty input if it came alone
    return sp, Known(KNOWN_MB), len(sp.encode("a ")) - len(sp.encode("a"))


def pretokens(text: str) -> list[str]:
    """The pre-tokens: runs of non-spaces with the spaces before them, less one space (the library adds one itself)."""
    if not text:
        return []
    text = text.replace("▁", " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [run[1:] for run in _RUNS.findall(" " + text)]
    return text.split(" ")


def count_step(texts: list[str], model_path: str) -> list[int]:
    sp, known, lone = _counter(model_path)
    known.turn()
    frequencies = [Counter(pretokens(t)) for t in texts]
    distinct = {p for f in frequencies for p in f}
    counts = {p: n for p in distinct if (n := known.get(p) or known.recall(p)) is not None}
    counts[""] = lone
    new = list(distinct.difference(counts))
    for i in range(0, len(new), 20_000):
        part = new[i : i + 20_000]
        for p, n in zip(part, map(len, sp.encode(part, num_threads=1)), strict=True):
            counts[p] = n
            known.keep(p, n)
    return [sum(map(mul, map(counts.__getitem__, f), f.values())) for f in frequencies]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens`` per row, as ``sentencepiece`` encodes each whole text.

    No begin or end tokens; special strings are ordinary text, as the library
    has it. Null texts count as empty (0 bytes, 0 tokens). Repeated ids stay
    rows of their own; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_steps(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(count_step(texts, model_path), pa.int64())], [id_col, "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    chosen = docs.select(F.col(f"`{id_col}`"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return chosen.mapInArrow(run, f"`{id_col}` {chosen.schema[0].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
