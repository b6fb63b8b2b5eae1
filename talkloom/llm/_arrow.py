"""Arrow helpers for operators that run in Python workers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401

from talkloom.session import store  # noqa: F401

#: Texts of one step in a worker: memory stays bounded whatever the batch holds.
STEP_CHARS = 1_000_000


def text_steps(batch: pa.RecordBatch, column: int = 1, limit: int = STEP_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with their texts as Python strings; null texts are empty."""
    lengths = batch.column(column)
    sizes = pa.compute.binary_length(lengths).to_pylist()
    start = size = 0
    for i, n in enumerate([*sizes, None]):
        n = n or 0
        if i == len(sizes) or (size and size + n > limit):
            if i > start:
                part = batch.slice(start, i - start)
                yield part, ["" if x is None else x for x in part.column(column).to_pylist()]
            start, size = i, 0
        size += n


def binary_array(values: Iterable[bytes]) -> pa.Array:
    return pa.array(list(values), pa.binary())
