"""Tokens of Arrow batches of texts, cut from bytes in the tasks."""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import text as T

TEXT_BYTES = 4 << 20  # text that is cut into tokens together
TOKEN_BYTES = np.array([re.fullmatch(T.TOKEN, chr(c)) is not None for c in range(256)])


def text_pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of `TEXT_BYTES` of its column `text`, or of one row: batches are bounded by rows and may hold any number of tokens."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + TEXT_BYTES, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(tokens of each text, all tokens) of lower-cased texts, the same as `T.words` finds: runs of the bytes that T.TOKEN allows."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    inside = TOKEN_BYTES[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]  # no token goes on from one text to the next
    begins[first] = inside[first]
    counted = np.concatenate([[0], np.cumsum(begins)])
    kept = raw[inside]
    ends = np.append(np.flatnonzero(begins[inside]), len(kept)).astype(np.int32)
    return counted[bounds[1:]] - counted[bounds[:-1]], pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(kept))
