"""What the operators share: the shared folder, written tables, ragged word arrays and hashes of words."""
from __future__ import annotations

import ctypes
import functools
import weakref
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir, written  # noqa: F401

SLICE_BYTES = 6 << 20
MEMO_ENTRIES = 250_000


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, the whole text (null: empty), and the named further columns; all other columns are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       *[F.col(c) for c in more])


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `limit` bytes of `column`; a longer value is a batch of its own."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, total = 0, np.concatenate([[0], np.cumsum(sizes)])
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(total, total[start] + limit, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def give_back() -> None:
    """Return freed pages to the system: a worker process serves one operator after the other, and allocators keep what an earlier one used."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc(), "malloc_trim", None)
    if trim:
        trim(0)


@functools.cache
def _libc():
    try:
        return ctypes.CDLL(None)
    except OSError:
        return None


class Memo(dict):
    """Results by key, computed when first asked for.

    Bounded: when full, it becomes the old generation, and what was not asked for since the last time is forgotten.
    A worker process serves one operator after the other; `alone` empties what earlier ones left in it.
    """

    every: weakref.WeakSet = weakref.WeakSet()

    def __init__(self, compute: Callable, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.compute, self.entries, self.old = compute, entries, {}
        Memo.every.add(self)

    __hash__ = object.__hash__
    __eq__ = object.__eq__

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def alone(self, *others: Memo) -> Memo:
        """This memo, after all but `others` have been emptied."""
        for memo in list(Memo.every):
            if memo is not self and memo not in others and (memo or memo.old):
                memo.forget()
                pa.default_memory_pool().release_unused()
        return self


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated runs [starts[i], starts[i] + lengths[i])."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class Words:
    """The words of many texts, each distinct one once.

    Words are what ASCII white space (space, \\t, \\n, \\v, \\f, \\r) separates. `codes` numbers the words of all texts in order,
    `bounds[i]:bounds[i + 1]` are those of text i, `values` are the words as an array, `distinct` as bytes.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        split = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
        offsets = split.offsets.to_numpy().astype(np.int64)
        flat = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = offsets - offsets[0]
        self.values: pa.Array = flat.dictionary
        empty = np.flatnonzero(pc.equal(pc.binary_length(self.values), 0).to_numpy(zero_copy_only=False))
        if len(empty):  # leading or trailing white space leaves an empty word
            keep = codes != empty[0]
            before = np.concatenate([[0], np.cumsum(keep)])
            codes, offsets = codes[keep], before[offsets]
        self.codes, self.bounds = codes, offsets

    @functools.cached_property
    def distinct(self) -> list[bytes]:
        return listed(self.values.cast(pa.binary()))

    def __len__(self) -> int:
        return len(self.bounds) - 1


def listed(column: pa.Array) -> list:
    """The values of a string or binary array without nulls."""
    return column.to_numpy(zero_copy_only=False).tolist()


def word_hashes(words: Words) -> np.ndarray:
    """The 64-bit hash of each distinct word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.distinct), dtype=np.uint64, count=len(words.distinct))


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every bit depends on all bits."""
    h = h.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def small_enough(df: DataFrame, max_rows: int = 2_000_000) -> bool:
    """Whether a frame of ids has at most `max_rows` rows: counted, no more than one row past the bound is read on."""
    return df.limit(max_rows + 1).count() <= max_rows
