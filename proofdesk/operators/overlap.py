"""Common elements of held sets and corpus sets: a rare-first index over a bounded block of held sets.

Elements are ordered by how many held sets have them; what no held set has comes first and cannot match. Two sets that share enough
must share one of their first elements in this order, at places that leave room for the rest, so frequent elements are
seldom looked up and a corpus set of mostly foreign elements is never looked up at all. The corpus is scanned and stays in
its tasks; a pair is counted once and leaves only when it qualifies. More held sets than a block holds make more blocks.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ty
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from ..functions.batches import text_pieces, tokens
from ..session import bounded_blocks

BLOCK_SETS = 2_000
BLOCK_BYTES = 32 << 20
CELLS = 2_000_000  # postings looked at together
SLACK = 1e-6


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + sizes[0] - 1, then the next run, and so on."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class SetIndex:
    """Held sets of element numbers below `universe`.

    needed(hs, os): what sets of these sizes must share; least(s): what a set of size s shares with any partner.
    """

    def __init__(self, sets: list[np.ndarray], universe: int, needed: Callable, least: Callable):
        self.needed, self.least = needed, least
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate([*sets, np.empty(0, np.int64)]).astype(np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        self.rank = np.empty(universe, dtype=np.int64)
        self.rank[np.argsort(np.bincount(flat, minlength=universe), kind="stable")] = np.arange(universe)
        ranks = self.rank[flat]
        order = np.lexsort((ranks, owner))
        self.members, owner = ranks[order], owner[order]
        self.first = np.cumsum(self.sizes) - self.sizes
        place = np.arange(len(owner)) - self.first[owner] + 1
        use = np.flatnonzero(place <= self._prefix(self.sizes)[owner])
        use = use[np.argsort(self.members[use], kind="stable")]
        self.held, self.place = owner[use], place[use]
        self.starts = np.searchsorted(self.members[use], np.arange(universe + 1))

    def _prefix(self, sizes: np.ndarray) -> np.ndarray:
        return sizes - np.ceil(self.least(sizes) - SLACK).astype(np.int64) + 1

    def candidates(self, row: np.ndarray, ranks: np.ndarray, size: np.ndarray) -> np.ndarray:
        """row * held sets + held set, of the pairs that may share enough; row and ranks sorted, foreign elements only in `size`."""
        known = np.bincount(row, minlength=len(size))
        place = np.arange(len(row)) - (np.cumsum(known) - known)[row] + 1 + (size - known)[row]
        use = place <= self._prefix(size)[row]
        row, ranks, place = row[use], ranks[use], place[use]
        width = self.starts[ranks + 1] - self.starts[ranks]
        upto = np.cumsum(width)
        found = [np.empty(0, np.int64)]
        edges = np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, CELLS))
        for low, high in zip(edges, [*edges[1:], len(row)]):
            post = _runs(self.starts[ranks[low:high]], width[low:high])
            r = np.repeat(row[low:high], width[low:high])
            held, hs, os = self.held[post], self.sizes[self.held[post]], size[r]
            room = 1 + np.minimum(hs - self.place[post], os - np.repeat(place[low:high], width[low:high]))
            fits = room >= self.needed(hs, os) - SLACK
            found.append(np.unique(r[fits] * len(self.sizes) + held[fits]))
        return np.unique(np.concatenate(found))

    def pairs(self, row: np.ndarray, elements: np.ndarray, size: np.ndarray):
        """(row, held set, common elements) of the pairs that share enough; (row, element) pairs are distinct and known."""
        ranks = self.rank[elements]
        order = np.lexsort((ranks, row))
        row, ranks = row[order], ranks[order]
        cand = self.candidates(row, ranks, size)
        r, held = cand // max(1, len(self.sizes)), cand % max(1, len(self.sizes))
        common = np.empty(len(cand), dtype=np.int64)
        mark = np.zeros(len(self.rank), dtype=np.int64)
        edges = np.flatnonzero(np.diff(r, prepend=-1))
        for low, high in zip(edges, [*edges[1:], len(r)]):
            mine = ranks[np.searchsorted(row, r[low], "left"):np.searchsorted(row, r[low], "right")]
            mark[mine] = 1
            sizes = self.sizes[held[low:high]]
            common[low:high] = np.add.reduceat(mark[self.members[_runs(self.first[held[low:high]], sizes)]], np.cumsum(sizes) - sizes)
            mark[mine] = 0
        enough = common >= np.maximum(1, self.needed(self.sizes[held], size[r]) - SLACK)
        return r[enough], held[enough], common[enough]


def _listed(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row of each token, tokens per row, tokens) of the texts; a null text has none."""
    sizes, words = tokens(piece.column("text"))
    return np.repeat(np.arange(len(sizes)), sizes), sizes, words


def _windows(row: np.ndarray, code: np.ndarray, n: int, tables: list[np.ndarray] | None = None):
    """(row, number) of each n-word window of numbered words, and the tables that give equal windows equal numbers.

    A window is numbered by its words one after the other: (number so far, next word) is looked up in the table of that step. Without
    tables they are made from these words; with tables, windows that they don't hold are left out, as are words numbered below 0.
    """
    made = []
    at = np.flatnonzero(code >= 0)
    number = code[at].astype(np.int64)
    for step in range(1, n):
        ok = at + step < len(code)
        at, number = at[ok], number[ok]
        ok = (row[np.minimum(at + step, len(code) - 1)] == row[at]) & (code[np.minimum(at + step, len(code) - 1)] >= 0)
        at, number = at[ok], number[ok]
        key = number << 32 | code[at + step].astype(np.int64)
        table = np.unique(key) if tables is None else tables[step - 1]
        made.append(table)
        number = np.searchsorted(table, key)
        if tables is not None:
            ok = np.append(table, -1)[number] == key
            at, number = at[ok], number[ok]
    return row[at], number, made


def _distinct(row: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs in order, as one number each while they are sorted; a number is below 2^32, as in `_windows`."""
    both = np.unique(row.astype(np.int64) << 32 | number.astype(np.int64))
    return both >> 32, both & 0xFFFFFFFF


def _scan(held: DataFrame, other: DataFrame, kernel: Callable, columns: list[str]) -> DataFrame:
    """Rows of `kernel(block of held rows, key types)` over the tasks of other(entry_ord, text), one plan part a block.

    The texts are cut into tokens in the tasks, a bounded piece of a batch at a time, so that a task's memory goes with the piece and not with the tokens of a batch.
    """
    schema = ty.StructType([ty.StructField("held_ord", held.schema["held_ord"].dataType), ty.StructField("entry_ord", other.schema["entry_ord"].dataType),
                            *(ty.StructField(c, ty.DoubleType()) for c in columns)])
    lower = other.select("entry_ord", F.lower("text").alias("text"))
    named = held.select("held_ord", "text", T.words(F.col("text")).alias("t"))
    id_type = to_arrow_type(schema["held_ord"].dataType)
    parts = [lower.mapInArrow(kernel([(r["held_ord"], r["t"] or []) for r in rows], id_type), schema)
             for rows, _ in bounded_blocks(named, "held_ord", "text", BLOCK_SETS, BLOCK_BYTES)]
    return reduce(DataFrame.unionByName, parts) if parts else held.sparkSession.createDataFrame([], schema)


def _batch(keys: pa.Array, held: np.ndarray, entries: pa.Array, row: np.ndarray, **values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys.take(pa.array(held)), entries.take(pa.array(row)), *(pa.array(v, pa.float64()) for v in values.values())],
                                      names=["held_ord", "entry_ord", *values])


def jaccard(held: DataFrame, other: DataFrame, minimum: float) -> DataFrame:
    """(held_ord, entry_ord, jaccard) of held(held_ord, text) x other(entry_ord, text) with distinct-token Jaccard >= minimum (> 0)."""
    if not minimum > 0:
        raise ValueError("the least similarity must be above 0")

    def needed(hs, os):
        return np.where((os >= minimum * hs - SLACK) & (hs >= minimum * os - SLACK), minimum / (1 + minimum) * (hs + os), np.inf)

    def kernel(block: list, id_type: pa.DataType) -> Callable:
        vocab = sorted({t for _, ts in block for t in ts})
        number = {t: i for i, t in enumerate(vocab)}
        index = SetIndex([np.array([number[t] for t in set(ts)], dtype=np.int64) for _, ts in block], len(vocab), needed, lambda s: minimum * s)
        keys = pa.array([k for k, _ in block], type=id_type)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = pa.array(vocab, type=pa.string())
            for piece in (p for batch in batches for p in text_pieces(batch)):
                row, sizes, words = _listed(piece)
                every = words.dictionary_encode()
                row, word = _distinct(row, every.indices.to_numpy(zero_copy_only=False))
                size = np.bincount(row, minlength=len(sizes))
                code = pc.fill_null(pc.index_in(every.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False)[word] if len(word) else word
                r, h, c = index.pairs(row[code >= 0], code[code >= 0], size)
                score = c / (index.sizes[h] + size[r] - c)
                r, h, score = (x[score >= minimum] for x in (r, h, score))
                yield _batch(keys, h, piece.column("entry_ord"), r, jaccard=score)
        return run

    return _scan(held, other, kernel, ["jaccard"])


def containment(held: DataFrame, other: DataFrame, n: int, minimum: float = 0.0) -> DataFrame:
    """(held_ord, entry_ord, held_in_other, other_in_held): shares of distinct n-token shingles, of pairs where either is >= minimum.

    Pairs that share nothing never qualify. Shingles are numbered exactly, from the numbers of their words; a text's own distinct
    shingles are counted only where one of them is held.
    """
    def needed(hs, os):
        return np.maximum(1, minimum * np.minimum(hs, os))

    def kernel(block: list, id_type: pa.DataType) -> Callable:
        vocab = sorted({t for _, ts in block for t in ts})
        number = {t: i for i, t in enumerate(vocab)}
        row = np.repeat(np.arange(len(block)), [len(ts) for _, ts in block])
        code = np.array([number[t] for _, ts in block for t in ts], dtype=np.int64)
        at, shingle, tables = _windows(row, code, n)
        at, shingle = _distinct(at, shingle)
        cuts = np.searchsorted(at, np.arange(1, len(block)))
        universe = int(shingle.max()) + 1 if len(shingle) else 0
        index = SetIndex(np.split(shingle, cuts), universe, needed, np.ones_like)
        keys = pa.array([k for k, _ in block], type=id_type)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = pa.array(vocab, type=pa.string())
            for piece in (p for batch in batches for p in text_pieces(batch)):
                row, sizes, words = _listed(piece)
                code = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False)
                at, shingle = _distinct(*_windows(row, code, n, tables)[:2])
                hit = np.unique(at)
                mine = np.isin(row, hit)
                own = words.filter(pa.array(mine)).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                size = np.bincount(_distinct(*_windows(row[mine], own, n)[:2])[0], minlength=len(sizes))
                r, h, c = index.pairs(at, shingle, size)
                a, b = c / index.sizes[h], c / size[r]
                on = (a >= minimum) | (b >= minimum)
                yield _batch(keys, h[on], piece.column("entry_ord"), r[on], held_in_other=a[on], other_in_held=b[on])
        return run

    return _scan(held, other, kernel, ["held_in_other", "other_in_held"])
