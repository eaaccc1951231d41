"""Periodic runs of words: maximal stretches that repeat with a smallest period, found from seeds on diagonals and extended once.

A run has at least `least` words and `times` periods. Words q apart in a run are equal, so the run overlaps itself moved by its period q, by
max(least - q, (times - 1) * q) words or more. k-grams of the smallest such overlap are seeds: with k between q and that overlap, a k-gram in the run comes again
q words later, and not earlier, for else the run had a smaller period (Fine and Wilf). So a pair of neighbouring occurrences of a k-gram gives the lag, and
no other pairs of a group need be formed. Lags are taken in classes, each up to twice the one before, with k equal to the largest lag of the class;
k-gram hashes double with it, and only places whose k-gram recurred go on to the next class.

Seeds are extended along their diagonal, word by word, to both sides. For each lag a table holds the furthest place covered; seeds before it lie in
a stretch already found and are not extended again.

Defined results: words are split by ASCII white space; a null or empty text has no words, no runs and the digests of empty strings; repeated rows are rows of their own;
rows without an id stay; an empty table gives no rows; further columns are not read. A task holds some arrays of one slice, at least one whole text:
about 150 bytes a word.
"""
from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .base import Words, mix, slices, texts

LEAST, TIMES = 24, 3
SLICE = 2 << 20
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ODD = np.uint64(0x9E3779B97F4A7C15)


def joined_hash(h: np.ndarray, by: int) -> np.ndarray:
    """The hash of a gram from those of two equally long grams that cover it, `by` words apart."""
    n = max(0, len(h) - by)
    return mix(h[:n] * ODD + h[by:by + n])


def gram_hashes(g: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each on."""
    size, h = 1, g
    while 2 * size <= k:
        h, size = joined_hash(h, size), 2 * size
    return joined_hash(h, k - size) if size < k else h


def recurring(h: np.ndarray) -> np.ndarray:
    """Places whose hash comes at least twice."""
    ordered = np.sort(h)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    return np.flatnonzero(twice[at] == h)


def first_gram(least: int) -> int:
    """The smallest overlap that a run of any period has."""
    return min(max(least - q, 2 * q) for q in range(1, least + 1))


def seeds(codes: np.ndarray, owner: np.ndarray, longest: int, k: int):
    """(places, lags, k) of each class of lags: neighbouring occurrences of a k-gram in one text. `owner` numbers the texts, so grams of two texts differ."""
    h, low = gram_hashes(mix(codes.astype(np.uint64) + (owner.astype(np.uint64) << np.uint64(32))), k), 0
    places = recurring(h)
    while len(places) and TIMES * (low + 1) <= longest:
        order = np.argsort(h[places], kind="stable")
        at, key = places[order], h[places][order]
        lag = np.diff(at)
        good = (key[1:] == key[:-1]) & (lag > low) & (lag <= k)
        yield at[:-1][good], lag[good], k
        h, low, k = joined_hash(h, k), k, 2 * k
        places = places[places < len(h)]
        places = places[recurring(h[places])]


def agreeing(codes: np.ndarray, at: int, lag: int, step: int, most: int) -> int:
    """How many words from `at` on, forwards or backwards (`step`), equal the ones `lag` later; `most` at most."""
    done, block = 0, 64
    while done < most:
        size = min(block, most - done)
        a = at + done if step > 0 else at - done - size + 1
        same = codes[a:a + size] == codes[a + lag:a + lag + size]
        wrong = np.flatnonzero(~same)
        if len(wrong):
            return done + int(wrong[0] if step > 0 else size - 1 - wrong[-1])
        done, block = done + size, 2 * block
    return done


def extended(codes: np.ndarray, bounds: np.ndarray, found, least: int, times: int) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of the runs that the seeds lie in."""
    out = []
    for at, lag, k in found:
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        head = np.flatnonzero(np.concatenate([[True], (np.diff(lag) != 0) | (np.diff(at) != 1)])) if len(at) else at
        tail = np.append(head[1:], len(at)) - 1
        texts_of = np.searchsorted(bounds, at[head], side="right") - 1
        covered: dict[int, int] = {}  # by lag: the furthest place
        for i, j, q, text in zip(at[head].tolist(), at[tail].tolist() if len(at) else [], lag[head].tolist(), texts_of.tolist()):
            if i < covered.get(q, -1):
                continue
            begin, end = int(bounds[text]), int(bounds[text + 1])
            if not np.array_equal(codes[i:j + k], codes[i + q:j + k + q]):
                continue  # equal hashes of different words
            start = i - agreeing(codes, i - 1, q, -1, i - begin)
            stop = j + k + agreeing(codes, j + k, q, 1, end - q - j - k)
            covered[q] = stop
            if stop - start + q >= max(least, times * q):
                out.append((text, start - begin, stop - start + q, q))
    return out


def runs_of(codes: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of all runs of all texts, by text, start and period."""
    if times < 3:
        raise ValueError("a run takes three periods or more; with fewer a k-gram does not tell the period")
    k = first_gram(least)
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(n)), n)
    some = recurring(gram_hashes(mix(codes.astype(np.uint64) + (owner.astype(np.uint64) << np.uint64(32))), k))
    if not len(some):
        return []
    kept = np.zeros(len(n), bool)  # most texts have no gram twice
    kept[owner[some]] = True
    number, own = np.flatnonzero(kept), kept[owner]
    small, sizes = codes[own], n[number]
    inner = np.concatenate([[0], np.cumsum(sizes)])
    found = extended(small, inner, seeds(small, np.repeat(np.arange(len(number)), sizes), int(sizes.max()), k), least, times)
    return sorted((int(number[t]), start, length, q) for t, start, length, q in found)


def top(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exponent; of equal ones the first by start, then period."""
    best = None
    for start, length, q in runs:
        if best is None or length * best[2] > best[1] * q:
            best = start, length, q
    return best


def collapsed(codes: np.ndarray, bounds: np.ndarray, runs: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, bounds) without what repeats: of each run its first period stays."""
    change = np.zeros(len(codes) + 1, np.int32)
    for text, start, length, q in runs:
        change[bounds[text] + start + q] += 1
        change[bounds[text] + start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return codes[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, rewrite=None, with_text: bool = False) -> DataFrame:
    """One row a document: doc_id, n_runs, the greatest run (start, length, period, exponent_milli), digests, all runs, and the collapsed text on request.

    `rewrite`, if given, maps a batch of (doc_id, text) to the one to be searched.
    """
    fields = [pa.field(c, pa.int64()) for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")]
    fields += [pa.field("runs_sha256", pa.string()), pa.field("collapsed_sha256", pa.string())]
    fields += [pa.field("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))] + [pa.field("collapsed", pa.string())] * with_text
    schema = pa.schema(fields)

    def run(batches):
        for batch in slices(batches, limit=SLICE):
            batch = rewrite(batch) if rewrite else batch
            words = Words(batch.column("text"))
            own = [[] for _ in range(batch.num_rows)]
            found = runs_of(words.codes, words.bounds, least, times)
            for text, *r in found:
                own[text].append(tuple(r))
            codes, bounds = collapsed(words.codes, words.bounds, found)
            left = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words.values.cast(pa.binary()).take(pa.array(codes))), b" ")
            best = [top(r) or (None, None, None) for r in own]
            columns = [batch.column("doc_id"), [len(r) for r in own], *zip(*best), [1000 * b[1] // b[2] if b[2] else None for b in best],
                       [hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in r).encode()).hexdigest() for r in own],
                       [hashlib.sha256(x).hexdigest() for x in left.to_pylist()],
                       [[dict(zip(("start", "length", "period"), x)) for x in r] for r in own], *([left.cast(pa.string())] * with_text)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, fields)], schema=schema)

    return texts(docs).mapInArrow(run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
                                       "collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>" + ", collapsed string" * with_text)


def repeated_tails(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Every tenth document, by a hash of its id, with its words repeating from a place on, as the query `op12` asks for."""
    texts_ = batch.column("text").to_pylist()
    for at, doc in enumerate(batch.column("doc_id").to_pylist()):
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        words = WORD.findall(texts_[at].encode()) if h % 10 == 0 else []
        if words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            texts_[at] = b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)]).decode()
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts_, pa.string())], ["doc_id", "text"])
