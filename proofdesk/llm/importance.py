"""Importance resampling towards a target distribution, with exact integer weights from bit planes.

A text's features are its runs of 1 to `longest` words, hashed into buckets. A bucket's gain is a thousand times the log ratio of its smoothed share in
the target to that in the documents. A document's weight is the floored mean of the gains of its features, and a document is drawn by weight plus Gumbel noise of its id,
so that the highest scores are a sample without replacement.

Weights are summed bit by bit: a document's bucket counts are planes of one bit a bucket, plane j holding bit j of each count; the gains are planes of
their magnitudes, the positive and the negative ones apart. The sum of count times gain is the sum over pairs of planes of 2 ** (j + k) times the
number of common bits, negative planes subtracted. That is exact in integers, whatever the order of documents or tasks.

Bucket totals are one row a bucket from each task. Scores are integers of a bounded range, so the lowest drawn score comes from a count per score, and only
rows from that score on are sorted, by range, to be ranked.

Defined results: a null text has no features and weight 0; rows without an id get the noise of an empty id and come last among ties; repeated rows
are counted, weighed and drawn as often as they come; without documents there are no rows; an empty target has no counts and is smoothed as any other;
further columns are not read. A task holds the arrays of one slice, at least one whole text.
"""
from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import Words, slices, texts, written

BUCKETS = 10_000
LEAST_WORDS = 20
SEED = 2024
SCALE = 1000
PLANE_BYTES = 12 << 20
#: Letters in lower case, digits and all of what is not ASCII stay; the rest is a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def folded(column: pa.Array) -> pa.Array:
    """The texts with FOLD applied to each byte; the column has no nulls."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    raw = bytes(memoryview(data)[bounds[0]:bounds[-1]]) if data is not None and len(column) else b""
    return pa.Array.from_buffers(column.type, len(column), [None, pa.py_buffer((bounds - bounds[0]).tobytes()) if len(column) else offsets, pa.py_buffer(raw.translate(FOLD))])


def features(column: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number and bucket of each feature, words of each text)."""
    words = Words(folded(column))
    distinct, n = words.distinct, np.diff(words.bounds)
    owner, ends = np.repeat(np.arange(len(n)), n), np.repeat(words.bounds[1:], n)
    crc = np.fromiter(map(zlib.crc32, distinct), np.int64, len(distinct))
    group, at, docs, out = words.codes, np.arange(len(words.codes)), [owner], [crc[words.codes] % buckets]
    for k in range(2, longest + 1):
        inside = at + k <= ends[at]
        group, at = group[inside], at[inside]
        pair, group = np.unique(group * max(1, len(distinct)) + words.codes[at + k - 1], return_inverse=True)
        before, last = np.divmod(pair, max(1, len(distinct)))
        crc = np.fromiter((zlib.crc32(b" " + distinct[w], c) for w, c in zip(last.tolist(), crc[before].tolist())), np.int64, len(pair))
        docs.append(owner[at])
        out.append(crc[group] % buckets)
    return np.concatenate(docs), np.concatenate(out), n


def totals(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket; each task sends one row a bucket at most, and `buckets` rows come to the driver."""

    def run(batches):
        n = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            n += np.bincount(features(batch.column("text"), longest, buckets)[1], minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts(docs.withColumn("doc_id", F.lit(0))).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket."""
    size, (s, t) = len(source), (int(source.sum()), int(target.sum()))
    return np.array([math.floor(SCALE * math.log(float((y + 1) * (s + size)) / float((x + 1) * (t + size)))) for x, y in zip(source.tolist(), target.tolist())], np.int64)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    return np.packbits(bits, axis=-1).view(np.uint64)


def gain_planes(gain: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(signed power of two, plane) of every plane that has a bit."""
    width = -(-len(gain) // 64) * 64
    out = []
    for sign in (1, -1):
        size = np.zeros(width, np.int64)
        size[:len(gain)] = np.maximum(sign * gain, 0)
        out += [(sign << k, packed((size >> k & 1).astype(bool))) for k in range(int(size.max()).bit_length())]
    return out


def summed(owner: np.ndarray, bucket: np.ndarray, count: np.ndarray, n: int, planes: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The sum of count times gain of each of `n` texts, from (text, bucket, count) in the order of texts."""
    out = np.zeros(n, np.int64)
    width = 64 * len(planes[0][1]) if planes else 64
    begin = 0
    while planes and begin < len(owner):
        # as many texts as fit, with a plane for each bit of their largest count
        first, depth = int(owner[begin]), 1
        most = max(1, PLANE_BYTES // width)
        stop = int(np.searchsorted(owner, first + most))
        depth = int(count[begin:stop].max()).bit_length()
        while stop > begin and (int(owner[stop - 1]) - first + 1) * depth * width > PLANE_BYTES and int(owner[stop - 1]) > first:
            stop = int(np.searchsorted(owner, first + max(1, (int(owner[stop - 1]) - first + 1) // 2)))
            depth = int(count[begin:stop].max()).bit_length()
        rows = int(owner[stop - 1]) - first + 1
        bits = np.zeros((depth, rows, width), bool)
        for j in range(depth):
            some = (count[begin:stop] >> j & 1).astype(bool)
            bits[j, owner[begin:stop][some] - first, bucket[begin:stop][some]] = True
        counts = packed(bits)
        for j in range(depth):
            for power, plane in planes:
                out[first:first + rows] += (power << j) * np.bitwise_count(counts[j] & plane).sum(axis=1, dtype=np.int64)
        begin = stop
    return out


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document."""
    buckets = len(gain)

    def run(batches):
        planes = gain_planes(gain)
        for batch in slices(batches):
            owner, bucket, words = features(batch.column("text"), longest, buckets)
            key, count = np.unique(owner * buckets + bucket, return_counts=True)
            n = np.bincount(owner, minlength=batch.num_rows)
            weight = summed(key // buckets, key % buckets, count, batch.num_rows, planes) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return texts(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, *order) -> DataFrame:
    """`rows` with `rank`, 1 for the first: sorted by range, numbered in each part, and each part moved by the rows of the parts before it."""
    placed = written(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    parts = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"))  # a row a part
    bases = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    return (placed.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(bases), "_part")
            .withColumn("rank", F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_base"))


def resample(docs: DataFrame, target: DataFrame, num: int = 10, den: int = 100, least_words: int = LEAST_WORDS, seed: int = SEED, longest: int = 1,
             buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every document; num / den of those with `least_words` words or more are drawn."""
    gain = gains(totals(docs, longest, buckets), totals(target, longest, buckets))
    uniform = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
               + 0.5) / 4294967296.0
    noise = F.floor(F.lit(-float(SCALE)) * F.log(-F.log(uniform))).cast("long")
    scored = written(weigh(docs, gain, longest).withColumn("score", F.col("weight") + noise), "scored")
    fit = scored.where(F.col("n_words") >= least_words)
    by_score = {r["score"]: r["n"] for r in fit.groupBy("score").agg(F.count("*").alias("n")).collect()}  # a row a score: a bounded range of integers
    left = drawn = num * sum(by_score.values()) // den
    cutoff = None
    for cutoff in sorted(by_score, reverse=True):
        left -= by_score[cutoff]
        if left <= 0:
            break
    chosen = (F.col("n_words") >= least_words) & (F.col("score") >= F.lit(cutoff if drawn else None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score"]
    ranks = ranked(scored.where(chosen).select(columns), F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight")
    return (ranks.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
            .union(scored.where(~F.coalesce(chosen, F.lit(False))).select(*columns, F.lit(None).cast("long").alias("rank"))))
