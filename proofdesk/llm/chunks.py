"""Substring deduplication by content-defined chunking, exact from RUN words on.

A passage is a duplicate if it has at least `run_words` words and occurred before: a word goes if a window of that many words around it has an
earlier place, by (doc_id, place). The first occurrence of each window stays, so a later copy is cut to its ends, whichever documents hold parts of it.

Chunks. A gear hash rolls over the words and forgets all but the last few (`shape`). A chunk ends where the hash is the least of `width` neighbouring ones, the
last among equals, so ends depend on nearby words alone and an insertion moves only the chunks around it. A chunk's digest is of its words and of those that
the hash at its start remembers. Each window of `run_words` words holds a whole chunk with that memory, so equal windows have an equal chunk: chunks whose digest
occurs once hold no duplicate, and all others are seeds.

Extension. The words of all windows around one chunk are its piece: the chunk extended to both sides. Where all pieces of a digest are equal,
as inside repeated passages, later ones are duplicates as a whole; where they differ, as at the ends of passages, their windows are compared one by one. Both
go by 64-bit digests, in an aggregate and a join: no pairs of occurrences are made.

Work. The first pass over the texts sends only chunk digests, sorted and cut into bins, a few rows a task; each bin tells which digests came twice and sets bits in
a filter of at most FILTER_BITS bits, which is broadcast. The second pass sends the pieces that pass the filter. A false bit only sends a piece too many.

Defined results: words are split by ASCII white space, and white space is not compared; a null text has no words; rows without an id come last
among the occurrences; rows that repeat a doc_id are told apart by a digest of their text, and exact repeats of a row are one document, none a duplicate of another;
an empty table gives no rows; further columns are not read, and `drop_spans` returns them as they are, whatever their names. A task holds about ten arrays of
eight bytes a word for one slice, at least one whole text.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_bounded
from .base import Words, mix, ragged, slices, written

RUN = 16
MEMORY = 5
SLICE = 2 << 20
FILTER_BITS = 1 << 29
BITS_OF_BIN = 17
FLUSH = 1 << 20
LISTS_BYTES = 32 << 20
ODD = 0x9E3779B97F4A7C15
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shape(run_words: int) -> tuple[int, int]:
    """(words that the gear hash remembers, neighbours among which it is least at the end of a chunk): a window has memory - 1 + 2 * width words or more."""
    if run_words < 2:
        raise ValueError("a passage has two words or more")
    memory = max(1, min(MEMORY, run_words // 3))
    return memory, (run_words - memory + 1) // 2


#: The longest and the shortest chunk: the first of a text has the memory before its end, the others `width` words at most.
MOST, LEAST = sum(shape(RUN)) - 1, 1


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts in order, bounds of each text)."""
    words = Words(column)
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, words.distinct), np.uint64, len(words.values))
    return known[words.codes], words.bounds


class Chunks:
    """Chunk ends over the words of many texts. `end[i]` is the end that is least in the hash neighbourhood from word i on."""

    def __init__(self, g: np.ndarray, run_words: int):
        self.memory, self.width = shape(run_words)
        self.g, h = g, g.copy()
        shift = -(-64 // self.memory)  # a word has left the hash after `memory` steps
        for back in range(1, self.memory):
            h[back:] += g[:-back] << np.uint64(shift * back)
        h = mix(h)
        n = max(0, len(g) - self.width + 1)
        least, self.end = h[:n].copy(), np.arange(n, dtype=np.int32 if len(g) < 2**31 else np.int64)
        for j in range(1, self.width):
            less = np.flatnonzero(h[j:j + n] <= least)
            least[less] = h[less + j]
            self.end[less] = less + j
        # digests of any stretch of words: differences of a running sum of words times powers, divided by the first power
        powers = np.full(len(g) + 1, ODD, np.uint64)
        powers[0] = 1
        inverse = np.full(len(g) + 1, pow(ODD, -1, 2**64), np.uint64)
        inverse[0] = 1
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(g) * np.cumprod(powers)[:-1], dtype=np.uint64)])
        self.inverse = np.cumprod(inverse)

    def digest(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64))

    def windows(self, bounds: np.ndarray, run_words: int):
        """(first words of all windows that lie in a text, the chunk of each as the ends before and behind it)."""
        n = max(0, len(self.g) - run_words + 1)
        whole = np.flatnonzero(np.repeat(bounds[1:], np.diff(bounds))[:n] >= np.arange(n) + run_words)
        left = self.end[whole + self.memory - 1]
        ends = np.unique(self.end)
        return whole, left, ends[np.searchsorted(ends, left, side="right")] if len(left) else left


def cut_column(column: pa.Array, run_words: int = RUN):
    """(text number, first word, words, digest) of all chunks of the texts, as arrays."""
    g, bounds = hashed_words(column)
    chunks = Chunks(g, run_words)
    ends = np.unique(chunks.end) + 1
    owner = np.searchsorted(bounds, ends - 1, side="right") - 1
    inside = (ends - bounds[owner] >= chunks.memory) & (ends < bounds[owner + 1])  # the hash at the end is of this text alone
    cuts = np.unique(np.concatenate([bounds, ends[inside]]))
    start, stop = cuts[:-1], cuts[1:]
    owner = np.searchsorted(bounds, start, side="right") - 1
    return owner, start - bounds[owner], stop - start, chunks.digest(np.maximum(bounds[owner], start - chunks.memory), stop)


def identified(docs: DataFrame, *more) -> DataFrame:
    """doc_id as long, `twin`: a digest of the text, the text (null: empty), and the further columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("twin"), text.alias("text"), *more)


def repeated_filter(docs: DataFrame, run_words: int) -> tuple[np.ndarray, int]:
    """(bytes of bits, shift): a bit is set if a chunk digest that, shifted, names it occurs twice."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    log_bins = max(10, (8 * parts - 1).bit_length())
    per_bin = min(BITS_OF_BIN, max(3, FILTER_BITS.bit_length() - 1 - log_bins))
    shift = 64 - log_bins - per_bin

    def send(batches):
        def binned(held):
            d = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            d = np.repeat(d[first], np.minimum(2, np.diff(np.append(first, len(d)))))  # once or twice
            bins = (d >> np.uint64(64 - log_bins)).astype(np.int64)
            at = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
            offsets = 8 * np.append(at, len(d))
            blob = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(d.tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(bins[at], pa.int32()), blob], ["bin", "digests"])

        held, n = [], 0
        for batch in slices(batches, limit=SLICE):
            g, bounds = hashed_words(batch.column("text"))
            chunks = Chunks(g, run_words)
            _, left, right = chunks.windows(bounds, run_words)
            heads = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]])) if len(left) else left
            held.append(chunks.digest(left[heads] - chunks.memory + 1, right[heads] + 1))
            n += len(heads)
            if n >= FLUSH:
                yield binned(held)
                held, n = [], 0
        if n:
            yield binned(held)

    def meet(batches):
        def bits(number, blobs):
            d = np.sort(np.frombuffer(b"".join(blobs), np.uint64))
            twice = np.unique(d[1:][d[1:] == d[:-1]] >> np.uint64(shift)) & np.uint64((1 << per_bin) - 1)
            out = np.zeros(1 << per_bin, bool)
            out[twice.astype(np.int64)] = True
            return number, np.packbits(out, bitorder="little").tobytes()

        now, blobs = None, []
        for batch in batches:
            done = []
            for number, blob in zip(batch.column("bin").to_pylist(), batch.column("digests")):
                if number != now:
                    done += [bits(now, blobs)] if blobs else []
                    now, blobs = number, []
                blobs.append(blob.as_buffer())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int32()), pa.array([x[1] for x in done], pa.binary())], ["bin", "bits"])
        if blobs:
            x = bits(now, blobs)
            yield pa.RecordBatch.from_arrays([pa.array([x[0]], pa.int32()), pa.array([x[1]], pa.binary())], ["bin", "bits"])

    sent = identified(docs).select("text").mapInArrow(send, "bin int, digests binary")
    found = sent.repartition(parts, "bin").sortWithinPartitions("bin").mapInArrow(meet, "bin int, bits binary").toArrow()  # FILTER_BITS at most
    out = np.zeros((1 << log_bins, 1 << per_bin >> 3), np.uint8)
    for number, raw in zip(found.column("bin").to_pylist(), found.column("bits")):
        out[number] = np.frombuffer(raw.as_buffer(), np.uint8)
    return out.reshape(-1), shift


def piece_table(docs: DataFrame, run_words: int) -> DataFrame:
    """(doc_id, twin, digest: the chunk's, piece: digest of its piece, at, n, windows: the digests of its windows) of all chunks that may occur twice."""
    bits, shift = repeated_filter(docs, run_words)
    sent = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches):
        known = np.frombuffer(sent.value, np.uint8)
        for batch in slices(batches, limit=SLICE):
            g, bounds = hashed_words(batch.column("text"))
            chunks = Chunks(g, run_words)
            first, left, right = chunks.windows(bounds, run_words)
            if not len(first):
                continue
            heads = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
            n = np.diff(np.append(heads, len(first)))
            digest = chunks.digest(left[heads] - chunks.memory + 1, right[heads] + 1)
            bit = digest >> np.uint64(shift)
            some = np.flatnonzero(known[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
            heads, n, digest = heads[some], n[some], digest[some]
            start = first[heads]
            owner = np.searchsorted(bounds, start, side="right") - 1
            lead = (left[heads] - start).astype(np.uint64)
            own = first[ragged(heads, n)]
            windows = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(8 * n)]).astype(np.int32).tobytes()),
                                                                    pa.py_buffer(chunks.digest(own, own + run_words).tobytes())])
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("twin").take(at), pa.array(digest.view(np.int64)),
                 pa.array(mix(chunks.digest(start, start + n + run_words - 1) + lead).view(np.int64)), pa.array(start - bounds[owner], pa.int32()),
                 pa.array(n + run_words - 1, pa.int32()), windows], ["doc_id", "twin", "digest", "piece", "at", "n", "windows"])

    return identified(docs).mapInArrow(run, "doc_id long, twin long, digest long, piece long, at int, n int, windows binary")


def with_firsts(rows: DataFrame, *more) -> DataFrame:
    """`rows` whose digest has two places or more, with the first place, whether it is the row's own, and the aggregates `more`."""
    place = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("at").alias("p"), F.col("twin").alias("t"))
    firsts = written(rows.groupBy("digest").agg(F.count("*").alias("times"), F.min(place).alias("first"), *more).where("times > 1")
                     .select("digest", F.col("first.d").alias("first_doc_id"), F.col("first.p").alias("first_word"), F.col("first.t").alias("first_twin"),
                             *[c for c in ("mixed",) if more]), "firsts")
    return rows.join(firsts, "digest").withColumn("own", F.expr("doc_id <=> first_doc_id and at = first_word and twin = first_twin"))


def window_table(pieces: DataFrame) -> DataFrame:
    """(doc_id, twin, digest, at) of each window of the pieces."""

    def run(batches):
        for batch in batches:
            windows = batch.column("windows")
            n = pc.binary_length(windows).to_numpy(zero_copy_only=False) // 8
            owner = pa.array(np.repeat(np.arange(len(n)), n))
            at = np.repeat(batch.column("at").to_numpy(), n) + ragged(np.zeros(len(n), np.int64), n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(owner), batch.column("twin").take(owner), pa.array(np.frombuffer(b"".join(w.as_buffer() for w in windows), np.int64)),
                 pa.array(at, pa.int32())], ["doc_id", "twin", "digest", "at"])

    return pieces.select("doc_id", "twin", "at", "windows").mapInArrow(run, "doc_id long, twin long, digest long, at int")


def duplicate_spans(docs: DataFrame, run_words: int = RUN) -> DataFrame:
    """One row a duplicate span: doc_id, twin, start_word, end_word (behind it), n_words, and where its first piece or window first occurred."""
    pieces = with_firsts(written(piece_table(docs, run_words), "pieces"), (F.min("piece") != F.max("piece")).alias("mixed"))
    pieces = written(pieces.where("mixed or not own").select("doc_id", "twin", "at", "n", "mixed", "first_doc_id", "first_word", F.when(F.col("mixed"), F.col("windows")).alias("windows")),
                     "shared")
    windows = with_firsts(written(window_table(pieces.where("mixed")), "windows")).withColumn("n", F.lit(run_words))
    columns = ["doc_id", "twin", "at", "n", "first_doc_id", "first_word"]
    later = pieces.where("not mixed").select(columns).unionByName(windows.where("not own").select(columns))
    # a document's pieces and windows, in order; at most as many as it has words
    ordered = later.repartition("doc_id", "twin").sortWithinPartitions("doc_id", "twin", "at")

    def join(batches):
        held = None
        for batch in batches:
            out = []
            for doc, twin, at, n, first, word in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if held and held[0] == doc and held[1] == twin and held[3] >= at:
                    held[3] = max(held[3], at + n)  # the next one, or the same of a repeated row
                else:
                    out.append(held)
                    held = [doc, twin, at, at + n, first, word]
            yield from rows(out)
        yield from rows([held])

    def rows(spans):
        spans = [s for s in spans if s]
        if spans:
            doc, twin, start, end, first, word = zip(*spans)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(twin, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()),
                 pa.array([e - s for s, e in zip(start, end)], pa.int64()), pa.array(first, pa.int64()), pa.array(word, pa.int64())],
                ["doc_id", "twin", "start_word", "end_word", "n_words", "first_doc_id", "first_word"])

    return ordered.mapInArrow(join, "doc_id long, twin long, start_word long, end_word long, n_words long, first_doc_id long, first_word long")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space behind them."""
    raw = text.encode()
    at = [m.start() for m in WORD.finditer(raw)] + [len(raw)]
    out, done = [], 0
    for start, end in sorted(spans):
        out.append(raw[done:at[start]])
        done = at[min(end, len(at) - 1)]
    return b"".join([*out, raw[done:]]).decode()


def drop_spans(docs: DataFrame, run_words: int = RUN) -> DataFrame:
    """The documents without their duplicate spans; one that had words and has none left goes. `n_chars`, if there, is brought up to date.

    Rows without an id keep their texts. A row travels as one value, so no column of the caller's can clash with those used here.
    """
    spans = written(duplicate_spans(docs, run_words).where("doc_id is not null"), "spans")
    lists = spans.groupBy("doc_id", "twin").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("spans"))  # of one text each

    @F.arrow_udf("string")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([None if t is None else without_spans(t, [(s["start_word"], s["end_word"]) for s in x]) for t, x in zip(text.to_pylist(), spans.to_pylist())],
                        pa.string())

    # the lists travel where they are measured small, else the rows do, each with its text once
    lists = broadcast_if_bounded(written(lists, "lists"), max_bytes=LISTS_BYTES)
    rows = identified(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).drop("text")
    joined = rows.join(lists, ["doc_id", "twin"], "left")
    found = F.col("spans").isNotNull()
    done = joined.withColumn("cut", cut(F.when(found, F.col("row.text").cast("string")), F.col("spans")))
    left = ~found | (F.length(F.translate("cut", " \t\n\x0b\x0c\r", "")) > 0)
    kinds, text = dict(docs.dtypes), F.when(found, F.col("cut").cast(docs.schema["text"].dataType)).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.char_length(text).cast(kinds.get("n_chars", "long"))}
    return done.where(left).select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])
