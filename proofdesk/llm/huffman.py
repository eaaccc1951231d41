"""Token ids as canonical length-limited Huffman blocks.

Code lengths come from the counts of all ids (package-merge, so no code is longer than the decoding table). Documents are laid down in
ascending doc_id order in blocks that decode alone; in a block every `EVERY`-th id has its bit offset recorded, and decoding runs through
one table lookup per id for all checkpoints side by side.

The format is a folder with two tables: `book` (one row: code length of each id, by id) and `blocks` (one row a block: part, tokens of the
part before it, doc ids, their lengths, checkpoints, bits). Blocks end at document ends, so a very long document has a block of its own.

Defined results: a null text is an empty one and leaves the end id alone; null doc_ids come first; rows that repeat a doc_id stay rows of
their own, next to each other; an empty table gives an empty folder and no rows; further columns are not read.
"""
from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import shared_dir, small_enough, texts, written
from .tokens import END_ID, encoded

LIMIT = 20  # longest code in bits; more only if there are more ids than 2 ** LIMIT
EVERY = 128
BLOCK_TOKENS = 1 << 18


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits for ids with these counts (package-merge); 0 for ids that never occur."""
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} ids need codes longer than {limit} bits")
    order = used[np.lexsort((used, counts[used]))]
    items = counts[order].astype(np.int64)
    row, single = items, [np.ones(n, dtype=bool)]
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([items, pairs])
        rank = np.argsort(both, kind="stable")
        row = both[rank]
        single.append(rank < n)
    taken, depth = 2 * n - 2, np.zeros(n, dtype=np.uint8)
    for flags in reversed(single):
        own = int(flags[:taken].sum())
        depth[:own] += 1
        taken = 2 * (taken - own)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id): the lengths alone define them."""
    codes = np.zeros(len(lengths), dtype=np.uint32)
    code, last = 0, 0
    for length in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.flatnonzero(lengths == length)
        code <<= length - last
        last = length
        codes[ids] = code + np.arange(len(ids), dtype=np.uint32)
        code += len(ids)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For every window of `width` bits the id it starts with and that id's length: id << 5 | length."""
    width = max(1, int(lengths.max(initial=0)))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = np.left_shift(1, width - lengths[order].astype(np.int64))
    table = np.full(1 << width, 1, dtype=np.uint32)
    filled = np.repeat((order.astype(np.uint32) << np.uint32(5)) | lengths[order], spans)
    table[: len(filled)] = filled
    return table, width


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits, bit offset of every EVERY-th id)."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    placed = codes[ids].astype(np.uint64) << (64 - (at & 31) - size).astype(np.uint64)
    words = int(ends[-1] + 31 >> 5) + 1 if len(ids) else 1
    # codes do not overlap, so sums are unions; a 32-bit word is exact in a double
    out = np.bincount(at >> 5, (placed >> np.uint64(32)).astype(np.float64), words)
    out[1:] += np.bincount(at >> 5, (placed & np.uint64(0xFFFFFFFF)).astype(np.float64), words)[:-1]
    return out.astype(">u4").tobytes()[: int(ends[-1] + 7 >> 3) if len(ids) else 0], at[::EVERY]


def unpack_bits(bits: bytes, marks: np.ndarray, n: int, table: np.ndarray, width: int) -> np.ndarray:
    """The `n` ids of a block: all checkpoints advance together, one table lookup per id."""
    raw = np.frombuffer(bits + bytes(EVERY * width // 8 + 8), dtype=np.uint8).astype(np.uint32)
    window = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    at = np.asarray(marks, dtype=np.int64).copy()
    out = np.empty((min(EVERY, n), len(at)), dtype=np.uint32)
    for step in range(len(out)):
        found = table[(window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - width)]
        out[step] = found >> np.uint32(5)
        at += found & np.uint32(31)
    return out.T.reshape(-1)[:n]


def id_type(vocabulary: int) -> str:
    """How ids travel between the stages."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def id_table(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids as little-endian integers) of every document, tokenised once and written."""

    def run(batches):
        for batch, ids, bounds in encoded(batches, tokenizer, end_id):
            raw = ids.astype(id_type(vocabulary))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([raw[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())], ["doc_id", "ids"])

    return written(texts(docs).mapInArrow(run, "doc_id long, ids binary"), "ids")


def id_counts(ids: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all documents: counted in the tasks, summed by id; one row per id reaches the driver."""

    def run(batches):
        total = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), id_type(vocabulary)), minlength=vocabulary)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], ["id", "n"])

    counts = np.zeros(vocabulary, dtype=np.int64)
    for row in ids.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    return counts


def write_documents(docs: DataFrame, folder: str, tokenizer: str, vocabulary: int, end_id: int = END_ID, limit: int = LIMIT,
                    block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode every document and write the folder."""
    spark = docs.sparkSession
    ids = id_table(docs, tokenizer, vocabulary, end_id)
    lengths = code_lengths(id_counts(ids, vocabulary), max(limit, (vocabulary - 1).bit_length()) if vocabulary > 1 << limit else limit)
    codes = canonical_codes(lengths)
    spark.createDataFrame([(EVERY, bytearray(lengths.tobytes()))], "every int, lengths binary").coalesce(1).write.parquet(f"{folder}/book")

    def run(batches):
        part, done, held = None, 0, []

        def block():
            flat = np.concatenate([x for _, x in held])
            bits, marks = pack_bits(flat, codes, lengths)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([done], pa.int64()), pa.array([len(flat)], pa.int64()),
                 pa.array([[d for d, _ in held]], pa.list_(pa.int64())), pa.array([[len(x) for _, x in held]], pa.list_(pa.int64())),
                 pa.array([marks.tolist()], pa.list_(pa.int64())), pa.array([bits], pa.binary())],
                ["part", "before", "n_tokens", "doc_ids", "doc_tokens", "marks", "bits"])

        size = 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                held.append((doc, np.frombuffer(raw.as_buffer(), id_type(vocabulary))))
                size += len(held[-1][1])
                if size >= block_tokens:
                    yield block()
                    done, size, held = done + size, 0, []
        if held:
            yield block()

    laid = ids.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    laid = laid.withColumn("part", F.spark_partition_id())
    schema = "part int, before long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, marks array<long>, bits binary"
    laid.mapInArrow(run, schema).write.parquet(f"{folder}/blocks")


def read_documents(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row a document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and the ids on request."""
    book = spark.read.parquet(f"{folder}/book").first()
    if book["every"] != EVERY:
        raise ValueError(f"this folder has a checkpoint every {book['every']} ids")
    lengths = np.frombuffer(bytes(book["lengths"]), dtype=np.uint8)
    blocks = spark.read.parquet(f"{folder}/blocks")
    # one row a part: the number of written partitions, not of documents
    starts = (blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
              .select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start")))

    def run(batches):
        table, width = decoding_table(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_bits(row["bits"], row["marks"], row["n_tokens"], table, width).astype("<u4", copy=False)
                ends = np.cumsum(row["doc_tokens"])
                begins = ends - row["doc_tokens"]
                docs = [ids[a:b] for a, b in zip(begins, ends)]
                out = [pa.array(row["doc_ids"], pa.int64()), pa.array(begins + row["start"], pa.int64()), pa.array(row["doc_tokens"], pa.int64()),
                       pa.array([zlib.crc32(x) for x in docs], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(pa.array([x.tobytes() for x in docs], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    placed = blocks.join(F.broadcast(starts) if small_enough(starts, 1_000_000) else starts, "part").select("doc_ids", "doc_tokens", "n_tokens", "marks", "bits", (F.col("part_start") + F.col("before")).alias("start"))
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def encode_and_read(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int = END_ID) -> DataFrame:
    """Write all documents into a new folder in the shared place and return what reading it gives."""
    folder = f"{shared_dir(docs.sparkSession)}/tables/huffman-{uuid.uuid4().hex}"
    write_documents(docs, folder, tokenizer, vocabulary, end_id)
    return read_documents(docs.sparkSession, folder)
