"""N-gram Jaccard join by rare-first prefix filtering, verified once per pair, without ever listing all pairs of a group.

A document is the set of its distinct word n-grams. Sets are put in one global order, rare first, by counts of n-gram hashes in BUCKETS
buckets (any order gives the right result; a rare-first one gives few candidates). Two sets can only reach the similarity if they share an
n-gram in the larger one's probing prefix and the smaller one's indexing prefix; the length filter, the positional filter (what both still
have behind a shared n-gram) and the suffix filter (sizes of both sets by hash class bound their difference) prune before verification.

1. Equal sets collapse to one representative, so copies cost nothing further.
2. Representatives' prefixes meet by n-gram hash. One streaming pass over each list proposes only pairs with the list's centre, the set whose
   n-grams are the most common (among copies the least edited one); they are verified and joined into provisional components. Lists of one
   are gone after this pass.
3. Of the lists that still touch several components, all pairs across components are proposed and verified. A pair within a
   component could add no reachability, so nothing that decides a component is lost.
Lists that the counts show as hot are dealt out by salt for step 2; step 3 sees them whole, as a join that adaptive execution can split.

Defined results: A-Z count as a-z, other letters as they are; words are split by ASCII white space; a text of fewer words than n is one n-gram;
a null text or one without words has an empty set and links with nothing, as do rows without an id; a repeated doc_id is one node;
an empty table gives no rows; further columns are not read. Similarity is exact in integers: den * intersection >= num * union.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Words, mix, slices, small_enough, texts, word_hashes, written
from .components import components

BUCKET_BITS = 20
CHUNK_BITS = 12  # buckets that travel together
CLASSES = 512
HOT_MEANS, HOT_LEAST = 20, 10_000
FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]



def factor(i: int) -> np.uint64:
    return np.uint64((FACTORS[i % len(FACTORS)] * (2 * (i // len(FACTORS)) + 1)) & 0xFFFFFFFFFFFFFFFF)


def shingle_sets(column: pa.Array, n: int):
    """The sorted distinct n-gram hashes of each text."""
    words = Words(column, lower=True)
    known = word_hashes(words)
    h = known[words.codes]
    if len(h) >= n:
        grams = h[:len(h) - n + 1] * factor(0)
        for i in range(1, n):
            grams = grams + h[i:len(h) - n + 1 + i] * factor(i)
        grams = mix(grams)
    else:
        grams = np.zeros(0, np.uint64)
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if b - a >= n:
            yield np.unique(grams[a:b - n + 1])
        elif b > a:
            few = np.array([sum(int(x) * int(factor(i)) for i, x in enumerate(h[a:b])) + (b - a) & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64)
            yield mix(few)
        else:
            yield grams[:0]


def probing(n, num: int, den: int):
    """Length of the prefix in which a set meets smaller ones."""
    return n - (n * num + den - 1) // den + 1


def indexing(n, num: int, den: int):
    """Length of the prefix in which a set meets larger or equal ones."""
    return n - (2 * n * num + num + den - 1) // (num + den) + 1


def bucket_counts(rows: DataFrame, n: int) -> np.ndarray:
    """In how many sets the n-grams of each hash bucket occur; a fixed number of buckets, summed in the tasks and then chunk by chunk."""
    size = 1 << CHUNK_BITS

    def count(batches):
        total = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for batch in slices(batches):
            for grams in shingle_sets(batch.column("text"), n):
                np.add.at(total, (grams >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
        parts = total.reshape(-1, size).astype("<u4")
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())], ["chunk", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(raw, "<u4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.astype("<i8").tobytes() for s in sums.values()], pa.binary())], ["chunk", "counts"])

    out = np.zeros((1 << BUCKET_BITS - CHUNK_BITS, size), dtype=np.int64)
    for row in rows.select("text").mapInArrow(count, "chunk int, counts binary").repartition("chunk").mapInArrow(add, "chunk int, counts binary").collect():
        out[row["chunk"]] = np.frombuffer(bytes(row["counts"]), "<i8")
    return out.reshape(-1)


def signatures(rows: DataFrame, n: int, counts: np.ndarray, num: int, den: int) -> DataFrame:
    """doc_id, n (set size), a digest of the set, how common its n-grams are, its probing prefix in global order, and the classes of odd size."""
    sent = rows.sparkSession.sparkContext.broadcast(np.minimum(counts, 2**32 - 1).astype(np.uint32))

    def run(batches):
        counts = sent.value
        for batch in slices(batches):
            size, d1, d2, common, prefix, odd = [], [], [], [], [], []
            for grams in shingle_sets(batch.column("text"), n):
                size.append(len(grams))
                d1.append(int(grams.sum(dtype=np.uint64).view(np.int64)))
                d2.append(int(np.bitwise_xor.reduce(mix(grams)).view(np.int64)) if len(grams) else 0)
                found = counts[(grams >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                common.append(int(1e6 * np.log2(1.0 + found).mean()) if len(grams) else 0)
                order = np.lexsort((grams, found))
                prefix.append(grams[order[:probing(len(grams), num, den)]].view(np.int64) if len(grams) else np.zeros(0, np.int64))
                odd.append(np.packbits(np.bincount((grams & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES) & 1).view(np.int64))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefix])]), pa.int32())
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                 pa.array(common, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array([list(x) for x in odd], pa.list_(pa.int64()))],
                ["doc_id", "n", "d1", "d2", "common", "prefix", "odd"])

    return rows.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, common long, prefix array<long>, odd array<long>")


def meetings(reps: DataFrame, counts: np.ndarray, num: int, den: int) -> DataFrame:
    """One pass over the lists: (h, rep, n, pos) of lists with several sets, and `a`, `b`: the row's set and the list's centre, the smaller
    one first, where the two may link.

    Rows of a list arrive with the centre first, so the pass keeps two rows and no list.
    """
    hot = max(HOT_LEAST, int(HOT_MEANS * counts.mean()))
    salts = {int(b): int(-(-counts[b] // hot)) for b in np.flatnonzero(counts > hot)}
    sent = reps.sparkSession.sparkContext.broadcast(salts)

    def deal(batches):
        salts = sent.value
        for batch in batches:
            prefix = batch.column("prefix")
            lengths = np.diff(prefix.offsets.to_numpy()).astype(np.int64)
            h = prefix.flatten().to_numpy()
            rep, n, common = (np.repeat(batch.column(c).to_numpy(), lengths) for c in ("rep", "n", "common"))
            pos = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            salt = np.zeros(len(h), dtype=np.int32)
            if salts:
                bucket = (h.view(np.uint64) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
                for b in np.intersect1d(bucket, np.fromiter(salts, np.int64)):
                    at = bucket == b
                    salt[at] = 1 + (mix(rep[at].view(np.uint64) ^ h[at].view(np.uint64)) % np.uint64(salts[int(b)])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, salt, common, rep, n, pos)], ["h", "salt", "common", "rep", "n", "pos"])

    def meet(batches):
        before = None  # the last row: h, salt, rep, n, pos, and whether it was put out
        centre = (0, 0, 0)  # rep, n, pos of its list's first row
        for batch in batches:
            h, salt, rep, n, pos = (batch.column(c).to_numpy() for c in ("h", "salt", "rep", "n", "pos"))
            if not len(h):
                continue
            new = np.concatenate([[before is None or before[0] != h[0] or before[1] != salt[0]], (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])])
            last = np.concatenate([new[1:], [True]])
            several = ~new | ~last | (salt > 0)  # a salted list's others may lie elsewhere
            head = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))  # -1: the list began in an earlier batch
            c_rep, c_n, c_pos = (np.where(head < 0, c, x[head]) for c, x in zip(centre, (rep, n, pos)))
            need = (num * (n + c_n) + num + den - 1) // (num + den)
            fits = ~new & (c_rep != rep) & (np.minimum(n, c_n) * den >= num * np.maximum(n, c_n)) & (np.minimum(n - pos, c_n - c_pos) >= need)
            less = (c_n < n) | ((c_n == n) & (c_rep < rep))
            pair = np.where(less, c_rep, rep), np.where(less, rep, c_rep)
            if not new[0] and not before[5]:  # its list has more rows after all
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([before[i]], pa.int64()) for i in (0, 2, 3, 4)] + [none, none], ["h", "rep", "n", "pos", "a", "b"])
            yield pa.RecordBatch.from_arrays([pa.array(x[several]) for x in (h, rep, n, pos)] + [pa.array(x[several], mask=~fits[several]) for x in pair],
                                             ["h", "rep", "n", "pos", "a", "b"])
            centre = int(c_rep[-1]), int(c_n[-1]), int(c_pos[-1])
            before = [int(x[-1]) for x in (h, salt, rep, n, pos)] + [bool(several[-1])]

    rows = reps.select("rep", "n", "common", "prefix").mapInArrow(deal, "h long, salt int, common long, rep long, n long, pos long")
    rows = rows.repartition("h", "salt").sortWithinPartitions("h", "salt", F.desc("common"), "rep")
    return rows.mapInArrow(meet, "h long, rep long, n long, pos long, a long, b long")


def may_link(x: str, y: str, num: int, den: int) -> str:
    """SQL of the length and suffix filters on two rows with `n` and `odd`, named with the suffixes x and y."""
    apart = " + ".join(f"bit_count(odd{x}[{i}] ^ odd{y}[{i}])" for i in range(CLASSES // 64))
    return (f"least(n{x}, n{y}) * {den} >= {num} * greatest(n{x}, n{y}) and "
            f"{den} * (n{x} + n{y} - ({apart})) >= {num} * (n{x} + n{y} + {apart})")


def suffix_filter(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Keep the pairs (a, b) whose filters allow enough of an intersection."""
    left, right = (reps.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("odd").alias(f"odd_{k}")) for k in "ab")
    return pairs.join(left, "a").join(right, "b").where(may_link("_a", "_b", num, den)).select("a", "b").distinct()


def verify(pairs: DataFrame, rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. Sets are made anew from the texts of the documents that are asked for."""
    asked = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "asked")
    wanted = rows.join(F.broadcast(asked) if small_enough(asked) else asked, "doc_id", "left_semi")

    def make(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([g.tobytes() for g in shingle_sets(batch.column("text"), n)], pa.binary())], ["doc_id", "grams"])

    sets = written(wanted.mapInArrow(make, "doc_id long, grams binary"), "sets")

    def compare(batches):
        for batch in batches:
            keep = []
            for ga, gb in zip(batch.column("ga"), batch.column("gb")):
                x, y = np.frombuffer(ga.as_buffer(), np.uint64), np.frombuffer(gb.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common > 0 and den * common >= num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.withColumnsRenamed({"doc_id": "b", "grams": "gb"}), "b").join(sets.withColumnsRenamed({"doc_id": "a", "grams": "ga"}), "a")
    return written(both.select("a", "b", "ga", "gb").mapInArrow(compare, "a long, b long"), "links")


def near_documents(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the smallest doc_id reachable by links of similarity num / den or more."""
    rows = texts(docs)
    counts = bucket_counts(rows, n)
    signed = written(signatures(rows, n, counts, num, den), "signatures")
    full = signed.where("n > 0 and doc_id is not null")
    classes = full.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    members = written(signed.select("doc_id", "n", "d1", "d2").join(classes, ["n", "d1", "d2"], "left")
                      .select("doc_id", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("rep")).alias("rep")), "members")
    chosen = members.where("rep = doc_id").select("doc_id").distinct()
    reps = (full.join(F.broadcast(chosen) if small_enough(chosen) else chosen, "doc_id", "left_semi")
            .withColumnRenamed("doc_id", "rep").dropDuplicates(["rep", "d1", "d2"]).select("rep", "n", "common", "prefix", "odd"))
    lists = written(meetings(reps, counts, num, den), "lists")

    tried = written(lists.where("a is not null").select("a", "b").distinct(), "tried")
    known = full.withColumnRenamed("doc_id", "rep")
    links = verify(written(suffix_filter(tried, known, num, den), "pairs"), rows, n, num, den)
    parts = components(links)

    labelled = written(lists.select("h", "rep", "n", "pos").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
                       .select("h", "rep", "n", "pos", F.coalesce("component", "rep").alias("part")), "labelled")
    mixed = labelled.groupBy("h").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("h")
    left = labelled.join(mixed, "h", "left_semi")
    left = written(left.join(known.select("rep", "n", "odd"), ["rep", "n"]).distinct(), "mixed")
    small = left.where(f"pos < n - ((2 * n * {num} + {num + den - 1}) div {num + den}) + 1").withColumnsRenamed({c: f"{c}_a" for c in left.columns if c != "h"})
    across = left.withColumnsRenamed({c: f"{c}_b" for c in left.columns if c != "h"}).join(small, "h").where(
        f"part_b <> part_a and (n_a < n_b or n_a = n_b and rep_a < rep_b) and least(n_b - pos_b, n_a - pos_a) >= (({num} * (n_b + n_a) + {num + den - 1}) "
        f"div {num + den}) and {may_link('_a', '_b', num, den)}")
    pairs = written(across.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        links = links.union(verify(pairs, rows, n, num, den))
        parts = components(links)
    # equal sets of a repeated doc_id tie classes together, too
    ids = members.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    twice = members.groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y")
    if not twice.isEmpty():
        parts = components(links.union(ids))
    found = members.join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents, with all their columns, but of each component only the one with the smallest doc_id.

    Rows without an id stay. Rows that share an id are one document: the one whose text has the smallest digest stays, of equal texts the first by the row's
    JSON form. A row travels as one value, so no column of the caller's can clash with those used here.
    """
    found = written(near_documents(docs, n, num, den), "near")
    bounded = lambda ids: F.broadcast(ids) if small_enough(ids) else ids
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = rows.join(bounded(gone), "id", "left_anti")
    many = written(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated")
    if many.isEmpty():
        return kept.select("row.*")
    many = bounded(many)
    order = F.struct(F.xxhash64("row.text"), F.to_json("row"))
    again = kept.join(many, "id", "left_semi").groupBy("id").agg(F.min_by("row", order).alias("row"))
    return kept.join(many, "id", "left_anti").select("row.*").unionByName(again.select("row.*"))
