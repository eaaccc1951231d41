"""Near-duplicate vectors by a pivot-permutation index.

Each vector is described by its `near` nearest pivots in order. An inverted list holds the vectors that have `shared` given pivots among
theirs, so two vectors meet exactly if they share at least that many pivots; they are verified in double precision where the list's pivots
are the first that they share, so once. Pivots are a bounded sample (PIVOT_SAMPLE rows by hash of the id, thinned so that no two are closer than
APART, or a dense group would fill its neighbourhood with pivots and split on them); every vector is indexed. Recall is tested against brute force.

Equal vectors are collapsed first and counted as often as they occur. A list longer than BLOCK is dealt into blocks, and each pair of blocks is a
task's group: no list is gathered whole. A group returns a count for each vector and a spanning forest of its links, never all pairs.

Defined results: vectors that are null, empty or zero, or hold a null, NaN or infinite component, link with nothing, nor do rows without an
id; a shorter vector counts as if padded by zeros; a repeated vec_id is one node, and its rows count for each other as equal vectors do;
an empty table gives no rows; further columns are not read.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import ragged, written
from .components import components

PIVOT_SAMPLE = 2048
PIVOTS = 512
APART = 0.6
BLOCK = 1024


def padded(column: pa.Array, width: int) -> np.ndarray:
    """A matrix of the lists of doubles, unit length."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(column)), lengths), ragged(np.zeros(len(column), np.int64), lengths.astype(np.int64))] = flat
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def choose_pivots(rows: np.ndarray, most: int = PIVOTS, apart: float = APART) -> np.ndarray:
    """The first `most` rows that are no closer than `apart` to an earlier chosen one."""
    chosen = np.zeros((0, rows.shape[1]))
    for row in rows:
        if len(chosen) == most:
            break
        if not len(chosen) or (chosen @ row).max() < apart:
            chosen = np.vstack([chosen, row])
    return chosen


def spanning(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index that each of `n` indices reaches over the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def describe(vectors: DataFrame, pivots: np.ndarray, near: int) -> DataFrame:
    """(rep, times, vector, pivots: the numbers of the nearest pivots, nearest first)."""
    width = pivots.shape[1]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                unit = padded(part.column("vector"), width)
                order = np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :near]
                yield pa.RecordBatch.from_arrays(
                    [part.column("rep"), part.column("times"), part.column("vector"), pa.array(order.tolist(), pa.list_(pa.int32()))],
                    ["rep", "times", "vector", "pivots"])

    return vectors.mapInArrow(run, "rep long, times long, vector array<double>, pivots array<int>")


def verified(groups: DataFrame, width: int, threshold: float, near: int, shared: int) -> DataFrame:
    """(a, b, n): vector a has n links in the group, and b is its neighbour in the group's spanning forest, if it needs one.

    The rows of a group (list, i, j) come together and in order, those of block i and those of block j.
    """

    def group(rep, times, unit, pivots, block, wanted, i, j):
        left, right = (np.flatnonzero(block == i), np.flatnonzero(block == j)) if i != j else (np.arange(len(rep)),) * 2
        if not len(left) or not len(right):
            return None
        # vectors with the same pivots are checked for being at home in this list together
        sets, kind = np.unique(np.sort(pivots, axis=1), axis=0, return_inverse=True)
        kind = kind.reshape(-1)
        home = np.zeros((len(sets), len(sets)), dtype=bool)
        for at in range(0, len(sets), 64):
            both = (sets[at:at + 64, None, :, None] == sets[None, :, None, :]).any(axis=3)
            first = both & (np.cumsum(both, axis=2) <= shared)
            home[at:at + 64] = (np.where(first, sets[at:at + 64, None, :], 0).sum(axis=2) == sum(wanted)) & \
                (first & np.isin(sets, wanted)[at:at + 64, None, :]).sum(axis=2).__eq__(shared)
        hit = (unit[left] @ unit[right].T >= threshold) & home[kind[left]][:, kind[right]]
        x, y = np.nonzero(hit)
        x, y = left[x], right[y]
        keep = x < y if i == j else rep[x] != rep[y]
        x, y = x[keep], y[keep]
        if not len(x):
            return None
        n = np.bincount(x, times[y], len(rep)) + np.bincount(y, times[x], len(rep))
        return n.astype(np.int64), spanning(len(rep), x, y)

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("list", "i", "j")], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(key)]):
                if stop > start:
                    if last is not None and tuple(key[start]) != last:
                        yield from done(held, last)
                        held = []
                    last = tuple(key[start])
                    held.append(batch.slice(start, stop - start))
        if last is not None:
            yield from done(held, last)

    def done(parts, key):
        rows = pa.Table.from_batches(parts).combine_chunks()
        if rows.num_rows < 2:
            return
        column = lambda c: rows.column(c).combine_chunks()
        rep = column("rep").to_numpy()
        pivots = column("pivots").flatten().to_numpy().reshape(len(rep), -1)
        found = group(rep, column("times").to_numpy(), padded(column("vector"), width), pivots, column("block").to_numpy(), column("wanted")[0].as_py(),
                      key[1], key[2])
        if found:
            n, label = found
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(rep[label[at]]), pa.array(n[at])], ["a", "b", "n"])

    return groups.mapInArrow(run, "a long, b long, n long")


def near_vectors(vectors: DataFrame, threshold: float = 0.95, near: int = 6, shared: int = 2, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row: see the top of the module."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    sound = F.expr("vec_id is not null and size(vector) > 0 and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity')) "
                   "and exists(vector, x -> x <> 0)")
    marked = rows.select("vec_id", F.coalesce(sound, F.lit(False)).alias("sound"), F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"), "vector")
    classes = written(marked.where("sound").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"),
                                                                    F.first("vector").alias("vector")), "vectors")
    width = classes.agg(F.max(F.size("vector"))).first()[0]
    members = written(marked.select("vec_id", "sound", "h1", "h2").join(classes.select("h1", "h2", "rep", "times").withColumn("sound", F.lit(True)),
                                                                        ["sound", "h1", "h2"], "left").select("vec_id", "rep", "times"), "members")
    alone = members.select("vec_id", F.coalesce(F.col("times") - 1, F.lit(0)).alias("n_links"), "rep")
    if width is None:
        return alone.select("vec_id", "n_links", F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(PIVOT_SAMPLE).select("vector").toArrow().column("vector").combine_chunks()
    pivots = choose_pivots(padded(sample, width))
    near = min(near, len(pivots))
    shared = min(shared, near)
    described = written(describe(classes.select("rep", "times", "vector"), pivots, near), "described")
    picks = list(combinations(range(near), shared))
    wanted = F.explode(F.array(*[F.sort_array(F.array(*[F.col("pivots")[p] for p in c])) for c in picks]))
    listed = described.select("rep", wanted.alias("wanted")).select("rep", "wanted", F.expr(f"aggregate(wanted, 0L, (s, p) -> s * {len(pivots)} + p)").alias("list"))
    lists = listed.groupBy("list").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    dealt = (listed.join(lists, "list").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("rep", "wanted", "list", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    groups = dealt.join(described, "rep").repartition("list", "i", "j").sortWithinPartitions("list", "i", "j", "rep")
    links = written(verified(groups, width, threshold, near, shared), "links")
    counts = links.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    parts = components(links.select("a", "b")).withColumnRenamed("node", "rep")
    return (alone.join(counts, "rep", "left").join(parts, "rep", "left")
            .select("vec_id", (F.col("n_links") + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
