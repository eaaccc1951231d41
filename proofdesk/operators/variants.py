"""Hold-out hygiene: every copy of a held entry leaves the corpus that answers it.

Five signals mark a copy: same id; same block on another url; similar question; token Jaccard; shingle
containment. Each is its own join driven by the held side: ids and blocks are broadcast when measured small, token and
shingle sets are indexed in bounded blocks, so the corpus is scanned and never shuffled; only matches are. No pair is formed without
a shared key, except for the question ratio, which has no exact index: there each task compares its questions to the held ones in
place, after bounds on shared letters and on the longest common subsequence.
"""
from __future__ import annotations

from array import array
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import bounded_blocks, broadcast_if_bounded, cut_lineage
from . import overlap

# Inclusive thresholds of the three similarity signals.
QUESTION_RATIO, JACCARD_MIN, CONTAINMENT_MIN = 0.6, 0.3, 0.2

HELD_TITLE_LIMIT = 5_000
HELD_TITLE_BYTES = 2 << 20
PAIR_CELLS = 1_000_000  # titles x held titles compared at a time within a task, titles x letters too


def jaccard_pairs(held: DataFrame, other: DataFrame, minimum: float = JACCARD_MIN) -> DataFrame:
    """held(held_ord, text) x other(entry_ord, text) with distinct-token Jaccard >= minimum (> 0)."""
    return overlap.jaccard(held, other, minimum)


def containment_pairs(held: DataFrame, other: DataFrame, n: int = T.SHINGLE_WORDS, minimum: float = 0.0) -> DataFrame:
    """Pairs sharing a shingle, with the contained share seen from either side; one of both is at least `minimum`."""
    return overlap.containment(held, other, n, minimum)


def _codes(title: str) -> np.ndarray:
    return np.frombuffer(title.encode("utf-32-le"), dtype=np.uint32)


def _letters(titles, alphabet: np.ndarray) -> np.ndarray:
    """Character counts over an alphabet; other characters cannot match and are left out."""
    out = np.zeros((len(titles), len(alphabet)), dtype=np.int32)
    for row, title in enumerate(titles):
        codes = _codes(title)
        slot = np.minimum(np.searchsorted(alphabet, codes), len(alphabet) - 1)
        out[row] = np.bincount(slot[alphabet[slot] == codes], minlength=len(alphabet))
    return out


def _places(title: str) -> dict[str, int]:
    """Per character, a bit for every position that holds it."""
    out: dict[str, int] = {}
    for i, ch in enumerate(title):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


def _common_subsequence(places: dict[str, int], size: int, other: str) -> int:
    """Length of the longest common subsequence, bit-parallel: one addition per character of `other`.

    difflib's matching blocks keep their order in both texts, so their total never exceeds it.
    """
    full = (1 << size) - 1
    rows = full
    for ch in other:
        hit = rows & places.get(ch, 0)
        rows = ((rows + hit) | (rows - hit)) & full
    return size - rows.bit_count()


def _may_reach(common: int, total: int, minimum: float) -> bool:
    return total == 0 or 2.0 * common >= minimum * total - 1e-6


def _length_bounds(size, minimum: float):
    """Lengths that a partner of a title of this length has: 2 * common >= minimum * (both lengths), and no more is common than the shorter one has."""
    return np.floor(size * minimum / (2 - minimum) - 1e-6), np.ceil(size * (2 - minimum) / minimum + 1e-6)


def question_pairs(held: DataFrame, other: DataFrame, minimum: float = QUESTION_RATIO) -> DataFrame:
    """held(held_ord, question) x other(entry_ord, question): difflib ratio of lower-cased questions >= minimum.

    One plan at every size: the distinct held titles are dealt by hash into bounded blocks, by rows and bytes, and each block meets all other titles in the tasks
    that scan them. No titles are shuffled against each other; a title's pairs are then handed to all held entries that bear it. A null question has no pairs.
    Titles of a length that no title of the block can match stay out of the tasks' Python.
    """
    h = held.select("held_ord", F.lower("question").alias("q")).where("q is not null")
    o = other.select("entry_ord", F.lower("question").alias("q")).where("q is not null")
    titles = cut_lineage(h.select("q").distinct().withColumn("title", F.monotonically_increasing_id()))
    schema = "title long, entry_ord long, ratio double"
    parts = []
    for rows, _ in bounded_blocks(titles, "title", "q", max(1, HELD_TITLE_LIMIT), HELD_TITLE_BYTES):
        kept = [(r["title"], r["q"]) for r in rows]
        low, high = _length_bounds(np.array([min(len(q) for _, q in kept), max(len(q) for _, q in kept)]), minimum)
        parts.append(o.where(F.length("q").between(int(low[0]), int(high[1]))).mapInPandas(_against_titles(kept, minimum), schema))
    pairs = reduce(DataFrame.unionByName, parts) if parts else held.sparkSession.createDataFrame([], schema)
    bearers = broadcast_if_bounded(h.join(titles, "q").select("title", "held_ord"))
    return pairs.join(bearers, "title").select("held_ord", "entry_ord", "ratio")


def _against_titles(kept: list, minimum: float):
    """Pairs of a block's titles with those of each batch: by length, then by shared characters, then by common subsequence, then exactly."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        alphabet = np.unique(np.concatenate([_codes(q + " ") for _, q in kept] or [_codes(" ")]))
        letters = _letters([q for _, q in kept], alphabet)
        sizes, places = [len(q) for _, q in kept], [_places(q) for _, q in kept]
        step = max(16, PAIR_CELLS // max(1, len(kept), len(alphabet)))
        matcher = SequenceMatcher()
        for pdf in (b.iloc[at:at + step] for b in batches for at in range(0, len(b), step)):
            where, titles = pd.factorize(pdf["q"].to_numpy(dtype=object))  # as objects: a text array is as wide as its longest title in each row
            length = np.fromiter(map(len, titles), np.int64, len(titles))
            order = np.argsort(length, kind="stable")
            mine, length = _letters(titles[order], alphabet), length[order]
            near: dict[int, list[int]] = {}
            for j, size in enumerate(sizes):
                shortest, longest = _length_bounds(size, minimum)
                low, high = np.searchsorted(length, shortest, side="left"), np.searchsorted(length, longest, side="right")
                common = np.minimum(mine[low:high], letters[j]).sum(1)
                for i in np.flatnonzero(2.0 * common >= minimum * (length[low:high] + size) - 1e-6).tolist():
                    near.setdefault(low + i, []).append(j)
            found = array("q"), array("q"), array("d")
            for i, held_rows in near.items():
                title = titles[order[i]]
                held_rows = [j for j in held_rows if _may_reach(_common_subsequence(places[j], sizes[j], title), sizes[j] + len(title), minimum)]
                if held_rows:
                    matcher.set_seq2(title)  # the index over the second text serves every held one
                for j in held_rows:
                    matcher.set_seq1(kept[j][1])
                    ratio = matcher.ratio()
                    if ratio >= minimum:
                        for column, value in zip(found, (int(order[i]), kept[j][0], ratio)):
                            column.append(value)
            hit = pd.DataFrame({n: np.array(c, dtype=c.typecode) for n, c in zip(("i", "title", "ratio"), found)})
            rows = pd.DataFrame({"i": where.astype("int64"), "entry_ord": pdf["entry_ord"].to_numpy()})
            yield rows.merge(hit, on="i")[["title", "entry_ord", "ratio"]]
    return run


def variants(entries: DataFrame, held: DataFrame, *, question_ratio: float | None = QUESTION_RATIO,
             jaccard_min: float = JACCARD_MIN, containment_min: float = CONTAINMENT_MIN) -> DataFrame:
    """(held_ord, entry_ord) of every entry that is a copy of a held one, itself included.

    `entries` and `held` hold entry_ord, id, url, block, question, answer. `question_ratio=None` leaves the
    question signal out. Not transitive: a copy of a copy stays unless it matches the held entry itself.
    """
    h = held.withColumnRenamed("entry_ord", "held_ord")
    ids = broadcast_if_bounded(h.select("held_ord", "id"))
    blocks = broadcast_if_bounded(h.select("held_ord", "block", F.col("url").alias("held_url")))
    whole = F.concat("question", F.lit(" "), "answer").alias("text")
    pair = ("held_ord", "entry_ord")
    signals = [
        entries.select("entry_ord", "id").join(ids, "id").select(*pair),
        entries.select("entry_ord", "block", "url").join(blocks, "block")
        .where(F.col("url") != F.col("held_url")).select(*pair),
        jaccard_pairs(h.select("held_ord", whole), entries.select("entry_ord", whole), jaccard_min).select(*pair),
        containment_pairs(h.select("held_ord", F.col("answer").alias("text")),
                          entries.select("entry_ord", F.col("answer").alias("text")), minimum=containment_min).select(*pair),
    ]
    if question_ratio is not None:
        signals.append(question_pairs(h, entries, question_ratio).select(*pair))
    out = signals[0]
    for s in signals[1:]:
        out = out.unionByName(s)
    return out.distinct()


def without_variants(entries: DataFrame, held: DataFrame, **thresholds) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) for a held set taken as a whole: kept loses every copy of any held entry."""
    gone = broadcast_if_bounded(cut_lineage(variants(entries, held, **thresholds).select("entry_ord").distinct()))
    return entries.join(gone, "entry_ord", "left_anti"), entries.join(gone, "entry_ord", "left_semi")
