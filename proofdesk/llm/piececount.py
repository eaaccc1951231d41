"""Counting sentencepiece BPE tokens without making them: rank-synchronous merging over ragged numpy arrays.

A text is cut where no piece of the vocabulary can reach across: before a word's mark, and between two characters that stand next to each
other in no piece. Each distinct pre-token is merged once per batch: all of them lie in flat arrays (one symbol per entry), every round finds
each sequence's lowest-rank pair and merges it in all sequences at once, and what survives is counted. Where a pair's merging cannot
bring up a pair of the same or a lower rank, all its occurrences in the sequence merge in that round; otherwise the leftmost alone, which
is the library's order. A character outside the vocabulary counts as its UTF-8 bytes.

Defined results: a null or empty text has 0 bytes and 0 tokens; control strings inside texts are plain text; white space is kept as
it is; repeated rows stay; an empty table gives no rows; further columns are not read.
"""
from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .base import Memo, slices, texts

MARK = "▁"
NO_PAIR = np.iinfo(np.int64).max
OVER = 4096


class PieceCounter:
    """The merges of a sentencepiece BPE model as sorted arrays of pair keys."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.encode("A  b\tc", out_type=str) != ["▁A", MARK, "▁b", "<0x09>", "c"] or model.normalize("ﬁ ") != "▁ﬁ▁":
            raise ValueError("only models that normalise nothing, keep white space and add a first mark are counted here")
        pieces = {model.id_to_piece(i): i for i in range(model.get_piece_size())
                  if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.n = model.get_piece_size()
        scores = {i: model.get_score(i) for i in pieces.values()}
        by_score = sorted(set(scores.values()), reverse=True)
        rank_of_score = {s: r for r, s in enumerate(by_score)}
        self.char_id = np.full(0x110000, -1, dtype=np.int32)
        self.char_bytes = np.ones(0x110000, dtype=np.int8)
        for start, size in ((0x80, 2), (0x800, 3), (0x10000, 4)):
            self.char_bytes[start:] = size
        for piece, i in pieces.items():
            if len(piece) == 1:
                self.char_id[ord(piece)] = i
        pairs, bigrams = [], set()
        for piece, i in pieces.items():
            for cut in range(1, len(piece)):
                bigrams.add(ord(piece[cut - 1]) << 21 | ord(piece[cut]))
                left, right = pieces.get(piece[:cut]), pieces.get(piece[cut:])
                if left is not None and right is not None:
                    pairs.append((left * self.n + right, rank_of_score[scores[i]], i))
        pairs.sort()
        self.keys = np.array([p[0] for p in pairs], dtype=np.int64)
        self.ranks = np.array([p[1] for p in pairs], dtype=np.int64)
        self.merged = np.array([p[2] for p in pairs], dtype=np.int64)
        self.bigrams = np.array(sorted(bigrams), dtype=np.int64)
        # a merged symbol is quiet if each pair that it can enter has a higher rank than any pair that makes it
        worst = np.full(self.n, -1, dtype=np.int64)
        np.maximum.at(worst, self.merged, self.ranks)
        least = np.full(self.n, NO_PAIR, dtype=np.int64)
        np.minimum.at(least, self.keys // self.n, self.ranks)
        np.minimum.at(least, self.keys % self.n, self.ranks)
        self.quiet = least > worst
        # Long runs of marks: their merges come last and from the left, so once the longest piece of marks stands it is final and what is
        # behind it merges as if alone. That holds if nothing else has their rank or holds two marks; the counts are tried, too.
        runs = {len(p): i for p, i in pieces.items() if not p.strip(MARK)}
        longest, self.run = max(runs, default=1), 0
        others = [i for p, i in pieces.items() if len(p) > 1 and p.strip(MARK)]
        alone = not any(MARK * 2 in p and p.strip(MARK) for p in pieces) and {scores[i] for n, i in runs.items() if n > 1} == {by_score[-1]}
        if longest > 1 and alone and all(scores[i] > by_score[-1] for i in others):
            tried = self.count([MARK * n for n in range(1, 4 * longest)]).tolist()
            if all(tried[n + longest] == tried[n] + 1 for n in range(len(tried) - longest)) and tried[longest - 1] == 1:
                self.run = longest

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of adjacent symbols; NO_PAIR where they do not merge."""
        key = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NO_PAIR), np.where(hit, self.merged[at], -1)

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        symbols = self.char_id[chars].astype(np.int64)
        tokens = np.bincount(word, np.where(symbols < 0, self.char_bytes[chars], 1), len(words)).astype(np.int64)
        if len(chars) < 2:
            return tokens
        # sequences end at words and where two characters never meet in a piece; one symbol alone has nothing to merge
        pair = chars[:-1] << 21 | chars[1:]
        at = np.minimum(np.searchsorted(self.bigrams, pair), len(self.bigrams) - 1)
        joined = (self.bigrams[at] == pair) & (word[1:] == word[:-1]) & (symbols[:-1] >= 0) & (symbols[1:] >= 0)
        linked = np.concatenate([joined, [False]]) | np.concatenate([[False], joined])
        ahead = np.concatenate([joined, [False]])[linked]
        symbols, word = symbols[linked], word[linked]
        while len(symbols):
            # `ahead`: the next symbol is in the same sequence
            nxt = np.concatenate([symbols[1:], [-1]])
            rank, made = self.look_up(np.where(ahead, symbols, -1), nxt)
            heads = np.flatnonzero(np.concatenate([[True], ~ahead[:-1]]))
            low = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.concatenate([heads, [len(symbols)]]))
            best = np.repeat(low, sizes)
            chosen = (rank == best) & (rank != NO_PAIR)
            first = np.minimum.reduceat(np.where(chosen, np.arange(len(symbols)), len(symbols)), heads)
            loud = chosen & ~self.quiet[made]
            only_first = np.repeat(np.logical_or.reduceat(loud, heads), sizes)
            chosen &= ~only_first | (np.arange(len(symbols)) == np.repeat(first, sizes))
            # in a run of overlapping pairs every other one merges, from the left
            at = np.flatnonzero(chosen)
            new_run = np.concatenate([[True], np.diff(at) != 1]) if len(at) else np.zeros(0, bool)
            start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0)) if len(at) else at
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            tokens -= np.bincount(word[at], minlength=len(tokens))
            symbols = symbols.copy()
            symbols[at] = made[at]
            ahead[at] = ahead[at + 1]
            keep = np.repeat(low != NO_PAIR, sizes)
            keep[at + 1] = False
            symbols, word, ahead = symbols[keep], word[keep], ahead[keep]
        return tokens

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """(pre-tokens of one text of any shape, tokens cut off from long runs of marks)."""
        if not text:
            return [], 0
        whole, cut = [], 0
        for part in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK)):
            marks = len(part) - len(part.lstrip(MARK))
            if self.run and marks > self.run:
                groups = (marks - 1) // self.run
                cut += groups
                part = part[groups * self.run:]
            whole.append(part)
        return whole, cut


@functools.lru_cache(maxsize=2)
def piece_counter(path: str) -> tuple[PieceCounter, Memo]:
    return PieceCounter(path), Memo(None, 600_000)


def count_column(column: pa.Array, path: str) -> np.ndarray:
    """Tokens of every text of an Arrow string array without nulls."""
    counter, memo = piece_counter(path)
    memo.alone()
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    odd = pc.or_(pc.or_(pc.match_substring(column, "  "), pc.match_substring(column, MARK)), pc.starts_with(column, " "))
    odd = pc.or_(odd, pc.equal(column, "")).to_numpy(zero_copy_only=False)
    plain = pc.if_else(pa.array(odd), "", column)
    split = pc.split_pattern(plain, " ")
    offsets = split.offsets.to_numpy().astype(np.int64)
    flat = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    codes, distinct = flat.indices.to_numpy(zero_copy_only=False), [MARK + w for w in flat.dictionary.to_pylist()]
    others = {i: counter.pre_tokens(column[i].as_py()) for i in np.flatnonzero(odd)}
    wanted = set(distinct).union(*(p for p, _ in others.values()))
    missing = [w for w in wanted if w not in memo]
    known: dict = memo
    if len(memo) + len(missing) > memo.entries:  # full: keep what this batch uses and start anew
        known = {w: memo[w] for w in wanted if w in memo}
        memo.clear()
    for start in range(0, len(missing), 100_000):
        part = missing[start:start + 100_000]
        known.update(zip(part, counter.count(part).tolist()))
    by_word = np.fromiter((known[w] for w in distinct), dtype=np.int64, count=len(distinct))
    total = np.concatenate([[0], np.cumsum(by_word[codes])])
    out = total[offsets[1:] - offsets[0]] - total[offsets[:-1] - offsets[0]]
    for i, (parts, cut) in others.items():
        out[i] = sum(known[p] for p in parts) + cut
    return out


def count_tokens(docs: DataFrame, model: str, over: int = OVER) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > over) of every document."""

    def run(batches):
        for batch in slices(batches):
            text = batch.column("text")
            n = count_column(text, model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(text).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(n > over)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
