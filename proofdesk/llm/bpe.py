"""Exact BPE by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton over all reversed tokens, run once over the reversed pre-token, names the longest token that begins at each
position. The encoder takes it if the pair with the token before is compatible (the merges of both, written side by side, would not have
merged across the border); else the longest shorter token; else it steps back and never ends a token at that position again. Each position
is given up at most once, so the time is linear in the pre-token. A sequence whose neighbours are all compatible is the merges' own result.

The decoder keeps all tokens' bytes in one string and an offset per id, and gathers the ids' spans.

Defined results: a null text is empty: no ids and an empty decoded text. Repeated rows stay; an empty table gives no rows; further columns are
not read. Special strings inside texts become their ids, as the library does.
"""
from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import Memo, Words, ragged, slices, texts
from .tokens import byte_letters

GATHER = 500_000


class WordBPE:
    """A word-end BPE tokenizer file: byte-level letters, lower case, NFC, white space dropped.

    Inside, a byte is the code point of its value, and the last byte of a pre-token is 256 higher.
    """

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not self.suffix or steps != ["NFC", "Replace", "Lowercase"] or spec.get("decoder"):
            raise ValueError("only word-end BPE with NFC and lower case and without a decoder is read here")
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.added = sorted(((t["content"], t["id"]) for t in spec["added_tokens"]), key=lambda t: -len(t[0]))
        self.added_at = regex.compile("|".join(regex.escape(c) for c, _ in self.added)) if self.added else None
        self.added_id = dict(self.added)
        letters = {c: b for b, c in byte_letters().items()}

        def inner(token: str) -> str:
            if token.endswith(self.suffix) and token != self.suffix:
                token = token[:-len(self.suffix)]
                return "".join(chr(letters[c]) for c in token[:-1]) + chr(256 + letters[token[-1]])
            return "".join(chr(letters[c]) for c in token)

        vocab = model["vocab"]
        self.ids = {inner(t): i for t, i in vocab.items()}
        self.length = np.ones(max(vocab.values()) + 1, dtype=np.int64)
        for t, i in self.ids.items():
            self.length[i] = len(t)
        self.length = self.length.tolist()
        self.split: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            l, r = vocab[left], vocab[right]
            made = vocab[(left[:-len(self.suffix)] if left.endswith(self.suffix) else left) + right]
            if made <= max(l, r) and max(l, r) >= len(vocab) - len(model["merges"]):
                raise ValueError("ids do not follow the order of the merges")
            self.pair[l, r] = made
            self.split[made] = (l, r)
        whole = {t: i for t, i in self.ids.items() if i not in self.split or self.compatible(*self.split[i], limit=i)}
        self.shorter = {i: next((whole[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in whole), None) for t, i in whole.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in whole.items():
            self.automaton.add_word(t[::-1], i)
        self.automaton.make_automaton()
        # decoding: without a decoder the library joins the tokens' own spelling by spaces
        spelled = {i: t for t, i in vocab.items()} | {i: c for c, i in self.added}
        parts = [(spelled[i] + " ").encode() if i in spelled else b"" for i in range(max(spelled) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def compatible(self, left: int, right: int, limit: int = 1 << 40) -> bool:
        """Whether merging, with only merges below `limit`, leaves a border between these two tokens."""
        pair, split = self.pair, self.split
        while True:
            if pair.get((left, right), limit) < limit:
                return False
            # undo the later of the two merges; before it, its half at the border stood there
            if left > right and left in split or right not in split:
                if left not in split:
                    return True
                limit, left = min(limit, left), split[left][1]
            else:
                limit, right = min(limit, right + 1), split[right][0]

    def encode_run(self, word: str) -> list[int]:
        """Ids of one pre-token in the inner alphabet."""
        whole = self.ids.get(word)
        if whole is not None and (whole in self.shorter):
            return [whole]
        n, length, shorter, compatible = len(word), self.length, self.shorter, self.compatible
        longest = [-1] * n
        for end, i in self.automaton.iter(word[::-1]):
            at = n - 1 - end
            if longest[at] < 0 or length[i] > length[longest[at]]:
                longest[at] = i
        out, free, at = [], bytearray(b"\1") * (n + 1), 0
        token = longest[0]
        while at < n:
            while token is not None:
                end = at + length[token]
                if free[end] and (not out or compatible(out[-1], token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else None
                    break
                token = shorter[token]
            else:
                free[at] = 0
                token = out.pop()
                at -= length[token]
        return out

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of what stands between two white spaces."""
        text, out = word.decode("utf-8", "replace"), []
        at = 0
        for found in self.added_at.finditer(text) if self.added_at and "<" in text else ():
            out += self.plain(text[at:found.start()])
            out.append(self.added_id[found.group()])
            at = found.end()
        return out + self.plain(text[at:])

    def plain(self, text: str) -> list[int]:
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        text = text.lower() if text.isascii() else "".join(c.lower() for c in text)
        return [i for run in self.pattern.findall(text) for i in self.runs[run]]

    @functools.cached_property
    def runs(self) -> Memo:
        def of(run: str) -> list[int]:
            raw = run.encode("utf-8", "surrogatepass").decode("latin-1")
            return self.encode_run(raw[:-1] + chr(256 + ord(raw[-1])))

        return Memo(of, 200_000)

    def decode_bytes(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The decoded UTF-8 text of each run of ids."""
        known = np.minimum(ids, len(self.offsets) - 2)
        size = np.where(ids == known, self.offsets[known + 1] - self.offsets[known], 0)
        parts = [self.bytes[ragged(self.offsets[known[a:a + GATHER]], size[a:a + GATHER])].tobytes() for a in range(0, len(ids), GATHER)]
        raw, ends = b"".join(parts), np.concatenate([[0], np.cumsum(size)])
        return [raw[a:max(a, b - 1)] for a, b in zip(ends[bounds[:-1]].tolist(), ends[bounds[1:]].tolist())]


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> tuple[WordBPE, Memo]:
    bpe = WordBPE(path)
    return bpe, Memo(lambda w: array("I", bpe.encode_word(w)).tobytes())


def encode_column(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in order, bounds of each text)."""
    words, (bpe, memo) = Words(column), word_bpe(path)
    memo.alone(bpe.runs)
    each = [memo[w] for w in words.distinct]
    lengths = np.fromiter(map(len, each), dtype=np.int64, count=len(each)) // 4
    flat = np.frombuffer(b"".join(each), dtype=np.uint32)
    starts, of_words = np.cumsum(lengths) - lengths, lengths[words.codes]
    ids = flat[ragged(starts[words.codes], of_words)] if len(of_words) else np.zeros(0, np.uint32)
    return ids, np.concatenate([[0], np.cumsum(of_words)])[words.bounds]


def encode_decode(docs: DataFrame, tokenizer: str, outputs: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document; with `outputs` also the ids and the decoded text."""

    def run(batches):
        for batch in slices(batches):
            ids, bounds = encode_column(batch.column("text"), tokenizer)
            raw = ids.astype("<u4", copy=False)
            back = word_bpe(tokenizer)[0].decode_bytes(ids, bounds)
            own = [raw[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            cols = [batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in own], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if outputs:
                cols += [pa.array(own, pa.binary()), pa.array([x.decode() for x in back], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * outputs)
