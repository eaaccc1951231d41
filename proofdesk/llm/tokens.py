"""Ids of whole texts by the tokenizers library, each distinct word encoded once per batch.

Correct for a tokenizer whose white space always ends a pre-token and leaves no id (as word_bpe_49k.json: white space is dropped, no
pattern, normaliser step or added token reaches across it); `checked` verifies that on the loaded file.
"""
from __future__ import annotations

import functools
import os
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .base import Memo, Words, listed, ragged, slices

END_ID = 2


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A word of Latin letters with marks behind it: lower-casing is all that normalising does to it, and letters and marks are a pre-token each.
SIMPLE = r"^(?P<core>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+)(?P<tail>[.,;:!?]*)$"


@functools.lru_cache(maxsize=2)
def unit_memo(path: str) -> Memo:
    """Ids, as bytes, of a pre-token in lower case, which the library's model alone encodes, or of a word with a space before it."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    checked(tokenizer)
    tokenize, encode, spell = tokenizer.model.tokenize, tokenizer.encode, byte_letters()

    def compute(unit: str) -> bytes:
        if unit[0] == " ":  # a whole word
            return array("I", encode(unit[1:], add_special_tokens=False).ids).tobytes()
        text = unit if unit.isascii() else unit.encode().decode("latin-1").translate(spell)
        return array("I", [t.id for t in tokenize(text)]).tobytes()

    return Memo(compute, 300_000)


def checked(tokenizer) -> None:
    """Raise unless encoding word by word gives what encoding the whole text gives, and a plain word is one pre-token."""
    for text in ("Ab cd", " x\ty\n", "don't 12 a1, b.", "é é ́x", "a<|endoftext|> b", "ΑΣ σ", "Word,", "it?!"):
        whole = tokenizer.encode(text, add_special_tokens=False).ids
        parts = [i for w in text.split() for i in tokenizer.encode(w, add_special_tokens=False).ids]
        if whole != parts:
            raise ValueError("this tokenizer does not end its pre-tokens at white space")
    if tokenizer.encode("word?!", add_special_tokens=False).ids != [t.id for s in ("word", "?!") for t in tokenizer.model.tokenize(s)]:
        raise ValueError("this tokenizer does not take letters and the marks behind them as one pre-token each")


@functools.cache
def byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable letter: itself where printable, else the next free code point from 256."""
    kept = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    moved = (b for b in range(256) if b not in kept)
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}


def gathered(each: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the units that `codes` name, in order, length of each)."""
    lengths = np.fromiter(map(len, each), dtype=np.int64, count=len(each)) // 4
    flat = np.frombuffer(b"".join(each), dtype=np.uint32)
    own = lengths[codes]
    return (flat[ragged((np.cumsum(lengths) - lengths)[codes], own)] if len(own) else flat[:0]), own


def encode_column(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in order, bounds of each text)."""
    words = Words(column)
    memo = unit_memo(path).alone()
    distinct = words.values
    parts = pc.extract_regex(distinct, SIMPLE)
    simple = parts.is_valid()
    # each distinct word is two units: core and marks, or itself and nothing
    units = pa.concat_arrays([pc.if_else(simple, pc.utf8_lower(pc.struct_field(parts, 0)), pc.binary_join_element_wise("", distinct, " ")), pc.if_else(simple, pc.struct_field(parts, 1), "")])
    units = pc.fill_null(units, "").dictionary_encode()
    ids, own = gathered([memo[u] if u else b"" for u in listed(units.dictionary)], units.indices.to_numpy().reshape(2, -1).T.reshape(-1))
    own = own.reshape(-1, 2).sum(axis=1)  # of each distinct word
    ids = ids[ragged((np.cumsum(own) - own)[words.codes], own[words.codes])] if len(words.codes) else ids[:0]
    return ids, np.concatenate([[0], np.cumsum(own[words.codes])])[words.bounds]


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The same with `end_id` behind each text."""
    n = len(bounds) - 1
    out = np.full(len(ids) + n, end_id, dtype=np.uint32)
    own = np.ones(len(out), dtype=bool)
    new = bounds + np.arange(n + 1)
    own[new[1:] - 1] = False
    out[own] = ids
    return out, new


def encoded(batches: Iterable[pa.RecordBatch], path: str, end_id: int | None = END_ID) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each slice of a batch with the ids of its `text` column."""
    for batch in slices(batches):
        ids, bounds = encode_column(batch.column("text"), path)
        if end_id is not None:
            ids, bounds = with_end(ids, bounds, end_id)
        yield batch, ids, bounds
