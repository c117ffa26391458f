"""Words of Arrow string batches, and hashes of their windows.

Words are the maximal runs of characters outside ``[\\x20\\x09-\\x0D]``.  A
batch is split and dictionary-encoded by Arrow, so what costs Python time is
done once per distinct word: its hash is the first 64 bits of BLAKE2b, for which
no two words of equal hash can be constructed.

Null texts count as empty; empty texts have no words.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MUL = [U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB),
        U64(0x8EBC6AF09C88C6E3), U64(0x589965CC75374CC3)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Words(NamedTuple):
    distinct: pa.Array  #: the different words
    code: np.ndarray  #: of each word, in order: its place in ``distinct``
    doc: np.ndarray  #: of each word: the number of its text
    texts: int


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """The words of some texts; ``lower`` folds A-Z first."""
    # An array of its own: Arrow's lower-casing misreads slices.
    data, offsets = text_buffer(texts)
    texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = split.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = split.offsets.to_numpy()
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    blank = pc.index(coded.dictionary, pa.scalar("", pa.large_string())).as_py()
    if blank >= 0:  # white space at the ends of a text gives empty words
        some = code != blank
        code, doc = code[some], doc[some]
    return Words(coded.dictionary, code, doc, len(texts))


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=8).digest() for w in words.cast(pa.large_binary()).to_pylist()]), U64)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its n + 1 offsets, from 0; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary() if texts.null_count == 0 else pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("").cast(pa.large_binary())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words of a batch, and each word's text number."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | cut[1:-1]
    last[:-1] &= ~word[1:] | cut[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def windows(words: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word windows inside one text, and the first word of each."""
    if len(words) < width:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[width - 1:] == doc[: len(doc) - width + 1])
    h = np.full(len(at), U64(width), U64)
    for i in range(width):
        h = (h ^ words[at + i]) * _MUL[i % len(_MUL)]
        h ^= h >> U64(29)
    return mix(h), at


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct ``width``-word shingles of each text, as 64-bit hashes.

    A text of fewer words is one shingle, its whole sequence; a text without
    words (or null) has the empty set.
    """
    split = split_words(texts, lower=True)
    doc, n = split.doc, split.texts
    words = hashes(split.distinct)[split.code] if len(doc) else np.zeros(0, U64)
    found, at = windows(words, doc, width)
    cuts = np.searchsorted(doc[at], np.arange(n + 1)) if len(at) else np.zeros(n + 1, np.int64)
    bounds = np.searchsorted(doc, np.arange(n + 1))
    sets = []
    for i in range(n):
        if cuts[i] < cuts[i + 1]:
            own = np.sort(found[cuts[i]: cuts[i + 1]])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif bounds[i] < bounds[i + 1]:
            few = words[bounds[i]: bounds[i + 1]]
            own, _ = windows(few, np.zeros(len(few), np.int64), len(few))
        else:
            own = np.zeros(0, U64)
        sets.append(own)
    return sets
