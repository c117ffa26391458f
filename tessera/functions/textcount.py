"""All handcrafted features of texts from counts, in Arrow batches: one narrow pass, no shuffle.

Every code point has a class (a combination of flags such as letter, upper case,
Latin), so a batch's characters are counted by (text, class) once, and all
shares of characters are sums of these counts.  The words of a batch are split
and numbered once; counts by (text, word) give diversity, lengths and entropy.

Null texts are empty.  Lower case goes character by character, so U+0130 is one
character as well, where the column expressions of ``text`` make two of it.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SENTENCE

#: The flags of code points, by pattern.
CLASSES = {"digit": r"\p{Nd}", "alpha": r"\p{L}", "upper": r"\p{Lu}", "lower": r"\p{Ll}", "space": r"[ \t\n\r]", "punctuation": r"\p{P}", "symbol": r"\p{S}", "non_ascii": r"[^\x00-\x7F]",
           "latin": r"\p{Script=Latin}", "arabic": r"\p{Script=Arabic}", "cyrillic": r"\p{Script=Cyrillic}", "han": r"\p{Script=Han}", "hiragana": r"\p{Script=Hiragana}",
           "katakana": r"\p{Script=Katakana}", "hangul": r"\p{Script=Hangul}", "newline": r"\n", "question": "[?؟]", "exclamation": "!", "sentence": f"[{SENTENCE}]", "blank": " ",
           "stop": r"[\n\r\x85\u2028\u2029]"}
SCRIPTS = ("latin", "arabic", "cyrillic", "han", "hiragana", "katakana", "hangul")
URL, EMAIL = r"https?://[^ \n]+", r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"
NAMES = ("chars", "words", "sentences", "lines", "questions", "exclamations", "digit", "alpha", "upper", "lower", "space", "punctuation", "symbol", "non_ascii", *SCRIPTS, "urls", "emails",
         "repeats", "symbols", "unique_ratio", "log_ttr", "per_root_char", "word_mean", "word_max", "word_std", "hapax_ratio", "newline_ratio", "numeric_ratio", "empty", "token_entropy", "char_entropy")
PART = 500_000  # characters counted together, or one text: some hundred bytes each while they are counted
ROWS = 256  # texts that are Python strings at once


@functools.cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of each code point, and the flags [classes, names] of each class."""
    import regex

    every = "".join(map(chr, [c if not 0xD800 <= c < 0xE000 else 0 for c in range(0x110000)]))
    bits = np.zeros(0x110000, np.int64)  # one number a code point: a table of flags would take a hundred MB
    for i, pattern in enumerate(CLASSES.values()):
        for m in regex.finditer(f"(?:{pattern})+", every):
            bits[m.start(): m.end()] |= 1 << i
    bits[0xD800:0xE000] = 0
    values, number = np.unique(bits, return_inverse=True)
    return number.astype(np.int64), ((values[:, None] >> np.arange(len(CLASSES))) & 1).astype(np.int64)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different lower-cased words, and of each word in order its number and its text's."""
    split = pc.split_pattern_regex(texts, r"[^\p{L}\p{N}_]+")
    coded = pc.utf8_lower(split.flatten()).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    blank = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if blank >= 0:
        some = code != blank
        code, doc = code[some], doc[some]
    return coded.dictionary, code, doc


def _entropy(doc: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Entropy in bits of each text's counts."""
    total = np.bincount(doc, weights=count, minlength=n)
    inner = np.bincount(doc, weights=count * np.log2(count), minlength=n)
    some = np.maximum(total, 1)
    return np.where(total > 0, np.log2(some) - inner / some, 0.0)


def _part(texts: list[str]) -> np.ndarray:
    n = len(texts)
    arrow = pa.array(texts, pa.large_string())
    points = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    chars = np.array([len(p) // 4 for p in points], np.int64)
    cp = np.frombuffer(b"".join(points), "<u4").astype(np.int64)
    doc = np.repeat(np.arange(n), chars)
    number, flags = _classes()
    kinds = number[cp]
    counts = np.bincount(doc * len(flags) + kinds, minlength=n * len(flags)).reshape(n, -1) @ flags
    by = dict(zip(CLASSES, counts.T.astype(float), strict=True))
    same = np.zeros(len(cp), bool)  # as the character before, in one text
    same[1:] = (cp[1:] == cp[:-1]) & (doc[1:] == doc[:-1])
    ends = flags[kinds, list(CLASSES).index("sentence")] > 0
    first = ends.copy()
    first[1:] &= ~(ends[:-1] & (doc[1:] == doc[:-1]))
    # A run of three equal characters or more counts once, at its third.
    third = np.zeros(len(cp), bool)
    third[2:] = same[2:] & same[1:-1] & ~same[:-2]
    third &= flags[kinds, list(CLASSES).index("stop")] == 0
    keys, many = np.unique(doc << 21 | cp, return_counts=True)
    names, code, owner = words_of(arrow)
    size = max(1, len(names))
    pairs, times = np.unique(owner * size + code, return_counts=True)
    own, which = pairs // size, pairs % size
    length = pc.utf8_length(names).to_numpy(zero_copy_only=False).astype(float) if len(names) else np.zeros(0)
    numeric = pc.match_substring_regex(names, r"^\p{N}+$").to_numpy(zero_copy_only=False) if len(names) else np.zeros(0, bool)
    add = lambda weights: np.bincount(own, weights=weights, minlength=n)
    w, d, once = add(times.astype(float)), add(np.ones(len(own))), add((times == 1).astype(float))
    long, square, digits = add(length[which] * times), add(length[which] ** 2 * times), add(numeric[which] * times.astype(float))
    top = np.zeros(n)
    np.maximum.at(top, own, length[which])
    share = lambda a, b: np.where(b > 0, a / np.where(b > 0, b, 1), 0.0)
    mean, letters, size_ = share(long, w), by["alpha"], chars.astype(float)
    return np.stack([
        size_, w, np.bincount(doc, weights=first.astype(float), minlength=n), by["newline"] + 1, by["question"], by["exclamation"],
        share(by["digit"], size_), share(letters, size_), share(by["upper"], letters), share(by["lower"], letters), share(by["space"], size_), share(by["punctuation"], size_),
        share(by["symbol"], size_), share(by["non_ascii"], size_), *(share(by[s], letters) for s in SCRIPTS),
        pc.count_substring_regex(arrow, URL).to_numpy().astype(float), pc.count_substring_regex(arrow, EMAIL).to_numpy().astype(float), np.bincount(doc, weights=third.astype(float), minlength=n), by["symbol"],
        share(d, w), share(np.log1p(d), np.log1p(w)), share(d, np.sqrt(np.maximum(size_, 1))), mean, top, np.sqrt(np.maximum(share(square, w) - mean * mean, 0)), share(once, w),
        share(by["newline"], size_), share(digits, w), (by["blank"] == size_).astype(float), _entropy(own, times, n), _entropy(keys >> 21, many, n)], 1)


def features(texts: list[str | None]) -> np.ndarray:
    """The features [texts, NAMES]."""
    out, at, size = [np.zeros((0, len(NAMES)))], 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t or "") > PART:
            out.append(_part([x or "" for x in texts[at:i]]))
            at, size = i, 0
        size += len(t or "")
    if at < len(texts):
        out.append(_part([x or "" for x in texts[at:]]))
    return np.concatenate(out)


def handcrafted(c: Column) -> Column:
    """An array of the features of a text column, in the order of ``NAMES``."""

    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        out = np.concatenate([np.zeros((0, len(NAMES))), *(features(x.slice(at, ROWS).to_pylist()) for at in range(0, len(x), ROWS))])
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, len(NAMES), dtype=np.int32)), pa.array(out.ravel()))

    return run(c.cast("string"))
