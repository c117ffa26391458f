"""Tokeniser fertility: how public vocabularies spell the words of a text.

Words are encoded by themselves, so each distinct word is spelled once and the
texts gather its tokens: characters per token, the share of byte-fallback tokens
and the entropy of the tokens.  Of a byte-level vocabulary the tokens of a
single byte count as fallback.  A word of over ``SLICE`` characters is spelled in
slices of that length, so the work stays linear in a text's length.
"""

from __future__ import annotations

import base64
import random
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .common import resident
from .wordhash import Words

PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
KNOWN = 200_000  # words a worker keeps; results don't depend on it
SLICE = 1024
#: Fixed value: the pattern that goes with the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _pieces(path: str) -> tuple[int, np.ndarray, Callable[[list[str]], list[list[int]]]]:
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    size = library.get_piece_size()
    return size, np.array([library.is_byte(i) for i in range(size)]), lambda words: library.encode(words, num_threads=1)


def _bytes(path: str) -> tuple[int, np.ndarray, Callable[[list[str]], list[list[int]]]]:
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    single = np.zeros(max(ranks.values()) + 1, bool)
    single[[rank for token, rank in ranks.items() if len(token) == 1]] = True
    return len(single), single, lambda words: [library.encode_ordinary(" " + w) for w in words]


class Vocabulary:
    """A public vocabulary (``.model`` or ``.tiktoken``) and the spellings it has given."""

    def __init__(self, path: str):
        self.size, self.fallback, self.encode = (_pieces if path.endswith(".model") else _bytes)(path)
        self.known: dict[str, bytes] = {}

    def spell(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the distinct ``words``, and how many each has."""
        if len(self.known) > KNOWN:
            self.known.clear()
        known = self.known
        new = [w for w in words if w not in known]
        short = [w for w in new if len(w) <= SLICE]
        known.update(zip(short, [np.array(x, np.int32).tobytes() for x in self.encode(short)] if short else [], strict=True))
        for w in new:
            if len(w) > SLICE:
                known[w] = b"".join(np.array(x, np.int32).tobytes() for x in self.encode([w[at: at + SLICE] for at in range(0, len(w), SLICE)]))
        spelled = [known[w] for w in words]
        return np.frombuffer(b"".join(spelled), np.int32), np.fromiter(map(len, spelled), np.int64, len(spelled)) // 4

    def measure(self, words: Words, names: list[str], chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters per token, fallback share and token entropy (bits) of each text; zeros without words."""
        flat, size = self.spell(names)
        start, code, n = np.cumsum(size) - size, words.code, words.texts
        tokens = np.bincount(words.doc, weights=size[code], minlength=n)
        some = np.maximum(tokens, 1)
        back = np.concatenate(([0], np.cumsum(self.fallback[flat], dtype=np.int64)))
        share = np.bincount(words.doc, weights=(back[start + size] - back[start])[code], minlength=n) / some
        many = size[code]
        at = np.repeat(start[code] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        keys = np.repeat(words.doc, many) * self.size + flat[at]
        keys.sort()
        cuts = np.flatnonzero(np.diff(keys, prepend=-1))
        owner = keys[cuts] // self.size
        p = np.diff(np.append(cuts, len(keys))) / some[owner]
        return np.where(tokens > 0, chars / some, 0.0), share, np.bincount(owner, weights=-p * np.log2(p), minlength=n)


#: Fixed value: letters of the script whose words both vocabularies hold, so that words cost fewer tokens than random letters.
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz"}
DRAWN, SEED = 4000, 1


def random_level(vocabulary: Vocabulary, letters: str) -> float:
    """Characters per token of words of 2 to 10 random letters: what a vocabulary makes of text that it knows nothing of, whatever the corpus."""
    r = random.Random(SEED)
    words = ["".join(r.choice(letters) for _ in range(r.randrange(2, 11))) for _ in range(DRAWN)]
    return sum(map(len, words)) / sum(map(len, vocabulary.encode(words)))


def vocabularies(paths: tuple[str, str]) -> list[Vocabulary]:
    return resident(f"vocabularies {paths}", lambda: [Vocabulary(p) for p in paths])


def names(words: Words) -> list[str]:
    return words.distinct.cast(pa.large_string()).to_pylist()
