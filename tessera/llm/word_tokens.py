"""Ids of the lower-casing word BPE (tokenizers library), for each distinct word once.

The library's pattern never crosses white space, so white-space chunks are
independent.  The words of a lot of texts are numbered, each distinct one is
spelled once, and the texts gather their ids by number.  A word of Latin-1
characters is split by the same pattern here, and its distinct lower-cased parts
go to the library side by side in one text: every part ends with a token of its
own kind, which tells the parts' ids apart again.  Any other word (and any that
may hold a special token's string) goes to the library by itself.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import resident

KNOWN = 300_000  # parts a worker keeps, and as many words that go by themselves; results don't depend on it
LOT = 4_000_000  # characters whose words are numbered together
SIDE = 5000  # parts encoded in one text
MODEL = "word_bpe_49k.json"
# The library's pattern on lower-cased Latin-1.
_LETTERS, _DIGIT = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
_PART = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGIT}]|[^\s{_LETTERS}{_DIGIT}]+")
_PLAIN = re.compile(r"[!-;=-~¡-ÿ]+")  # Latin-1 without white space, controls and "<"
# Without apostrophes as well, the pattern needs no look around a part.
_EASY, _EASY_PART = "^[!-&(-;=-~¡-ÿ]+$", f"([{_LETTERS}]+|[{_DIGIT}]|[^{_LETTERS}{_DIGIT}]+)"


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordTokens:
    def __init__(self, model_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(model_file)
        self.known: dict[str, np.ndarray] = {}
        self.parts, self.pool, self.at = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)
        names = self.library.get_vocab()
        self.last = np.zeros(max(names.values()) + 1, bool)  # the tokens that end a part
        self.last[[i for name, i in names.items() if name.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some parts, and how many each has."""
        flat, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for at in range(0, len(parts), SIDE):
            some = parts[at: at + SIDE]
            ids = self._encode([" ".join(some)])[0]
            ends = np.flatnonzero(self.last[ids])
            size = np.diff(ends, prepend=-1)
            if len(ends) != sum(map(bool, some)) or ends[-1:].sum() + 1 != len(ids):  # the library splits a part
                each = self._encode(some)
                ids, size = np.concatenate(each), np.array([len(x) for x in each])
            elif len(ends) != len(some):  # an empty part has no ids
                size = np.insert(size, some.index(""), 0)
            flat.append(ids)
            sizes.append(size)
        return np.concatenate(flat), np.concatenate(sizes)

    def _find(self, parts: pa.Array) -> np.ndarray:
        """The number of each distinct part among ``parts`` of this object, which has learnt them then."""
        where = pc.index_in(parts, value_set=self.parts)
        new = pc.is_null(where)
        if pc.any(new).as_py():
            if len(self.parts) > KNOWN:
                self.parts, self.pool, self.at = self.parts[:0], self.pool[:0], self.at[:1]
                return self._find(parts)
            some = parts.filter(new)
            flat, size = self._encode_parts(some.to_pylist())
            first = len(self.parts)
            self.parts = pa.concat_arrays([self.parts, some])
            self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(size)))
            self.pool = np.concatenate((self.pool, flat))
            found = where.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            found[new.to_numpy(zero_copy_only=False)] = np.arange(first, len(self.parts))
            return found
        return where.to_numpy(zero_copy_only=False).astype(np.int64)

    def _alone(self, words: list[str]) -> list[np.ndarray]:
        if len(self.known) > KNOWN:
            self.known.clear()
        split = [_PART.findall(w.lower()) if _PLAIN.fullmatch(w) else [w] for w in words]
        new = list(set(chain.from_iterable(split)).difference(self.known))
        for at in range(0, len(new), 10_000):
            some = new[at: at + 10_000]
            self.known.update(zip(some, self._encode(some), strict=True))
        return [np.concatenate([*map(self.known.__getitem__, x), np.zeros(0, "<u4")]) for x in split]

    def spell(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and the start and number of each distinct word's in it."""
        easy = pc.match_substring_regex(words, _EASY)
        start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(words.filter(easy)), pattern=_EASY_PART, replacement="\\1 "))
        coded = split.flatten().dictionary_encode()  # each word's last split is empty
        code = self._find(coded.dictionary)[coded.indices.to_numpy()]
        many = np.diff(self.at)[code]
        total = np.concatenate(([0], np.cumsum(many)))
        pool = self.pool[np.repeat(self.at[code] - total[:-1], many) + np.arange(total[-1])]
        cuts = total[split.offsets.to_numpy()]
        easy = easy.to_numpy(zero_copy_only=False)
        start[easy], size[easy] = cuts[:-1], np.diff(cuts)
        rest = self._alone(words.filter(pa.array(~easy)).to_pylist())
        some = np.array([len(x) for x in rest], np.int64)
        start[~easy], size[~easy] = len(pool) + np.cumsum(some) - some, some
        return np.concatenate([pool, *rest]), start, size

    def _lot(self, texts: list[str]) -> list[bytes]:
        # Lower case first where it changes nothing: it is taken word by word and leaves Latin-1, and special tokens hold "<".
        lowered = [t.lower() if "<" not in t and _latin(t) else t for t in texts]
        split = pc.ascii_split_whitespace(pa.array(lowered, pa.string()))
        coded = split.flatten().dictionary_encode()
        flat, start, size = self.spell(coded.dictionary)
        which = coded.indices.to_numpy()
        sizes = size[which]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        every = flat[np.repeat(start[which] - ends[:-1], sizes) + np.arange(ends[-1])]
        cuts = ends[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        return [every[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers; null is empty."""
        out, lot, size = [], [], 0
        for i, text in enumerate(texts):
            lot.append(text or "")
            size += len(lot[-1])
            if size > LOT or i + 1 == len(texts):
                out += self._lot(lot)
                lot, size = [], 0
        return out


def tokenizer(model_file: str) -> WordTokens:
    return resident(f"tokenizer {model_file}", lambda: WordTokens(model_file))
