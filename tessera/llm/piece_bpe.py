"""SentencePiece merge-type encoding by a score-ordered agenda.

A text is normalised as these models ask (a leading space mark, spaces as
marks, all else kept), and its adjacent symbol pairs enter an agenda ordered by
piece score, then position.  The best pair merges, its new neighbours enter,
until the agenda is empty; symbols outside the vocabulary fall back to bytes.

No piece of a merge-type vocabulary that splits by white space has a mark after
another character (checked at load), so no merge crosses from a word to the
next mark: words are independent, and each distinct one runs its agenda once.
The new words of an Arrow batch are checked against the sentencepiece library;
a difference stops the job.

Defined cases: null is the empty text; empty text has no ids and decodes to
empty; repeated rows repeat; columns of any other name are left out; rows with
a null doc_id are kept with a null doc_id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resident

MARK = "▁"
WORDS = 1_000_000  # words whose ids a worker keeps; results don't depend on it
LOT = 125_000  # words of some texts learnt together
MODEL = "piece_bpe_32k.model"


class PieceBpe:
    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        sp = self.library
        self.ids, self.scores, self.bytes = {}, {}, [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
                self.scores[piece] = sp.get_score(i)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("the vocabulary joins words: it has a space mark inside a piece")
        if sp.normalize(" a  ﬁ\t ") != MARK * 2 + "a" + MARK * 2 + "ﬁ\t" + MARK:
            raise ValueError("the model's normaliser is not the plain one")
        # Equal scores share a rank, so that position decides between them.
        ranks = {x: i for i, x in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.rank = {p: ranks[x] << 32 for p, x in self.scores.items()}
        self.joinable = {p[i: i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.known: dict[str, tuple[int, ...]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> tuple[int, ...]:
        """The ids of one normalised word: cut where no piece holds both neighbours, for no merge crosses there."""
        joinable, parts = self.joinable, self.parts
        out: tuple[int, ...] = ()
        start = 0
        for i in range(1, len(word) + 1):
            if i == len(word) or word[i - 1: i + 1] not in joinable:
                part = word[start:i]
                ids = parts.get(part)
                if ids is None:
                    if len(parts) > WORDS:
                        parts.clear()
                    ids = parts[part] = self.agenda(part)
                out += ids
                start = i
        return out

    def agenda(self, part: str) -> tuple[int, ...]:
        """The ids of a part: the best adjacent pair by (score, position) merges until none is left."""
        symbols: list[str] = list(part)
        n = len(symbols)
        if n > 1:
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            rank = self.rank.get
            pairs = []
            for i in range(n - 1):
                r = rank(part[i: i + 2])
                if r is not None:
                    pairs.append(r | i)
            heapify(pairs)
            while pairs:
                key = heappop(pairs)
                i = key & 0xFFFFFFFF
                left, j = symbols[i], after[i]
                if not left or j >= n:
                    continue
                pair = left + symbols[j]
                if rank(pair) != key - i:  # a side has merged since
                    continue
                symbols[i], symbols[j] = pair, ""
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    r = rank(pair + symbols[k])
                    if r is not None:
                        heappush(pairs, r | i)
                h = before[i]
                if h >= 0:
                    r = rank(symbols[h] + pair)
                    if r is not None:
                        heappush(pairs, r | h)
        out: list[int] = []
        for s in symbols:
            if s:
                if s in self.ids:
                    out.append(self.ids[s])
                else:
                    out.extend([self.bytes[b] for b in s.encode()])
        return tuple(out)

    def words(self, text: str) -> list[str]:
        return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, words: set[str]) -> None:
        """Encodes the words not yet known, and checks them against the library."""
        if len(self.known) + len(words) > WORDS:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        own = [self.word(w) for w in new]
        # The library puts the first mark itself.
        theirs = self.library.encode([w[1:].replace(MARK, " ") for w in new], num_threads=1)
        for w, a, b in zip(new, own, theirs, strict=True):
            if list(a) != b and len(w) > 1:
                raise ValueError(f"the agenda and the library differ on {w!r}: {a} and {b}")
            self.known[w] = a

    def batch(self, texts: list[str | None]) -> Iterator[list[tuple[int, ...]]]:
        """Each text's ids, as one tuple a word."""
        split = [self.words(t or "") for t in texts]
        for lot, part in _lots(split):
            self.learn(lot)
            known = self.known.__getitem__
            for one in part:
                yield list(map(known, one))


_WORD = re.compile(f"{MARK}+[^{MARK}]*")


def _lots(split: list[list[str]]) -> Iterator[tuple[set[str], list[list[str]]]]:
    """Texts in lots of under ``LOT`` words, or one text."""
    at, lot, count = 0, [], 0
    for one in split:
        if lot and count + len(one) > LOT:
            yield set(chain.from_iterable(lot)), lot
            lot, count = [], 0
        lot.append(one)
        count += len(one)
    if lot:
        yield set(chain.from_iterable(lot)), lot


def encoder(model_file: str) -> PieceBpe:
    return resident(f"encoder {model_file}", lambda: PieceBpe(model_file))


def encode_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text; ids by the agenda, text by the library's decode."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(model_file)
        decode, spelled = bpe.library.decode, [str(i) for i in range(bpe.library.get_piece_size())].__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, ids_hash, text_hash = [], [], []
                for words in bpe.batch(part.column(1).to_pylist()):
                    ids = list(chain.from_iterable(words))
                    counts.append(len(ids))
                    ids_hash.append(hashlib.sha256(",".join(map(spelled, ids)).encode()).hexdigest())
                    text_hash.append(hashlib.sha256((decode(ids) if ids else "").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash), pa.array(text_hash)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids themselves, as an array, of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [list(chain.from_iterable(w)) for w in bpe.batch(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id and the text that the library's decode gives for ``ids``; null ids decode to null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(model_file).library.decode
        for batch in batches:
            texts = [None if ids is None else decode(ids) if ids else "" for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
