"""Alignment of two tokenizers over one corpus.

Each text is spelled by a byte-level vocabulary (A) and by a piece vocabulary
(B).  Byte offsets where tokens of both end cut the spellings into groups, and
every A and B token of a group are linked.  How many documents hold a pair of
ids linked is counted corpus-wide; a document is scored by its links' counts.

1. **Spelling.**  Neither vocabulary joins bytes across a place before white space
   that follows another character (checked at load for B; A's pattern starts a
   part there), so texts are cut there and each different unit is spelled and
   aligned once a worker.  New units go to A's library side by side in one text.
2. **Stripes.**  The id pairs of a slice of documents are dealt by A's id into
   ``STRIPES`` stripes (id modulo their number, so that frequent ids spread): per
   stripe the different pairs, the documents that hold each, and how often.
3. **Counts.**  The pairs and numbers of documents, without the documents, meet by
   stripe; ``np.add.at`` adds them into the stripe's dense block, A ids by B ids
   (50 MB), and the row maxima tell each A id's best partners.
4. **Scores.**  Counts and links meet by (stripe, salt) and each task adds up what
   its stripes give to each document; the salts deal the slices, and grow in
   number with the links.  A document gets at most ``STRIPES`` partial sums.

A group's pairs come from its different ids and their numbers, so a long group of
few ids stays small.  Block, slice and sums are bounded at every size.

Defined cases: texts that are null, empty, or whose tokens spell other bytes
than a space and the text (such as with U+2581) have no tokens: zeros and an
empty groups_sha256; special tokens' strings are plain text; repeated rows, and
rows of a null doc_id, are documents of their own; very long texts are read
whole; other columns are ignored, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clustered, drop_resident, resident, stored

A_MODEL, B_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
STRIPES = 256
LOT, DOCS = 4_000_000, 50_000  # characters and documents of a slice, at most (or one document)
KNOWN, POOL = 250_000, 40_000_000  # units that a worker keeps, and characters of their spellings; results don't depend on it
SIDE = 4000  # units spelled in one text
SALT_LINKS = 8_000_000  # links of a stripe from which slices are dealt into salts
HELD = 64 << 20  # bytes of partial sums that a task holds


def _byte_level() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both vocabularies, and the units spelled so far in flat arrays."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        letters = _byte_level()
        names = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        self.b_bytes, cuts = [], set(" \t\n\v\f\r")  # white space that no piece has after another character
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
            if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)):
                if re.search("[^▁]▁", piece):
                    raise ValueError(f"piece {piece!r} crosses a space")
                cuts.difference_update(re.findall(r"(?<=\S)[\t-\r]", piece))
        self.cut = re.compile(rf"(?<=\S)(?=[{re.escape(''.join(sorted(cuts)))}])")
        self.mark = self.b.piece_to_id("▁")
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.a_name, self.b_name = ([str(i) for i in range(len(x))] for x in (self.a_bytes, self.b_bytes))
        self.b_bits = (len(self.b_bytes) - 1).bit_length()
        self.rows = -(-len(self.a_bytes) // STRIPES)
        self.cell_bits = (self.rows - 1).bit_length() + self.b_bits
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.texts: list[str] = []
        self.held = 0
        self.facts = np.zeros((0, 5), np.int64)  # n_a, n_b, n_groups, n_links, and whether the bytes differ
        self.start = np.zeros(1, np.int64)
        self.pair, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _keep(self, some: set[str]) -> None:
        """Forgets the units that aren't among ``some``."""
        names = [u for u in self.number if u in some]
        at = np.fromiter(map(self.number.__getitem__, names), np.int64, len(names))
        size = self.start[at + 1] - self.start[at]
        start = np.concatenate(([0], np.cumsum(size)))
        where = np.repeat(self.start[at] - start[:-1], size) + np.arange(start[-1])
        self.pair, self.times, self.start, self.facts = self.pair[where], self.times[where], start, self.facts[at]
        self.texts = [self.texts[i] for i in at.tolist()]
        self.number = {u: i for i, u in enumerate(names)}
        self.held = sum(map(len, self.texts)) + sum(map(len, names))

    def _spell_a(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units, and how many each has."""
        ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(units), SIDE):
            some = units[at: at + SIDE]
            # What ends in white space would look at the next unit's.
            if all(not u[-1].isspace() for u in some):
                flat = np.array(self.a.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, np.int64)
                ends = np.cumsum(self.a_size[flat])
                cuts = np.cumsum([len(u.encode()) for u in some])
                place = np.searchsorted(ends, cuts)
                if len(ends) and ends[-1] == cuts[-1] and (ends[place] == cuts).all():
                    ids.append(flat)
                    sizes.append(np.diff(place + 1, prepend=0))
                    continue
            each = [e.ids for e in self.a.encode_batch_fast(some, add_special_tokens=False)]
            ids.append(np.array(list(chain.from_iterable(each)), np.int64))
            sizes.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate(ids), np.concatenate(sizes)

    def _spell_b(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_spell_a``; the library puts a mark before each unit, which stands for its own space or goes."""
        each = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        for i, u in enumerate(units):
            if u[0] != " ":
                if each[i][0] != self.mark:
                    raise ValueError(f"the space mark merges with {u!r}")
                each[i] = each[i][1:]
            elif len(u) == 1:  # a space alone
                each[i] = [self.mark]
        return np.array(list(chain.from_iterable(each)), np.int64), np.array([len(x) for x in each], np.int64)

    def _same(self, table: list[bytes], ids: np.ndarray, size: np.ndarray, units: list[str], whole: bytes) -> np.ndarray:
        """Which units their tokens spell byte by byte."""
        if b"".join(map(table.__getitem__, ids.tolist())) == whole:
            return np.ones(len(units), bool)
        ends = np.cumsum(size).tolist()
        spelled = ids.tolist()
        return np.array([b"".join(map(table.__getitem__, spelled[e - n: e])) == u.encode() for u, e, n in zip(units, ends, size.tolist(), strict=True)])

    def _learn(self, units: list[str]) -> None:
        """Spells and aligns new units."""
        a, a_many = self._spell_a(units)
        b, b_many = self._spell_b(units)
        whole = "".join(units).encode()
        good = self._same(self.a_bytes, a, a_many, units, whole) & self._same(self.b_bytes, b, b_many, units, whole)
        a, b = a[np.repeat(good, a_many)], b[np.repeat(good, b_many)]
        a_many, b_many = np.where(good, a_many, 0), np.where(good, b_many, 0)
        n = len(units)
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
        a_in, b_in = np.bincount(a_group, minlength=len(ends)), np.bincount(b_group, minlength=len(ends))
        of = np.zeros(len(ends), np.int64)  # the unit of each group
        of[a_group] = np.repeat(np.arange(n), a_many)
        facts = np.stack([a_many, b_many, np.bincount(of, minlength=n), np.bincount(of, weights=(a_in * b_in).astype(float), minlength=n).astype(np.int64), ~good], 1)

        # The pairs of each group: its different ids with their numbers, multiplied out.
        a_key, a_times = np.unique(a_group << 32 | a, return_counts=True)
        b_key, b_times = np.unique(b_group << 32 | b, return_counts=True)
        ga, gb = a_key >> 32, b_key >> 32
        first = np.searchsorted(gb, np.arange(len(ends)))
        many = np.bincount(gb, minlength=len(ends))[ga]
        left = np.repeat(np.arange(len(a_key)), many)
        right = np.repeat(first[ga] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        ids_a, ids_b = a_key[left] & 0xFFFFFFFF, b_key[right] & 0xFFFFFFFF
        pair = (ids_a % STRIPES) << self.cell_bits | (ids_a // STRIPES) << self.b_bits | ids_b
        unit, times = of[ga[left]], a_times[left] * b_times[right]
        order = np.lexsort((pair, unit))
        unit, pair, times = unit[order], pair[order], times[order]
        new = np.flatnonzero(np.concatenate(([True], (unit[1:] != unit[:-1]) | (pair[1:] != pair[:-1])))) if len(unit) else np.zeros(0, np.int64)
        times = np.add.reduceat(times, new) if len(new) else times
        pair = pair[new]
        per_unit = np.bincount(unit[new], minlength=n)

        # The groups written out: A's ids, then B's, with the mark that follows each.
        names = [x + y for side, marks in ((self.a_name, ",|"), (self.b_name, ",;")) for y in marks for x in side]
        base = np.cumsum([0, len(self.a_name), len(self.a_name), len(self.b_name)])
        a_last, b_last = np.diff(a_group, append=-1) != 0, np.diff(b_group, append=-1) != 0
        token = np.concatenate((a + base[a_last.astype(int)], b + base[2 + b_last.astype(int)]))
        order = np.argsort(np.concatenate((a_group * 2, b_group * 2 + 1)), kind="stable")
        written = [names[t] for t in token[order].tolist()]
        sizes = np.fromiter(map(len, written), np.int64, len(written))
        owner = of[np.concatenate((a_group, b_group))[order]] if len(written) else np.zeros(0, np.int64)
        cuts = np.cumsum(np.bincount(owner, weights=sizes.astype(float), minlength=n).astype(np.int64)).tolist()
        text = "".join(written)

        base_number, at = len(self.number), 0
        for i, (u, cut) in enumerate(zip(units, cuts, strict=True)):
            self.number[u] = base_number + i
            self.texts.append(text[at: max(at, cut - 1)])  # without the last ";"
            at = cut
        self.held += len(text) + len(whole)
        self.facts = np.concatenate((self.facts, facts))
        self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(per_unit)))
        self.pair, self.times = np.concatenate((self.pair, pair)), np.concatenate((self.times, times))

    def slice(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Facts and hash of each text, and its links: sorted keys pair << 16 | text, and how often each occurs."""
        split = [self.cut.split(" " + t) if t else [] for t in texts]
        every = set(chain.from_iterable(split))
        new = every.difference(self.number)
        if new and (len(self.number) + len(new) > KNOWN or self.held > POOL):
            self._keep(every)
        if new:
            self._learn(list(new))
        many = np.fromiter(map(len, split), np.int64, len(split))
        code = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, int(many.sum()))
        doc = np.repeat(np.arange(len(split)), many)
        facts = np.zeros((len(split), 5), np.int64)
        np.add.at(facts, doc, self.facts[code])
        bad = facts[:, 4] > 0
        facts[bad] = 0
        text = self.texts
        ends = np.cumsum(many).tolist()
        codes = code.tolist()
        hashes = ["" if not n or wrong else hashlib.sha256(";".join([text[c] for c in codes[e - n: e]]).encode()).hexdigest()
                  for e, n, wrong in zip(ends, many.tolist(), bad.tolist(), strict=True)]
        some = ~bad[doc]
        key, held = np.unique(doc[some] * len(self.number) + code[some], return_counts=True)  # the different units of each text
        owner, code = key // max(1, len(self.number)), key % max(1, len(self.number))
        size = self.start[code + 1] - self.start[code]
        at = np.repeat(self.start[code] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        link = self.pair[at] << 16 | np.repeat(owner, size)
        order = np.argsort(link, kind="stable")
        link, times = link[order], (self.times[at] * np.repeat(held, size))[order]
        if len(link):
            first = np.flatnonzero(np.concatenate(([True], link[1:] != link[:-1])))
            link, times = link[first], np.add.reduceat(times, first)
        return facts, hashes, link, times


def aligner(a_file: str, b_file: str) -> Aligner:
    return resident(f"aligner {a_file} {b_file}", lambda: Aligner(a_file, b_file))


LINKED = pa.schema([("kind", pa.int32()), ("slice", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                    ("groups_sha256", pa.string()), ("stripe", pa.int32()), ("cells", pa.binary()), ("sizes", pa.binary()), ("docs", pa.binary()), ("times", pa.binary())])
LINKED_DDL = ("kind int, slice long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, stripe int, cells binary, sizes binary, "
              "docs binary, times binary")


def _record(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _lots(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and (size + n > LOT or i - start >= DOCS):
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def linked(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The links of all documents, stored: a row per document (kind 0) and one per slice and stripe (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_file, b_file)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            every = batch.column(1).to_pylist()
            for a, b in _lots(every):
                facts, hashes, link, times = both.slice(every[a:b])
                n = b - a
                yield _record(LINKED, n, kind=pa.array(np.zeros(n, np.int32)), slice=pa.array(np.full(n, number)), place=pa.array(np.arange(n, dtype=np.int32)), doc_id=batch.column(0).slice(a, n),
                              **{c: pa.array(facts[:, i].copy()) for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}, groups_sha256=pa.array(hashes, pa.string()))
                pair, doc = link >> 16, (link & 0xFFFF).astype("<u2")
                first = np.flatnonzero(np.diff(pair, prepend=-1))
                size = np.diff(np.append(first, len(pair))).astype("<u2")
                cells, stripe = (pair[first] & ((1 << both.cell_bits) - 1)).astype("<u4"), pair[first] >> both.cell_bits
                names, at = np.unique(stripe, return_index=True)
                ends, out = np.append(first, len(pair)), []
                for i, k in zip(at.tolist(), np.append(at[1:], len(stripe)).tolist(), strict=True):
                    t = times[ends[i]: ends[k]]
                    out.append((cells[i:k].tobytes(), size[i:k].tobytes(), doc[ends[i]: ends[k]].tobytes(), t.astype("u1" if t.max() < 256 else "<i8").tobytes()))
                c, s, d, t = zip(*out, strict=True) if out else ([], [], [], [])
                n = len(names)
                yield _record(LINKED, n, kind=pa.array(np.ones(n, np.int32)), slice=pa.array(np.full(n, number)), stripe=pa.array(names.astype(np.int32)),
                              cells=pa.array(c, pa.binary()), sizes=pa.array(s, pa.binary()), docs=pa.array(d, pa.binary()), times=pa.array(t, pa.binary()))
                number += 1

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(run, LINKED_DDL), "align-links")


COUNTS = pa.schema([("stripe", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary()), ("best", pa.binary())])
COUNTS_DDL = "stripe int, cells binary, counts binary, best binary"


def _shape(a_file: str, b_file: str) -> tuple[int, int]:
    """Bits of a B id, and cells of a stripe's block."""
    import sentencepiece
    from tokenizers import Tokenizer

    ids = max(Tokenizer.from_file(a_file).get_vocab(with_added_tokens=True).values()) + 1
    bits = (sentencepiece.SentencePieceProcessor(model_file=b_file).get_piece_size() - 1).bit_length()
    return bits, -(-ids // STRIPES) << bits


def add_up(bits: int, cells: int):
    """Dense blocks: rows (stripe, cells, numbers), sorted by stripe, added into one block a stripe; its filled cells, counts and row maxima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_resident()
        block, now = np.zeros(cells, np.int64), None

        def flush() -> pa.RecordBatch:
            filled = np.flatnonzero(block)
            counts = block[filled]
            best = counts == block.reshape(-1, 1 << bits).max(1)[filled >> bits]
            block[filled] = 0
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (filled.astype("<u4"), counts, best))], schema=COUNTS)

        for batch in batches:
            for stripe, where, numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stripe != now:
                    if now is not None:
                        yield flush()
                    now = stripe
                where = np.frombuffer(where, "<u4")
                np.add.at(block, where, np.frombuffer(numbers, "<u2" if len(numbers) == 2 * len(where) else "<i8").astype(np.int64))
        if now is not None:
            yield flush()

    return run


def _salts(links: DataFrame, per: int) -> int:
    held = links.where("kind = 1").agg(F.sum(F.octet_length("docs") / 2)).first()[0] or 0
    return max(1, int(-(-held // (STRIPES * per))))


def pair_counts(links: DataFrame, a_file: str, b_file: str, per: int = SALT_LINKS) -> DataFrame:
    """One row per stripe, stored: the cells of linked id pairs, how many documents hold each, and whether that is the A id's highest."""
    work, salts = add_up(*_shape(a_file, b_file)), _salts(links, per)
    rows = links.where("kind = 1").withColumn("salt", F.pmod(F.xxhash64("slice"), F.lit(salts)).cast("int"))
    parts = clustered(rows.select("stripe", "cells", "sizes", "salt"), ["stripe", "salt"]).select("stripe", "cells", "sizes").mapInArrow(work, COUNTS_DDL)
    if salts > 1:
        parts = clustered(parts.select("stripe", "cells", "counts"), ["stripe"]).mapInArrow(work, COUNTS_DDL)
    return stored(parts, "align-counts")


def pairs(counts: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """The counts as rows: a_id, b_id, documents, best."""
    bits, _ = _shape(a_file, b_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stripe, cells, numbers, best in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cells = np.frombuffer(cells, "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((cells >> bits) * STRIPES + stripe), pa.array(cells & ((1 << bits) - 1)), pa.array(np.frombuffer(numbers, "<i8")),
                                                  pa.array(np.frombuffer(best, bool))], names=["a_id", "b_id", "documents", "best"])

    return counts.mapInArrow(run, "a_id long, b_id long, documents long, best boolean")


def score(cells: int):
    """From rows by stripe, counts (kind 0) before links (kind 1): partial sums of each slice's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_resident()
        count, best, filled = np.zeros(cells, np.int64), np.zeros(cells, bool), np.zeros(0, np.int64)
        sums: dict[int, np.ndarray] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            some = {k: (np.flatnonzero(v[1]), v) for k, v in sums.items()}
            out = pa.RecordBatch.from_arrays([pa.array(list(some), pa.int64()), pa.array([d.astype("<u2").tobytes() for d, _ in some.values()], pa.binary()),
                                              *(pa.array([v[i][d].tobytes() for d, v in some.values()], pa.binary()) for i in (0, 1))], names=["slice", "docs", "n_best", "count_sum"])
            sums.clear()
            return out

        for batch in batches:
            for kind, number, where, sizes, docs, times, counts, highest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                where = np.frombuffer(where, "<u4")
                if kind == 0:
                    count[filled], best[filled] = 0, False
                    filled = where
                    count[filled], best[filled] = np.frombuffer(counts, "<i8"), np.frombuffer(highest, bool)
                    continue
                docs = np.frombuffer(docs, "<u2")
                each = np.repeat(where, np.frombuffer(sizes, "<u2"))
                times = np.frombuffer(times, "u1" if len(times) == len(docs) else "<i8").astype(np.int64)
                top, own = int(docs.max()) + 1, sums.get(number)
                if own is None or own.shape[1] < top:
                    more = np.zeros((2, top), np.int64)
                    if own is not None:
                        more[:, : own.shape[1]] = own
                        held -= own.nbytes
                    own = sums[number] = more
                    held += own.nbytes
                np.add.at(own[0], docs, times * best[each])
                np.add.at(own[1], docs, times * count[each])
            if held > HELD:
                yield flush()
                held = 0
        yield flush()

    return run


OUT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows by slice, documents (kind 0, by place) before partial sums (1): the result's rows."""
    rows: list[list] = []
    now, sums = None, None

    def flush() -> pa.RecordBatch:
        ids, a, b, groups_, links, sha = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, a, b, groups_, links)] + [pa.array(sums[0, : len(ids)]), pa.array(sums[1, : len(ids)]), pa.array(sha, pa.string())],
                                          names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    for batch in batches:
        for number, kind, *facts, docs, best, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if number != now:
                if rows:
                    yield flush()
                now, rows, sums = number, [], np.zeros((2, 1 << 16), np.int64)
            if kind == 0:
                rows.append(facts)
            else:
                docs = np.frombuffer(docs, "<u2")
                sums[0, docs] += np.frombuffer(best, "<i8")
                sums[1, docs] += np.frombuffer(total, "<i8")
    if rows:
        yield flush()


def align(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", per: int = SALT_LINKS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    links = linked(docs, a_file, b_file, id_col, text_col)
    counts, salts = pair_counts(links, a_file, b_file, per), _salts(links, per)
    _, cells = _shape(a_file, b_file)
    met = (links.where("kind = 1").select("kind", "slice", "stripe", "cells", "sizes", "docs", "times").withColumn("salt", F.pmod(F.xxhash64("slice"), F.lit(salts)).cast("int"))
           .unionByName(counts.withColumns({"kind": F.lit(0), "salt": F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))}), allowMissingColumns=True))
    sums = (clustered(met, ["stripe", "salt"], ["stripe", "salt", "kind"]).select("kind", "slice", "cells", "sizes", "docs", "times", "counts", "best")
            .mapInArrow(score(cells), "slice long, docs binary, n_best binary, count_sum binary"))
    facts = links.where("kind = 0").select("slice", "kind", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    every = facts.unionByName(sums.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return (clustered(every, ["slice"], ["slice", "kind", "place"])
            .select("slice", "kind", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "docs", "n_best", "count_sum").mapInArrow(_finish, OUT_DDL))
