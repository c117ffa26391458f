"""Secret scan through a trigram inverted index.

Each rule's regex yields a Boolean query over trigrams: every text that the
regex matches satisfies it.  The trigrams of each block of documents go into
posting lists (only trigrams that some query names), the queries intersect and
unite them, and the regex verifies the documents that remain.  A rule without
mandatory trigrams (such as a run of hex digits) scans every text in full; one
whose text is a long run of one byte class first measures the runs of all texts
as bytes, which is the same full scan done in numpy.

Defined cases: null is the empty text; empty text has no span; repeated rows
repeat; spans are in code points, end exclusive, and ties at one start are in
the order of the rules; overlapping kinds all stay; a null doc_id stays null.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as op
import re._parser as parser
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_resident
from .wordhash import text_buffer


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    fold: bool = False  # letters in either case (ASCII)
    group: int = 0  # the group whose length counts
    least: int = 0  # matches with a shorter group are dropped
    base: bool = False
    run: str = ""  # a full scan by runs: the byte class, at least ``least`` long


_PEM = r"PRIVATE\x20KEY(?:\x20BLOCK)?-----"
_GAP = r"(?:\s|\\[rn])"  # line ends may be escaped
#: A private key from its header through its END line; without one, through its header fields and base64 lines.
PEM = (rf"-----BEGIN\x20[A-Z0-9\x20]*{_PEM}(?:(?:(?!-----)[\s\S])*?-----END\x20[A-Z0-9\x20]*{_PEM}"
       rf"|(?:{_GAP}*[A-Za-z][A-Za-z0-9-]*:\x20[^\r\n\\]*(?={_GAP}))*(?:{_GAP}*[A-Za-z0-9+/]{{16,}}={{0,2}})*"
       rf"(?:{_GAP}+(?:[A-Za-z0-9+/]+={{1,2}}|[A-Za-z0-9+/]+(?=\s*\Z|\r?\n|\\[rn])))?(?:{_GAP}+=[A-Za-z0-9+/]{{4}}(?![A-Za-z0-9+/]))?)")

#: The base rules of the contract, then the added kinds.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, base=True),
    Rule("hex", r"[0-9a-f]+", least=24, base=True, run="0123456789abcdef"),
    Rule("pem", PEM, least=1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", least=1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", least=1),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", least=1),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", least=1),
    Rule("url_login", r"[A-Za-z]{3,10}://[^\s/:@]+:[^\s/:@]{3,}@[A-Za-z0-9.-]+", least=1),
)


# ---- trigram queries: True (always), ("and", [..]), ("or", [..]), or a trigram (bytes)

LIMIT = 64  # exact strings followed at once; beyond, the part counts as unknown text


def _both(a, b):
    if a is True:
        return b
    return a if b is True or a == b else ("and", [a, b])


def _grams(strings: set[bytes]):
    """The query that one of some strings lies in the text."""
    parts = []
    for s in sorted(strings):
        grams = {s[i: i + 3] for i in range(len(s) - 2)}
        if not grams:
            return True
        parts.append(("and", sorted(grams)))
    return parts[0] if len(parts) == 1 else ("or", parts)


def trigram_query(pattern: str, fold: bool = False):
    """A Boolean trigram query that every text matched by ``pattern`` satisfies; with ``fold``, of lower-cased text."""

    def chars(items) -> set[bytes] | None:
        out: set[bytes] = set()
        for kind, x in items:
            if kind is op.LITERAL:
                out.add(chr(x).encode())
            elif kind is op.RANGE and x[1] - x[0] < LIMIT:
                out |= {chr(c).encode() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return {x.lower() for x in out} if fold else out

    def walk(seq):
        """(query, exact strings or None): the strings are all that the sequence can match."""
        query, exact = True, {b""}
        for kind, x in seq:
            q, e = True, None
            if kind is op.LITERAL:
                c = chr(x).encode()
                e = {c.lower() if fold else c}
            elif kind is op.IN:
                e = chars(x)
            elif kind is op.SUBPATTERN:
                q, e = walk(x[-1])
            elif kind is op.BRANCH:
                each = [walk(b) for b in x[1]]
                if all(b[1] is not None for b in each):
                    e = set().union(*(b[1] for b in each))
                else:
                    qs = [_both(b[0], _grams(b[1]) if b[1] is not None else True) for b in each]
                    q = True if any(y is True for y in qs) else ("or", qs)
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
                low, high, body = x
                bq, be = walk(body)
                if (low, high) == (0, 1) and be is not None:
                    e = be | {b""}
                elif low and be is not None:
                    e = {b"".join(p) for p in product(be, repeat=low)} if len(be) ** low <= LIMIT else None
                    if high != low:
                        q, e = (_grams(e) if e else True), None
                elif low:
                    q = bq
            elif kind is op.AT:
                e = {b""}
            query = _both(query, q)
            if e is None or len(exact) * len(e) > LIMIT:
                query, exact = _both(query, _grams(exact)), {b""}
                broken = True
                if e is not None:
                    exact = e
                whole.append(broken)
            else:
                exact = {a + b for a in exact for b in e}
        return (query, exact) if not whole_reset(seq, query, exact) else (_both(query, _grams(exact)), None)

    whole: list[bool] = []

    def whole_reset(seq, query, exact) -> bool:
        """Whether something in ``seq`` was not followed exactly, so ``exact`` is only its tail."""
        done = bool(whole)
        whole.clear()
        return done

    query, exact = walk(list(parser.parse(pattern)))
    return _both(query, _grams(exact) if exact is not None else True)


def _named(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(_named, query[1]))


class Index:
    """Posting lists of one block of texts, for the trigrams that queries name; ASCII letters are folded."""

    def __init__(self, grams: list[bytes]):
        self.number = {g: i for i, g in enumerate(grams)}
        self.table = np.full(1 << 24, -1, np.int16)
        for g, i in self.number.items():
            self.table[g[0] << 16 | g[1] << 8 | g[2]] = i

    def post(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.docs = np.arange(len(offsets) - 1)
        if len(data) < 3:
            self.lists = [np.zeros(0, np.int64) for _ in self.number]
            return
        low = _FOLD[data].astype(np.int32)
        found = self.table[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        at = np.flatnonzero(found >= 0)
        doc = np.searchsorted(offsets, at, "right") - 1
        within = at + 3 <= offsets[doc + 1]
        pairs = np.unique(found[at[within]].astype(np.int64) << 32 | doc[within])
        cuts = np.searchsorted(pairs >> 32, np.arange(len(self.number) + 1))
        self.lists = [pairs[a:b] & 0xFFFFFFFF for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def ask(self, query) -> np.ndarray:
        if query is True:
            return self.docs
        if isinstance(query, bytes):
            return self.lists[self.number[query]]
        each = [self.ask(q) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(each))
        each.sort(key=len)
        out = each[0]
        for e in each[1:]:
            out = np.intersect1d(out, e, assume_unique=True)
        return out


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _with_runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, least: int) -> np.ndarray:
    """Texts with a run of at least ``least`` bytes of a class."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = table[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = ends - starts >= least  # a run may cross into the next text; the regex decides
    starts, ends = starts[long], ends[long]
    first = np.searchsorted(offsets, starts, "right") - 1
    last = np.searchsorted(offsets, ends - 1, "right") - 1
    out = [np.arange(a, b + 1) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.regex = [re.compile(r.pattern, re.ASCII | re.IGNORECASE if r.fold else 0) for r in rules]
        self.queries = [trigram_query(_lowered(r), True) for r in rules]
        self.index = Index(sorted(set().union(*map(_named, self.queries))))
        self.runs = {}
        for i, r in enumerate(rules):
            if r.run:
                self.runs[i] = np.zeros(256, np.int8)
                self.runs[i][list(r.run.encode())] = 1

    def spans(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Per text: (start, rule number, end), sorted."""
        data, offsets = text_buffer(texts)
        self.index.post(data, offsets)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
        held: dict[int, str] = {}
        for i, (rule, regex, query) in enumerate(zip(self.rules, self.regex, self.queries, strict=True)):
            docs = _with_runs(data, offsets, self.runs[i], rule.least) if i in self.runs else self.index.ask(query)
            for d in docs.tolist():
                text = held.get(d)
                if text is None:
                    text = held[d] = texts[d].as_py() or ""
                if i in self.runs:
                    found[d] += [(a, i, b) for a, b in _runs(text, rule)]
                else:
                    found[d] += [(m.start(), i, m.end()) for m in regex.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        for f in found:
            f.sort()
        return found


_long_run: dict[tuple[str, int], re.Pattern] = {}


def _runs(text: str, rule: Rule) -> Iterator[tuple[int, int]]:
    """Maximal runs of the class that are long enough: what ``[class]+`` matches, without the short ones."""
    key = (rule.run, rule.least)
    if key not in _long_run:
        _long_run[key] = re.compile(f"[{re.escape(rule.run)}]{{{rule.least},}}")
    for m in _long_run[key].finditer(text):
        yield m.start(), m.end()


def _lowered(rule: Rule) -> str:
    return rule.pattern


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kinds, base = [r.kind for r in rules], [i for i, r in enumerate(rules) if r.base]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                every = scanner.spans(part.column(1))
                counts = [[sum(x[1] == b for x in f) for f in every] for b in base]
                spell = lambda f: ",".join([f"{kinds[i]}:{a}:{b}" for a, i, b in f])
                digest = [hashlib.sha256(spell([x for x in f if rules[x[1]].base]).encode()).hexdigest() for f in every]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest), pa.array([spell(f) for f in every])],
                    names=["doc_id", *(f"n_{kinds[b]}" for b in base), "base_sha256", "spans"])

    counts = ", ".join(f"n_{r.kind} long" for r in rules if r.base)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id long, {counts}, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by ``mask`` (spans that overlap become one); null stays null."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_resident()
        scanner = Scanner(rules)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                column, new = part.column(at), {}
                for i, spans in enumerate(scanner.spans(column)):
                    if spans:
                        text, out, end = column[i].as_py(), [], 0
                        for a, _, b in spans:
                            if a >= end:
                                out += [text[end:a], mask]
                            end = max(end, b)
                        new[i] = "".join([*out, text[end:]])
                if new:
                    column = pa.array([new[i] if i in new else column[i].as_py() for i in range(len(column))], column.type)
                    part = part.set_column(at, part.schema.field(at), column)
                yield part

    return docs.mapInArrow(run, schema)
