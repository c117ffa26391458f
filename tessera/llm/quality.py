"""Quality rules by tokeniser fertility.

A text fails the base rules with under 50 words, or when over half of its words
lie in three-word windows that it repeats.  Of the rest, two public vocabularies
(``fertility``) measure characters per token, the share of byte-fallback tokens
and the entropy of the tokens; a text outside its band in any of them is rejected.

Every script and language (column ``lang``, if there is one) has its own bands
for texts of about equal length (each class twice as long as the one before),
from the quartiles of its texts that pass the base rules, copies counted once:
``FENCE`` spreads (median to quartile) beyond the median, ``LEAST`` of it at
least.  A class with under ``FEW`` such texts has the bands of all lengths, and
with under ``FEW`` of these, the script's wide fixed band.  Scripts are told by
the first bytes of UTF-8 letters.

A corpus can't move one bound: a text to which both vocabularies give no more
characters per token than to random letters (``ABOVE`` times that; for Latin,
whose words both hold) is rejected in any band, and no band is measured by it.

Defined cases: null and empty texts have no words and fail; very long texts are
measured whole; repeated rows repeat; values at an edge of a band lie inside, so
ties are kept; an empty table gives an empty result; other columns are ignored,
whatever their names; a null lang has bands of its own; a text without letters
uses the band of script ``other``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .fertility import ALPHABETS, names, random_level, vocabularies
from .wordhash import U64, Words, mix, split_words, text_buffer, windows

MIN_WORDS, MAX_REPEAT = 50, 50  # words; per cent of words
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Accepted characters per token, byte-fallback share at most, token entropy in bits at least."""

    low: float
    high: float
    bytes: float
    entropy: float


_BYTES = Band(0.2, 8.0, 1.0, 2.5)  # a vocabulary may spell such a script in bytes
#: Bands of the first vocabulary by script where too few texts are there to measure one; the second's are ``_BYTES`` for all scripts.
BANDS = {
    "latin": Band(1.3, 8.0, 0.05, 4.0), "greek": Band(0.5, 4.0, 0.10, 4.0), "cyrillic": Band(0.8, 6.0, 0.10, 4.0),
    "arabic": Band(0.5, 4.0, 0.15, 4.0), "han": Band(0.3, 3.0, 0.60, 4.0), "hangul": Band(0.3, 3.0, 0.60, 4.0),
    **dict.fromkeys(("armenian", "hebrew", "syriac", "thaana", "nko", "devanagari", "bengali", "gurmukhi", "gujarati", "oriya", "tamil", "telugu", "kannada",
                     "malayalam", "sinhala", "thai", "lao", "tibetan", "myanmar", "georgian", "ethiopic", "cherokee", "khmer", "mongolian", "kana", "other"), _BYTES),
}
_NAMES = list(BANDS)
_SCRIPT = np.full(256, len(_NAMES) - 1, np.int8)
for _name, _leads in {"latin": [*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)], "greek": [0xCE, 0xCF], "cyrillic": range(0xD0, 0xD4), "armenian": [0xD4, 0xD5],
                      "hebrew": [0xD6, 0xD7], "arabic": range(0xD8, 0xDC), "syriac": [0xDC], "thaana": [0xDE], "nko": [0xDF], "han": range(0xE3, 0xEA),
                      "hangul": range(0xEA, 0xEE)}.items():
    _SCRIPT[list(_leads)] = _NAMES.index(_name)
#: Lead bytes that several scripts share: the script by the second byte.
_SECOND = {lead: np.full(256, _SCRIPT[lead], np.int8) for lead in (0xE0, 0xE1, 0xE3)}
for _lead, _name, _low, _high in (
        (0xE0, "devanagari", 0xA4, 0xA5), (0xE0, "bengali", 0xA6, 0xA7), (0xE0, "gurmukhi", 0xA8, 0xA9), (0xE0, "gujarati", 0xAA, 0xAB), (0xE0, "oriya", 0xAC, 0xAD),
        (0xE0, "tamil", 0xAE, 0xAF), (0xE0, "telugu", 0xB0, 0xB1), (0xE0, "kannada", 0xB2, 0xB3), (0xE0, "malayalam", 0xB4, 0xB5), (0xE0, "sinhala", 0xB6, 0xB7),
        (0xE0, "thai", 0xB8, 0xB9), (0xE0, "lao", 0xBA, 0xBB), (0xE0, "tibetan", 0xBC, 0xBF), (0xE1, "myanmar", 0x80, 0x82), (0xE1, "georgian", 0x83, 0x83),
        (0xE1, "hangul", 0x84, 0x87), (0xE1, "ethiopic", 0x88, 0x8E), (0xE1, "cherokee", 0x8E, 0x8F), (0xE1, "khmer", 0x9E, 0x9F), (0xE1, "mongolian", 0xA0, 0xA2),
        (0xE1, "latin", 0xB8, 0xBB), (0xE1, "greek", 0xBC, 0xBF), (0xE3, "kana", 0x81, 0x83)):
    _SECOND[_lead][_low: _high + 1] = _NAMES.index(_name)
FEW, FENCE, LEAST = 50, 5.0, Band(0.06, 0.06, 0.04, 0.08)  # texts; spreads, 3.4 standard deviations of a normal distribution; of the median (bytes: absolute)
ABOVE = 1.08  # times the characters per token of random letters
SPAN = 6  # classes of length beyond MIN_WORDS
FAR_BANDS = 50_000  # bands that may be broadcast; beyond, the join shuffles
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS.encode())] = True
_STRIP = " \t\n\x0b\x0c\r"


def _letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The first bytes of each script's letters in each of some strings: [string, script], without ``other``."""
    script = _SCRIPT[data]
    for lead, second in _SECOND.items():
        at = np.flatnonzero(data[:-1] == lead) if len(data) else np.zeros(0, np.int64)
        script[at] = second[data[at + 1]]
    n, k = len(offsets) - 1, len(_NAMES)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    return np.bincount(owner * k + script, minlength=n * k).reshape(n, k)[:, :-1] if n else np.zeros((0, k - 1), np.int64)


def base_counts(texts: pa.Array) -> tuple[dict[str, np.ndarray], Words]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the script of each text, and its words.

    All but repeated lines and windows are counted once per distinct word.
    """
    words = split_words(texts)
    n, doc, code = words.texts, words.doc, words.code
    data, offsets = text_buffer(words.distinct)
    weigh = lambda each: np.bincount(doc, weights=each[code], minlength=n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)
    symbols = np.concatenate(([0], np.cumsum(_IS_SYMBOL[data], dtype=np.int64)))
    letters = _letters(data, offsets)
    by_script = np.stack([weigh(letters[:, k]) if letters[:, k].any() else np.zeros(n, np.int64) for k in range(letters.shape[1])])

    h, at = windows(mix(code.astype(U64)), doc, 3)  # the numbers of the words tell them apart
    key = mix(h ^ (doc[at].astype(U64) * U64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(code) + 1, bool)
    for i in range(3):
        covered[at[twice] + i] = True

    lines = np.zeros(n, np.int64)
    for i in np.flatnonzero(pc.match_substring(texts, "\n").fill_null(False).to_numpy(zero_copy_only=False)).tolist():
        every = texts[i].as_py().split("\n")
        if len(set(every)) < len(every):
            seen: set[str] = set()
            for line in every:
                if line in seen:
                    lines[i] += line.strip(_STRIP) != ""
                seen.add(line)
    return {
        "n_words": np.bincount(doc, minlength=n), "word_chars": weigh(pc.utf8_length(words.distinct).to_numpy(zero_copy_only=False)),
        "n_symbols": weigh(symbols[offsets[1:]] - symbols[offsets[:-1]]), "n_dup_lines": lines,
        "n_repeat_words": np.bincount(doc, weights=covered[:-1], minlength=n).astype(np.int64) if len(doc) else np.zeros(n, np.int64),
        "script": np.where(by_script.max(0) > 0, by_script.argmax(0), len(_NAMES) - 1),
    }, words


VOCABULARIES = ("piece", "byte")
_FERTILITY = [f"{v}_{k}" for v in VOCABULARIES for k in ("chars_per_token", "fallback_share", "token_entropy")]
_MEASURED = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean",
             "script": "string", **dict.fromkeys(_FERTILITY, "double"), "like_random": "boolean"}
_OWN = "quality own "


def _measured(docs: DataFrame, paths: tuple[str, str], text_col: str, passing: bool) -> DataFrame:
    """``docs`` and what is measured of each text, in columns named with ``_OWN``; only texts that pass the base rules with ``passing``."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{_OWN}{k}` {v}" for k, v in _MEASURED.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = vocabularies(paths)
        floors = np.zeros((len(_NAMES), len(both)))
        for name, letters in ALPHABETS.items():
            floors[_NAMES.index(name)] = [ABOVE * random_level(v, letters) for v in both]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                c, words = base_counts(part.column(part.schema.get_field_index(text_col)))
                failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT * c["n_words"])
                spelled = names(words)
                measures = list(chain.from_iterable(v.measure(words, spelled, c["word_chars"]) for v in both))
                like_random = np.all([measures[3 * i] < floors[c["script"], i] for i in range(len(both))], axis=0)
                new = [*(pa.array(c[k], pa.int64()) for k in list(_MEASURED)[:5]), pa.array(failed), pa.array([_NAMES[k] for k in c["script"]], pa.string()),
                       *(pa.array(x) for x in measures), pa.array(like_random)]
                out = pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *(_OWN + k for k in _MEASURED)])
                yield out.filter(pa.array(~failed)) if passing else out

    return docs.mapInArrow(run, schema)


def _own(name: str) -> Column:
    return F.col(f"`{_OWN}{name}`")


def _length() -> Column:
    return F.least(F.floor(F.log2(_own("n_words") / F.lit(float(MIN_WORDS)))), F.lit(SPAN)).cast("int")


def _small(bands: DataFrame) -> DataFrame:
    """For a join: broadcast, unless there are very many scripts and languages."""
    found = stored(bands, "quality-bands")
    return F.broadcast(found) if found.count() <= FAR_BANDS else found


def fences(measured: DataFrame, lang: Column) -> tuple[DataFrame, DataFrame]:
    """Bands by (script, language, length) and by (script, language): columns s, l, k and band, an array of all edges."""
    seen = (measured.where(~_own("base_failed") & ~_own("like_random")).select(_own("script").alias("s"), lang.alias("l"), _length().alias("k"), _own("n_words").alias("w"),
                                                        *(F.round(_own(x), 3).alias(x) for x in _FERTILITY)).distinct())
    quartiles = [F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(x) for x in _FERTILITY]  # rounded: few distinct values
    edges = []
    for v in VOCABULARIES:
        per, share, entropy = (F.col(f"{v}_{x}") for x in ("chars_per_token", "fallback_share", "token_entropy"))
        edges += [per[1] - F.greatest(FENCE * (per[1] - per[0]), LEAST.low * per[1]), per[1] + F.greatest(FENCE * (per[2] - per[1]), LEAST.high * per[1]),
                  share[1] + F.greatest(FENCE * (share[2] - share[1]), F.lit(LEAST.bytes)),
                  entropy[1] - F.greatest(FENCE * (entropy[1] - entropy[0]), LEAST.entropy * entropy[1])]
    return tuple(_small(seen.groupBy(*by).agg(F.count("*").alias("n"), *quartiles).where(F.col("n") >= FEW).select(*by, F.array(*edges).alias("band")))
                 for by in (["s", "l", "k"], ["s", "l"]))


def _judged(measured: DataFrame, lang_col: str | None, bands: dict[str, Band]) -> DataFrame:
    """``measured`` with ``_OWN`` kept: whether a text passes the base rules and lies in its band."""
    lang = F.col(f"`{lang_col}`") if lang_col else F.lit(None).cast("string")
    by_length, by_language = fences(measured, lang)
    wide = F.create_map(*chain.from_iterable((F.lit(k), F.array(*(F.lit(float(x)) for x in (*astuple(b), *astuple(_BYTES))))) for k, b in bands.items()))[_own("script")]
    own = measured.withColumn(_OWN + "lang", lang).withColumn(_OWN + "length", _length())
    first = by_length.select(F.col("s").alias(_OWN + "s1"), F.col("l").alias(_OWN + "l1"), F.col("k").alias(_OWN + "k1"), F.col("band").alias(_OWN + "b1"))
    second = by_language.select(F.col("s").alias(_OWN + "s2"), F.col("l").alias(_OWN + "l2"), F.col("band").alias(_OWN + "b2"))
    own = (own.join(first, (_own("script") == _own("s1")) & _own("lang").eqNullSafe(_own("l1")) & (_own("length") == _own("k1")), "left")
           .join(second, (_own("script") == _own("s2")) & _own("lang").eqNullSafe(_own("l2")), "left"))
    e = F.coalesce(_own("b1"), _own("b2"), wide)
    inside = ~_own("base_failed") & ~_own("like_random")
    for i, v in enumerate(VOCABULARIES):
        per, share, entropy = (F.round(_own(f"{v}_{x}"), 3) for x in ("chars_per_token", "fallback_share", "token_entropy"))
        inside = inside & (per >= e[4 * i]) & (per <= e[4 * i + 1]) & (share <= e[4 * i + 2]) & (entropy >= e[4 * i + 3])
    return own.withColumn(_OWN + "kept", inside)


def _lang(docs: DataFrame) -> str | None:
    return "lang" if "lang" in docs.columns and docs.schema["lang"].dataType.simpleString() == "string" else None


def measure(docs: DataFrame, paths: tuple[str, str], id_col: str = "doc_id", text_col: str = "text", bands: dict[str, Band] = BANDS) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, script and what both vocabularies measure."""
    lang = _lang(docs)
    some = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([lang] if lang else []))
    found = stored(_measured(some, paths, "text", False).drop("text"), "quality")
    shown = list(_MEASURED)
    return _judged(found, lang, bands).select("doc_id", *(_own(k).alias(k) for k in shown[:6]), _own("kept").alias("kept"), *(_own(k).alias(k) for k in shown[6:]))


def keep_good(docs: DataFrame, paths: tuple[str, str], text_col: str = "text", bands: dict[str, Band] = BANDS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are."""
    found = stored(_measured(docs, paths, text_col, True), "quality")
    return _judged(found, _lang(docs), bands).where(_own("kept")).select(*(F.col(f"`{c}`") for c in docs.columns))
