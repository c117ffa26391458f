"""Multilingual mixture inference.

A byte n-gram model per language is learned from a bounded, hash-chosen sample
of labelled texts; their n-grams are counted where they are, and only the counts
are gathered.  Each word of a text has a likelihood under every language (the
sum of its n-grams); expectation-maximisation finds the text's language
proportions, and backward elimination drops the smallest language as long as
the penalised likelihood (BIC) doesn't fall by more than ``SLACK``.  The largest
proportion names the text, and is its score.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
so is every text if nothing is labelled; ties go to the language that sorts
first; whole texts are read, very long ones too; repeated rows repeat, and teach
as often; rows without lang or id don't teach, nor do languages beyond the
``LANGUAGES`` most frequent; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_resident
from .wordhash import text_buffer, word_bounds

ORDERS = (2, 3, 4)  # bytes of an n-gram
SLOTS = 1 << 16  # hashed n-grams of each order
SAMPLE = 1500  # labelled texts a language, in expectation
LANGUAGES = 256  # languages that are learned, the most frequent ones
SHARDS = 8  # tasks that count the sample
ROUNDS = 6  # EM steps between eliminations
SLACK = 1.0  # nats: what so few EM steps may be short of the likelihood's maximum
UND = "und"
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """The slot of the n-gram that ends at each byte; the text before the first byte is spaces."""
    low = _FOLD[data]
    h = np.zeros(len(low), np.uint32)
    for back in range(order):
        one = low if back == 0 else np.concatenate((np.full(min(back, len(low)), 32, np.uint32), low[:-back]))
        h = h * np.uint32(0x01000193) + one * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h & np.uint32(SLOTS - 1)).astype(np.int64)


class Model:
    """Log-likelihood tables: [language, order, slot], scaled to one n-gram order's evidence."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        p = counts + 0.1
        self.table = (np.log(p / p.sum(-1, keepdims=True)) / len(ORDERS)).astype(np.float32)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each word (with the byte after it) under every language, and its text number."""
        starts, ends, doc = word_bounds(data, offsets)
        slot = [grams(data, order) for order in ORDERS]
        out = np.empty((len(starts), len(self.languages)))
        for k in range(len(self.languages)):
            score = sum(self.table[k, o][slot[o]] for o in range(len(ORDERS)))
            total = np.concatenate(([0.0], np.cumsum(score, dtype=np.float64)))
            out[:, k] = total[ends] - total[starts]
        return out, doc


def mixtures(loglik: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Proportions [text, language] by EM and backward elimination; zeros for texts without words."""
    k = loglik.shape[1]
    share = np.zeros((n, k))
    if not len(doc) or not k:
        return share
    count = np.bincount(doc, minlength=n)
    some = np.flatnonzero(count)
    at = np.concatenate(([0], np.cumsum(count[some])[:-1]))
    rank = np.repeat(np.arange(len(some)), count[some])
    words = count[some].astype(float)
    top = loglik.max(1, keepdims=True)
    like = np.exp(np.maximum(loglik - top, -50.0))
    active = np.ones((len(some), k), bool)

    def em(active: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(ROUNDS):
            r = like * pi[rank]
            r /= r.sum(1, keepdims=True)
            pi = np.add.reduceat(r, at, axis=0) / words[:, None]
        return pi, np.add.reduceat(np.log((like * pi[rank]).sum(1)), at)

    pi, fit = em(active, np.full((len(some), k), 1.0 / k))
    for _ in range(k - 1):
        least = np.where(active, pi, np.inf).argmin(1)
        row = np.arange(len(some))
        tried = active.copy()
        tried[row, least] = False
        start = np.where(tried, np.maximum(pi, 1e-6), 0.0)
        start /= np.maximum(start.sum(1, keepdims=True), 1e-300)
        one = active.sum(1) <= 1
        start[one], tried[one] = pi[one], active[one]
        other, worse = em(tried, start)
        drop = ~one & (worse + 0.5 * np.log(words) + SLACK >= fit)
        if not drop.any():
            break
        active[drop], pi[drop], fit[drop] = tried[drop], other[drop], worse[drop]
    share[some] = pi
    return share


def gram_counts(texts: pa.Array) -> np.ndarray:
    """How often each n-gram occurs in some texts: [order, slot]."""
    data, _ = text_buffer(pc.binary_join_element_wise(texts.cast(pa.string()), "", " "))
    return np.stack([np.bincount(grams(data, order), minlength=SLOTS) for order in ORDERS])


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> Model:
    """A model of about ``per_language`` rows a language with a label outside fold 0, chosen by a hash of the id."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL AND id IS NOT NULL AND pmod(crc32(encode(id, 'UTF-8')), 5) <> 0")
    many = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    languages = sorted(many)
    counts = np.zeros((len(languages), len(ORDERS), SLOTS))
    if not many:
        return Model(languages, counts)
    share = F.create_map(*[x for lang, n in many.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))])
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    picked = rows.where(draw < F.try_element_at(share, F.col("lang"))).where("text IS NOT NULL").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_resident()
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang in pc.unique(b.column(0)).to_pylist():
                found = gram_counts(b.column(1).filter(pc.equal(b.column(0), lang)))
                total[lang] = total[lang] + found if lang in total else found
        for lang, found in total.items():
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(found.ravel()[some])], names=["lang", "gram", "n"])

    found = picked.repartition(SHARDS).mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    place = {lang: k for k, lang in enumerate(languages)}
    owner = np.array([place[x] for x in found["lang"].to_pylist()], np.int64)
    counts.reshape(len(languages), -1)[owner, found["gram"].to_numpy()] = found["n"].to_numpy()
    return Model(languages, counts)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE,
             model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the language mixture of every row; learns from ``docs`` unless given a model."""
    if model is None:
        model = learn(docs, id_col, text_col, lang_col, per_language)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: languages x orders x slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_resident()
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                label, score, mix = _decide(part.column(1), model)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(label), pa.array(score), pa.array(mix)],
                                                 names=["doc_id", "lang_pred", "score", "mixture"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return (rows.mapInArrow(run, "doc_id long, lang_pred string, score double, mixture string")
            .select("doc_id", F.expr("coalesce(pmod(crc32(encode(cast(doc_id AS string), 'UTF-8')), 5) = 0, false)").alias("held_out"),
                    "lang_pred", "score", "mixture"))


def _decide(texts: pa.Array, model: Model) -> tuple[list[str], list[float], list[str]]:
    data, offsets = text_buffer(texts)
    loglik, doc = model.words(data, offsets)
    share = mixtures(loglik, doc, len(texts))
    label, score, mix = [], [], []
    for i in range(len(texts)):
        if share[i].any() and _LETTER.search(texts[i].as_py()):
            best = int(share[i].argmax())
            label.append(model.languages[best])
            score.append(min(1.0, max(0.0, float(share[i, best]))))
            mix.append(",".join(f"{x}:{s:.3f}" for x, s in zip(model.languages, share[i], strict=True) if s > 0))
        else:
            label.append(UND)
            score.append(0.0)
            mix.append("")
    return label, score, mix


def keep_known(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
               per_language: int = SAMPLE) -> DataFrame:
    """The rows whose text is in a learned language with a share of ``least`` at least; all columns as they are.

    Without a labelled row there is no language to tell, and every row stays.
    """
    model = learn(docs, id_col, text_col, lang_col, per_language)
    if not model.languages:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_resident()
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                label, score, _ = _decide(part.column(part.schema.get_field_index(text_col)), shared.value)
                yield part.filter(pa.array([x != UND and s >= least for x, s in zip(label, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
