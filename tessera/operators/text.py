"""Text operators that need a corpus: TF-IDF, hashing, latent factors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, IDF, Normalizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.shared import total
from ..functions.textcount import words_of

ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaaaaceeeeiiiinooooouuuuy"


def _counted(df: DataFrame, key: str, text: str) -> DataFrame:
    """__key, __word and tf of each text's lower-cased words, without a shuffle: where its sorted words change."""
    rows = df.select(F.col(key).alias("__key"), F.array_sort(F.transform(T.words(F.col(text)), F.lower)).alias("__w")).where(F.size("__w") > 0)
    at = F.filter(F.sequence(F.lit(0), F.size("__w") - 1), lambda i: (i == 0) | (F.get("__w", i) != F.get("__w", i - 1)))
    rows = rows.withColumn("__at", at)
    each = rows.select("__key", F.explode(F.transform("__at", lambda i, k: F.struct(F.get("__w", i).alias("__word"), (F.coalesce(F.get("__at", k + 1), F.size("__w")) - i).cast("long").alias("tf")))).alias("r"))
    return each.select("__key", "r.*")


def _weighted(df: DataFrame, key: str, text: str, min_df: int, max_df: float) -> DataFrame:
    """key, word, df and score of each text's words, (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1).

    A text's words are counted in its own row, sorted, so only words and their
    numbers of texts are shuffled; rows that share a key are one text, and
    counted by key and word.
    """
    told = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    n, each = told["n"] or 0, _counted(df, key, text)
    if (told["most"] or 0) > 1:
        each = each.groupBy("__key", "__word").agg(F.sum("tf").alias("tf"))
    idf = each.groupBy("__word").agg(F.count("*").alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    score = (1 + F.log(F.col("tf").cast("double"))) * (F.log((F.lit(1.0) + n) / (1.0 + F.col("df"))) + 1)
    return each.join(idf, "__word").select("__key", "__word", "df", score.alias("score"))


def tfidf(df: DataFrame, key: str, text: str, top: int = 3, min_df: int = 2, max_df: float = 0.995) -> DataFrame:
    """Each text's ``top`` words by TF-IDF; ties by word.  A text's best words are cut by rank, not gathered in one value."""
    place = F.row_number().over(Window.partitionBy("__key").orderBy(F.desc(F.round("score", 9)), "__word"))
    best = _weighted(df, key, text, min_df, max_df).withColumn("rank", place).where(F.col("rank") <= top)
    return best.select(F.col("__key").alias(key), F.col("rank").cast("long").alias("rank"), F.col("__word").alias("word"), F.round("score", 9).alias("score"))


def token_entropy(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and token_entropy (bits) of each text's lower-cased words, from counts by text and word; 0 without words."""
    counts = df.select(F.col(key).alias("__key"), F.explode(F.transform(T.words(F.col(text)), F.lower)).alias("__word")).groupBy("__key", "__word").agg(F.count("*").cast("double").alias("n"))
    each = counts.groupBy("__key").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("e"))
    return df.select(F.col(key).alias("__own")).join(each, F.col("__own") == F.col("__key"), "left").select(F.col("__own").alias(key), F.coalesce("e", F.lit(0.0)).alias("token_entropy"))


def lexical_diversity(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and what ``functions.text.diversity`` tells of each text, from counts by text and word."""
    rows = df.select(F.col(key).alias("__own"), F.greatest(F.length(text), F.lit(1)).alias("__chars"))
    words = df.select(F.col(key).alias("__key"), F.explode(F.transform(T.words(F.col(text)), F.lower)).alias("__word")).groupBy("__key", "__word").agg(F.count("*").alias("c"))
    long, c = F.length("__word"), F.col("c")
    each = words.groupBy("__key").agg(F.sum(c).cast("double").alias("n"), F.count("*").cast("double").alias("d"), F.sum(F.when(c == 1, 1.0).otherwise(0.0)).alias("once"),
                                      F.sum(long * c).cast("double").alias("l"), F.sum(long * long * c).cast("double").alias("ll"), F.max(long).cast("long").alias("top"))
    out = rows.join(each, F.col("__own") == F.col("__key"), "left").na.fill(0.0, ["n", "d", "once", "l", "ll"]).na.fill(0, ["top"])
    n, d, mean = F.col("n"), F.col("d"), T.share(F.col("l"), F.col("n"))
    return out.select(F.col("__own").alias(key), T.share(d, n).alias("unique_ratio"), T.share(F.log1p(d), F.log1p(n)).alias("log_ttr"), T.share(d, F.sqrt("__chars")).alias("per_root_char"),
                      mean.alias("word_mean"), F.col("top").alias("word_max"), F.sqrt(F.greatest(T.share(F.col("ll"), n) - mean * mean, F.lit(0.0))).alias("word_std"), T.share(F.col("once"), n).alias("hapax_ratio"))


def hashed(df: DataFrame, key: str, text: str, features: int = 1024) -> DataFrame:
    rows = df.select(key, F.transform(T.words(F.coalesce(F.col(text), F.lit(""))), F.lower).alias("__w"))
    stages = [HashingTF(inputCol="__w", outputCol="__tf", numFeatures=features), IDF(inputCol="__tf", outputCol="__idf"), Normalizer(inputCol="__idf", outputCol="features")]
    return Pipeline(stages=stages).fit(rows).transform(rows).select(key, "features")


_FOLD = str.maketrans(ACCENTED, PLAIN)
GRAMS = (3, 4, 5)  # characters of the grams inside a word, which has a space on each side
KINDS = (("words", 0.6, 1), ("chars", 0.4, 2))  # share of the vocabulary, and texts that a term is in at least


def _times(doc: np.ndarray, term: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs of a text and a term's number, and how often each occurs."""
    many = max(1, int(term.max(initial=0)) + 1)
    keys, at = np.unique(doc * many + term, return_inverse=True)
    return keys // many, keys % many, np.bincount(at, weights=times, minlength=len(keys)).astype(np.int64) if len(keys) else np.zeros(0, np.int64)


def _spread(sizes: np.ndarray, values: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lists with ``sizes`` that lie one after the other in ``values``, how long each one of ``pick`` is, and their values."""
    start, many = (np.cumsum(sizes) - sizes)[pick], sizes[pick]
    return many, values[np.repeat(start - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]


def _known(texts: list[str | None], places: dict[str, dict[str, int]]) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What ``_terms`` counts, of the terms in ``places`` alone: the text, the term's place and how often; other terms are never made."""
    words, code, doc = words_of(pa.array([(t or "").translate(_FOLD) for t in texts], pa.large_string()))
    names = words.to_pylist()
    own, size = places["words"], max(1, len(names))
    at = np.array([own.get(w, -1) for w in names], np.int64)[code] if names else code
    halves = {tuple(t.split(" ")): i for t, i in own.items() if " " in t}
    needed = {w for pair in halves for w in pair}
    number = {w: i for i, w in enumerate(names) if w in needed}
    pairs = sorted((number[a] * size + number[b], i) for (a, b), i in halves.items() if a in number and b in number)
    keys, values = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    follows = np.flatnonzero(doc[1:] == doc[:-1])
    met = code[follows] * size + code[follows + 1]
    some = np.isin(met, keys)
    found = values[np.searchsorted(keys, met[some])]
    out = {"words": _times(np.concatenate((doc[at >= 0], doc[follows[some]])), np.concatenate((at[at >= 0], found)))}
    grams, sizes, own = [], np.zeros(len(names), np.int64), places["chars"]
    for i, w in enumerate(names):  # each different word once
        p = f" {w} "
        before = len(grams)
        grams += [c for g in GRAMS for k in range(len(p) - g + 1) if (c := own.get(p[k: k + g])) is not None]
        sizes[i] = len(grams) - before
    has = sizes[code] > 0 if names else np.zeros(0, bool)
    many, gram = _spread(sizes, np.array(grams, np.int64), code[has])
    out["chars"] = _times(np.repeat(doc[has], many), gram)
    return out


def _terms(texts: list[str | None]) -> dict[str, tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """Of each kind the different terms, and of each (text, term) that occurs the text, the term and how often: word 1- and 2-grams, and character grams inside words."""
    words, code, doc = words_of(pa.array([(t or "").translate(_FOLD) for t in texts], pa.large_string()))
    names = words.to_pylist()

    one = _times(doc, code)
    follows = np.flatnonzero(doc[1:] == doc[:-1])
    pair, at = np.unique(code[follows] * max(1, len(names)) + code[follows + 1], return_inverse=True)
    two = _times(doc[follows], at)
    size = max(1, len(names))
    both = [*names, *(f"{names[p // size]} {names[p % size]}" for p in pair.tolist())]
    out = {"words": (both, *(np.concatenate(x) for x in ((one[0], two[0]), (one[1], two[1] + len(names)), (one[2], two[2]))))}
    number: dict[str, int] = {}
    grams, sizes = [], []
    for w in names:  # each different word once
        p = f" {w} "
        own = [number.setdefault(p[i: i + g], len(number)) for g in GRAMS for i in range(len(p) - g + 1)]
        grams += own
        sizes.append(len(own))
    sizes, grams = np.array(sizes, np.int64), np.array(grams, np.int64)
    many, gram = _spread(sizes, grams, one[1])
    out["chars"] = (list(number), *_times(np.repeat(one[0], many), gram, np.repeat(one[2], many)))
    return out


def _parts(texts: list[str | None], most: int = 2_000_000):
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t or "") > most:
            yield texts[at:i]
            at, size = i, 0
        size += len(t or "")
    if at < len(texts):
        yield texts[at:]


@dataclass
class Lexical:
    """Vocabularies, weights and factors of a corpus, to replay on other texts."""

    terms: dict[str, list[str]]
    idf: dict[str, list[float]]
    factors: np.ndarray
    values: list[float]  # the singular values

    @property
    def width(self) -> int:
        return sum(len(t) for t in self.terms.values())

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        """The unit-length TF-IDF vectors [texts, vocabulary]."""
        out, done = np.zeros((len(texts), self.width)), 0
        places = {kind: {t: i for i, t in enumerate(self.terms[kind])} for kind, _, _ in KINDS}
        for part in _parts(texts):
            found, column = _known(part, places), 0
            for kind, _, _ in KINDS:
                doc, term, times = found[kind]
                out[doc + done, term + column] = times * np.array(self.idf[kind])[term] if len(term) else 0.0
                column += len(places[kind])
            done += len(part)
        size = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(size > 0, size, 1.0)

    def transform(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """``df`` with the array column ``out``: the factors' products with each text's unit-length TF-IDF vector."""
        shared = df.sparkSession.sparkContext.broadcast(self)  # the vocabulary's size times dims

        @F.pandas_udf("array<double>")
        def factors(x: pd.Series) -> pd.Series:
            own = shared.value
            return pd.Series((own.vectors([t if isinstance(t, str) else None for t in x]) @ own.factors).tolist(), dtype=object)

        return df.withColumn(out, factors(F.col(f"`{text}`").cast("string")))


def vocabulary(df: DataFrame, text: str, size: int) -> tuple[dict[str, list[str]], dict[str, list[float]]]:
    """The commonest terms of all texts, by kind, and their inverse document frequencies: ties by term."""

    def run(batches):
        for b in batches:
            for part in _parts(b.column(0).to_pylist()):
                for kind, (names, _, term, times) in _terms(part).items():
                    tf, docs = np.bincount(term, weights=times, minlength=len(names)).astype(np.int64), np.bincount(term, minlength=len(names))
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(tf), pa.array(docs)], names=["kind", "term", "tf", "docs"])

    n = df.count()
    counts = (df.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "kind string, term string, tf long, docs long")
              .groupBy("kind", "term").agg(F.sum("tf").alias("tf"), F.sum("docs").alias("docs")).persist())
    terms, idf = {}, {}
    for kind, share, least in KINDS:
        best = (counts.where((F.col("kind") == kind) & (F.col("docs") >= least) & (F.col("docs") <= (0.995 * n if n > 10 else n)))
                .orderBy(F.desc("tf"), "term").limit(max(1, int(size * share))).collect())
        terms[kind] = [r["term"] for r in best]
        idf[kind] = [float(np.log((n + 1) / (r["docs"] + 1))) for r in best]
    counts.unpersist()
    return terms, idf


def fit_lexical(df: DataFrame, key: str, text: str, dims: int = 64, seed: int = 42) -> Lexical:
    """Vocabularies of words and character grams (60 to 40 of ``dims * 6``, 64 at least), TF-IDF, and the leading factors of all texts."""
    terms, idf = vocabulary(df, text, max(64, dims * 6))
    made = Lexical(terms, idf, np.zeros((0, 0)), [])

    def run(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            for at in range(0, len(texts), 1000):
                x = made.vectors(texts[at: at + 1000]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], names=["x"])

    rows = df.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "x binary").persist()
    made.factors, values = right_factors(rows, made.width, dims, seed)
    made.values = values.tolist()
    rows.unpersist()
    return made


OVER, POWERS = 10, 3  # directions beyond those asked for, and passes that sharpen them


def right_factors(rows: DataFrame, width: int, dims: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The leading right factors [width, dims] and singular values of a tall matrix (uncentred), by a randomised range finder.

    ``rows`` has blobs ``x`` of float32 rows.  A pass multiplies some random
    directions by x'x, without forming it; after ``POWERS`` passes a tall-skinny
    QR over the partitions leaves a small triangle, whose decomposition gives the
    factors.  The driver holds ``width`` times ``dims + OVER`` numbers.
    """
    k = min(width, dims + OVER)

    def summed(directions: np.ndarray):
        def partial(batches):
            out = None
            for b in batches:
                for blob in b.column(0):
                    x = np.frombuffer(blob.as_buffer(), np.float32).reshape(-1, width).astype(float)
                    part = x.T @ (x @ directions)
                    out = part if out is None else out + part
            return out

        return partial

    def triangle(directions: np.ndarray):
        def partial(batches):
            out = None
            for b in batches:
                for blob in b.column(0):
                    x = np.frombuffer(blob.as_buffer(), np.float32).reshape(-1, width).astype(float) @ directions
                    out = np.linalg.qr(x if out is None else np.concatenate((out, x)), "r")
            return out

        return partial

    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, k)))[0]
    for _ in range(POWERS if k < width else 0):
        z = total(rows, summed(q))
        if z is None:
            break
        q = np.linalg.qr(z)[0]
    r = total(rows, triangle(q), lambda parts: np.linalg.qr(np.concatenate(parts), "r"))
    if r is None:
        return np.zeros((width, min(dims, width))), np.zeros(min(dims, width))
    _, values, w = np.linalg.svd(r, full_matrices=True)
    v = (q @ w.T)[:, : min(dims, width)]
    values = np.concatenate((values, np.zeros(width)))[: v.shape[1]]
    return v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0), values


def latent(df: DataFrame, key: str, text: str, dims: int = 8, features: int = 256) -> DataFrame:
    """Latent factors of the hashed TF-IDF matrix by a truncated, uncentred decomposition; the signs are those of each factor's largest entry."""
    from pyspark.ml.functions import vector_to_array

    rows = hashed(df, key, text, features)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(0).flatten()).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], names=["x"])

    v, _ = right_factors(rows.select(vector_to_array("features").alias("x")).mapInArrow(run, "x binary"), features, dims)

    @F.pandas_udf("array<double>")
    def factors(x: pd.Series) -> pd.Series:
        return pd.Series((np.stack(x.to_list()) @ v).tolist() if len(x) else [], dtype=object)

    return rows.select(key, factors(vector_to_array("features")).alias("lsa"))
