"""Text features as column expressions: no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
SENTENCE = ".!?؟。！？"  # fixed value: what ends a sentence


def single(c: Column, characters: str) -> Column:
    """How many of some characters a text has, without a pattern: by what is left when they go."""
    return F.length(c) - F.length(F.translate(c, characters, ""))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({WORD})"), F.lit(1))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def char_stats(c: Column) -> dict[str, Column]:
    return {"chars": F.length(c).cast("long"), "words": count(c, WORD).cast("long"), "sentences": count(c, f"[{SENTENCE}]+").cast("long"),
            "lines": (count(c, "\n") + 1).cast("long"), "questions": single(c, "?؟").cast("long"), "exclamations": single(c, "!").cast("long")}


def ratios(c: Column) -> dict[str, Column]:
    n, letters = F.length(c), count(c, r"\p{L}")
    return {"digit": share(count(c, r"\p{Nd}"), n), "alpha": share(letters, n), "upper": share(count(c, r"\p{Lu}"), letters), "lower": share(count(c, r"\p{Ll}"), letters),
            "space": share(single(c, " \t\n\r"), n), "punctuation": share(count(c, r"\p{P}"), n), "symbol": share(count(c, r"\p{S}"), n), "non_ascii": share(count(c, r"[^\x00-\x7F]"), n)}


def scripts(c: Column) -> dict[str, Column]:
    letters = count(c, r"\p{L}")
    return {"latin": share(count(c, r"\p{IsLatin}"), letters), "arabic": share(count(c, r"\p{IsArabic}"), letters),
            "cyrillic": share(count(c, r"\p{IsCyrillic}"), letters), "han": share(count(c, r"\p{IsHan}"), letters),
            "hiragana": share(count(c, r"\p{IsHiragana}"), letters), "katakana": share(count(c, r"\p{IsKatakana}"), letters), "hangul": share(count(c, r"\p{IsHangul}"), letters)}


def patterns(c: Column) -> dict[str, Column]:
    return {"urls": count(c, r"https?://[^ \n]+").cast("long"), "emails": count(c, r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+").cast("long"),
            "repeats": count(c, r"(.)\1{2,}").cast("long"), "symbols": count(c, r"\p{S}").cast("long")}


def shape(c: Column) -> dict[str, Column]:
    """newline and numeric-token ratios, and whether the text is empty."""
    w = words(c)
    return {"newline_ratio": share(single(c, "\n"), F.length(c)), "numeric_ratio": share(F.size(F.filter(w, lambda x: x.rlike(r"^\p{N}+$"))), F.size(w)),
            "empty": (F.trim(c) == "").cast("int")}


def characters(c: Column) -> Column:
    """The characters of a text."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def diversity(c: Column) -> dict[str, Column]:
    w = F.transform(words(c), F.lower)
    n, d = F.size(w), F.size(F.array_distinct(w))
    length = F.transform(w, F.length)
    total = F.aggregate(length, F.lit(0).cast("long"), lambda a, x: a + x)
    square = F.aggregate(length, F.lit(0).cast("long"), lambda a, x: a + x * x)
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("once"))
    end = lambda a: a["once"] + F.when(a["run"] == 1, 1).otherwise(0)
    step = lambda a, x: F.struct(x.alias("last"), F.when(a["last"] == x, a["run"] + 1).otherwise(1).alias("run"), F.when(a["last"] == x, a["once"]).otherwise(end(a)).alias("once"))
    once = F.aggregate(F.array_sort(w), start, step, end)  # runs of one in sorted order
    return {"unique_ratio": share(d, n), "log_ttr": share(F.log1p(d.cast("double")), F.log1p(n.cast("double"))), "per_root_char": share(d, F.sqrt(F.greatest(F.length(c), F.lit(1)))),
            "word_mean": share(total, n), "word_max": F.coalesce(F.array_max(length), F.lit(0)).cast("long"),
            "word_std": F.sqrt(F.greatest(share(square, n) - share(total, n) * share(total, n), F.lit(0.0))), "hapax_ratio": share(once, n)}


def entropy(items: Column) -> Column:
    """Entropy in bits of an array's values: sorted, then run lengths in one pass."""
    ordered = F.array_sort(items)
    n = F.size(items).cast("double")
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    close = lambda a: F.when(a["run"] > 0, a["run"] * F.log2(F.greatest(a["run"], F.lit(1.0)))).otherwise(0.0)
    step = lambda a, x: F.struct(x.alias("last"), F.when(a["last"] == x, a["run"] + 1.0).otherwise(1.0).alias("run"),
                                 F.when(a["last"] == x, a["sum"]).otherwise(a["sum"] + close(a)).alias("sum"))
    total = F.aggregate(ordered, start, step, lambda a: a["sum"] + close(a))
    return F.when(n > 0, F.log2(F.greatest(n, F.lit(1.0))) - total / F.greatest(n, F.lit(1.0))).otherwise(0.0)


def bounded(c: Column, most: int) -> Column:
    """Head, middle and tail of a long text."""
    part = most // 3
    middle = (F.length(c) / 2 - part / 2).cast("int")
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, part), F.lit("\n…\n"), F.substring(c, middle + 1, F.lit(part)), F.lit("\n…\n"), F.right(c, F.lit(part))))
