"""Quality rules: a threshold table compiled into one native Spark projection.

Input: a table with an id and a text column (other columns are ignored, so their names
cannot clash). Output: one row per input row, repeated rows included.

The stop-word rule has lists of four languages. Words are matched without regard to case, and texts
whose letters are mostly not Latin ones are not judged by it; long texts of other languages in
Latin letters are rejected, unless they share two of the words.

Defined results: null or empty text has no words and every count 0, so ``base_failed`` is
true and ``kept`` false; a null id is passed through; an empty table gives an empty table;
very long texts are handled in O(n log n) in their own row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

# Frequent function words of four languages.
STOP_WORDS = (
    "the of and to in is by for at as was this are with be it that on he an "
    "der die das und ist von mit den ein eine auf nicht für zu des dem im sich "
    "le la les de et en un une du des que pas est il pour dans sur par au ce "
    "el los las y que del se por con para una su al lo como es"
).split()

#: Different stop words that a text mostly of Latin letters must have.
STOP_KINDS = 2
#: (name, measure, lowest allowed, highest allowed, words a text needs for the rule to apply).
#: A text is rejected by a rule when its measure is outside the two bounds.
RULES: tuple[tuple[str, str, float | None, float | None, int], ...] = (
    ("length", "n_words", 20, None, 0),
    ("mean_word_chars", "mean_word_chars", 2.0, 14.0, 20),
    ("symbol_ratio", "symbol_ratio", None, 0.2, 0),
    ("stop_words", "missing_stop_kinds", None, 0, 40),
    ("duplicate_lines", "dup_line_ratio", None, 0.4, 0),
    ("repeated_windows", "repeat_ratio", None, 0.3, 0),
)

WINDOW = 8
_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"
_SYMBOLS = r"[#*$%&|<>]+"


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more.

    Hashes are sorted with their positions; a window is flagged if a neighbour in that order
    has its hash; the union of the flagged windows is summed by sorted start.
    """

    def covered(pairs: Column) -> Column:
        n = F.size(pairs)
        flagged = F.filter(
            pairs,
            lambda p, i: ((i > 0) & (F.get(pairs, i - 1)["h"] == p["h"])) | ((i < n - 1) & (F.get(pairs, i + 1)["h"] == p["h"])),
        )
        return F.array_sort(F.transform(flagged, lambda p: p["i"]))

    def total(starts: Column) -> Column:
        steps = F.transform(starts, lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - s, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    once = F.transform(F.array(pairs), covered)
    exact = F.element_at(F.transform(once, total), 1)
    unique = F.size(F.array_distinct(hashes)) == F.size(hashes)
    return F.when(unique, F.lit(0).cast("long")).otherwise(exact)


def verdict(rules: Sequence[tuple[str, str, float | None, float | None, int]] = RULES) -> Column:
    """The threshold table as one boolean expression over the measure columns."""
    ok = F.lit(True)
    for _, measure, low, high, least in rules:
        bad = F.lit(False)
        if low is not None:
            bad = bad | (F.col(measure) < F.lit(low))
        if high is not None:
            bad = bad | (F.col(measure) > F.lit(high))
        ok = ok & ~(bad & (F.col("n_words") >= F.lit(least)))
    return ok


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Counts and ratios of each text: no shuffle and no user function."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, _SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD))
    base = docs.select(F.col(id_col).alias(id_col), text.alias("text"), words.alias("words"), lines.alias("lines"))
    hashes = F.when(
        F.size("words") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))
    stops = F.array(*[F.lit(w) for w in dict.fromkeys(stop_words)])
    low_words = F.split(ascii_lower(F.col("text")), _SPACE)
    latin = 2 * F.length(F.regexp_replace("text", "[^A-Za-z]+", "")) >= F.length(F.array_join("words", ""))
    kinds = F.size(F.array_intersect(low_words, stops))
    counted = base.select(
        id_col,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(latin, F.greatest(F.lit(0), F.lit(STOP_KINDS) - kinds)).otherwise(F.lit(0)).cast("long").alias("missing_stop_kinds"),
        F.col("words"),
        hashes.alias("hashes"),
    )
    full = counted.withColumn("n_repeat_words", _repeat_words(F.col("words"), F.col("hashes"))).drop("words", "hashes")
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return full.withColumns(
        {
            "mean_word_chars": per_word("word_chars"),
            "symbol_ratio": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "repeat_ratio": per_word("n_repeat_words"),
        }
    )


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Measures with ``base_failed`` and ``kept``."""
    m = measure(docs, id_col, text_col)
    failed = (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))
    return m.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
