"""Quality rules as one projection: a table of thresholds over ratios of a text.

Everything is built-in column functions. Arrays that several parts of an
expression read are bound once per row as the variable of a one-element
transform, since the optimizer would otherwise repeat the work for each use.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What separates words, and which characters count as symbols.
SPACE = "[ \\t\\n\\x0B\\f\\r]"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 3
LEAST_WORDS = 50

# Frequent short words of the languages that the rules know.
STOP_WORDS = (
    "the", "and", "of", "to", "in", "is", "that", "for", "with", "on",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "ein",
    "le", "la", "les", "de", "des", "et", "un", "une", "du", "que",
    "el", "los", "las", "y", "en", "por", "con", "del", "una", "no",
)


@dataclass(frozen=True)
class Threshold:
    """A text passes if its measure is not below ``least`` and not above ``most``."""

    measure: str
    least: float | None = None
    most: float | None = None


RULES = (
    Threshold("mean_word_chars", least=2.0, most=15.0),
    Threshold("symbols_per_word", most=0.5),
    Threshold("stop_words", least=2),
    Threshold("dup_line_share", most=0.5),
    Threshold("ellipsis_line_share", most=0.3),
    Threshold("bullet_line_share", most=0.9),
)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more.

    Windows are 63-bit hashes. Sorted together with their places (the hash
    scaled down to leave room for the place), equal ones are neighbours; the
    full hashes then decide. The places found, in order, cover as many words as
    the gaps between them allow. Should scaled hashes have mixed up unequal
    windows, there are fewer places than the sorted full hashes show; only then
    the places are looked up one by one.
    """
    n = F.size(words) - (WINDOW - 1)

    def hashed(i: Column) -> Column:
        parts = [F.get(words, i + j) for j in range(WINDOW)]
        return F.xxhash64(*parts).bitwiseAND(F.lit(2**63 - 1))

    def repeated(sorted_hashes: Column) -> Column:
        return F.filter(sorted_hashes, lambda x, i: _near(sorted_hashes, i, lambda y: x == y))

    def places(hashes: Column) -> Column:
        scale = F.size(hashes).cast("long")
        packed = F.sort_array(F.transform(
            hashes, lambda h, i: F.call_function("div", h, scale) * scale + i.cast("long")))

        def chosen(p: Column) -> Column:
            def twin(x: Column, i: Column) -> Column:
                own = F.get(hashes, (x % scale).cast("int"))
                return _near(p, i, lambda y: F.get(hashes, (y % scale).cast("int")) == own)

            return F.sort_array(F.transform(F.filter(p, twin), lambda x: x % scale))

        return bound(packed, chosen)

    def looked_up(hashes: Column, again: Column) -> Column:
        return F.filter(
            F.transform(hashes, lambda h, i: F.when(F.array_contains(again, h), i.cast("long"))),
            lambda x: x.isNotNull())

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda x, i: F.least(
            F.lit(WINDOW).cast("long"), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW).cast("long"))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, x: total + x)

    def count(hashes: Column) -> Column:
        def decide(again: Column) -> Column:
            return F.when(F.size(again) == 0, F.lit(0).cast("long")).otherwise(
                bound(places(hashes), lambda at: F.when(F.size(at) == F.size(again), covered(at)).otherwise(
                    bound(looked_up(hashes, again), covered))))

        return bound(F.sort_array(hashes), lambda s: bound(repeated(s), decide))

    windows = F.transform(F.sequence(F.lit(0), n - 1), hashed)
    return F.when(n < 2, F.lit(0).cast("long")).otherwise(bound(windows, count))


def _near(values: Column, i: Column, test: Callable[[Column], Column]) -> Column:
    """Whether the neighbour before or after place i passes the test."""
    before = F.coalesce(test(F.get(values, i - 1)), F.lit(False))
    return before | F.coalesce(test(F.get(values, i + 1)), F.lit(False))


def verdict(rules: tuple[Threshold, ...]) -> Column:
    """All thresholds as one condition on the columns they name; an unknown measure passes no rule."""
    tests = [F.lit(True)]
    for rule in rules:
        if rule.least is not None:
            tests.append(F.coalesce(F.col(rule.measure) >= rule.least, F.lit(False)))
        if rule.most is not None:
            tests.append(F.coalesce(F.col(rule.measure) <= rule.most, F.lit(False)))
    return reduce(lambda a, b: a & b, tests)


def quality_rules(
    docs: DataFrame, rules: tuple[Threshold, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Counts and verdict for every row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, and the ratios of the rules.

    A null text counts as an empty one: no words, base_failed true, kept
    false. Repeated rows are judged alike, and an empty table gives an empty
    result. Only the id and the text are read, so other columns may have any name.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    words = F.array_remove(F.split("text", f"{SPACE}+"), "")
    lines = F.filter(F.split("text", "\\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    known = F.array(*[F.lit(w) for w in STOP_WORDS])

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated_words(w).alias("n_repeat_words"),
            F.size(F.array_intersect(known, F.transform(w, F.lower))).cast("long").alias("stop_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x, lambda y: F.rtrim(y).endswith("..."))).cast("long").alias("ellipses"),
            F.size(F.filter(x, lambda y: F.ltrim(y).startswith("- ") | F.ltrim(y).startswith("* "))).cast("long").alias("bullets"))

    measured = rows.select(
        "doc_id", F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.inline(F.transform(F.array(F.struct(bound(words, of_words).alias("w"), bound(lines, of_lines).alias("l"))),
                             lambda both: both)))
    n = F.nullif(F.col("n_words"), F.lit(0).cast("long"))
    n_lines = F.nullif(F.col("n_lines"), F.lit(0).cast("long"))
    ratios = measured.select("doc_id", "n_symbols", "w.*", "l.*").select(
        "*",
        (F.col("word_chars") / n).alias("mean_word_chars"), (F.col("n_symbols") / n).alias("symbols_per_word"),
        (F.col("n_dup_lines") / n_lines).alias("dup_line_share"), (F.col("ellipses") / n_lines).alias("ellipsis_line_share"),
        (F.col("bullets") / n_lines).alias("bullet_line_share"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return ratios.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & verdict(rules)).alias("kept"),
        *[F.col(name) for name in dict.fromkeys(rule.measure for rule in rules)])
