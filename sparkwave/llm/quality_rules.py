"""Quality rules: a table of thresholds compiled into one projection.

Each rule names a ratio and the range it must stay in. All ratios are built from
a few counts of the text (words, characters, symbols, stop words, lines), so the
whole table becomes one Spark projection of built-in functions. There is no
shuffle and a row never leaves its partition.

Defined results: a null or empty text has no words, all counts 0, and fails.
Ratios with an empty denominator are 0. Rows are judged one by one, so repeated
rows and null ids get the same verdict as any other row. Other columns stay.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwave.llm.common import NOT_SPACE, SPACE, free_name, let, text_of, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "are", "this",
    "de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "qui", "dans", "est", "pour", "par", "sur",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "auf", "ist", "im", "dem", "nicht", "ein",
    "el", "los", "del", "se", "las", "por", "con", "no", "una", "su", "para", "al", "y",
)


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high``; a limit of None is open."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


#: Counts a rule may use: word_chars n_words n_symbols n_chars n_lines n_dup_lines n_stop n_upper n_marks.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("marks_per_word", "n_marks", "n_words", None, 0.5),
    Rule("stop_word_share", "n_stop", "n_words", 0.02, None),
    Rule("upper_case_share", "n_upper", "n_words", None, 0.5),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", None, 0.5),
)


def _repeat_words(words: Column) -> Column:
    """Words inside a three-word window that occurs at least twice.

    Windows are sorted with their positions, so equal ones are neighbours.
    Most texts repeat no window; those are told by distinct window hashes
    (equal windows have equal hashes) and skip the sort.
    """

    def at(w: Column, i: Column) -> Column:
        return F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def twice(s: Column) -> Column:
        def same(x: Column, k: Column) -> Column:
            return F.coalesce(F.get(s, k)["t"] == x["t"], F.lit(False))

        found = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
        covered = F.flatten(F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(covered))

    def counted(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 3)
        hashes = F.transform(places, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        windows = F.transform(places, lambda i: F.struct(at(w, i).alias("t"), i.alias("i")))
        alone = F.size(F.array_distinct(hashes)) == F.size(w) - 2
        return F.when(F.size(w) < 4, 0).when(alone, 0).otherwise(let(F.array_sort(windows), twice))

    return let(words, counted).cast("long")


def _lengths(text: Column, drop: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, drop, ""))


def counts(text: Column) -> Column:
    """All counts of a text as one struct."""
    words = words_of(text)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(text).cast("long").alias("n_chars"),
        F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long").alias("word_chars"),
        _lengths(text, "[#*$%&|<>]").cast("long").alias("n_symbols"),
        _lengths(text, "[!?]").cast("long").alias("n_marks"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
        F.size(F.filter(words, lambda w: (F.length(w) > 1) & (w == F.upper(w)) & (w != F.lower(w)))).cast("long").alias("n_upper"),
        _repeat_words(words).alias("n_repeat_words"),
    )


def compile_rules(rules: Sequence[Rule], count: Column) -> list[Column]:
    """One boolean column per rule: whether the text breaks it."""
    out = []
    for r in rules:
        below = count[r.denominator].cast("double")
        ratio = F.when(below > 0, count[r.numerator] / below).otherwise(0.0)
        broken = F.lit(False)
        if r.low is not None:
            broken = broken | (ratio < r.low)
        if r.high is not None:
            broken = broken | (ratio > r.high)
        out.append(broken.alias(r.name))
    return out


def judge(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, out: str = "quality") -> DataFrame:
    """``df`` with a struct ``out``: the counts, ``base_failed``, ``broken`` (names of broken rules) and ``kept``.

    A column of the same name is replaced.
    """
    full = df.withColumn(out, counts(text_of(text)))
    c = F.col(out)
    failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
    broken = F.array_compact(F.array(*[F.when(x, F.lit(r.name)) for r, x in zip(rules, compile_rules(rules, c), strict=True)]))
    return full.withColumn(out, c.withField("base_failed", failed).withField("broken", broken).withField("kept", ~failed & (F.size(broken) == 0)))


def keep(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``df`` that break no rule, all columns."""
    out, once = free_name(df, "_quality"), free_name(df, "_once")
    judged = judge(df, text, rules, out)
    # a filter would be pushed below the counts and make them twice; a generator stays above
    passed = F.when(F.col(out)["kept"], F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return judged.select(*[F.col(f"`{c}`") for c in df.columns], F.explode(passed).alias(once)).drop(once)
