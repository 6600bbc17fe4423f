"""Quality rules, line first: rules judge each line, failed lines go, and a document that loses too much
of its text is rejected. DataFrame functions only; nothing is shuffled.

Nulls: a null text counts as empty, a null doc_id stays null. A text without words fails the base rules.
Repeated rows and ties are judged row by row; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what divides words.
SPACE = " \t\n\x0b\x0c\r"
#: As regular expressions: a word, the end of a sentence, marks heaped up, separators of menus, symbols.
WORD = r"[^\x20\x09-\x0D]+"
END = r"[.!?…。！？][\"'”’)\]]*\z"
MARK = r"[.!?…。！？][\"'”’)\]]*(?:[\x20\x09-\x0D]|\z)"
HEAPED = r"[!?]{2,}"
SEPARATOR = r"[|›•·→]"
SYMBOL, NO_SYMBOL = r"[#*$%&|<>]", r"[^#*$%&|<>]+"
ODD = rf"{HEAPED}|{SEPARATOR}|{SYMBOL}"
#: Phrases of pages' frames.
BOILERPLATE = r"(?i)(?:^|[^a-z])(?:all rights reserved|click here|cookie policy|copyright \(c\)|enable javascript|licensed under|lorem ipsum|privacy policy|sign up for|skip to content|spdx-license|subscribe to|terms of (?:service|use))"


@dataclass(frozen=True)
class Rules:
    """Bounds, as shares of a line's or a document's words unless named otherwise."""

    min_words: int = 50
    most_repeated: float = 0.5
    most_symbols: float = 0.1
    most_heaped: float = 0.1
    #: A line that ends without a mark needs one in so many words.
    words_a_mark: int = 40
    most_separators: float = 0.1
    #: Longer lines are prose, whatever phrase they hold.
    boilerplate_words: int = 40
    most_lost: float = 0.5


def line_fails(line: Column, n: Column, rules: Rules) -> Column:
    """Whether a line of n words breaks the punctuation, navigation or boilerplate rule; one without words
    breaks none. Shares are compared as whole hundredths. Cheap tests stand before the counts that they
    may save."""
    over = lambda count, share: 100 * count > round(100 * share) * n
    count = lambda pattern: F.regexp_count(line, F.lit(pattern))
    ends = F.substring(F.rtrim(line, F.lit(SPACE)), -4, 4).rlike(END)
    odd = over(count(SYMBOL), rules.most_symbols) | over(count(HEAPED), rules.most_heaped) | ((count(SEPARATOR) >= 2) & over(count(SEPARATOR), rules.most_separators))
    unmarked = ~ends & (count(MARK) * rules.words_a_mark < n)
    phrase = (n < rules.boilerplate_words) & line.rlike(BOILERPLATE)
    return (n > 0) & (unmarked | (line.rlike(ODD) & odd) | phrase)


def ordered_windows(words: str) -> Column:
    """The three-word windows of the column ``words`` in order, each with its place. Fields are named as
    ``arrays_zip`` names them: the words, "1", "2" and, for the place, "3"."""
    n = F.size(words)
    many = F.greatest(n, F.lit(1))
    return F.sort_array(F.slice(F.arrays_zip(words, F.slice(words, 2, many), F.slice(words, 3, many), F.sequence(F.lit(1), many)), 1, F.greatest(n - 2, F.lit(0))))


def repeated_words(windows: str, words: str) -> Column:
    """Words in windows that stand twice or more, the first included: among ordered windows equal ones are
    neighbours, and the places they cover are counted. (What differs most often is compared first.)"""
    m = F.greatest(F.size(windows) - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(windows, 1, m), F.slice(windows, 2, F.greatest(m, F.lit(1))))
    same = F.filter(pairs, lambda x: (x["0"]["1"] == x["1"]["1"]) & (x["0"]["2"] == x["1"]["2"]) & (x["0"][words] == x["1"][words]))
    return F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(*[x[k]["3"] + i for k in "01" for i in range(3)]))))).cast("long")


def quality_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, n_lines (with a word), n_failed_lines, n_lost_words, cleaned_text
    (the text without its failed lines).

    The base rules ask for ``min_words`` and forbid that over ``most_repeated`` of the words repeat. The
    method then rejects documents that lose over ``most_lost`` of their words with their failed lines.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(text, F.lit(SPACE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    counted = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    rows = docs.select("doc_id", words.alias("words"), F.length(F.regexp_replace(text, NO_SYMBOL, "")).cast("long").alias("n_symbols"), counted.alias("lines"))
    judged = F.transform("lines", lambda x: F.struct(x["line"], x["n"], line_fails(x["line"], x["n"], rules).alias("fails")))
    # a frame a step, so that what a later step reads twice is made once
    rows = rows.select(F.col("*"), ordered_windows("words").alias("windows"))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols", repeated_words("windows", "words").alias("n_repeat_words"), judged.alias("lines"))
    rows = rows.select(
        "*", F.transform(F.filter("lines", lambda x: x["n"] > 0), lambda x: x["line"]).alias("full"), F.filter("lines", lambda x: x["fails"]).alias("failed"),
        ((F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > round(100 * rules.most_repeated) * F.col("n_words"))).alias("base_failed"),
    )
    rows = rows.withColumn("n_lost_words", F.aggregate("failed", F.lit(0).cast("long"), lambda total, x: total + x["n"]))
    kept = ~F.col("base_failed") & (100 * F.col("n_lost_words") <= round(100 * rules.most_lost) * F.col("n_words"))
    cleaned = F.array_join(F.transform(F.filter("lines", lambda x: ~x["fails"]), lambda x: x["line"]), "\n")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"), "n_repeat_words", "base_failed",
        kept.alias("kept"), F.size("full").cast("long").alias("n_lines"), F.size("failed").cast("long").alias("n_failed_lines"), "n_lost_words", cleaned.alias("cleaned_text"),
    )
