"""Line-first cleaning: rules per line, then a verdict per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ondula.llm.common import SPACES

# Fixed values of the line rules.
BOILERPLATE = [
    "accept cookies",
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "is licensed under",
    "log in to",
    "privacy policy",
    "sign up for",
    "subscribe to our",
    "terms of service",
    "terms of use",
]
MIN_WORDS = 50
REPEAT_PERCENT = 50
MARK_PERCENT = 15  # marks among the visible characters of a line
BARS = 3  # separators of a navigation line
LOST_PERCENT = 50


def line_fails(line: Column) -> Column:
    """Whether a line with a word breaks a rule: punctuation (no mark
    that closes a sentence, at the end or before, or mostly other marks), navigation (items between separators), or
    boilerplate (a stock phrase)."""
    ink = F.length(F.regexp_replace(line, r"\s+", ""))
    marks = F.size(F.regexp_extract_all(line, F.lit(r"[!#*$%&|<>=~^]"), F.lit(0)))
    unclosed = ~line.rlike(r"[.!?…:][\"'”’»)\]]*(\s|$)")
    bars = F.size(F.regexp_extract_all(line, F.lit(r"\s[|›»•·/]\s"), F.lit(0)))
    stock = line.rlike("(?i)" + "|".join(BOILERPLATE))
    return unclosed | (marks * 100 > ink * MARK_PERCENT) | (bars >= BARS) | stock



def clean_lines(docs: DataFrame) -> DataFrame:
    """Statistics, cleaned text and verdict of every row of ``docs``.

    Lines are cut at newlines; words are [^\\x20\\x09-\\x0D]+. Lines without a
    word are neither judged nor counted; lines that fail are removed, the
    others stay in order as ``cleaned``. ``base_failed``: under 50 words, or
    more than half of the words in 3-word windows that occur twice or more (a
    64-bit hash stands for a window within its text). ``kept``: not
    base_failed, and the removed lines hold at most half of the visible
    characters. A null or empty text has no words and isn't kept. Repeated
    rows each get a row; other columns of ``docs`` are left out.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, lost_chars, cleaned.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("_text"),
        F.trim(text, F.lit(SPACES)).alias("_trimmed"),
    )
    words = cut.select(
        "doc_id",
        "_text",
        F.when(F.col("_trimmed") == "", F.array().cast("array<string>"))
        .otherwise(F.split("_trimmed", r"[ \t-\r]+"))
        .alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("_lines"),
    )
    # windows sorted by hash, so equal ones are neighbours
    windows = words.select(
        "*",
        F.sort_array(
            F.when(F.size("_words") < 3, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
                F.expr(
                    "transform(sequence(0, size(_words) - 3), i -> named_struct("
                    "'h', xxhash64(_words[i], _words[i + 1], _words[i + 2]), 'i', i))"
                )
            )
        ).alias("_sorted"),
        F.filter("_lines", line_fails).alias("_failed"),
        F.filter("_lines", lambda x: ~line_fails(x)).alias("_passed"),
    )
    found = windows.select(
        "*",
        F.sort_array(
            F.expr(
                "transform(filter(_sorted, (e, j) -> e.h <=> get(_sorted, j - 1).h"
                " OR e.h <=> get(_sorted, j + 1).h), e -> e.i)"
            )
        ).alias("_again"),
    )
    counted = found.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size(F.regexp_extract_all("_text", F.lit("[#*$%&|<>]"), F.lit(0)))
        .cast("long")
        .alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        # a window that starts at p covers words up to the next one, three at most
        F.expr(
            "aggregate(transform(_again, (p, j) -> least(3, coalesce(get(_again, j + 1) - p, 3))),"
            " 0L, (a, x) -> a + x)"
        ).alias("n_repeat_words"),
        F.length(F.regexp_replace(F.array_join("_failed", ""), r"\s+", ""))
        .cast("long")
        .alias("lost_chars"),
        F.array_join("_passed", "\n").alias("cleaned"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    )
    little = 100 * F.col("lost_chars") <= LOST_PERCENT * F.col("word_chars")
    return counted.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & little).alias("kept"),
        "lost_chars",
        "cleaned",
    )
