"""Operator 8, quality rules: line-first cleaning. Lines that fail a rule go; a document that loses too much text is rejected.

Column expressions only, one projection over the documents: no shuffle, no Python.

Rules for a line that holds a word (lines without one carry no text and always stay):
- punctuation: it is short (fewer than ``SHORT_LINE`` words) and does not end a sentence, or symbols make up over a quarter of
  its characters;
- navigation: it holds at least ``MENU_MARKS`` menu separators;
- boilerplate: it is short enough to be a notice (at most ``NOTICE_CHARS`` characters) and holds one of ``BOILERPLATE``.
A document is rejected by the method when fewer than half of its word characters remain.

Edge cases: a null or empty text has no words, fails the base rule (fewer than 10 words) and is cleaned to an empty text; rows
with null ids and repeated rows are judged like any other, and equal texts alike; a text of any length is judged whole, as one row of Spark's
own arrays; other columns are untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscribe.llm.common import BLANKS, let

#: Fixed values of the base rules.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT, SYMBOLS = 10, 5, 20, "#*$%&|<>"
#: Rules for lines: documented parameters.
SHORT_LINE, MENU_MARKS, NOTICE_CHARS, MIN_KEPT_PERCENT = 4, 4, 200, 50
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "javascript is disabled",
    "enable javascript", "lorem ipsum", "click here", "sign up for our newsletter", "subscribe to our newsletter", "skip to content",
)
SENTENCE_END = r"""[.!?…:;。！？]["'”’»)\]]*\z"""
MENU_PATTERN = r"(?:[|»›•·][^|»›•·]*){%d}" % MENU_MARKS
AT_LEAST_SHORT_LINE = r"^(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){%d}[^\x20\x09-\x0D]" % (SHORT_LINE - 1)


def line_list(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_fails(line: Column) -> Column:
    """Whether a line fails a rule. Blanks at both ends do not count."""

    def fails(bare: Column) -> Column:
        # Patterns that stop at the fourth word or menu mark, so a long line is not read to its end.
        unfinished = ~bare.rlike(AT_LEAST_SHORT_LINE) & ~bare.rlike(SENTENCE_END)
        symbols = F.length(bare) - F.length(F.regexp_replace(bare, r"[#*$%&|<>]+", ""))
        notice = (F.length(bare) <= NOTICE_CHARS) & F.lower(bare).rlike("|".join(BOILERPLATE))
        return (bare != "") & (unfinished | bare.rlike(MENU_PATTERN) | (4 * symbols > F.length(bare)) | notice)

    return let(F.btrim(line, F.lit(BLANKS)), fails)


def words_of(text: Column) -> Column:
    """The words of a text: what stands between blanks."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+", -1))


def word_chars(text: Column) -> Column:
    return F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))


def repeated_words(words: Column) -> Column:
    """Words in windows of five that the text holds twice or more. Windows are compared by a 64-bit hash within one text."""
    n = F.size(words)

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(w[i + j] for j in range(WINDOW))))

    def union(starts: Column) -> Column:
        # Windows in order: each adds its five words, less what the next one covers as well.
        def add(i: Column) -> Column:
            return F.when(i == F.size(starts) - 1, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), F.get(starts, i + 1) - F.get(starts, i)))

        return F.aggregate(F.transform(F.sequence(F.lit(0), F.size(starts) - 1), add), F.lit(0), lambda a, b: a + b)

    def covered(h: Column) -> Column:
        at = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            return F.filter(
                F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull()
            )

        return let(at, lambda s: let(F.sort_array(twice(s)), union))

    def count(h: Column) -> Column:
        # Most texts repeat no window; a hash set tells so without sorting.
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))

    return F.when(n < WINDOW + 1, F.lit(0)).otherwise(let(hashes(words), count)).cast("long")


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``judged``: the base measures, the verdicts and the cleaned text."""
    body = F.coalesce(F.col(text), F.lit(""))

    def verdict(lines: Column, kept_lines: Column, n: Column, repeats: Column, chars: Column) -> Column:
        same = F.size(kept_lines) == F.size(lines)
        left = F.when(same, chars).otherwise(word_chars(F.array_join(kept_lines, "\n")))
        failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
        with_words = F.filter(lines, lambda x: F.btrim(x, F.lit(BLANKS)) != "")
        return F.struct(
            n.alias("n_words"),
            chars.cast("long").alias("word_chars"),
            F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(with_words, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeats.alias("n_repeat_words"),
            failed.alias("base_failed"),
            let(left, lambda x: ~failed & (100 * x >= MIN_KEPT_PERCENT * chars)).alias("kept"),
            (F.size(lines) - F.size(kept_lines)).cast("long").alias("n_lines_removed"),
            F.when(same, body).otherwise(F.array_join(kept_lines, "\n")).alias("clean_text"),
        )

    def measures(lines: Column) -> Column:
        words = words_of(body)
        kept = F.filter(lines, lambda x: ~line_fails(x))
        counts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeats"), word_chars(body).alias("chars")))
        return let(kept, lambda k: let(counts, lambda c: verdict(lines, k, c["n"], c["repeats"], c["chars"])))

    judged = F.transform(F.array(line_list(F.col(text))), measures)
    # Exploding the one element keeps a filter on the verdict from computing all of it a second time.
    return docs.select("*", F.explode(judged).alias("judged"))


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their failed lines taken out and ``n_chars`` counted anew; columns as given."""
    judged = judge(docs).where(F.col("judged.kept"))
    changed = {"text": F.col("judged.clean_text"), "n_chars": F.length("judged.clean_text").cast("long")}
    return judged.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns))
