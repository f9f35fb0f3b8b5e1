"""Line-first cleaning, in DataFrame functions alone.

Each line that holds a word is judged by itself: no terminal punctuation, navigation (separators between short items, or
the words of menus), boilerplate (legal and technical phrases), symbols out of proportion. Lines that fail are
removed; a document is then rejected if what is left is less than LEAST_LEFT of its characters in words, if words are mostly
symbols, or if one word makes up too much of it. The base measures come first: too few words or too much repetition.

Words are runs other than space and \\x09-\\x0D. Repeated words are found by sorting a text's window hashes with their
places, inside the row: no shuffle, and n log n for very long texts.

Defined results: a null or empty text has no words and fails the base rule; repeated rows are judged each; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafmill.llm.common import texts

LEAST_WORDS, MOST_REPEATED = 50, 50
#: Share of word characters that must survive line cleaning.
LEAST_LEFT = 0.5
#: Words to one symbol character, at least.
SYMBOL_SHARE = 0.1
#: Share of a document's words that are the one before them.
MOST_STUTTER = 0.3

SPACE = "[\\\\x20\\\\x09-\\\\x0D]"
NAVIGATION = r"(?i)^\W*(home|menu|login|log in|sign in|sign up|register|search|next|previous|back to top|skip to content|contact us|about us|share|tweet|subscribe|read more|more|archive|tags?|categories)(\W+(home|menu|login|log in|sign in|sign up|register|search|next|previous|contact|about|us|faq|share|tweet|help|news|blog|shop|more|sitemap))*\W*$"
BOILERPLATE = r"(?i)(all rights reserved|copyright \W|©|terms of (use|service)|privacy policy|cookie policy|uses? cookies|enable javascript|javascript is (disabled|required)|click here|lorem ipsum|powered by|page not found|unsubscribe)"
#: Items set apart by bars.
SEPARATED = r"(\|[^|]*){3}"
TERMINAL = r"[.!?…:;][\"'”’»)\]]*[\x20\x09-\x0D]*$"


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def line_kept(line: Column) -> Column:
    """Whether a line passes all rules."""
    symbols = F.length(F.regexp_replace(line, r"[^#*$%&|<>{}=~^\\]+", ""))
    return line.rlike(TERMINAL) & ~line.rlike(NAVIGATION) & ~line.rlike(SEPARATED) & ~line.rlike(BOILERPLATE) & (symbols * 10 <= F.length(line))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_lines_kept."""
    docs = texts(docs)
    step = docs.select(
        "doc_id",
        "text",
        F.expr(f"filter(split(text, '{SPACE}+'), w -> w <> '')").alias("words"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines_of(F.col("text")).alias("lines"),
    )
    step = step.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.filter("lines", line_kept).alias("good"),
        F.expr("size(filter(words, (w, i) -> w = get(words, i + 1)))").alias("n_stutter"),
        F.expr("array_sort(slice(transform(words, (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2))), 1, greatest(size(words) - 2, 0)))").alias("sorted_windows"),
        "words",
    )
    # most texts with no window found twice are done here; the others sort windows with their places
    twice = "size(array_distinct(sorted_windows)) < size(sorted_windows)"
    placed = "sort_array(slice(transform(words, (w, i) -> named_struct('h', xxhash64(w, get(words, i + 1), get(words, i + 2)), 'i', i)), 1, greatest(size(words) - 2, 0)))"
    step = step.withColumn("placed", F.expr(f"case when {twice} then {placed} end")).drop("words", "sorted_windows")
    step = step.withColumn("at", F.expr("sort_array(transform(filter(placed, (x, k) -> x.h = get(placed, k + 1).h or x.h = get(placed, k - 1).h), x -> x.i))")).drop("placed")
    covered = "aggregate(at, named_struct('last', -3, 'n', 0L), (a, x) -> named_struct('last', x, 'n', a.n + least(3, x - a.last)), a -> a.n)"
    step = step.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0)).cast("long")).drop("at")
    left = F.length(F.regexp_replace(F.array_join("good", " "), "[\\x20\\x09-\\x0D]+", "")).cast("long")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    verdict = (left >= LEAST_LEFT * F.col("word_chars")) & (F.col("n_symbols") <= SYMBOL_SHARE * F.col("word_chars")) & (F.col("n_stutter") <= MOST_STUTTER * F.col("n_words"))
    return step.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict).alias("kept"), "n_lines", F.size("good").cast("long").alias("n_lines_kept")
    )


def clean(docs: DataFrame) -> DataFrame:
    """doc_id and the text without the lines that fail, of documents that are kept."""
    kept = judge(docs).where("kept").select("doc_id")
    cleaned = texts(docs).withColumn("text", F.array_join(F.filter(lines_of(F.col("text")), line_kept), "\n"))
    return cleaned.join(kept, "doc_id", "left_semi")
