"""Line-first cleaning: rules judge each line, and a document that loses too much of its text goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm._shared import WHITE_SPACE

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 30
SHORT_LINE_WORDS = 8

# What may end a sentence, possibly before closing quotes or brackets.
SENTENCE_END = r"""[.!?:;,…。！？][\]"'\)»“”’]*[\x20\x09-\x0D]*$"""
# Signs that stand between the entries of a menu or a path of links.
MENU_SIGNS = "|»›•·>"
# Phrases of notices that surround a text.
BOILERPLATE = (
    r"(?i)\b(cookies?|javascript|privacy policy|terms of (use|service)|all rights reserved|copyright \d|lorem ipsum"
    r"|sign (in|up)|log ?in|subscribe|newsletter|click here|read more|share (on|this)|follow us|add to cart"
    r"|datenschutz|impressum|alle rechte vorbehalten|mentions légales|tous droits réservés"
    r"|aviso legal|todos los derechos reservados)\b"
)
# The signs of markup and noise.
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE_SPACE), "")


def sorted_windows(tokens: Column) -> Column:
    """The 3-word windows of the column `tokens`, sorted, with their positions; null if fewer than two.

    Windows, as 64-bit hashes that stand for them inside one text, are sorted with their positions,
    so equal ones are neighbours: no window is compared with all others, however long the text.
    """
    n = F.size(tokens) - 2
    windows = F.transform(
        F.arrays_zip(F.slice(tokens, 1, n).alias("a"), F.slice(tokens, 2, n).alias("b"), F.slice(tokens, 3, n).alias("c")),
        lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("k"), i.alias("p")),
    )
    return F.when(n > 1, F.array_sort(windows))


def _neighbours(windows: Column) -> Column:
    """Sorted distinct positions of the windows that equal a neighbour."""
    pairs = F.zip_with(
        windows, F.slice(windows, 2, F.size(windows)), lambda a, b: F.when(a["k"] == b["k"], F.array(a["p"], b["p"]))
    )
    return F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))


def _covered(positions: Column) -> Column:
    """Words covered by 3-word windows at these positions."""
    steps = F.zip_with(
        positions, F.slice(positions, 2, F.greatest(F.size(positions), F.lit(0))), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3))
    )
    return F.aggregate(steps, F.lit(0), lambda x, y: x + y)


def counted_line(line: Column) -> Column:
    """A line with its number of words, which several rules need."""
    return F.struct(line.alias("line"), F.size(words(line)).alias("n"))


def good_line(x: Column) -> Column:
    """True if a line of `counted_line` passes the punctuation, navigation and boilerplate rules."""
    line, n = x["line"], x["n"]
    ends = line.rlike(SENTENCE_END)
    menu = F.length(line) - F.length(F.translate(line, MENU_SIGNS, ""))
    is_menu = (menu > 0) & ((menu >= 2) & ~ends | (menu * 3 > n))
    notice = (n < 40) & line.rlike(BOILERPLATE)
    shouted = (n >= 4) & (F.length(F.regexp_replace(line, r"\P{Lu}+", "")) * 2 > F.length(F.regexp_replace(line, r"\P{L}+", "")))
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    noise = (symbols > n) | F.contains(line, F.lit("{")) | F.contains(line, F.lit("}"))
    return ((n >= SHORT_LINE_WORDS) | ends) & ~noise & ~is_menu & ~shouted & ~notice


def quality(docs: DataFrame) -> DataFrame:
    """One row per row of `docs(doc_id, text, ...)`: the base counts, `base_failed`, `kept` and `cleaned`.

    `n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words` count over the whole text. A text
    fails the base with fewer than MIN_WORDS words or with more than MAX_REPEAT_PERCENT of its words
    in repeated 3-word windows. Otherwise `good_line` judges each line and an equal earlier line
    makes a line fail too; the failed lines are removed from `cleaned`, and the document is
    kept if they hold at most MAX_LOST_PERCENT of the characters of its lines. A null text counts as empty.
    Each row is judged for itself, so there is no shuffle and no key; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("_t"))
    split = base.select("doc_id", "_t", words(F.col("_t")).alias("_w"), F.split("_t", "\n", -1).alias("_all"))
    lined = split.withColumn("_lines", F.filter("_all", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    windowed = lined.withColumn("_sorted", sorted_windows(F.col("_w"))).withColumn("_good", F.filter(F.transform(F.array_distinct("_lines"), counted_line), good_line)["line"])
    placed = windowed.withColumn("_places", _neighbours(F.col("_sorted")))
    counted = placed.select(
        "doc_id",
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("_t", WHITE_SPACE, "")).cast("bigint").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("_places")), F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.length(F.array_join("_lines", "")).alias("_chars"),
        F.array_join("_good", "\n").alias("cleaned"),
        F.length(F.array_join("_good", "")).alias("_left"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    judged = counted.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & ((F.col("_chars") - F.col("_left")) * 100 <= F.col("_chars") * MAX_LOST_PERCENT)
    )
    return judged.drop("_chars", "_left")
