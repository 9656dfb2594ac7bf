"""Line-first quality rules: drop failing lines, then reject documents that lose too much. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_CHARS, ascii_lower, kept_columns, private, quoted, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|›>•·"
#: Lines without any of these need not be counted.
ANY_COUNTED = "[!?#*$%&|<>›•·]"
#: What may end a sentence or the quotation that ends with it.
ENDS = r"""[.!?…:;"'”’»)\]。！？][\x20\x09-\x0D]*\z"""
#: Words of site furniture, in short lines.
BOILERPLATE = r"\b(javascript|cookies?|privacy policy|terms of (use|service)|all rights reserved|click here|read more|sign (in|up)|log ?in|subscribe|newsletter|skip to (main )?content|share (this|on)|lorem ipsum|page not found)\b"
#: A line of fewer words has to end like a sentence; boilerplate is looked for in lines of at most so many.
SHORT, FURNITURE = 10, 20
#: A document that loses more than this percentage of its words is rejected.
MOST_LOST = 30


def count_of(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def line_fails(line: Column, n: Column) -> Column:
    """Whether a line of n words fails: a short one that does not end like a sentence; shouting; symbols; menus; site furniture."""
    symbols, bangs, separators = count_of(line, SYMBOLS), count_of(line, "!?"), count_of(line, SEPARATORS)
    counted = ((n >= 3) & (bangs > n)) | ((n >= 3) & (symbols * 2 > n)) | ((separators >= 2) & (separators * 3 > n))
    return ((n < SHORT) & ~line.rlike(ENDS)) | (line.rlike(ANY_COUNTED) & counted) | ((n <= FURNITURE) & ascii_lower(line).rlike(BOILERPLATE))


def repeat_words(words: str, hashes: str, windows: str, placed: str) -> list[tuple[str, Column]]:
    """Columns of these names, each on those before, and n_repeat_words: the words inside windows of 8 words that occur twice or more in the text.

    Each array is named more than once by what uses it, so that the optimizer keeps it as a column of its own; put in place of a
    name inside a lambda, it would be computed again for every element.
    """
    each = F.when(F.size(hashes) > WINDOW, F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    sorted_ = F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    twins = F.filter(F.transform(placed, lambda x, k: F.when((x["h"] == F.get(placed, k - 1)["h"]) | (x["h"] == F.get(placed, k + 1)["h"]), x["i"])), lambda i: i.isNotNull())
    covered = F.aggregate(F.sort_array(twins), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n")), lambda a: a["n"])
    return [(hashes, F.transform(words, lambda w: F.xxhash64(w))), (windows, each), (placed, sorted_), ("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint"))]


RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cleaned", "n_words_lost", "kept"]


def quality(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, cleaned (the text without failing lines), n_words_lost, kept.

    Null text counts as empty: no words, base_failed, not kept, cleaned empty. Blank lines never fail and count for nothing. Whole
    texts at any length; a column named like a result, in any case, is replaced. Each row stands alone: ties, copies and order do not
    matter, and nothing is shuffled; no rows give none.
    """
    text = F.coalesce("text", F.lit(""))
    keep = kept_columns(docs, RESULTS)
    docs = docs.select(*map(quoted, keep))
    words, lines, hashes, windows, placed, worded, judged = private(docs, "words", "lines", "hashes", "windows", "placed", "worded", "judged")
    out = docs.withColumns({words: words_of(F.col("text")), lines: F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), F.size(words_of(x)).alias("n")))})
    for name, column in repeat_words(words, hashes, windows, placed):
        out = out.withColumn(name, column)
    out = out.withColumns(
        {
            "n_words": F.size(words).cast("bigint"),
            "word_chars": F.char_length(F.translate(text, SPACE_CHARS, "")).cast("bigint"),
            "n_symbols": count_of(text, SYMBOLS).cast("bigint"),
            worded: F.transform(F.filter(lines, lambda x: x["n"] > 0), lambda x: x["line"]),
            judged: F.transform(lines, lambda x: F.struct(x["line"].alias("line"), x["n"].alias("n"), ((x["n"] > 0) & line_fails(x["line"], x["n"])).alias("fails"))),
        }
    )
    out = out.withColumns(
        {
            "n_dup_lines": (F.size(worded) - F.size(F.array_distinct(worded))).cast("bigint"),
            "base_failed": (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30),
            "cleaned": F.array_join(F.transform(F.filter(judged, lambda x: ~x["fails"]), lambda x: x["line"]), "\n"),
            "n_words_lost": F.aggregate(judged, F.lit(0).cast("bigint"), lambda a, x: a + F.when(x["fails"], x["n"]).otherwise(0)),
        }
    )
    kept = ~F.col("base_failed") & (F.col("n_words_lost") * 100 <= F.col("n_words") * MOST_LOST)
    return out.withColumn("kept", kept).select(*map(quoted, keep), *RESULTS)
