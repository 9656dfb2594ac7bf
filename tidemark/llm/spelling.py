"""Groups of spelling variants: near words by bidirectional FM-indexes over blocks of the delimited vocabulary, then forms and roots.

A word with one error leaves one of its halves whole. So each word asks twice: once the blocks that hold its left half, once those that
hold its right half. A block's text is its words, each between delimiters; its index has the suffix ranks of that text and of the text
read backwards, and a match is an interval in both, so that it can grow at either end (`extended`). A search scheme has two searches:
match one half exactly, from the middle to the word's end and its delimiter, then grow across the other half, allowing one inserted,
deleted or replaced code point, up to the delimiter there. All words of a block and length step together.

Words go to blocks by a hash of the half: an index word under each prefix (suffix) that is a half of a word of its length, or of one
more or less; a block has about SYMBOLS code points. A half that more than HOT words share is cut: its words into parts, its questions
into parts, one block for each pair of parts. So a task's memory is bounded, and only words that share such a half cost more than in
proportion. Nothing but counts comes to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, ship, stored

LEAST_LENGTH, LEAST_COUNT, FACTOR = 6, 5, 5
SYMBOLS, HOT = 1 << 17, 1 << 14
#: Symbols of a block's text: END once, at its end; DELIMITER around words; letters from FIRST on.
END, DELIMITER, FIRST = 0, 1, 2
#: Words of a block that step together.
TOGETHER = 1 << 13


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of a text in the order of their suffixes, by prefix doubling; its last symbol is the least and occurs once."""
    rank, size = text.astype(np.int64), 1
    while True:
        key = rank * (int(rank.max()) + 2)
        key[:-size] += rank[size:] + 1
        order = np.argsort(key, kind="stable")
        found = key[order]
        rank = np.empty(len(text), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], found[1:] != found[:-1]]))
        if rank[order[-1]] == len(text) - 1:
            return order
        size *= 2


class _Ranks:
    """less[i, c]: symbols below c among those before the first i suffixes."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        self.order = suffix_order(text)
        before = text[self.order - 1]
        self.less = np.zeros((len(text) + 1, symbols + 1), np.int32)
        np.cumsum(before[:, None] < np.arange(symbols + 1), axis=0, dtype=np.int32, out=self.less[1:])


#: A match: which word asks, where its interval begins among the suffixes of the text and of the text read backwards, how long it is.
Matches = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class VocabularyIndex:
    """A bidirectional FM-index over distinct words."""

    def __init__(self, words: list[str]) -> None:
        codes = np.frombuffer("\0".join(["", *words, ""]).encode("utf-32-le"), np.uint32)
        self.letters = np.unique(codes[codes > 0])
        text = np.where(codes > 0, np.searchsorted(self.letters, codes) + FIRST, DELIMITER)
        self.starts = np.flatnonzero(codes == 0)
        symbols = len(self.letters) + FIRST
        self.sides = tuple(_Ranks(np.append(t, END), symbols) for t in (text, text[::-1]))
        self.size = len(text) + 1

    def symbols_of(self, words: list[str]) -> np.ndarray:
        """Words of one length as rows of symbols; a letter that no word of the index has is -1."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
        if not len(self.letters):
            return np.full(codes.shape, -1)
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[at] == codes, at + FIRST, -1)

    def extended(self, m: Matches, c: np.ndarray, side: int) -> Matches:
        """The matches with one more symbol each, at the left (side 0) or right end (1); those that do not occur go."""
        less, (who, *at, size) = self.sides[side].less, m
        c, known = np.maximum(c, 0), c >= 0
        lo, hi = at[side], at[side] + size
        below = less[lo, c]
        before, gone = less[lo, c + 1] - below, less[hi, c] - below
        grown = less[hi, c + 1] - less[hi, c] - before
        new = [0, 0]
        new[side], new[1 - side] = less[-1, c] + before, at[1 - side] + gone
        keep = np.flatnonzero(known & (grown > 0))
        return who[keep], new[0][keep], new[1][keep], grown[keep]

    def branched(self, m: Matches, side: int) -> tuple[Matches, np.ndarray]:
        """The matches with each letter that can follow at that end, and these letters."""
        less, (who, *at, size) = self.sides[side].less, m
        lo, hi = less[at[side]], less[at[side] + size]
        counts = np.diff(hi, axis=1) - np.diff(lo, axis=1)
        counts[:, :FIRST] = 0
        i, c = np.nonzero(counts)
        new = [0, 0]
        new[side], new[1 - side] = less[-1, c] + lo[i, c + 1] - lo[i, c], at[1 - side][i] + hi[i, c] - lo[i, c]
        return (who[i], new[0], new[1], counts[i, c]), c

    def near(self, words: list[str], left_whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """For words of one length: pairs (place in words, word of the index) that differ by one edit in the right half, or in the left one."""
        rows = self.symbols_of(words)
        n, half = len(words[0]), len(words[0]) // 2
        whole, torn = (range(half - 1, -1, -1), range(half, n)) if left_whole else (range(half, n), range(half - 1, -1, -1))
        inner, outer = (0, 1) if left_whole else (1, 0)
        some, end = np.arange(len(words)), lambda m: np.full(len(m[0]), DELIMITER)
        exact: Matches = (some, np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.full(len(words), self.size))
        for k in whole:
            exact = self.extended(exact, rows[exact[0], k], inner)
        exact = self.extended(exact, end(exact), inner)
        erred: list[Matches] = []

        def together() -> Matches:
            return tuple(np.concatenate(x) for x in zip(*erred, strict=True))  # type: ignore[return-value]

        for k in torn:
            more, letter = self.branched(exact, outer)
            erred.append(more)  # a letter inserted before k
            pool = together()
            other = letter != rows[more[0], k]
            erred = [self.extended(pool, rows[pool[0], k], outer), tuple(x[other] for x in more), exact]  # k replaced, k deleted
            exact = self.extended(exact, rows[exact[0], k], outer)
        erred.append(self.branched(exact, outer)[0])
        pool = together()
        who, at, _, _ = self.extended(pool, end(pool), outer)
        found = np.searchsorted(self.starts, self.sides[0].order[at])
        pairs = np.unique(who * np.int64(len(self.starts)) + found)
        return pairs // len(self.starts), pairs % len(self.starts)


def _search(table: pa.Table) -> pa.Table:
    """Pairs of near words of one block: role 0 are its words, 1 and 2 ask with their left, right half."""
    held: dict[str, int] = {}
    asked: dict[tuple[int, int], list[str]] = {}
    for role, word, n in zip(table["role"].to_pylist(), table["word"].to_pylist(), table["n"].to_pylist(), strict=True):
        if role:
            asked.setdefault((role, len(word)), []).append(word)
        else:
            held[word] = n
    words, counts = list(held), list(held.values())
    out: tuple[list[str], list[str], list[int]] = ([], [], [])
    if words and asked:
        index = VocabularyIndex(words)
        for (role, _), own in sorted(asked.items()):
            for a in range(0, len(own), TOGETHER):
                who, found = index.near(own[a : a + TOGETHER], role == 1)
                out[0].extend(own[a + i] for i in who.tolist())
                out[1].extend(words[i] for i in found.tolist())
                out[2].extend(counts[i] for i in found.tolist())
    return pa.table({"word": pa.array(out[0], pa.string()), "near": pa.array(out[1], pa.string()), "near_n": pa.array(out[2], pa.int64())})


def _halves(words: DataFrame) -> DataFrame:
    """(role, part, key, word, n): what each word gives to blocks and what it asks of them. part: 1 a left half, 2 a right one."""
    length = F.char_length("word")

    def cut(part: int, size: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), (F.substring("word", F.lit(1), size) if part == 1 else F.substring("word", length - size + 1, size)).alias("key"))

    def half(part: int, n: Column) -> Column:
        left = F.floor(n / 2).cast("int")
        return left if part == 1 else n - left

    given = F.filter(F.array_distinct(F.array(*[cut(p, half(p, length + d)) for p in (1, 2) for d in (-1, 0, 1)])), lambda c: c["key"] != "")
    index = words.select(F.lit(0).alias("role"), F.explode(given).alias("c"), "word", "n").select("role", "c.part", "c.key", "word", "n")
    asks = words.select(F.explode(F.array(cut(1, half(1, length)), cut(2, half(2, length)))).alias("c"), "word", "n").select(F.col("c.part").alias("role"), "c.part", "c.key", "word", "n")
    return index.unionByName(asks)


def near_pairs(words: DataFrame, symbols: int = SYMBOLS, hot: int = HOT) -> DataFrame:
    """(word, near, near_n): the words of words (word, n; distinct, two code points or more) that differ by exactly one inserted, deleted or
    replaced code point, in both directions. No words give none."""
    rows = _halves(words)
    total = words.agg(F.sum(F.char_length("word") + 1)).head()[0] or 0
    blocks = max(1, -(-4 * total // symbols))
    crowded = rows.groupBy("part", "key").agg(F.count("*").alias("held")).filter(F.col("held") > hot).select("part", "key", F.ceil(F.col("held") / hot).cast("int").alias("cuts"))
    crowded = stored(crowded, "crowded")
    if crowded.isEmpty():
        placed = rows.withColumns({"own": F.lit(0), "other": F.lit(0)})
    else:
        rows = rows.join(crowded, ["part", "key"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
        placed = rows.withColumn("own", F.pmod(F.xxhash64("word", F.lit(5)), "cuts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    index_part, asking_part = F.when(F.col("role") == 0, F.col("own")).otherwise(F.col("other")), F.when(F.col("role") == 0, F.col("other")).otherwise(F.col("own"))
    bucket = F.pmod(F.xxhash64("part", "key", index_part, asking_part), F.lit(blocks))
    bucket = F.when((index_part == 0) & (asking_part == 0), bucket).otherwise(F.xxhash64("part", "key", index_part, asking_part).bitwiseOR(F.lit(-(1 << 63))))
    found = placed.select(bucket.alias("bucket"), "role", "word", "n").groupBy("bucket").applyInArrow(_search, "word string, near string, near_n bigint")
    return found.distinct()


def counted_words(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of words (word; null ones count for nothing) that have enough code points and occurrences."""
    return words.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def spelling_groups(vocabulary: DataFrame, factor: int = FACTOR) -> DataFrame:
    """One row a word of vocabulary (word, n; distinct words of two code points or more): word, n, n_near, form, form_n, root.

    n_near: words that differ by exactly one inserted, deleted or replaced code point. form: the one of them with the largest n (ties:
    the smallest in code-point order), if that is at least factor (2 or more) times the word's n, else null. root: the last word that
    forms lead to, the word itself without one. Counts grow with each form, so there are no rings and the way is as long as the
    logarithm of the largest count at most; it is followed by doubling. No words give no rows; other columns are not read.
    """
    if factor < 2:
        raise ValueError("factor must be 2 at least")
    spark = vocabulary.sparkSession
    words = stored(vocabulary.select("word", F.col("n").cast("bigint").alias("n")), "vocabulary")
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    joined = words.join(best, "word", "left")
    follows = F.coalesce(-F.col("best.less") >= factor * F.col("n"), F.lit(False))
    formed = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(follows, F.col("best.near")).alias("form"), F.when(follows, -F.col("best.less")).alias("form_n"))
    formed = stored(formed, "forms")
    steps = stored(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    top = words.agg(F.max("n")).head()[0] or 1
    for _ in range(max(0, math.ceil(math.log2(max(1.0, math.log(top, factor) + 1))))):
        then = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(steps.join(then, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        discard(spark, [steps])
        steps = longer
    discard(spark, [words])
    return formed.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ship(__name__)
